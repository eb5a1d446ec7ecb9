"""Banking days: a calendar table and joins that count on it.

``ord`` numbers banking days: the count of banking days up to and including a
date. Distances and shifts are then differences of ordinals, without loops.
The table has a row per day, so it is small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def banking_calendar(spark: SparkSession, first: str, last: str, declared: Iterable[str]) -> DataFrame:
    """(d, holiday, ord): Sundays, second and fourth Saturdays and the declared dates are holidays."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS d")
    week = F.floor((F.dayofmonth("d") + 6) / 7)
    off = (F.dayofweek("d") == 1) | ((F.dayofweek("d") == 7) & week.isin(2, 4)) | F.col("d").isin([F.lit(x).cast("date") for x in declared])
    return days.withColumn("holiday", off).withColumn("ord", F.sum(F.when(off, 0).otherwise(1)).over(Window.orderBy("d")))


def add_banking_days(df: DataFrame, cal: DataFrame, date: str, n: int, out: str) -> DataFrame:
    """``out``: n banking days after ``date``, which first rolls forward off a holiday."""
    here = cal.select(F.col("d").alias(date), (F.col("ord") + n + F.col("holiday").cast("int")).alias("__ord"))
    there = cal.where(~F.col("holiday")).select(F.col("ord").alias("__ord"), F.col("d").alias(out))
    return df.join(F.broadcast(here.join(there, "__ord").drop("__ord")), date, "left")


def with_ordinal(df: DataFrame, cal: DataFrame, date: str, out: str) -> DataFrame:
    return df.join(F.broadcast(cal.select(F.col("d").alias(date), F.col("ord").alias(out))), date, "left")


def banking_distance(df: DataFrame, cal: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Signed banking days from ``a`` to ``b``."""
    both = with_ordinal(with_ordinal(df, cal, a, "__a"), cal, b, "__b")
    return both.withColumn(out, F.col("__b") - F.col("__a")).drop("__a", "__b")


def second_of_day(at: Column) -> Column:
    return (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).cast("long")
