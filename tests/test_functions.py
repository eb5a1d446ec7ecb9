import datetime as dt

import pytest
from pyspark.sql import functions as F

from reconweave.functions import calendar, money, narration
from reconweave.sources.derive import DECLARED_HOLIDAYS, FIRST_DAY, LAST_DAY


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t}" for n, t in ((n, "string" if isinstance(v, str) else "bigint") for n, v in values.items())))
    return row.select(column).first()[0]


@pytest.mark.parametrize(("text", "paise"), [("10000.00", 1_000_000), ("12.3", 1230), ("-0.05", -5), ("", 0), ("1.234", None), ("1e3", None), ("x", None)])
def test_parse(spark, text, paise):
    assert one(spark, money.parse(F.col("a")), a=text) == paise


@pytest.mark.parametrize(("paise", "plain", "grouped"), [(123456789, "1234567.89", "12,34,567.89"), (-5, "-0.05", "-0.05"), (100000, "1000.00", "1,000.00"), (99999, "999.99", "999.99")])
def test_format(spark, paise, plain, grouped):
    assert one(spark, money.fmt(F.col("a")), a=paise) == plain
    assert one(spark, money.fmt_inr(F.col("a")), a=paise) == grouped


def test_share_rounds_half_up(spark):
    assert one(spark, money.pct_of(F.col("a"), 200), a=125) == 3


def test_banking_days(spark):
    cal = calendar.banking_calendar(spark, FIRST_DAY, LAST_DAY, DECLARED_HOLIDAYS)
    days = spark.createDataFrame([(dt.date(2025, 11, 13),), (dt.date(2025, 11, 12),)], "d date")
    got = {r.d: r.due for r in calendar.add_banking_days(days, cal, "d", 2, "due").collect()}
    assert got == {dt.date(2025, 11, 13): dt.date(2025, 11, 17), dt.date(2025, 11, 12): dt.date(2025, 11, 15)}
    pair = spark.createDataFrame([(dt.date(2025, 11, 21), dt.date(2025, 11, 24))], "a date, b date")
    assert calendar.banking_distance(pair, cal, "a", "b", "n").first().n == 1


def test_candidates_by_priority(spark):
    text = "neft ABCDN 84670771808097 ref 123456789012 and 7059037715S4"
    found = one(spark, narration.utr_candidates(narration.canonical(F.col("a"))), a=text)
    assert found == ["ABCDN84670771808097", "123456789012", "84670771808097", "7059037715S4"]


def test_entity_tokens(spark):
    assert one(spark, narration.entity_tokens(F.col("a")), a="x RFND_0a1 y disp_2") == ["rfnd_0a1", "disp_2"]


def test_jaro_winkler():
    assert narration.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert narration.jaro_winkler("", "") == 1 and narration.jaro_winkler("A", "") == 0
    assert narration.jaro_winkler("ABCDXXXX", "ABCDYYYYZZ") > 0.7
