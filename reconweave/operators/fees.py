"""Fees of payments and batches under effective-dated rate tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconweave.functions.durable import small
from reconweave.functions.money import pct_of

# Terms of a merchant whose rate card is not given: basis points, methods that a reserve is held on, paise.
STANDARD = {"gst_bp": 1800, "tds_bp": 100, "reserve_bp": 500, "reserve_methods": "card,wallet", "instant_bp": 25, "dispute_fee_paise": 30_000,
    "tolerance_paise": 100}


#: What is read of the payments of the batches.
FACTS = ("amount_paise", "method", "capture_date", "capture_sec")


def with_facts(members: DataFrame, payment: DataFrame, *columns: str) -> DataFrame:
    """Members with these columns of their payments, which are joined only where the members do not carry them already."""
    if set(columns) <= set(members.columns):
        return members
    return members.join(payment.select("merchant_id", "payment_id", *columns), ["merchant_id", "payment_id"])


def with_terms(df: DataFrame, terms: DataFrame | None) -> DataFrame:
    """``df`` with the terms of its merchants as columns; the standard ones where a merchant, or a term of it, has none."""
    if terms is None:
        return df.withColumns({n: F.lit(v) for n, v in STANDARD.items()})
    joined = df.join(small(terms.select("merchant_id", *STANDARD), 120), "merchant_id", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in STANDARD.items()})


def tier_ranges(rate: DataFrame) -> DataFrame:
    """Tiers as half-open date ranges; a method's first tier also covers all earlier dates."""
    w = Window.partitionBy("merchant_id", "method").orderBy("effective_from")
    first = F.row_number().over(w) == 1
    return rate.select(
        "merchant_id", "method", "effective_from", "pct_bp", "flat_paise", F.when(~first, F.col("effective_from")).alias("from_date"),
            F.lead("effective_from").over(w).alias("to_date")
    )


def with_tier(payment: DataFrame, rate: DataFrame) -> DataFrame:
    """As-of join: each payment with the tier of its method on its capture date."""
    t = small(tier_ranges(rate), 80).alias("t")
    p = payment.alias("p")
    on = (
        (F.col("p.merchant_id") == F.col("t.merchant_id"))
        & (F.col("p.method") == F.col("t.method"))
        & (F.col("t.from_date").isNull() | (F.col("p.capture_date") >= F.col("t.from_date")))
        & (F.col("t.to_date").isNull() | (F.col("p.capture_date") < F.col("t.to_date")))
    )
    return p.join(t, on, "left").select("p.*", "t.pct_bp", "t.flat_paise", "t.effective_from")


def payment_fees(payment: DataFrame, rate: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Fee, GST on the fee and reserve base of each payment, rounded payment by payment; ``instant`` adds its surcharge."""
    surcharge = F.when(F.col("instant"), pct_of(F.col("amount_paise"), F.col("instant_bp"))).otherwise(0)
    priced = with_terms(with_tier(payment, rate), terms).withColumn("fee", pct_of(F.col("amount_paise"), F.col("pct_bp")) + F.col("flat_paise") + surcharge)
    priced = priced.withColumn("gst_on_fee", pct_of(F.col("fee"), F.col("gst_bp")))
    held = F.array_contains(F.split("reserve_methods", ","), F.col("method"))
    return priced.withColumn("reserve_base",
        F.when(held, F.col("amount_paise") - F.col("fee") - F.col("gst_on_fee")).otherwise(F.lit(0)).cast("long"))


def batch_fees(members: DataFrame, rate: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Sums per batch; the reserve is held on the summed base, nothing for instant batches."""
    return (
        payment_fees(members, rate, terms)
        .groupBy("merchant_id", "settlement_id", "instant", "reserve_bp")
        .agg(F.sum("amount_paise").alias("gross"), F.sum("fee").alias("fee"), F.sum("gst_on_fee").alias("gst_on_fee"),
            F.sum("reserve_base").alias("reserve_base"), F.count("*").alias("n_members"))
        .withColumn("reserve_held", F.when(F.col("instant"), F.lit(0).cast("long")).otherwise(pct_of(F.col("reserve_base"), F.col("reserve_bp"))))
        .drop("reserve_bp")
    )
