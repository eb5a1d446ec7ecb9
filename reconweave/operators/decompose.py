"""Decomposition of each credit into signed components, its residue, and the exceptions that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconweave.functions.money import pct_of
from reconweave.operators.fees import batch_fees, with_facts, with_terms

COMPONENTS = ("gross", "platform_fee", "gst_on_fee", "tds_194o", "refund_netted", "chargeback_debit", "dispute_fee", "dispute_fee_gst",
    "chargeback_reversal", "reserve_held", "reserve_released")


def decompose(settlement: DataFrame, bank: DataFrame, links: DataFrame, members: DataFrame, payment: DataFrame, rate: DataFrame,
    deducted: DataFrame, ambiguous_payments: DataFrame, near_ties: DataFrame, netted: bool = True, terms: DataFrame | None = None,
    sums: DataFrame | None = None) -> DataFrame:
    """One row per settlement: eleven components, predicted net, residue, flags.

    A settlement without proved members takes its reported gross and fees, and
    is ambiguous and never within tolerance, unless no membership was looked for
    (``netted`` false); one without a credit has its whole predicted payout as
    residue. ``sums`` are the batches' fees where they are made already.
    """
    if sums is None:
        sums = batch_fees(with_facts(members, payment, "amount_paise", "method", "capture_date"), rate, terms)
    own = sums.select("merchant_id", "settlement_id", F.col("gross").alias("m_gross"), "fee",
        F.col("gst_on_fee").alias("m_gst"), "reserve_held", "n_members")
    tied = ambiguous_payments.select("merchant_id", "settlement_id").distinct().withColumn("tied", F.lit(True))
    near = near_ties.where("near_tie").select("merchant_id", "bank_txn_id").distinct().withColumn("near", F.lit(True))
    b = bank.select("merchant_id", "bank_txn_id", F.col("amount_paise").alias("bank_paise"), "value_date")
    link = links.select("merchant_id", "settlement_id", "bank_txn_id", "confidence", "source")
    s = settlement.join(link, ["merchant_id", "settlement_id"], "left").join(b, ["merchant_id", "bank_txn_id"], "left")
    s = s.join(own, ["merchant_id", "settlement_id"], "left").join(deducted, ["merchant_id", "settlement_id"], "left")
    s = s.join(tied, ["merchant_id", "settlement_id"], "left").join(near, ["merchant_id", "bank_txn_id"], "left")
    s = with_terms(s, terms)
    proven = F.col("n_members").isNotNull() if netted else F.lit(True)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    values = {
        "gross": F.coalesce("m_gross", F.col("gross")), "platform_fee": -F.coalesce("fee", F.col("fees")),
            "gst_on_fee": -F.coalesce("m_gst", F.col("gst")), "tds_194o": -F.col("tds"),
        "refund_netted": -zero("refund_netted"), "chargeback_debit": -zero("chargeback"), "dispute_fee": -zero("dispute_fee"),
            "dispute_fee_gst": -pct_of(zero("dispute_fee"), F.col("gst_bp")),
        "chargeback_reversal": zero("reversal"), "reserve_held": -zero("reserve_held"), "reserve_released": zero("reserve_released"),
    }
    out = s.select("merchant_id", "settlement_id", "bank_txn_id", "settle_date", "value_date", "bank_paise", "confidence", "source", "tied",
        "near", proven.alias("membership_proven"), zero("n_members").alias("n_members"), F.col("net").alias("reported_net"), "tolerance_paise",
        *[values[c].alias(c) for c in COMPONENTS])
    out = out.withColumn("predicted", sum(F.col(c) for c in COMPONENTS[1:]) + F.col("gross")).withColumn("unmatched", F.col("bank_txn_id").isNull())
    out = out.withColumn("residue", F.when(F.col("unmatched"), -F.col("predicted")).otherwise(F.col("bank_paise") - F.col("predicted")))
    out = out.withColumn("within_tolerance", ~F.col("unmatched") & F.col("membership_proven") & (F.abs("residue") <= F.col("tolerance_paise")))
    flagged = (~F.col("unmatched") & F.coalesce("near", F.lit(False)) & (F.coalesce("source", F.lit("")) != "exact_utr")) | F.coalesce("tied",
        F.lit(False)) | (~F.col("unmatched") & ~F.col("membership_proven"))
    return out.withColumn("ambiguous", flagged).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).drop("tied", "near")


def components_long(d: DataFrame) -> DataFrame:
    """(merchant, settlement, bank row, component, paise), with the residue and the credit as rows of their own."""
    wide = d.select("merchant_id", "settlement_id", "bank_txn_id", *COMPONENTS, "residue",
        F.coalesce("bank_paise", F.lit(0)).alias("TOTAL_bank_credit"))
    return wide.unpivot(["merchant_id", "settlement_id", "bank_txn_id"], [*COMPONENTS, "residue", "TOTAL_bank_credit"], "component", "amount_paise")


def exceptions(d: DataFrame, attributed: DataFrame, proofs: DataFrame | None = None) -> DataFrame:
    """Settlements outside tolerance or ambiguous, and refused attributions; ``exception_seq`` orders each merchant's.

    Order: ambiguous last, then by size of the residue, then by settlement.
    ``proofs`` tells why the members of a batch are not proved.
    """
    if proofs is None:
        d = d.withColumn("outcome", F.lit(None).cast("string"))
    else:
        d = d.join(proofs.select("merchant_id", "settlement_id", "outcome"), ["merchant_id", "settlement_id"], "left")
    unproven = F.when(~F.col("membership_proven"), F.coalesce("outcome", F.lit("NO_PAYMENTS")))
    from_batches = d.where(~F.col("within_tolerance") | F.col("ambiguous")).select(
        "merchant_id", "settlement_id", "bank_txn_id", "residue", F.col("gross").alias("batch_value"), "confidence", "ambiguous", "unmatched",
            F.coalesce("value_date", "settle_date").alias("value_date"),
        unproven.alias("partition_refusal"), F.lit(None).cast("string").alias("attribution_refusal"), F.lit("").alias("adjustment"),
        "tolerance_paise",
    )
    refused = attributed.where("settlement_id is null").select(
        "merchant_id", F.when(F.col("candidates") != "", F.split("candidates", ",")[0]).alias("settlement_id"),
            F.lit(None).cast("string").alias("bank_txn_id"), (F.col("amount_paise") + F.col("fee_paise")).alias("residue"),
        F.lit(0).cast("long").alias("batch_value"), F.lit(0.0).alias("confidence"), F.lit(True).alias("ambiguous"),
            F.lit(False).alias("unmatched"), F.col("settle_date").alias("value_date"),
        F.lit(None).cast("string").alias("partition_refusal"), F.col("basis").alias("attribution_refusal"),
            F.concat_ws(":", "type", "adjustment_id").alias("adjustment"), F.lit(0).alias("tolerance_paise"),
    )
    both = from_batches.unionByName(refused)
    # sizes of one bit length are ranked by themselves, after the counts of all larger ones, so that no task orders a whole merchant
    both = both.withColumn("_part", F.when(F.col("ambiguous"), 100).otherwise(0) - F.length(F.bin(F.abs("residue"))))
    before = Window.partitionBy("merchant_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = both.groupBy("merchant_id", "_part").count()
    base = counts.select("merchant_id", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("merchant_id", "_part").orderBy(F.abs("residue").desc(), "settlement_id", "adjustment")
    ranked = both.withColumn("_nth", F.row_number().over(order)).join(base, ["merchant_id", "_part"])
    return ranked.withColumn("exception_seq", (F.col("_base") + F.col("_nth")).cast("long")).drop("_part", "_base", "_nth")


def run_totals(d: DataFrame, members: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """Net and absolute residue, gross, credits matched, payments linked and what was decided, per merchant."""
    m = members.groupBy("merchant_id").agg(F.count("*").alias("links"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    t = d.groupBy("merchant_id").agg(
        F.count("*").alias("settlements"), n(~F.col("unmatched")).alias("credits_matched"), F.sum("residue").alias("net_residue"),
            F.sum(F.abs("residue")).alias("abs_residue"),
        F.sum("gross").alias("gross"), n(F.col("within_tolerance") & ~F.col("ambiguous")).alias("clean"),
    )
    t = t.join(m, "merchant_id", "left")
    counts = ["links"]
    if decided is not None:
        verdict = lambda v: n(F.col("verdict") == v)
        of = decided.groupBy("merchant_id").agg(
            F.count("*").alias("exceptions"), verdict("AUTO_POST").alias("auto_posted"), verdict("ESCALATE").alias("escalated"),
                verdict("SUPPRESSED_DUPLICATE").alias("suppressed")
        )
        t = t.join(of, "merchant_id", "left")
        counts += of.columns[1:]
    return t.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
