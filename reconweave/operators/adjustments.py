"""Refunds, disputes, reversals and reserve releases: to which batch each belongs, or why that is not proved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconweave.functions.calendar import add_banking_days
from reconweave.operators.fees import with_facts

DAY = 86400


def adjustments(refund: DataFrame, chargeback: DataFrame, reserve: DataFrame, cal: DataFrame) -> DataFrame:
    """All adjustments in one shape: type, id, amount, fee, due date, second of day.

    Refunds and disputes are due two banking days after they are raised,
    reversals and reserve releases on their own date.
    """
    zero = F.lit(0).cast("long")
    shape = lambda df, kind, id_col, amount, fee, due, sec: df.select("merchant_id", F.lit(kind).alias("type"),
        F.col(id_col).alias("adjustment_id"), F.col(amount).alias("amount_paise"), fee.alias("fee_paise"), F.col(due).alias("due_date"),
        F.col(sec).alias("sec"))
    parts = [
        shape(add_banking_days(refund.where("netted"), cal, "created_date", 2, "due"), "refund", "refund_id", "amount_paise", zero, "due",
            "created_sec"),
        shape(add_banking_days(chargeback, cal, "raised_date", 2, "due"), "chargeback", "dispute_id", "amount_paise", F.col("fee_paise"), "due",
            "raised_sec"),
        shape(chargeback.where("reversed_date is not null"), "chargeback_reversal", "dispute_id", "amount_paise", zero, "reversed_date",
            "reversed_sec"),
        shape(reserve.where("netted"), "reserve_release", "reserve_id", "amount_paise", zero, "release_date", "released_sec"),
    ]
    return reduce(DataFrame.unionByName, parts)


def attach_dates(adj: DataFrame, settlement: DataFrame) -> DataFrame:
    """``settle_date``: the settlement run on the due date, else the nearest, the earlier of two.

    The nearest run is found per (merchant, due date), of which there are no
    more than days, by the last run up to it and the first after it: due dates
    and run dates lie in one ordered union.
    """
    runs = settlement.select("merchant_id", F.col("settle_date").alias("d")).distinct().withColumn("run", F.col("d"))
    due = adj.select("merchant_id", F.col("due_date").alias("d")).distinct().withColumn("run", F.lit(None).cast("date"))
    w = Window.partitionBy("merchant_id").orderBy("d", F.col("run").isNull())
    both = runs.unionByName(due).withColumns({
        "before": F.last("run", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.first("run", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    nearer = F.col("after").isNull() | (F.datediff("d", "before") <= F.datediff("after", "d"))
    found = both.where("run is null").select("merchant_id", F.col("d").alias("due_date"),
        F.when(nearer, F.col("before")).otherwise(F.col("after")).alias("settle_date"))
    return adj.join(found.where("settle_date is not null"), ["merchant_id", "due_date"])


def cycle_windows(members: DataFrame, payment: DataFrame) -> DataFrame:
    """Observed and inferred second-of-day range of each batch that is not instant.

    Inferred ranges are equal parts of the day if every batch of the date fits
    its own, else they meet halfway between the observed ones.
    """
    secs = with_facts(members.where("not instant"), payment, "capture_sec")
    obs = secs.groupBy("merchant_id", "settle_date", "settlement_id").agg(F.min("capture_sec").alias("obs_lo"), F.max("capture_sec").alias("obs_hi"))
    day = Window.partitionBy("merchant_id", "settle_date")
    order = day.orderBy("obs_lo", "settlement_id")
    n = obs.withColumns({"i": F.row_number().over(order) - 1, "k": F.count("*").over(day), "prev_hi": F.lag("obs_hi").over(order),
        "next_lo": F.lead("obs_lo").over(order)})
    width = F.floor(F.lit(DAY) / F.col("k"))
    fits = (F.lit(DAY) % F.col("k") == 0) & (F.col("obs_lo") >= F.col("i") * width) & (F.col("obs_hi") <= (F.col("i") + 1) * width - 1)
    n = n.withColumn("equal", F.bool_and(fits).over(day))
    lo = F.when(F.col("equal"), F.col("i") * width).otherwise(F.coalesce(F.floor((F.col("prev_hi") + F.col("obs_lo") + 1) / 2), F.lit(0)))
    hi = F.when(F.col("equal"), (F.col("i") + 1) * width - 1).otherwise(F.coalesce(F.floor((F.col("obs_hi") + F.col("next_lo")) / 2), F.lit(DAY - 1)))
    return n.select("merchant_id", "settle_date", "settlement_id", "obs_lo", "obs_hi", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"),
        "equal", F.col("k").alias("n_batches"))


def attribute(adj: DataFrame, windows: DataFrame) -> DataFrame:
    """Owner of each attached adjustment, one row each: settlement_id or null, basis, candidates.

    Only a sole batch of the date, or exactly one whose members were trading at
    that second, owns an adjustment; inferred ranges only name candidates.
    """
    rows = adj.withColumn("row", F.struct("merchant_id", "type", "adjustment_id"))
    w = windows.select("merchant_id", "settle_date", "settlement_id", "obs_lo", "obs_hi", "lo", "hi", "n_batches")
    j = rows.join(w, ["merchant_id", "settle_date"], "left")
    bracket = F.col("sec").between(F.col("obs_lo"), F.col("obs_hi"))
    inferred = F.col("sec").between(F.col("lo"), F.col("hi"))
    # before a range the distance is to its start, else from its end, as inside none of them holds the second
    far = F.when(F.col("sec") < F.col("obs_lo"), F.col("obs_lo") - F.col("sec")).otherwise(F.col("sec") - F.col("obs_hi"))
    ids = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("settlement_id"))))
    keys = ["merchant_id", "type", "adjustment_id", "amount_paise", "fee_paise", "due_date", "settle_date", "sec"]
    g = j.groupBy(*keys).agg(
        F.count("settlement_id").alias("n"), ids(F.col("settlement_id").isNotNull()).alias("all"), ids(bracket).alias("observed"),
            ids(inferred).alias("guessed"),
        F.sort_array(F.collect_list(F.when(F.col("settlement_id").isNotNull(), F.struct(far.alias("far"), "settlement_id")))).alias("near"),
    )
    nearest = F.transform(F.filter("near", lambda x: x["far"] == F.col("near")[0]["far"]), lambda x: x["settlement_id"])
    seen = F.size("observed")
    basis = (
        F.when(F.col("n") == 0, "no_batches_on_date").when(F.col("n") == 1, "sole_batch_on_date").when(seen == 1,
            "observed_members_bracket_timestamp")
        .when(seen > 1, "overlapping_observed_ranges").otherwise("timestamp_in_inferred_gap")
    )
    gap = F.when(F.size("guessed") > 0, F.col("guessed")).otherwise(nearest)
    named = F.when(F.col("n") <= 1, F.col("all")).when(seen > 0, F.col("observed")).otherwise(gap)
    owner = F.when(F.col("n") == 1, F.get("all", F.lit(0))).when((F.col("n") > 1) & (seen == 1), F.get("observed", F.lit(0)))
    return g.select(*keys, owner.alias("settlement_id"), basis.alias("basis"), F.array_join(named, ",").alias("candidates"))


def settled_separately(parsed_bank: DataFrame) -> DataFrame:
    """(merchant, id): entities that a bank debit names, so that no batch nets them too."""
    return parsed_bank.where("amount_paise < 0").select("merchant_id", F.explode("tokens").alias("adjustment_id")).distinct()


def deductions(attributed: DataFrame, separate: DataFrame) -> DataFrame:
    """Sums per batch; a dispute's fee always counts, its amount only when no bank debit carries it."""
    apart = separate.withColumn("apart", F.lit(True))
    owned = attributed.where("settlement_id is not null").join(apart, ["merchant_id", "adjustment_id"], "left")
    total = lambda kind, c="amount_paise", extra=F.lit(True): F.coalesce(F.sum(F.when((F.col("type") == kind) & extra, F.col(c))),
        F.lit(0)).cast("long")
    return owned.groupBy("merchant_id", "settlement_id").agg(
        total("refund").alias("refund_netted"), total("chargeback", extra=F.col("apart").isNull()).alias("chargeback"),
            total("chargeback", "fee_paise").alias("dispute_fee"),
        total("chargeback_reversal").alias("reversal"), total("reserve_release").alias("reserve_released"),
    )
