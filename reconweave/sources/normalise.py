"""Loaded files as the entity tables of a run.

The loader types the columns of files as they stand; a run wants amounts in
paise, local dates and seconds of the day, and a banking calendar that covers
all dates. A payment without a capture time has no due date and joins no pool.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconweave.functions.calendar import banking_calendar, second_of_day
from reconweave.sources.derive import DECLARED_HOLIDAYS

#: Days around all dates of a dataset that its calendar covers: due dates lie ahead, windows on both sides.
AROUND = 45

_day = lambda c, n: F.to_date(c).alias(n)
_sec = lambda c, n: second_of_day(F.col(c)).alias(n)
_paise = lambda c="amount", n="amount_paise": F.col(c).alias(n)


def _columns() -> dict[str, tuple[str, list[Column | str]]]:
    """Each entity: the loaded table it comes from and its columns."""
    at = "created_at_ist"
    return {
        "payment": ("payments", ["payment_id", "order_id", _paise(), "method", "status", _day(at, "capture_date"), _sec(at, "capture_sec"), F.col(at).alias("created_at")]),
        "purchase": ("orders", ["order_id", "customer_id", _paise(), _day("created_at_utc", "created_date")]),
        "settlement": ("settlements", ["settlement_id", "utr", "gross", "fees", "gst", "tds", "net", _day("settled_at", "settle_date"), "instant"]),
        "bank": ("bank", ["bank_txn_id", "value_date", _paise(), F.coalesce("narration", F.lit("")).alias("narration")]),
        "refund": ("refunds", ["refund_id", "payment_id", _paise(), _day(at, "created_date"), _sec(at, "created_sec"), F.col("netted_flag").alias("netted")]),
        "chargeback": ("chargebacks", ["dispute_id", "payment_id", _paise(), _paise("fee", "fee_paise"), _day("raised_at_ist", "raised_date"),
            _sec("raised_at_ist", "raised_sec"), _day("reversed_at_ist", "reversed_date"), _sec("reversed_at_ist", "reversed_sec")]),
        "reserve": ("reserve", ["reserve_id", _paise(), "held_on", "release_date", _sec("released_at_ist", "released_sec"), F.col("netted_flag").alias("netted")]),
    }


def span(entities: dict[str, DataFrame]) -> tuple[str, str] | None:
    """First and last day on which anything of a dataset happens, with room on both sides; none without dates."""
    dates = {"payment": "capture_date", "settlement": "settle_date", "bank": "value_date", "refund": "created_date", "chargeback": "raised_date",
        "reserve": "release_date"}
    reversed_ = entities["chargeback"].select(F.col("reversed_date").alias("d"))
    days = reduce(DataFrame.union, [entities[e].select(F.col(c).alias("d")) for e, c in dates.items()], reversed_)
    lo, hi = days.agg(F.min("d"), F.max("d")).first()
    return (str(lo - timedelta(AROUND)), str(hi + timedelta(AROUND))) if lo is not None else None


def entities(dataset: dict[str, DataFrame], declared: Iterable[str] = DECLARED_HOLIDAYS) -> dict[str, DataFrame]:
    """The tables that :func:`reconweave.plans.reconcile.reconcile` takes, from those that ``load_dataset`` gives; ``declared`` are bank holidays."""
    out = {e: dataset[name].select("merchant_id", *columns) for e, (name, columns) in _columns().items()}
    days = span(out) or ("2000-01-01", "2000-01-01")
    cal = banking_calendar(dataset["payments"].sparkSession, *days, declared)
    return out | {"rate": dataset["rate"], "terms": dataset["terms"], "cal": cal}
