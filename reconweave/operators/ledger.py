"""Hash-chained decision ledger: append without repeats, verify links and contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
FIELDS = ("actor", "action", "entity_type", "entity_id", "idempotency_key", "model_version", "score", "verdict", "payload", "canon_ts")


def _object(*fields: str, **named: str) -> Column:
    """The fields as the inside of a JSON object, in their order; a null is an empty text."""
    columns = {f: f for f in fields} | named
    text = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in columns.items()]))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def middle() -> Column:
    """The hashed object of a row between its number and the hash before it; the score has six decimals, the payload sorted keys."""
    head = F.struct(F.coalesce("canon_ts", F.lit("")).alias("timestamp"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FIELDS[:6]])
    text = F.to_json(head)
    parts = [F.substring(text, F.lit(2), F.length(text) - 2), F.concat(F.lit('"score":'), F.format_string("%.6f", F.col("score"))), _object("verdict")]
    return F.concat_ws(",", *parts, F.concat(F.lit('"payload":'), F.coalesce("payload", F.lit("{}"))))


def canonical() -> Column:
    """The whole hashed object of a ledger row: its number first, the hash before it last, no blanks."""
    before = F.coalesce("prev_hash", F.lit(""))
    return F.concat(F.lit('{"seq":'), F.col("canon_seq").cast("string"), F.lit(","), middle(), F.lit(',"prev_hash":"'), before, F.lit('"}'))


def payload(**fields: Column) -> Column:
    """A JSON object of texts, its keys in order."""
    return F.to_json(F.struct(*[F.coalesce(fields[n].cast("string"), F.lit("")).alias(n) for n in sorted(fields)]))


def entries(decided: DataFrame, model_version: str = "prior") -> DataFrame:
    """Ledger rows of decided exceptions, still unchained."""
    return decided.select(
        "merchant_id",
        "exception_seq",
        F.lit("reconweave").alias("actor"),
        F.lit("resolve_exception").alias("action"),
        F.lit("settlement").alias("entity_type"),
        F.coalesce("settlement_id", F.lit("")).alias("entity_id"),
        "idempotency_key",
        F.lit(model_version).alias("model_version"),
        F.col("label_confidence").cast("double").alias("score"),
        "verdict",
        payload(label=F.col("label"), residue=F.col("residue")).alias("payload"),
        F.col("value_date").cast("string").alias("canon_ts"),
    )


CHAIN = "merchant_id string, seq long, idempotency_key string, prev_hash string, hash string"


def _fold(batches: Iterator) -> Iterator:
    """Chain rows that come merchant by merchant in order, with the end of each merchant's chain so far; only that end is held."""
    import pyarrow as pa

    merchant, seq, end = None, 0, ""
    names = ["merchant_id", "idempotency_key", "canon", "last_seq", "last_hash"]
    for batch in batches:
        out = []
        for m, key, canon, last_seq, last_hash in zip(*(batch[n].to_pylist() for n in names), strict=True):
            if m != merchant:
                merchant, seq, end = m, last_seq, last_hash
            before, seq = end, seq + 1
            end = hashlib.sha256(f'{before}{{"seq":{seq},{canon},"prev_hash":"{before}"}}'.encode()).hexdigest()
            out.append((m, seq, key, before, end))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["merchant_id", "seq", "idempotency_key", "prev_hash", "hash"])


HEADS = "merchant_id string, last_seq long, last_hash string"


def heads(ledger: DataFrame) -> DataFrame:
    """(merchant_id, last_seq, last_hash): where each merchant's chain ends."""
    return ledger.groupBy("merchant_id").agg(F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("last_hash"))


def append(ledger: DataFrame | None, new: DataFrame) -> DataFrame:
    """New rows as chained ledger rows per merchant, after the ledger's last; keys already there, or repeated, add nothing."""
    return chained(new) if ledger is None else chained(new, ledger.select("merchant_id", "idempotency_key"), heads(ledger))


def chained(new: DataFrame, seen: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """New rows chained after ``ends``, the heads of the merchants' chains, but for those whose key is in ``seen`` or repeated.

    Each hash needs the one before, so a merchant's new rows pass through one
    task in order, row by row, while merchants run in parallel.
    """
    first = Window.partitionBy("merchant_id", "idempotency_key").orderBy("exception_seq")
    rows = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if seen is not None:
        rows = rows.join(seen, ["merchant_id", "idempotency_key"], "left_anti")
    line = rows.select("merchant_id", "exception_seq", "idempotency_key", middle().alias("canon"))
    if ends is None:
        line = line.withColumns({"last_seq": F.lit(0).cast("long"), "last_hash": F.lit(GENESIS)})
    else:
        line = line.join(ends, "merchant_id", "left")
        line = line.withColumns({"last_seq": F.coalesce("last_seq", F.lit(0)), "last_hash": F.coalesce("last_hash", F.lit(GENESIS))})
    line = line.repartition("merchant_id").sortWithinPartitions("merchant_id", "exception_seq", "idempotency_key")
    chain = line.select("merchant_id", "idempotency_key", "canon", "last_seq", "last_hash").mapInArrow(_fold, CHAIN)
    out = chain.join(rows, ["merchant_id", "idempotency_key"])
    return out.select("merchant_id", "seq", *FIELDS, F.col("seq").alias("canon_seq"), "prev_hash", "hash")


def verify(ledger: DataFrame) -> DataFrame:
    """Each row with whether its link and its contents hold; a row without the time and number that were hashed is unverifiable, not valid."""
    # the row before is met by its number, so a long chain is checked by many tasks; two rows of one number are both broken
    keys = ["merchant_id", "seq"]
    ends = ledger.groupBy(*keys).agg(F.min("hash").alias("_hash"), F.count("*").alias("_n"))
    before = ends.select("merchant_id", (F.col("seq") + 1).alias("seq"), F.col("_hash").alias("_before"))
    out = ledger.join(before, keys, "left").join(ends.select(*keys, "_n"), keys)
    first = (F.col("seq") == 1) & (F.col("prev_hash") == GENESIS)
    linked = first | ((F.col("seq") > 1) & F.coalesce(F.col("prev_hash") == F.col("_before"), F.lit(False)))
    out = out.withColumn("link_ok", F.coalesce(linked, F.lit(False)) & (F.col("_n") == 1)).drop("_before", "_n")
    same = F.sha2(F.concat("prev_hash", canonical()), 256) == F.col("hash")
    whole = F.col("hash").isNotNull() & F.col("prev_hash").isNotNull() & F.col("canon_ts").isNotNull() & F.col("canon_seq").isNotNull()
    same = same & (F.col("canon_seq") == F.col("seq"))
    return out.withColumn("verifiable", whole).withColumn("content_ok", ~whole | F.coalesce(same, F.lit(False)))


def summary(verified: DataFrame) -> DataFrame:
    """Rows, breaks, unverifiable rows and head of each merchant's chain."""
    bad = lambda c: F.sum((~F.col(c)).cast("long"))
    return verified.groupBy("merchant_id").agg(
        F.count("*").alias("n_rows"), bad("link_ok").alias("broken_links"), bad("content_ok").alias("altered"),
            bad("verifiable").alias("unverifiable"), F.max_by("hash", "seq").alias("head"),
    )


def verify_ledger(ledger: DataFrame) -> DataFrame:
    """Rows, breaks and head of each merchant's chain, links and contents checked."""
    return summary(verify(ledger))
