"""Exact duplicates by a Golomb-coded fingerprint exchange.

Three steps. (1) Each partition hashes its normalised texts, and sends to each
owner of a range of the hash space the sorted, Golomb-coded fingerprints that
fall there. (2) An owner merges its messages and answers each with a bitmap of
the fingerprints that occur elsewhere too, or more than once in the message.
(3) Only rows under a set bit, the suspects, are shuffled with their texts and
compared byte by byte. Rows without a set bit are unique and never move.

Messages hold each fingerprint once, so an owner's load is bounded by the
range, whatever the number of copies; copies of a hot text meet only as
partial aggregates of their partitions.

Edge cases: a null text counts as empty, and empty texts equal each other; a
null doc_id sorts last; of rows that repeat both doc_id and text, one is kept;
a very long text is hashed and compared whole; an empty table gives no rows;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconweave.llm.common import durable, map_batches, small

#: Bits of a fingerprint beyond log2(rows): about one row in 2**SPARE_BITS is suspected in vain.
SPARE_BITS = 10
#: Rows of an owner's range.
OWNER_ROWS = 2_000_000


def normalized(text: Column) -> Column:
    """The text with each run of ASCII white space replaced by one space; null as empty."""
    spaces = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_replace(spaces, "  +", " ")


def golomb_encode(values: np.ndarray) -> tuple[bytes, int]:
    """Ascending integers as Golomb-coded gaps with a power-of-two parameter; (bytes, parameter's exponent).

    All unary heads come first and all remainders after them, each part in
    whole bytes, so that either is coded and decoded in one step.
    """
    gaps = np.diff(values, prepend=0).astype(np.uint64)
    mean = max(1.0, float(values[-1]) / len(values)) if len(values) else 1.0
    low = max(0, int(np.log2(mean * np.log(2) + 1)))
    stops = np.cumsum((gaps >> np.uint64(low)).astype(np.int64) + 1) - 1
    heads = np.ones(int(stops[-1]) + 1 if len(stops) else 0, np.uint8)
    heads[stops] = 0
    rests = np.empty((len(gaps), low), np.uint8)
    for i in range(low):
        rests[:, i] = (gaps >> np.uint64(low - 1 - i)) & np.uint64(1)
    return np.packbits(heads).tobytes() + np.packbits(rests.ravel()).tobytes(), low


def golomb_decode(code: bytes, low: int, n: int) -> np.ndarray:
    """The ascending integers of ``golomb_encode``."""
    raw = np.frombuffer(code, np.uint8)
    split = len(raw) - (n * low + 7) // 8
    stops = np.flatnonzero(np.unpackbits(raw[:split]) == 0)[:n]
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64)
    rests = np.unpackbits(raw[split:], count=n * low).reshape(n, low)
    for i in range(low):
        gaps = (gaps << np.uint64(1)) | rests[:, i].astype(np.uint64)
    return np.cumsum(gaps)


def suspects(rows: DataFrame, n: int) -> DataFrame:
    """(part, fingerprint) of the rows whose fingerprint occurs more than once; ``rows`` has part and fingerprint."""
    owners = max(1, -(-n // OWNER_ROWS))
    bits = min(62, max(16, int(n).bit_length() + SPARE_BITS))
    shift = np.uint64(64 - bits)

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            part = batch["part"].to_numpy()
            hashes = batch["fingerprint"].to_numpy().view(np.uint64)
            for p in np.unique(part).tolist():
                found.setdefault(p, []).append(hashes[part == p] >> shift)
        sender = TaskContext.get().partitionId()
        for part, lists in sorted(found.items()):
            values, times = np.unique(np.concatenate(lists), return_counts=True)
            owner = (values >> np.uint64(bits - 16)).astype(np.int64) * owners >> 16
            for o in np.unique(owner).tolist():
                mine, again = values[owner == o], times[owner == o] > 1
                code, low = golomb_encode(mine)
                row = {"owner": o, "sender": sender, "part": part, "n": len(mine), "low": low, "code": code, "again": np.packbits(again).tobytes()}
                yield pa.RecordBatch.from_pylist([row], pa.schema({"owner": pa.int32(), "sender": pa.int32(), "part": pa.int32(),
                    "n": pa.int64(), "low": pa.int32(), "code": pa.binary(), "again": pa.binary()}.items()))

    def answer(table):
        import pyarrow as pa

        sent = table.to_pylist()
        lists = [golomb_decode(m["code"], m["low"], m["n"]) for m in sent]
        values, times = np.unique(np.concatenate(lists), return_counts=True)
        twice = values[times > 1]
        maps = [np.packbits(np.isin(v, twice, assume_unique=True) | np.unpackbits(np.frombuffer(m["again"], np.uint8),
            count=m["n"]).astype(bool)).tobytes() for v, m in zip(lists, sent, strict=True)]
        return pa.table({**{c: table[c] for c in ("owner", "sender", "part")}, "bitmap": pa.array(maps, pa.binary())})

    def mark(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for m in batch.to_pylist():
                set_bits = np.unpackbits(np.frombuffer(m["bitmap"], np.uint8), count=m["n"]).astype(bool)
                found = golomb_decode(m["code"], m["low"], m["n"])[set_bits]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), m["part"], np.int32)), pa.array(found.astype(np.int64))],
                        ["part", "prefix"])

    messages = durable(map_batches(rows.select("part", "fingerprint"), send,
        "owner int, sender int, part int, n long, low int, code binary, again binary"), "messages")
    answers = messages.select("owner", "sender", "part", "n", "low", "code", "again").groupBy("owner").applyInArrow(answer,
        "owner int, sender int, part int, bitmap binary")
    answered = messages.drop("again").join(answers, ["owner", "sender", "part"]).select("part", "n", "low", "code", "bitmap")
    marked = map_batches(answered, mark, "part int, prefix long").distinct()
    prefix = F.shiftrightunsigned("fingerprint", 64 - bits)
    return rows.withColumn("prefix", prefix).join(marked, ["part", "prefix"], "left_semi").drop("prefix")


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Of equal texts the row with the smallest doc_id is kept.
    """
    spark = docs.sparkSession
    text = normalized(F.col(text_col))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("norm"))
    rows = durable(
        base.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("uid"),
            F.xxhash64("norm").alias("fingerprint"), F.unhex(F.sha2("norm", 256)).alias("sha")),
        "rows",
    )
    n = rows.count()
    suspect = durable(suspects(rows, n).select("part", "uid", "doc_id", "fingerprint", "sha"), "suspects")
    hashes = durable(suspect.select("fingerprint").distinct(), "hashes")
    texts = base.withColumn("fingerprint", F.xxhash64("norm")).join(small(hashes, 16), "fingerprint", "left_semi")
    # equal bytes are one group; the copies of a partition are one row before the shuffle
    verified = texts.groupBy("fingerprint", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = durable(verified.where("group_size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "groups")
    first = suspect.join(small(groups, 64),
        "sha").where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.min("uid").alias("keep_uid"))
    groups = durable(groups.join(first, "sha", "left"), "kept")
    out = rows.select("doc_id", "uid", "sha").join(small(groups, 64), "sha", "left")
    group_size = F.coalesce("group_size", F.lit(1)).cast("long")
    return out.select(
        "doc_id",
        F.when(group_size > 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        group_size.alias("group_size"),
        (F.col("keep_uid").isNull() & (group_size == 1) | F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(False))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, all columns as they are."""
    dropped = durable(exact_groups(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"),
        F.col("text_sha256").alias("__gone_sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("__again")).distinct(), "dropped")
    again = dropped.where("__again")
    gone = dropped.where("not __again")
    sha = F.sha2(normalized(F.col("text")), 256)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone_id")) & (sha == F.col("__gone_sha"))
    out = docs.join(small(gone, 96), same, "left_anti")
    if again.isEmpty():
        return out
    repeated = out.join(small(again, 96), same, "left_semi").withColumn("__gone_sha", sha)
    return out.join(small(again, 96), same, "left_anti").unionByName(repeated.dropDuplicates(["doc_id", "__gone_sha"]).drop("__gone_sha"))
