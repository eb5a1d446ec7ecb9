"""Helpers shared by the corpus operators: durable tables, distributed ranks, a byte-level text kernel.

Nothing here holds more than one Arrow batch of text in a Python worker, and
nothing whole goes through the driver.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast, as estimated bytes; above it joins shuffle.
BROADCAST_BYTES = 8 << 20
#: Bytes that a built hash table has for each row beside its values.
TABLE_BYTES = 64
#: Bytes of an Arrow batch between Spark and a Python worker; a single longer row is a batch of its own.
ARROW_BYTES = 4 << 20

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and Spark runs in this process alone (tests)."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if _own_dir is None:
            _own_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _own_dir
    return base.rstrip("/")


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``ARROW_BYTES`` from here on in the session, so that long texts do not add up in a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Hint a broadcast of ``df`` if its counted size, ``row_bytes`` of values a row and the hash table around them, is under the bound; else leave it to a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * (row_bytes + TABLE_BYTES) <= BROADCAST_BYTES else df


def with_rank(df: DataFrame, keys: list[str], order: list[str], per_bucket: int = 50_000, rank: str = "rank") -> DataFrame:
    """0-based gapless rank of each row within ``keys``, without one task per key.

    Rows of a key are dealt over hash buckets of ``order[0]``'s values; ranks
    follow (bucket, order). Counts by (key, bucket) give each bucket its first
    rank, so a key with a third of all rows is still ranked in many tasks.
    ``keys`` must not be null.
    """
    n = df.count()
    buckets = max(1, -(-n // per_bucket))
    salted = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    at = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy(*keys, "_bucket").count().select(*keys, "_bucket", F.coalesce(F.sum("count").over(at), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        salted.withColumn("_nth", F.row_number().over(inside))
        .join(base, [*keys, "_bucket"])
        .withColumn(rank, F.col("_base") + F.col("_nth") - 1)
        .drop("_bucket", "_base", "_nth")
    )


def utf8_bytes(text: Column) -> Column:
    """Bytes of a text in UTF-8, null as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


# --- text kernel over Arrow buffers -------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied to each element."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    return x ^ (x >> np.uint64(31))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and its n+1 offsets; null rows are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize) if len(column) else np.zeros(1, kind)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return raw[lo:hi], offsets.astype(np.int64) - lo


def text_slices(column, most: int = 1 << 18):
    """Row ranges of an Arrow string array with about ``most`` bytes each, so that work arrays stay small."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        start = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, start + most, "right")))
        yield at, to
        at = to


#: Bytes of a long text that are worked on at once: masks and sums exist for one window at a time.
WINDOW = 1 << 18

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def space_mask(raw: np.ndarray) -> np.ndarray:
    """True where a byte is one of the six ASCII spaces."""
    return SPACES[raw]


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True flags of each text; a text without bytes has none."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(flags, offsets[full], dtype=np.int64)
    return out


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of non-space bytes), where each text starts anew."""
    n = len(raw)
    cuts = offsets[(offsets > 0) & (offsets < n)]
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, n, WINDOW):
        hi = min(lo + WINDOW, n)
        # one byte more on either side tells whether a word goes on there
        inside = np.zeros(hi - lo + 2, bool)
        first, last = max(lo - 1, 0), min(hi + 1, n)
        inside[first - lo + 1 : last - lo + 1] = ~SPACES[raw[first:last]]
        here = inside[1:-1]
        begins = here & ~inside[:-2]
        stops = here & ~inside[2:]
        new = cuts[(cuts >= lo) & (cuts < hi)] - lo
        begins[new] = here[new]
        old = cuts[(cuts > lo) & (cuts <= hi)] - lo - 1
        stops[old] = here[old]
        starts.append(np.flatnonzero(begins) + lo)
        ends.append(np.flatnonzero(stops) + (lo + 1))
    return np.concatenate(starts), np.concatenate(ends)


_STEPS = np.full(WINDOW + 1, _MULT, np.uint64)
_STEPS[0] = 1
_POWERS = np.cumprod(_STEPS)
_STEPS[1:] = np.uint64(pow(int(_MULT), -1, 1 << 64))
_INVERSES = np.cumprod(_STEPS)
del _STEPS


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending, disjoint byte spans: polynomial in an odd base by prefix sums, then a finaliser with the length.

    Sums run window by window; the one span that comes from an earlier window
    goes on where it stopped.
    """
    out = np.zeros(len(starts), np.uint64)
    for lo in range(0, len(raw), WINDOW):
        hi = min(lo + WINDOW, len(raw))
        a, b = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi))
        if a >= b:
            continue
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * _POWERS[: hi - lo], out=sums[1:])
        begin = np.maximum(starts[a:b] - lo, 0)
        part = (sums[np.minimum(ends[a:b], hi) - lo] - sums[begin]) * _INVERSES[begin]
        if starts[a] < lo:
            part[:1] *= np.uint64(pow(int(_MULT), int(lo - starts[a]), 1 << 64))
        out[a:b] += part
    return mix(out ^ mix((ends - starts).astype(np.uint64) * _MIX1))
