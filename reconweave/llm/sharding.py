"""Placement of documents into weighted shards by a hierarchical hash tree.

A document descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with u from a hash of (key, child), and the smallest draw
wins: a child gets rows in proportion to its weight, and a change of weights
under one child moves rows only between that child and the others of its level.
A new shard in a region of its own takes rows into itself alone; one put into
an old rack moves rows only into that region, rack and shard, and within them.

Law of placement: ``key``. The doc_id and the shard count decide; texts,
order and partitions do not matter. Only built-in functions are used.

Edge cases: a null doc_id is a key like any other; a null text has no bytes;
repeated rows share a shard and get slots of their own; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconweave.llm.common import durable, utf8_bytes, with_rank

#: {region: {rack: {shard: weight}}}
Tree = dict[int, dict[int, dict[int, float]]]

REGION_SHARDS, RACK_SHARDS = 8, 4


def even_tree(shards: int) -> Tree:
    """Shards of equal weight, four to a rack and two racks to a region."""
    tree: Tree = {}
    for s in range(shards):
        tree.setdefault(s // REGION_SHARDS, {}).setdefault(s // RACK_SHARDS, {})[s] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region and rack of its own."""
    rack = 1 + max((k for r in tree.values() for k in r), default=-1)
    return {**tree, 1 + max(tree, default=-1): {rack: {shard: weight}}}


def draw(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The child with the smallest weighted draw for ``key``."""
    tries = []
    for child, weight in sorted(weights.items()):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(level), F.lit(child), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        tries.append(F.struct((-F.ln(u) / weight).alias("draw"), F.lit(child).alias("child")))
    return F.array_min(F.array(*tries))["child"] if len(tries) > 1 else F.lit(next(iter(weights)))


def _case(on: Column, branches: dict[int, Column]) -> Column:
    (_, last), *rest = sorted(branches.items(), reverse=True)
    return reduce(lambda other, kv: F.when(on == kv[0], kv[1]).otherwise(other), rest, last)


def place(df: DataFrame, key: str, tree: Tree, into: str = "shard") -> DataFrame:
    """``df`` with the shard of each row's key in column ``into``."""
    k = F.col(key)
    rack_weight = {r: {c: sum(s.values()) for c, s in racks.items()} for r, racks in tree.items()}
    region = draw(k, "region", {r: sum(w.values()) for r, w in rack_weight.items()})
    df = df.withColumn("__region", region)
    df = df.withColumn("__rack", _case(F.col("__region"), {r: draw(k, "rack", w) for r, w in rack_weight.items()}))
    shards = {c: draw(k, "shard", s) for racks in tree.values() for c, s in racks.items()}
    return df.withColumn(into, _case(F.col("__rack"), shards)).drop("__region", "__rack")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Each document's size, checksum, shard, slot in the shard, and its shard were there one more."""
    tree = even_tree(shards)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (utf8_bytes(F.col("text")) + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = place(place(rows, "doc_id", tree), "doc_id", grown(tree, shards), "grown_shard")
    rows = durable(rows, "placed")
    return with_rank(rows, ["shard"], ["doc_id", "text_crc32", "size"], rank="slot")
