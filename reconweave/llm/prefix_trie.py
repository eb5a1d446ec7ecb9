"""Prefix trie of conversations by van Emde Boas recursion.

A trie of height 2h is cut at depth h into an upper trie and a forest of lower
ones, each as high as it; both halves are built alike, all blocks of a level at
once, down to blocks of ``BLOCK`` turns.

*Names.* Turns become 16-byte names of (role, text); a prefix's name is a hash
of the name where its block begins and of the turns since. Content names of
blocks are joined in pairs upwards; on the way down each cut prefix gets its
name, which is the root of a lower block. So equal prefixes, and only these,
have equal names, and a conversation is never gathered in one place: its blocks
of ``BLOCK`` turns are rows of their own.

*Totals.* First every block adds up its own subtrees. Then, from small blocks to
large ones, each root of a lower trie grafts its total on all nodes above it in
the upper trie. A level moves one row for each lower root and node above it, and
sums are combined before they are shuffled.

Members of a node are counted by its name. The node of a name is reached from
its smallest member. Where many nodes have one parent, that parent is one of at
most ``HEAVY`` and is broadcast; others meet by a shuffled join. The sorted
members that end at a node are joined in pieces of ``PIECE`` consecutive ids;
their hash runs over the pieces in one pass, which holds one piece.

Edge cases: a null conv_id is no conversation and its rows are left out; a null
role or text is empty; a null turn comes first; turns of one number follow in
the order of their names (a hash of role and text); repeated rows are turns of
their own; a text of any length is hashed whole; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconweave.llm.common import durable, map_batches, utf8_bytes

#: Turns of the smallest block; a power of two.
BLOCK = 16
#: Keys with more than one part in HEAVY of the rows; there are fewer than HEAVY of these.
HEAVY = 1000
#: Consecutive ids in one piece of a list of members, and turns numbered by one window.
PIECE = 4096
#: First turns that a conversation may take over from another: the remainder by which they are chosen, and the group.
HEAD, KIN = 9, 5

#: The name of the root, which no turn has.
ROOT = bytes(16)


def name_of(*parts: Column) -> Column:
    """16 bytes of the SHA-256 of the parts."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_name, bytes): numbered from 0 in each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    length = F.concat(F.octet_length(role).cast("string"), F.lit(":"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        name_of(F.concat(length, role, text).cast("binary")).alias("turn_name"),
        utf8_bytes(F.col("text")).alias("bytes"),
    )
    # a conversation is numbered part by part; turns without a number are dealt by their names
    part = F.expr(f"turn div {PIECE}")
    rows = rows.withColumn("part", F.when(F.col("turn").isNull(), F.struct(F.lit(None).cast("long").alias("p"), F.substring(F.hex("turn_name"), 1, 2).alias("q"))).otherwise(F.struct(part.alias("p"), F.lit("").alias("q"))))
    rows = durable(rows, "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("conv_id", "part").count().select("conv_id", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "turn_name")
    rows = rows.withColumn("nth", F.row_number().over(inside) - 1)
    same = rows["conv_id"].eqNullSafe(base["conv_id"]) & rows["part"].eqNullSafe(base["part"])
    return rows.join(base, same).select(rows["conv_id"], (F.col("base") + F.col("nth")).alias("pos"), "turn_name", "bytes")


def join_heavy(rows: DataFrame, table: DataFrame, key: str, weight: Column, total: int) -> DataFrame:
    """``rows`` left-joined with ``table``, unique in ``key``, where ``weight`` counts the rows of each key: the heaviest keys, fewer than ``HEAVY``, are broadcast."""
    heavy = weight * HEAVY > F.lit(total)
    few = F.broadcast(table.where(heavy))
    at_few = rows.join(few, key, "inner")
    others = rows.join(few.select(key), key, "left_anti")
    return at_few.unionByName(others.join(table.where(~heavy), key, "left"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation begins with the first turns of the first of its kin, as many as its id's hash says, and goes on with its own."""
    rows = durable(rows, "numbered")
    size = durable(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    first = size.select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    size = size.select("conv_id", "n", taken.alias("h"), F.expr(f"conv_id - conv_id % {KIN}").alias("head"))
    size = durable(size.join(first, "head", "left").select("conv_id", "n", "h", "head", F.least("h", F.coalesce("head_n", F.lit(0))).alias("k")), "kin")
    # at most HEAD turns of a head meet the few conversations that begin with it
    heads = rows.where(F.col("pos") < HEAD).where(f"conv_id % {KIN} = 0").withColumnRenamed("conv_id", "head")
    begun = heads.join(size.select("conv_id", "h", "head"), "head").where("pos < h").select("conv_id", "pos", "turn_name", "bytes")
    total = rows.count()
    own = join_heavy(rows.where(F.col("pos") >= taken), size.select("conv_id", "n", "h", "k"), "conv_id", F.col("n"), total)
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "turn_name", "bytes")
    return begun.unionByName(own), size.select("conv_id")


# --- names -----------------------------------------------------------------------------


def block_roots(full: DataFrame, height: int) -> DataFrame:
    """(conv_id, k, root): the names of the prefixes that end where block k begins.

    ``full`` has the content names of the full blocks, all of index under 2^height.
    """
    contents = [full]
    for _ in range(height - 1):
        pair = F.sort_array(F.collect_list(F.struct("k", "content")))
        halves = contents[-1].groupBy("conv_id", F.expr("k div 2").alias("k")).agg(pair.alias("h")).where(F.size("h") == 2)
        contents.append(durable(halves.select("conv_id", "k", name_of(F.col("h")[0]["content"], F.col("h")[1]["content"]).alias("content")), "contents"))
    roots = full.where("k = 0").select("conv_id", F.lit(0).cast("long").alias("k"), F.lit(ROOT).alias("root"))
    for content in reversed(contents):
        # cut at half: the upper block keeps its root, the cut prefix is the lower block's
        upper = roots.select("conv_id", (F.col("k") * 2).alias("k"), "root")
        lower = upper.join(content, ["conv_id", "k"]).select("conv_id", (F.col("k") + 1).alias("k"), name_of(F.col("root"), F.col("content")).alias("root"))
        roots = durable(upper.unionByName(lower), "roots")
    return roots


def _inside(root: Column, names: Column, lo: int, hi: int) -> list[Column]:
    """Names of the prefixes that end after each of the turns lo to hi - 1 of a block, below ``root``; null where there is no such turn."""
    if hi - lo == 1:
        return [name_of(root, F.get(names, F.lit(lo)))]
    mid = (lo + hi) // 2
    cut = name_of(root, *[F.get(names, F.lit(i)) for i in range(lo, mid)])
    return [*_inside(root, names, lo, mid)[:-1], cut, *_inside(cut, names, mid, hi)]


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, k, path, bytes): the names of block k's nodes, from its root on, and the bytes of its turns."""
    turn = F.sort_array(F.collect_list(F.struct("pos", "turn_name", "bytes")))
    cut = rows.groupBy("conv_id", F.expr(f"pos div {BLOCK}").alias("k")).agg(turn.alias("t"))
    cut = durable(cut.select("conv_id", "k", F.col("t.turn_name").alias("names"), F.col("t.bytes").alias("bytes")), "blocks")
    full = cut.where(F.size("names") == BLOCK).select("conv_id", "k", name_of(*[F.get("names", F.lit(i)) for i in range(BLOCK)]).alias("content"))
    full = durable(full, "full")
    last = full.agg(F.max("k")).first()[0]
    if last is None:
        named = cut.withColumns({"root": F.lit(ROOT), "next": F.lit(None).cast("binary")})
    else:
        roots = block_roots(full, (last + 1).bit_length())
        begun = cut.join(roots, ["conv_id", "k"], "left").withColumn("root", F.coalesce("root", F.when(F.col("k") == 0, F.lit(ROOT))))
        named = begun.join(roots.select("conv_id", (F.col("k") - 1).alias("k"), F.col("root").alias("next")), ["conv_id", "k"], "left")
    inside = _inside(F.col("root"), F.col("names"), 0, BLOCK)
    below = F.slice(F.array(*inside[:-1], F.col("next")), F.lit(1), F.size("names"))
    return named.select("conv_id", "k", F.concat(F.array("root"), below).alias("path"), "bytes")


# --- totals ------------------------------------------------------------------------------


def _sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def grafted(path: DataFrame, values: DataFrame) -> DataFrame:
    """(name, leaves, saved): sums over subtrees of ``values`` (name, conv_id, depth, leaves, saved), conv_id being a member of the node."""
    # a block's nodes that one conversation stands for are the end of its path: their sums go to the nodes above them
    mine = F.collect_list(F.struct(F.expr(f"int(depth % {BLOCK})").alias("at"), "leaves", "saved"))
    held = values.groupBy("conv_id", F.expr(f"depth div {BLOCK}").alias("k")).agg(mine.alias("v"))
    place = F.posexplode(F.slice("path", 1, BLOCK)).alias("at", "name")
    above = held.join(path, ["conv_id", "k"]).select("v", place)
    below = F.filter("v", lambda x: x["at"] > F.col("at"))
    above = above.withColumn("below", below).where(F.size("below") > 0)
    total = lambda c: F.aggregate(F.col(f"below.{c}"), F.lit(0).cast("long"), lambda a, x: a + x).alias(c)
    parts = values.select("name", "leaves", "saved").unionByName(_sums(above.select("name", total("leaves"), total("saved"))))
    parts = durable(parts, "block-sums")
    deepest = values.agg(F.max("depth")).first()[0] or 0
    height = BLOCK
    while height <= deepest:
        roots = values.where(F.col("depth") % (2 * height) == height).select("name", "conv_id", "depth")
        ready = _sums(parts.join(roots.select("name"), "name", "left_semi"))
        blocks = F.explode(F.sequence(F.expr(f"(depth - {height}) div {BLOCK}"), F.expr(f"depth div {BLOCK} - 1"))).alias("k")
        graft = roots.join(ready, "name").select("conv_id", "leaves", "saved", blocks)
        graft = graft.join(path, ["conv_id", "k"]).select(F.explode(F.slice("path", 1, BLOCK)).alias("name"), "leaves", "saved")
        parts = parts.unionByName(durable(_sums(graft), f"grafts-{height}"))
        height *= 2
    return _sums(parts)


# --- members that end at a node --------------------------------------------------------------


def _hashed(batches):
    """SHA-256 of each node's pieces, which come in order, node by node."""
    import pyarrow as pa

    at, state = None, None
    for batch in batches:
        done = []
        for name, ids in zip(batch["name"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if name != at:
                if at is not None:
                    done.append((at, state.hexdigest()))
                at, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in ((0, pa.binary()), (1, pa.string()))], ["name", "sha"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["name", "sha"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(name, sha) of the ascending, comma-joined conv_ids that end at each node."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = ends.groupBy("name", F.expr(f"conv_id div {PIECE}").alias("piece")).agg(ids.alias("ids"))
    pieces = durable(pieces, "pieces")
    counts = pieces.groupBy("name").agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    counts = durable(counts, "ends")
    alone = counts.where("n = 1").select("name", F.sha2(F.col("ids").cast("binary"), 256).alias("sha"))
    several = pieces.join(counts.where("n > 1").select("name"), "name", "left_semi")
    several = several.repartition("name").sortWithinPartitions("name", "piece").select("name", "ids")
    return alone.unionByName(map_batches(several, _hashed, "name binary, sha string"))


# --- the trie ----------------------------------------------------------------------------------


def trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` are turns as :func:`turns` gives them; ``conversations`` has the conv_ids, those without turns too.
    """
    path = durable(paths(rows), "paths")
    step = F.arrays_zip(
        F.expr("slice(path, 2, size(bytes))").alias("name"), F.expr("slice(path, 1, size(bytes))").alias("parent"), F.col("bytes").alias("bytes")
    )
    numbered = path.select("conv_id", "k", F.posexplode(step).alias("at", "s"))
    every = numbered.select("conv_id", (F.col("k") * BLOCK + F.col("at") + 1).alias("depth"), "s.name", "s.parent", "s.bytes")
    top = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"))
    nodes = every.unionByName(top).groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes")
    )
    nodes = durable(nodes, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = durable(nodes.join(children, "name", "left").fillna(0, ["n_children"]), "families")
    own = nodes.select("name", "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    sums = grafted(path, own)
    lasts = path.groupBy("conv_id").agg(F.max_by(F.element_at("path", -1), "k").alias("name"))
    ends = conversations.join(lasts, "conv_id", "left").select("conv_id", F.coalesce("name", F.lit(ROOT)).alias("name"))
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children").where("n_children > 0")
    out = nodes.join(sums, "name").join(end_hashes(ends), "name", "left").drop("bytes")
    out = durable(out, "sums")
    below = join_heavy(out.where("parent IS NOT NULL").withColumnRenamed("n_children", "children"), parents, "parent", F.col("n_children"), out.count())
    below = below.drop("n_children").withColumnRenamed("children", "n_children")
    out = below.unionByName(out.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(*rebuilt(turns(conversations)))
