"""Mixing of sources to target weights by Pfair scheduling.

A source's documents, in a fixed pseudo-random order, are laid end to end and
cut into blocks of ``block_bytes``. Time runs in slots of one block. Of all
weights W, a source of weight w gives its block i the release time
floor(i * W / w) and the deadline ceil((i + 1) * W / w), by exact whole-number
arithmetic; of the released blocks the one with the earliest deadline takes the
next slot. So after any number of slots each source is less than one block from
its share, however long the mix is.

Time is cut into spans of ``span`` slots that are scheduled apart from each
other. What a source has had by a cut is its share rounded down, or up for the sources
with the largest fractions, so that the shares add up; a span schedules the
blocks between its two cuts, by a fold over its slots on one row of as many
jobs.

All documents get a slot; when a source ends, its slots stay empty and the
others go on in the same proportions. ``in_mix`` tells which slots come before
sources with over a tenth of the weight have ended: the part of the whole in
which the target weights hold. ``mixture`` cuts there; ``in_order`` keeps every
document.

Default weights: a source weighs its bytes.

Only built-in functions are used. A span has at least four slots for each
source, so the table of cuts is no larger than that of blocks; a table is
broadcast only where it is counted as small.

Edge cases: a null source counts as the source named ''; a null text has no
bytes (each document counts 8 bytes more than its text); a text longer than a
block stays whole, and blocks whose range it covers stay empty; of blocks with
one deadline the source first in the alphabet goes first; a source without a given
weight gets the smallest one given; repeated rows take places side by side; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconweave.llm.common import durable, small, utf8_bytes

#: Slots that one fold schedules.
SPAN = 512
BLOCK_BYTES = 64 << 10
#: The mix ends when sources with more than one part in ENDED of the weight have ended.
ENDED = 10
#: Documents of a source, about, whose sizes are summed in one window.
CHUNK_ROWS = 1_000


def order_key(doc_id: Column) -> Column:
    """The fixed pseudo-random order of documents within a source."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def _whole(x: str) -> Column:
    """A whole number whose products do not overflow."""
    return F.expr(x).cast("decimal(19,0)")


def _shares(rows: DataFrame, total: int, span: int, first: Column, never: Column) -> DataFrame:
    """``rows`` (source, weight, at) with ``done``: blocks by slot at * span, the shares rounded down, or up for as many sources as are needed to fill the slots.

    Up go the sources of ``first``, then those with the largest fractions; those of ``never`` stay down.
    """
    rows = rows.withColumn("due", _whole(f"at * {span}") * _whole("weight"))
    rows = rows.withColumns({"base": F.expr(f"due div {total}BD"), "rest": F.expr(f"due % {total}BD")})
    left = F.col("at") * span - F.sum("base").over(Window.partitionBy("at"))
    order = Window.partitionBy("at").orderBy(F.when(first, 0).when(never, 2).otherwise(1), F.desc("rest"), "source")
    return rows.select("source", "weight", "at", (F.col("base") + (F.row_number().over(order) <= left).cast("long")).alias("done"))


def cuts(target: DataFrame, total: int, slots: int, span: int) -> DataFrame:
    """(source, weight, at, done, next): what each source has had by slot at * span, and by the next cut.

    Cuts are found by halving, all intervals of a level at once. A source that is
    rounded up at an interval's beginning is at its middle while the same block is due,
    and one rounded down at its end is so before, so a source never goes back.
    """
    step = 1
    while step * span < slots:
        step *= 2
    no = F.lit(False)
    ends = target.select("source", "weight", F.explode(F.array(F.lit(0), F.lit(step)).cast("array<long>")).alias("at"))
    known = _shares(ends, total, span, no, no)
    while True:
        after = known.select("source", (F.col("at") - step).alias("at"), F.col("done").alias("next"))
        known = durable(known.join(after, ["source", "at"], "left"), "cuts")
        if step == 1:
            return known.where("next IS NOT NULL")
        step //= 2
        middle = known.where("next IS NOT NULL").select("source", "weight", (F.col("at") + step).alias("at"), "done", "next")
        middle = _shares(middle, total, span, F.col("done") > F.col("base"), F.col("next") <= F.col("base"))
        known = known.drop("next").unionByName(middle)


def schedule(target: DataFrame, slots: int, span: int = SPAN) -> DataFrame:
    """(source, block, slot) of the first ``slots`` slots at least, for sources of whole weights: earliest deadline first, span by span."""
    total, n = target.agg(F.sum("weight"), F.count("*")).first()
    if not n:
        return target.select("source", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot"))
    while span < 4 * n:
        span *= 2
    jobs = cuts(target, total, slots, span).where("next > done").select("source", "weight", "at", F.explode(F.expr("sequence(done, next - 1)")).alias("block"))
    release = F.expr(f"(cast(block as decimal(19,0)) * {total}BD) div cast(weight as decimal(19,0))")
    deadline = F.expr(f"(cast(block + 1 as decimal(19,0)) * {total}BD + weight - 1) div cast(weight as decimal(19,0))")
    job = F.struct(deadline.alias("deadline"), "source", "block", release.alias("release"))
    one = jobs.groupBy("at").agg(F.sort_array(F.collect_list(job)).alias("jobs"))
    one = one.select("at", "jobs", F.transform("jobs", lambda j, i: F.struct(i.alias("i"), j["release"].alias("release"))).alias("waiting"))

    def step(state: Column, t: Column) -> Column:
        # jobs wait in order of their deadlines; if none is released the first goes early
        ready = F.filter(state["waiting"], lambda j: j["release"] <= t)
        taken = F.array(F.coalesce(F.get(ready, F.lit(0)), F.get(state["waiting"], F.lit(0)))["i"])

        def go(i: Column) -> Column:
            return F.struct(F.filter(state["waiting"], lambda j: j["i"] != i).alias("waiting"), F.array_append(state["order"], i).alias("order"))

        return F.element_at(F.transform(taken, go), 1)

    ticks = F.expr(f"sequence(at * {span}, at * {span} + size(jobs) - 1)")
    start = F.struct(F.col("waiting"), F.array().cast("array<int>").alias("order"))
    slot = one.select("at", "jobs", F.posexplode(F.aggregate(ticks, start, step)["order"]).alias("t", "i"))
    out = slot.select(F.element_at("jobs", F.col("i") + 1).alias("j"), (F.col("at") * span + F.col("t")).alias("slot"))
    return out.select("j.source", "j.block", "slot")


def _weights(sizes: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(source, bytes, n, weight) by default or given weights, in whole millionths."""
    if weights is None:
        return sizes.withColumn("weight", F.col("bytes"))
    given = {s: max(1, round(w * 1_000_000)) for s, w in weights.items()}
    table = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
    return sizes.withColumn("weight", F.coalesce(table[F.col("source")], F.lit(min(given.values()))).cast("long"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, span: int = SPAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, source, size, block, slot, place (in the block), release, deadline, in_mix.

    The mixed order is by (slot, place). ``weights`` gives targets by source;
    a source without one gets the smallest.
    """
    rows = durable(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
            (utf8_bytes(F.col("text")) + 8).alias("size"),
        ).withColumn("key", order_key(F.col("doc_id"))),
        "rows",
    )
    sizes = durable(_weights(rows.groupBy("source").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), weights), "sizes")
    total = sizes.agg(F.sum("weight")).first()[0] or 1
    # a source's last block is done by its deadline
    ends = sizes.select("weight", F.expr(f"(bytes + {block_bytes - 1}) div {block_bytes}").alias("blocks"))
    ends = ends.select("weight", F.expr(f"(cast(blocks as decimal(19,0)) * {total}BD + weight - 1) div cast(weight as decimal(19,0))").alias("end"))
    last = ends.agg(F.max("end")).first()[0] or 0
    slots = durable(schedule(sizes.select("source", "weight"), last, span), "slots")

    # running sizes per source, chunk by chunk in the order of the key; a source has as many chunks as its rows need
    chunks = sizes.select("source", F.ceil(F.col("n") / CHUNK_ROWS).alias("chunks"))
    rows = rows.join(small(chunks, 40), "source")
    part = F.conv(F.substring("key", 1, 6), 16, 10).cast("long")
    rows = rows.withColumn("chunk", F.floor(part * F.col("chunks") / (1 << 24)).cast("int")).drop("chunks")
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "chunk").agg(F.sum("size").alias("total"))
    base = base.select("source", "chunk", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "chunk").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["source", "chunk"])
    rows = rows.select("doc_id", "source", "size", "key", F.expr(f"(base + start) div {block_bytes}").alias("block"))

    # the mix ends with the first end by which enough weight is gone; ends are ranked apart by their lengths in bits
    ends = ends.groupBy("end").agg(F.sum("weight").alias("weight")).withColumn("bits", F.length(F.bin("end")))
    lower = Window.orderBy("bits").rowsBetween(Window.unboundedPreceding, -1)
    smaller = ends.groupBy("bits").agg(F.sum("weight").alias("all")).select("bits", F.coalesce(F.sum("all").over(lower), F.lit(0)).alias("before"))
    gone = F.sum("weight").over(Window.partitionBy("bits").orderBy("end"))
    ends = ends.withColumn("gone", gone).join(F.broadcast(smaller), "bits")
    horizon = ends.where((F.col("gone") + F.col("before")) * ENDED > total).agg(F.min("end")).first()[0] or 0

    out = rows.join(small(slots.select("source", "block", "slot"), 48), ["source", "block"])
    out = out.join(small(sizes.select("source", "weight"), 40), "source")
    place = F.row_number().over(Window.partitionBy("source", "block").orderBy("key", "doc_id", "size")) - 1
    return out.select(
        "doc_id",
        "source",
        "size",
        "block",
        "slot",
        place.cast("long").alias("place"),
        F.expr(f"(cast(block as decimal(19,0)) * {total}BD) div cast(weight as decimal(19,0))").alias("release"),
        F.expr(f"(cast(block + 1 as decimal(19,0)) * {total}BD + weight - 1) div cast(weight as decimal(19,0))").alias("deadline"),
        (F.col("slot") < F.lit(horizon)).alias("in_mix"),
    )


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, span: int = SPAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in the mix; all columns as they are.

    A source's part is a prefix of its order, so one bound per source carries
    the decision back to the rows and no text is shuffled.
    """
    bound = F.struct(order_key(F.col("doc_id")).alias("key"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"))
    cuts = durable(mix(docs, weights, span, block_bytes).where("in_mix").groupBy(F.col("source").alias("__source")).agg(F.max(bound).alias("__cut")), "cuts")
    mine = F.struct(order_key(F.col("doc_id").cast("long")).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"))
    same = F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("__source")
    return docs.join(small(cuts, 80), same & (mine <= F.col("__cut")), "left_semi")


def in_order(docs: DataFrame, weights: dict[str, float] | None = None, span: int = SPAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows of ``docs`` in the mixed order; all columns as they are."""
    at = mix(docs, weights, span, block_bytes).select(
        F.coalesce("doc_id", F.lit(0)).alias("__doc_id"), F.col("doc_id").isNull().alias("__null"), F.col("source").alias("__source"),
            F.col("size").alias("__size"), "slot", "place"
    )
    # rows alike in these columns are side by side in the order, so all take the first one's place
    at = at.groupBy("__doc_id", "__null", "__source", "__size").agg(F.min(F.struct("slot", "place")).alias("__at"))
    at = durable(at, "places")
    keyed = docs.withColumns(
        {
            "__doc_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
            "__null": F.col("doc_id").cast("long").isNull(),
            "__source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "__size": utf8_bytes(F.col("text")) + 8,
        }
    )
    # always a shuffled join: there are as many places as documents
    placed = keyed.join(at, ["__doc_id", "__null", "__source", "__size"], "left")
    return placed.orderBy("__at").select(*docs.columns)
