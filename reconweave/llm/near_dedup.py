"""Near-duplicate groups: MinHash banding, sequential Bayesian verification, exact check of survivors.

1. Each text gives its set of word shingles, a 128-value MinHash signature and
   a 128-bit key of the set. Texts with equal sets become one class.
2. Signatures are banded. In each bucket the smallest class is the centre.
   Round one tests each class against the smallest centre it shares a bucket
   with, and the two members of each bucket of two. A test compares the signatures in batches of 16 values; after a batch
   the pair is dropped when the posterior probability that its similarity
   reaches the threshold is under ``miss``. Survivors are checked exactly on
   their full shingle sets, and confirmed links give connected components.
3. Round two takes the larger buckets that still hold several components and tests
   every pair across components there, inside numpy tiles that give only the
   links that join components. So each pair that shares a bucket is either
   connected already or tested, and no pair list of a group is written out.
   A bucket of over ``SPLIT`` classes, as a passage makes that many unlike texts
   share, is first split by the other bands, where that at least halves its pairs:
   its classes meet only where they share a second band as well.

At similarity 0.8 a pair shares none of the 32 bands of 4 with probability
5e-8, and only one with 1e-6, which is what splitting can miss at most; the
Bayesian tests add at most ``miss`` per batch.

Edge cases: a null text is empty; a text without words is linked with nothing;
one with fewer words than a shingle is a single shingle of all its words; a
very long text is hashed in windows and its set held whole by one task; a row
with null doc_id is linked with nothing and kept; repeated rows are copies; of
equal choices the smallest doc_id is taken; an empty table gives no rows;
further columns are ignored. doc_id identifies a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconweave.llm.common import LOWER, durable, map_batches, mix, small, span_hashes, text_buffer, text_slices, word_bounds

PERMUTATIONS, ROWS, BATCH = 128, 4, 16
BANDS = PERMUTATIONS // ROWS
PAIRS = "a long, b long"
#: Probability at which a pair's chance of being similar is too small to go on.
MISS = 1e-6
#: Classes of one side of a tile in round two.
TILE = 500
#: Classes of a bucket from which it is split by a second band, where that makes at most one part in GAIN of the pairs.
SPLIT, GAIN = 2000, 2

_seeds = np.random.default_rng(20240229)
_A = _seeds.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_B = _seeds.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the k-word shingles of each text of an Arrow string array."""
    raw, offsets = text_buffer(column)
    raw = LOWER[raw]
    starts, ends = word_bounds(raw, offsets)
    words = span_hashes(raw, starts, ends)
    first = np.searchsorted(starts, offsets)
    del raw, starts, ends
    n = max(0, len(words) - k + 1)
    rolled = np.full(n, np.uint64(k))
    for i in range(k):
        rolled += words[i : i + n]
        rolled *= _STEP
    for lo in range(0, n, 1 << 16):
        rolled[lo : lo + (1 << 16)] = mix(rolled[lo : lo + (1 << 16)])
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(rolled[lo : hi - k + 1]))
        elif hi > lo:
            own = np.full(1, np.uint64(hi - lo))
            for i in range(lo, hi):
                own = (own + words[i]) * _STEP
            out.append(mix(own))
        else:
            out.append(rolled[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, one row each."""
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), PERMUTATIONS), np.uint32)
    for i in range(PERMUTATIONS):
        out[:, i] = np.minimum.reduceat(values * _A[i] + _B[i], at)
    return out


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """After each batch, the matches under which P(similarity >= threshold | matches) < miss, for a uniform prior."""
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def plausible(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows of two signature arrays that pass every batch."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for i, m in enumerate(least):
        cols = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (a[alive, cols] == b[alive, cols]).sum(axis=1)
        ok = matches >= m
        alive, matches = alive[ok], matches[ok]
    return alive


def _stack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, PERMUTATIONS)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key, sig of each document; key and signature null for an empty set."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, text = batch["doc_id"], batch["text"]
            for lo, hi in text_slices(text):
                sets = shingle_sets(text[lo:hi], k)
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full)) if full else iter(())
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                rows = [next(sigs).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                    pa.array(rows, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return map_batches(docs, run, "doc_id long, n_shingles long, set_key binary, sig binary")


def pruned(pairs: DataFrame, reps: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that pass the sequential tests."""
    least = least_matches(threshold, miss)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.select(["a", "b"]).take(plausible(_stack(batch["sig_a"]), _stack(batch["sig_b"]), least))

    sig = reps.select("rep", "sig")
    joined = pairs.join(sig.toDF("b", "sig_b"), "b").join(sig.toDF("a", "sig_a"), "a")
    return map_batches(joined.select("a", "b", "sig_a", "sig_b"), run, PAIRS)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def full_sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, words): the shingle sets of the documents in ids (doc_id), as bytes."""

    def full(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, hi in text_slices(batch["text"]):
                sets = [s.tobytes() for s in shingle_sets(batch["text"][lo:hi], k)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], pa.array(sets, pa.binary())], ["id", "words"])

    ids = durable(ids, "ids")
    chosen = docs.join(small(ids, 48), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
    return durable(map_batches(chosen, full, "id long, words binary"), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar."""

    def check(batches: Iterator) -> Iterator:
        for batch in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x,
                y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).take(np.flatnonzero(ok))

    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, k)
    joined = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    return map_batches(joined.select("a", "b", "x", "y"), check, PAIRS)


def components(links: DataFrame) -> DataFrame:
    """(rep, label): the smallest id of each connected component, for every id in links (a, b).

    Alternating large-star and small-star steps; each round is written out.
    """
    edges = durable(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == state:
            break
        state = mark
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
        large = both.where("v > u").join(low, "u").select("v", "m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        step = large.join(least, "v")
        pairs = F.array(F.struct(F.col("least").alias("a"), F.col("v").alias("b")), F.struct(F.col("least").alias("a"), F.col("m").alias("b")))
        edges = durable(step.select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a < b").distinct(), "edges")
    stars = edges.select(F.col("b").alias("rep"), F.col("a").alias("label"))
    return stars.union(edges.select("a", "a").distinct())


def partners(sig: np.ndarray, label: np.ndarray, band: int, second: int, least: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a bucket the later rows of other labels that are plausible and share no earlier band with it.

    In a part of a split bucket, where rows share ``second`` too (else -1), they
    share none between the two either.
    """
    before = np.array([i for i in range(max(band, second)) if i != band and (i < band or second >= 0)], np.int64)
    for x in range(len(label) - 1):
        y = x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
        y = y[plausible(np.broadcast_to(sig[x], (len(y), PERMUTATIONS)), sig[y], least)]
        if len(before) and len(y):
            bands = sig.reshape(len(sig), BANDS, ROWS)
            earlier = (bands[y][:, before] == bands[x, before]).all(axis=2).any(axis=1)
            y = y[~earlier]
        if len(y):
            yield x, y


def split_buckets(at: DataFrame, reps: DataFrame, split: int) -> DataFrame:
    """(band, second, key, rep, label): buckets of up to ``split`` classes as they are, larger ones by each other band, parts of one label left out."""
    whole = at.select("band", F.lit(-1).alias("second"), "key", "rep", "label")
    large = durable(at.groupBy("key").agg(F.count("*").alias("n_all")).where(F.col("n_all") > split), "large")
    if large.isEmpty():
        return whole
    spread = at.join(small(large, 24), "key").join(reps.select("rep", "sig"), "rep")
    others = F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: j != F.col("band"))
    parts = F.transform(others, lambda j: F.struct(j.alias("second"), F.xxhash64("key", j,
        F.substring("sig", j * 4 * ROWS + 1, F.lit(4 * ROWS))).alias("part")))
    spread = spread.select("band", F.col("key").alias("bucket"), "n_all", "rep", "label", F.explode(parts).alias("p"))
    spread = spread.select("band", "p.second", F.col("p.part").alias("key"), "rep", "label", "bucket", "n_all")
    spread = durable(spread, "spread")
    sizes = spread.groupBy("bucket", "n_all", "key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = durable(sizes.where("lo <> hi").select("bucket", "n_all", "key", "n"), "mixed-parts")
    # a bucket whose classes mostly share second bands too is left whole, as its parts would make more pairs, not fewer
    work = mixed.groupBy("bucket").agg(F.sum(F.col("n") * F.col("n")).alias("work"))
    fewer = F.coalesce("work", F.lit(0)) * GAIN <= F.col("n_all") * F.col("n_all")
    worth = durable(large.join(work, F.col("key") == F.col("bucket"), "left").where(fewer).select("key"), "worth")
    kept = spread.join(small(worth.withColumnRenamed("key", "bucket"), 16), "bucket", "left_semi")
    kept = kept.join(mixed.select("bucket", "key"), ["bucket", "key"], "left_semi")
    return durable(whole.join(small(worth, 16), "key", "left_anti").unionByName(kept.drop("bucket", "n_all")), "split")


def across(members: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """Confirmed links between components that meet in a bucket, at least as many as connect them.

    A pair belongs to the first band that it shares. A first pass over the
    signatures of a tile finds the classes with a plausible partner there; a
    second one gets the shingle sets of those, and checks pairs exactly unless
    links found before connect them already.
    """
    least = least_matches(percent / 100, miss)
    at = members.where("n > 2").join(labels, "rep", "left").select("band", "key", "rep", F.coalesce("label", "rep").alias("label"))
    at = durable(at, "labelled")
    mixed = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    at = split_buckets(at.join(small(durable(mixed, "mixed"), 16), "key", "left_semi"), reps, SPLIT)
    sizes = at.groupBy("key", "label").count()
    most = sizes.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("n_main"),
        F.sum("count").alias("n_all"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    most = durable(most.select("key", "main", tiles(F.col("n_main")).alias("mains"), tiles(F.col("n_all") - F.col("n_main")).alias("others")),
        "buckets")
    rows = at.join(small(most, 32), "key")
    # a tile is (main i, other j), i from 0, or (other i, other j), i below 0
    own = lambda n: F.pmod(F.xxhash64("rep"), n)
    main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(own(F.col("mains")).cast("int").alias("i"), j.alias("j")))
    mine = own(F.col("others")).cast("int")
    other = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: F.struct(i.alias("i"), mine.alias("j"))),
        F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct((-1 - F.least(j, mine)).alias("i"),
            F.greatest(j, mine).alias("j"))),
    )
    dealt = rows.withColumn("tile", F.explode(F.when(F.col("label") == F.col("main"), main).otherwise(other)))
    dealt = durable(dealt.select("band", "second", "key", "tile.i", "tile.j", "rep", "label"), "dealt")
    sig = reps.select("rep", "sig")

    def find(table):
        import pyarrow as pa

        label, found = table["label"].to_numpy(), np.zeros(table.num_rows, bool)
        for x, y in partners(_stack(table["sig"]), label, table["band"][0].as_py(), table["second"][0].as_py(), least):
            found[x] = True
            found[y] = True
        return table.select(["key", "i", "j", "rep"]).filter(pa.array(found))

    def settle(table):
        import pyarrow as pa

        rep, label = table["rep"].to_numpy(), table["label"].to_numpy().copy()
        sets = [np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()]
        links = []
        for x, ys in partners(_stack(table["sig"]), label.copy(), table["band"][0].as_py(), table["second"][0].as_py(), least):
            for y in ys.tolist():
                if label[x] != label[y] and similar(sets[x], sets[y], percent):
                    links.append((rep[x], rep[y]))
                    label[label == label[y]] = label[x]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    tile = ["key", "i", "j"]
    wanted = durable(dealt.join(sig, "rep").select("band", "second", *tile, "rep", "label", "sig").groupBy(*tile).applyInArrow(find,
        "key long, i int, j int, rep long"), "wanted")
    if wanted.isEmpty():
        return wanted.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    sets = full_sets(wanted.select(F.col("rep").alias("doc_id")).distinct(), docs, k)
    again = dealt.join(wanted, [*tile, "rep"]).join(sig, "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
    return again.select("band", "second", *tile, "rep", "label", "sig", "words").groupBy(*tile).applyInArrow(settle, PAIRS).distinct()


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked doc_id), kept (it is that one)."""
    threshold = percent / 100
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = durable(sketch(docs, k), "sketches")
    known = sketches.where("n_shingles > 0 and doc_id is not null")
    reps = durable(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "reps")
    band = [F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)]
    bands = reps.select("rep", F.posexplode(F.array(*band)).alias("band", "key"))
    centres = durable(bands.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1"), "centres")
    members = durable(bands.join(small(centres, 32), "key"), "members")
    apart = members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b"), "n")
    # round two leaves buckets of two out, so each of them is tested here
    pairs = apart.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(apart.where("n = 2").select("a", "b")).distinct()
    first = durable(confirmed(durable(pruned(pairs, reps, threshold, miss), "pairs"), docs, k, percent), "links")
    labels = durable(components(first), "labels")
    more = durable(across(members, labels, reps, docs, k, percent, miss), "across")
    if not more.isEmpty():
        stars = labels.select(F.col("label").alias("a"), F.col("rep").alias("b")).where("a < b")
        labels = durable(components(stars.union(more)), "labels")
    grouped = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).join(labels, "rep", "left")
    grouped = durable(grouped.where("copies > 1 or label < rep").select("set_key", F.coalesce("label", "rep").alias("component")), "grouped")
    out = sketches.select("doc_id", "n_shingles", "set_key").join(small(grouped, 40), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but for those linked with a smaller doc_id; all columns as they are."""
    gone = durable(near_groups(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone_id")).distinct(), "gone")
    return docs.join(small(gone, 16), F.col("doc_id").cast("long") == F.col("__gone_id"), "left_anti")
