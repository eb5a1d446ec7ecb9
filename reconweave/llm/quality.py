"""Quality rules with an isolation forest over rule statistics.

Every document gets counts (words, characters, signs, repeated lines, repeated
three-word windows, capitals, digits, ...). Two base rules fail a document
outright. For the others an isolation forest judges the ratios of the counts:
trees split a random statistic at a random place, and a document that random
splits cut off early, on a short path, is an anomaly. The forest is grown on
good labelled documents, within the box that all labelled documents span, so
"anomalous" means unlike the good. The threshold on the score costs least on
labelled documents, the good ones being held out from growing and weighing
``GOOD_WEIGHT`` bad ones each, by counts at ``STEPS`` steps of the score; of equal thresholds it is the middle one.
Without good labelled documents only the base rules apply.

Fitting uses every labelled document: the box and the threshold are counted over
all of them, and the trees draw from all good ones that are dealt to growing. The counts
and verdicts cover every document and its whole text.

Edge cases: a null or empty text has no words and fails; a null doc_id is
carried and unlabelled; repeated rows give repeated results; of rows that share
a labelled doc_id one is trained on; a doc_id labelled more than once counts as
good only if all its labels are; a score equal to the threshold passes; a very
long text is counted whole, in windows; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconweave.llm.common import WINDOW, durable, map_batches, mix, per_text, space_mask, span_hashes, text_buffer, text_slices, word_bounds

#: Steps of the score at whose ends thresholds are tried.
STEPS = 1 << 16
TREES, TREE_ROWS, DEPTH = 128, 256, 12
#: A good document lost weighs as many bad ones kept.
GOOD_WEIGHT = 20
#: Base rules: fewest words; most words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_marks", "n_distinct",
    "n_long")


def repeated(values: np.ndarray) -> np.ndarray:
    """True where a value occurs more than once."""
    ordered = np.sort(values)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    out = np.zeros(len(values), bool)
    if len(twice):
        for lo in range(0, len(values), WINDOW):
            some = values[lo : lo + WINDOW]
            out[lo : lo + WINDOW] = twice[np.minimum(np.searchsorted(twice, some), len(twice) - 1)] == some
    return out


def count_rules(column) -> dict[str, np.ndarray]:
    """The counts of each text of an Arrow string array."""
    raw, offsets = text_buffer(column)
    n = len(offsets) - 1
    starts, ends = word_bounds(raw, offsets)
    words = span_hashes(raw, starts, ends)
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    out = {"n_words": np.diff(first), "n_long": np.bincount(doc[(ends - starts) > 20], minlength=n)}
    out["word_chars"] = per_text(((raw & 0xC0) != 0x80) & ~space_mask(raw), offsets)
    out["n_symbols"] = per_text(_SYMBOLS[raw], offsets)

    # lines with a word that equal an earlier one of their text
    newlines = np.flatnonzero(raw == 10)
    heads = np.union1d(newlines + 1, offsets[:-1])
    heads = heads[heads < offsets[-1]] if n else heads
    stops = np.searchsorted(newlines, heads)
    tails = np.append(newlines, len(raw))[stops]
    owner = np.searchsorted(offsets, heads, "right") - 1
    tails = np.minimum(tails, offsets[owner + 1])
    worded = np.searchsorted(starts, tails) > np.searchsorted(starts, heads)
    heads, tails, owner = heads[worded], tails[worded], owner[worded]
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    seen, at = np.unique(span_hashes(raw, heads, tails) ^ salt[owner], return_index=True)
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[at], minlength=n)
    del starts, ends, heads, tails, owner, seen, at

    # words under three-word windows that occur again in their text
    m = max(len(words) - 2, 0)
    windows = np.empty(m, np.uint64)
    for lo in range(0, m, WINDOW):
        x, y, z = (words[lo + i : min(lo + WINDOW, m) + i] for i in range(3))
        windows[lo : lo + WINDOW] = mix(mix(mix(x + np.uint64(3)) * np.uint64(5) + y) * np.uint64(7) + z) ^ salt[doc[lo : lo + len(x)]]
    whole = np.flatnonzero(doc[2:] == doc[:-2])
    again = whole[repeated(windows[whole])]
    del windows, whole
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[again + i] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)

    if n == 1:
        out["n_distinct"] = np.array([len(np.unique(words))])
    else:
        _, at = np.unique(words ^ salt[doc], return_index=True)
        out["n_distinct"] = np.bincount(doc[at], minlength=n)
    out["n_capitals"] = per_text((raw >= 65) & (raw <= 90), offsets)
    out["n_digits"] = per_text((raw >= 48) & (raw <= 57), offsets)
    out["n_marks"] = per_text((raw == 33) | (raw == 63) | (raw == 124) | (raw == 95), offsets)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios that the forest splits on, one row per text."""
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_capitals"] / chars,
            c["n_digits"] / chars,
            c["n_marks"] / words,
            c["n_long"] / words,
            np.log1p(c["n_words"]) - np.log1p(c["n_distinct"]) - 0.1 * np.log1p(c["n_words"]),
        ],
        axis=1,
    )


class Forest:
    """Isolation trees in arrays: split column, value, children, and path length at a leaf.

    A tree's splits are drawn from a box, given as two rows, that is cut along
    with them; a part of the box without rows is a leaf at once. So a document
    outside the rows but inside the box ends on a short path.
    """

    def __init__(self, rows: np.ndarray, box: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, depth: int = DEPTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = min(size, len(rows))
        self.unit, self.depth = self.expected(size), depth
        self.column: list[int] = []
        self.value: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.path: list[float] = []
        self.roots = [self._grow(rows[rng.choice(len(rows), size, replace=False)], *box, 0, rng) for _ in range(trees)]
        self.column, self.value, self.child, self.path = map(np.array, (self.column, self.value, self.child, self.path))

    @staticmethod
    def expected(n: int) -> float:
        """Mean path length of a search among n."""
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, rng) -> int:
        node = len(self.path)
        for x, y in ((self.column, 0), (self.value, 0.0), (self.child, (node, node)), (self.path, depth + self.expected(len(rows)))):
            x.append(y)
        if depth < self.depth and len(rows) > 1 and (high > low).any():
            column = int(rng.choice(np.flatnonzero(high > low)))
            value = rng.uniform(low[column], high[column])
            left = rows[:, column] < value
            middle = np.where(np.arange(len(low)) == column, value, high), np.where(np.arange(len(low)) == column, value, low)
            self.column[node], self.value[node] = column, value
            self.child[node] = (self._grow(rows[left], low, middle[0], depth + 1, rng), self._grow(rows[~left], middle[1], high, depth + 1, rng))
        return node

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path) of each row: near 1 for anomalies."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                right = rows[each, self.column[node]] >= self.value[node]
                node = self.child[node, right.astype(np.int64)]
            total += self.path[node]
        return 2 ** (-total / len(self.roots) / max(self.unit, 1e-9))


def rule_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, hi in text_slices(batch["text"]):
                counts = count_rules(batch["text"][lo:hi])
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"][lo:hi], **counts})

    return map_batches(docs, run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_fails(c: dict) -> np.ndarray:
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


FEATURES = tuple(f"f{i}" for i in range(9))


def labelled_features(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """(good, grown, draw, f0..): all labelled documents that the base rules pass; ``grown`` deals the good ones half to the trees, half to the threshold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    # of rows that share a doc_id one is taken, by its counts
    one = counted.groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("c")).join(known, "doc_id").select("doc_id", "good", "c.*")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts = {c: batch[c].to_numpy() for c in COUNTS}
            columns = {"doc_id": batch["doc_id"], "good": batch["good"], **dict(zip(FEATURES, features(counts).T, strict=True))}
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(~base_fails(counts)))

    rows = map_batches(one, run, "doc_id long, good boolean, " + ", ".join(f"{f} double" for f in FEATURES))
    draw = F.xxhash64("doc_id")
    return durable(rows.select("good", (F.col("good") & (draw % 2 == 0)).alias("grown"), draw.alias("draw"), *FEATURES), "features")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """``fit_counts`` of documents."""
    return fit_counts(rule_counts(docs), labels)


def fit_counts(counted: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """Forest and threshold from the counts of all labelled documents; None without enough good ones.

    The box spans all of them, each tree draws its rows from all good ones that
    are dealt to the trees, and the threshold counts the scores of all others. Rows are
    dealt to the trees by their hash; the method wants ``TREE_ROWS`` a tree, so what comes to the driver is bounded.
    """
    rows = labelled_features(counted, labels)
    ends = rows.agg(F.count_if("good"), F.count_if("grown"), *[f(c) for f in (F.min, F.max) for c in FEATURES]).first()
    n_good, n_grown, box = ends[0], ends[1], np.array(ends[2:], np.float64).reshape(2, -1) if ends[0] else None
    if n_good < 20 or not 0 < n_grown < n_good:
        return None
    drawn = rows.where("grown")
    if n_grown > TREES * TREE_ROWS:
        # more rows than all trees take: each is a candidate of one tree, which takes those of smallest hash
        tree = F.pmod(F.xxhash64("draw"), F.lit(TREES))
        place = F.row_number().over(Window.partitionBy("tree").orderBy("draw", *FEATURES))
        drawn = drawn.withColumn("tree", tree).withColumn("place", place).where(F.col("place") <= TREE_ROWS)
    pdf = drawn.orderBy("draw", *FEATURES).select(*FEATURES).toPandas()
    forest = Forest(pdf.to_numpy(np.float64), box)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.stack([batch[f].to_numpy() for f in FEATURES], axis=1)
            yield pa.RecordBatch.from_pydict({"good": batch["good"], "step": step_of(forest.score(x))})

    counts = map_batches(rows.where("not grown"), run, "good boolean, step long").groupBy("step").agg(F.count_if("good"), F.count_if(~F.col("good"))).collect()
    good, bad = np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)
    for step, g, b in counts:
        good[step], bad[step] = g, b
    return forest, threshold(good, bad)


def step_of(score: np.ndarray) -> np.ndarray:
    """The first of ``STEPS`` equal steps from 0 to 1 whose end is no less than the score."""
    return np.clip(np.ceil(score * STEPS - 1e-9), 0, STEPS).astype(np.int64)


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The end of a step at which rows kept up to it cost least, from counts by step: the middle of the longest run of such ends."""
    cost = GOOD_WEIGHT * (good.sum() - np.cumsum(good)) + np.cumsum(bad)
    best = np.flatnonzero(cost == cost.min())
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    run = max(runs, key=len)
    return float((run[0] + run[-1]) // 2 / STEPS)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the counts, base_failed, anomaly score, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = durable(rule_counts(docs), "counts")
    fitted = fit_counts(counted, labels)
    shown = COUNTS[:5]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts = {c: batch[c].to_numpy() for c in COUNTS}
            failed = base_fails(counts)
            score = fitted[0].score(features(counts)) if fitted else np.zeros(len(failed))
            odd = score > fitted[1] + 1e-12 if fitted else np.zeros(len(failed), bool)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], **{c: counts[c] for c in shown}, "base_failed": failed,
                "score": np.round(score, 9), "kept": ~failed & ~odd})

    return map_batches(counted, run, "doc_id long, " + ", ".join(f"{c} long" for c in shown) + ", base_failed boolean, score double, kept boolean")
