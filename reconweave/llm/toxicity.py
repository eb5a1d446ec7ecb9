"""Toxicity by maximal scoring segments of token log-odds.

*Tokens.* Words, lower-cased, score the log-odds of the toxic class. The classes'
shares of a word have a Dirichlet prior: the shares of the words that begin
alike, which have those of shorter beginnings as their prior in turn, up to the
shares of all words. So a rare or unseen word is judged by its stem. Counts are
kept in ``BUCKETS`` hash buckets for each length of a beginning, so the table
that goes to all tasks has one size whatever the input.

*Segments.* A scan in linear time over each whole text finds all maximal scoring
segments, the passages whose score no longer or shorter passage around them
beats. Words that tell nothing score ``DRIFT`` less than nothing, so chance
passages stay short.

*Significance.* The best segment of a clean text of n words follows an extreme
value law, P(S >= s) = 1 - exp(-K n exp(-lambda s)). Lambda and K are fitted to
the clean labelled texts, each scored without its own counts. A passage whose
expected number by chance is under ``SIGNIFICANT`` is returned with its place. A
document's evidence, the best passage's significance and score and the mass of all
passages, is turned into a probability by a logistic curve fitted to the same
texts.

Labels come only from rows whose crc32(doc_id) mod 5 is not 0, at most ``SAMPLE``
of each class, those of smallest hash. Nothing but the text enters a score.

Edge cases: a null or empty text has no words and gets the score of a text
without evidence; a null doc_id is hashed as an empty text; a null label is
none, and a document with several labels is toxic if one says so; where only one class is
labelled, or none, every score is that class's share (0 without labels); a score of
exactly one half is toxic; of segments with equal scores each is returned; very long
texts are scanned whole; repeated rows are scored alike; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconweave.llm.common import LOWER, durable, map_batches, small, span_hashes, text_buffer, text_slices, word_bounds

#: Labelled rows of each class from which the model is fitted, at most.
SAMPLE = 20_000
#: Bytes of the beginnings that words are grouped by, shortest first; then the whole word.
STEMS = (3, 4, 5, 6, 8)
BUCKETS = 1 << 18
#: Weight of a beginning's prior, in words.
PRIOR = 2.0
#: What a word without evidence takes from a passage's score.
DRIFT = 2.0
#: Expected passages by chance, below which a passage is reported.
SIGNIFICANT = 0.01
#: Scores of a segment from which it adds to a document's mass.
MASS_FROM = 1.0
HELD = 5

# bytes that belong to words keep their lower-cased value, all others become spaces
_WORDS = np.where(np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]), LOWER, 32).astype(np.uint8)

SCORES = "doc_id long, held_out boolean, score double, predicted int, n_words long, best double, n_passages long, passages string"


def held_out(doc_id: Column) -> Column:
    """Whether a row's label may not be learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD == 0


# --- tokens in numpy -------------------------------------------------------------------


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts and ends of the words."""
    low = _WORDS[raw]
    capital = (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3)
    low[1:][capital] += 0x20
    return low, *word_bounds(low, offsets)


def keys_of(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Buckets of each word's beginnings and of the word, one row a length, each in a range of its own."""
    rows = [span_hashes(low, starts, np.minimum(starts + k, ends)) for k in STEMS]
    rows.append(span_hashes(low, starts, ends))
    return np.stack([(h % np.uint64(BUCKETS)).astype(np.int64) + i * BUCKETS for i, h in enumerate(rows)])


@dataclass
class Odds:
    """Counts of words by bucket, toxic and all, and the toxic share of all words."""

    toxic: np.ndarray
    every: np.ndarray
    share: float

    def scores(self, keys: np.ndarray, own: list[np.ndarray] | None = None, toxic: np.ndarray | None = None) -> np.ndarray:
        """Log-odds of each word less the drift; with ``own``, each word's counts within its text by length, these are left out of the counts of the text's class."""
        # the share and what it lacks to one are kept apart: near one, 1 - p would round to nothing and the odds to infinity
        p, q = np.full(keys.shape[1], self.share), np.full(keys.shape[1], 1 - self.share)
        for i, row in enumerate(keys):
            bad, every = self.toxic[row].astype(np.float64), self.every[row].astype(np.float64)
            if own is not None:
                every = np.maximum(every - own[i], 0)
                bad = np.where(toxic, np.clip(bad - own[i], 0, every), np.minimum(bad, every))
            p, q = (bad + PRIOR * p) / (every + PRIOR), (every - bad + PRIOR * q) / (every + PRIOR)
        return np.log(p) - np.log(q) - np.log(self.share) + np.log(1 - self.share) - DRIFT


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence, in order, in linear time.

    Only positive scores open segments, so the scan visits these alone. Each
    candidate keeps its score before and after, and a link to the nearest earlier one
    that begins lower; links are followed once, as what they pass is merged.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    first, end, low, high, link = [], [], [], [], []
    for at in np.flatnonzero(scores > 0):
        a, b, lo, hi = int(at), int(at) + 1, sums[at], sums[at + 1]
        while True:
            j = len(first) - 1
            while j >= 0 and low[j] >= lo:
                j = link[j]
            if j < 0 or high[j] >= hi:
                break
            # the two and what lies between them are one segment
            a, lo = first[j], low[j]
            del first[j:], end[j:], low[j:], high[j:], link[j:]
        first.append(a), end.append(b), low.append(lo), high.append(hi), link.append(j)
    return [(a, b, float(y - x)) for a, b, x, y in zip(first, end, low, high, strict=True)]


@dataclass
class Texts:
    """A slice of an Arrow column: its first row, bytes, and words; words cuts[i] to cuts[i + 1] are those of text i."""

    first: int
    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    cuts: np.ndarray

    def segments(self, scores: np.ndarray):
        """(text, maximal segments as words of the slice) of each text with a word that scores."""
        positive = np.searchsorted(self.cuts, np.flatnonzero(scores > 0), "right") - 1
        for i in np.unique(positive):
            a = int(self.cuts[i])
            yield int(i), [(a + x, a + y, s) for x, y, s in maximal_segments(scores[a : self.cuts[i + 1]])]


def _slices(column):
    """The texts of an Arrow column, slice by slice, so that work arrays stay small."""
    for lo, hi in text_slices(column):
        raw, offsets = text_buffer(column.slice(lo, hi - lo))
        low, starts, ends = words_of(raw, offsets)
        yield Texts(lo, raw, offsets, starts, ends, keys_of(low, starts, ends), np.searchsorted(starts, offsets))


# --- fitting -----------------------------------------------------------------------------


def training_texts(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic): labelled texts that may be learnt from, at most ``most`` of each class, by the hash of their doc_id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    chosen = durable(chosen[0].unionByName(chosen[1]), "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(chosen, 12), "doc_id")
    return durable(texts.select("text", "toxic"), "texts")


def _count(batches):
    import pyarrow as pa

    counts = [np.zeros((len(STEMS) + 1) * BUCKETS, np.int64) for _ in range(2)]
    for batch in batches:
        toxic = batch["toxic"].to_numpy()
        for t in _slices(batch["text"]):
            bad = np.repeat(toxic[t.first : t.first + len(t.cuts) - 1] == 1, np.diff(t.cuts))
            for side in (0, 1):
                found, n = np.unique(t.keys[:, bad == side], return_counts=True)
                counts[side][found] += n
    seen = np.flatnonzero(counts[0] + counts[1])
    for at in range(0, len(seen), 1 << 16):
        part = seen[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[1][part]), pa.array((counts[0] + counts[1])[part])], ["bucket", "toxic", "every"])


def word_odds(texts: DataFrame) -> Odds | None:
    """The counts of labelled texts; none where there are not both classes. As many rows come to the driver as there are buckets, at most."""
    counts = map_batches(texts.select("text", "toxic"), _count, "bucket long, toxic long, every long")
    found = counts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("every").alias("every")).toArrow()
    size = (len(STEMS) + 1) * BUCKETS
    at = found["bucket"].to_numpy()
    toxic, every = np.zeros(size, np.float32), np.zeros(size, np.float32)
    toxic[at], every[at] = found["toxic"].to_numpy(), found["every"].to_numpy()
    total, bad = float(every[-BUCKETS:].sum()), float(toxic[-BUCKETS:].sum())
    return Odds(toxic, every, bad / total) if 0 < bad < total else None


@dataclass
class Law:
    """The extreme value law of clean texts, and the curve from evidence to probability."""

    rate: float
    log_k: float
    curve: np.ndarray

    def evidence(self, n, best, mass) -> np.ndarray:
        n, best, mass = (np.asarray(x, np.float64) for x in (n, best, mass))
        size = np.log(np.maximum(n, 1))
        # the mass that a clean text of this length has by chance
        chance = np.exp(np.minimum(self.log_k + size - self.rate * MASS_FROM, 50)) / self.rate
        # beyond about 30 a chance passage is out of the question, so more adds little
        return np.stack([np.ones_like(size), np.tanh((self.rate * best - self.log_k - size) / 30) * 30, np.log1p(mass / (1 + chance)), np.log1p(best)], axis=-1)

    def probability(self, n, best, mass) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(n, best, mass) @ self.curve, -30, 30)))


def fit_law(toxic: np.ndarray, n: np.ndarray, best: np.ndarray, mass: np.ndarray, weights: np.ndarray) -> Law:
    """Lambda and K by maximum likelihood on clean texts, then a logistic curve with a small ridge by Newton steps."""
    clean = (toxic == 0) & (n > 0)
    s, size = best[clean], np.log(n[clean])
    rate, log_k = 1.0, 0.0
    found = s > 0
    if found.any():
        # a text without a segment tells only that none reached zero; the slope of the likelihood in lambda, with K at its best, has one root, found by halving
        low, high = 1e-6, 20.0
        for _ in range(60):
            rate = (low * high) ** 0.5
            w = np.exp(size - size.max() - rate * s)
            low, high = (rate, high) if 1 / rate > s[found].mean() - (s * w).sum() / w.sum() else (low, rate)
        log_k = float(np.log(found.sum()) - np.log(np.exp(size - size.max() - rate * s).sum()) - size.max())
    law = Law(float(rate), log_k, np.zeros(4))
    z = law.evidence(n, best, mass)
    ridge = np.diag([1e-3, 1e-2, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ law.curve, -30, 30)))
        slope = z.T @ (weights * (toxic - p)) - ridge @ law.curve
        bend = (z * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge
        step = np.linalg.solve(bend, slope)
        law.curve = law.curve + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return law


def _evidence(odds):
    def run(batches):
        import pyarrow as pa

        model = odds.value
        for batch in batches:
            toxic = batch["toxic"].to_numpy()
            n, best, mass = (np.zeros(len(toxic)) for _ in range(3))
            for t in _slices(batch["text"]):
                size = np.diff(t.cuts)
                n[t.first : t.first + len(size)] = size
                text = np.repeat(np.arange(len(size)), size)
                own = []
                for row in t.keys:
                    _, at, many = np.unique(text * t.keys.max(initial=0) + text + row, return_inverse=True, return_counts=True)
                    own.append(many[at])
                for i, found in t.segments(model.scores(t.keys, own, toxic[t.first + text] == 1)):
                    best[t.first + i] = max(s for *_, s in found)
                    mass[t.first + i] = sum(max(0.0, s - MASS_FROM) for *_, s in found)
            yield pa.RecordBatch.from_arrays([pa.array(toxic), pa.array(n), pa.array(best), pa.array(mass)], ["toxic", "n", "best", "mass"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE):
    """(odds, law): the model, both parts broadcast or plain values of one size; or (None, share) where there are not both classes."""
    spark = docs.sparkSession
    texts = training_texts(docs, labels, most)
    odds = word_odds(texts)
    if odds is None:
        share = texts.agg(F.avg("toxic")).first()[0]
        return None, 1.0 if share == 1 else 0.0
    sent = spark.sparkContext.broadcast(odds)
    # two numbers and two counts for each of the bounded number of labelled texts
    rows = map_batches(texts.select("text", F.col("toxic").cast("int").alias("toxic")), _evidence(sent), "toxic int, n double, best double, mass double").toArrow()
    toxic, n, best, mass = (rows[c].to_numpy() for c in ("toxic", "n", "best", "mass"))
    # classes are weighed as they stand among all labelled rows, not as they were sampled
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id").cast("long")))
    real = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    weights = np.where(toxic == 1, real.get(1, 0) / max(1, (toxic == 1).sum()), real.get(0, 0) / max(1, (toxic == 0).sum()))
    return sent, fit_law(toxic, n, best, mass, weights / max(weights.mean(), 1e-9))


# --- scoring -------------------------------------------------------------------------------


def _places(raw: np.ndarray, begin: int, spans: list[tuple[int, int]]) -> str:
    """Byte spans as code points from the text's beginning."""
    if not spans:
        return ""
    end = spans[-1][1]
    points = np.concatenate([[0], np.cumsum((raw[begin:end] & 0xC0) != 0x80)])
    return ",".join(f"{points[a - begin]}:{points[b - begin]}" for a, b in spans)


def _score(odds, law):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            size = len(batch)
            n, best, mass, many = np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
            places = [""] * size
            if odds is not None:
                for t in _slices(batch["text"]):
                    size = np.diff(t.cuts)
                    n[t.first : t.first + len(size)] = size
                    least = (law.log_k + np.log(np.maximum(size, 1)) - np.log(SIGNIFICANT)) / law.rate
                    for i, found in t.segments(odds.value.scores(t.keys)):
                        row = t.first + i
                        best[row] = max(s for *_, s in found)
                        mass[row] = sum(max(0.0, s - MASS_FROM) for *_, s in found)
                        sure = [(int(t.starts[a]), int(t.ends[b - 1])) for a, b, s in found if s >= least[i]]
                        many[row], places[row] = len(sure), _places(t.raw, int(t.offsets[i]), sure)
                score = law.probability(n, best, mass)
            else:
                score = np.full(size, law)
            columns = [batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(n), pa.array(best), pa.array(many), pa.array(places, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "n_words", "best", "n_passages", "passages"])

    return run


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; n_words, the best segment's score, and the significant passages as code points start:end."""
    odds, law = fitted(docs, labels, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return map_batches(rows, _score(odds, law), SCORES)
