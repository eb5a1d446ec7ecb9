"""Spelling variants: words one edit apart, found by Gram matrices of letter counts in blocks.

Words that differ by one inserted or deleted letter have letter counts at
squared distance 1; one replaced letter makes it 2. NumPy multiplies a block of
letter counts with itself, keeps the pairs at distance 1 in adjacent lengths and
at distance 2 in the same length, and only these are compared letter by letter.

Blocks are exact. Two words of lengths m and m or m + 1 that are one edit apart
agree either in their first m div 2 letters or in all that follow these in the
shorter one. So a word enters, for each of the two lengths m it can take part
in, one block by its beginning and one by its end. A block of over ``LIMIT``
words is split by halving the part that is still open in the same way, again
and again. A pair that several blocks hold counts in one: the one that its
common beginning leads to. No pair is lost and none counts twice.

Within a task, blocks that stand next to each other are multiplied together, up
to ``TILE`` words, and larger ones tile by tile, so no more than a tile of
distances is held at once.

A word's form has at least ten times its count, so following forms ends after
log10 of the largest count; roots are found by doubling the steps.

Edge cases: a null text has no words; a null doc_id is written as an empty text
before the colon; ties between forms go to the word first in code-point order;
repeated rows count as often as they stand there; very long runs of letters
are words like others (their counts are compared in doubles); an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconweave.llm.common import durable, map_batches, small

#: Letters of a word, at least, and occurrences of it.
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form has so many times its word's occurrences.
RATIO = 10
#: Words of a block before it is split, and rows and columns of a matrix of distances.
LIMIT, TILE = 8192, 256
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
NEAR = "word string, near long, best_n long, best string"


def runs(docs: DataFrame) -> DataFrame:
    """(word): each maximal run of letters, A-Z lower-cased, where one in 31 loses a letter."""
    low = F.translate(F.col("run"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(LETTERS), F.lit(0))).alias("run"),
    )
    found = found.where(F.length("run") >= LEAST_LETTERS).select("id", low.alias("run"))
    found = found.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of words with enough letters and occurrences."""
    words = runs(docs).where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in the two blocks that halving the open part ``lo`` to ``hi`` of its block makes."""
    mid = F.expr("lo + (hi - lo) div 2")
    sides = F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi")))
    out = rows.select("word", "n", "m", F.explode(sides).alias("open")).select("word", "n", "m", "open.lo", "open.hi")
    return out.withColumn("block", _block())


def _block() -> Column:
    """The key of the letters outside the open part; where two keys meet by chance, comparing letters tells them apart."""
    end = F.substring(F.col("word"), F.expr("length(word) - (m - hi) + 1"), F.col("m") - F.col("hi"))
    return F.xxhash64("m", "lo", "hi", F.substring(F.col("word"), F.lit(1), F.col("lo")), end)


def blocks(words: DataFrame, limit: int = LIMIT, least: int = LEAST_LETTERS) -> DataFrame:
    """(word, n, m, lo, hi, block): every word in its blocks, those of over ``limit`` words halved until they are smaller or one letter wide."""
    lengths = F.expr(f"filter(array(length(word) - 1, length(word)), m -> m >= {least})")
    rows = words.select("word", "n", F.explode(lengths).alias("m")).withColumns({"lo": F.lit(0), "hi": F.col("m")})
    rows = durable(_halved(rows), "blocks")
    done = None
    while True:
        counts = rows.where("hi - lo > 1").groupBy("block").count()
        large = durable(counts.where(F.col("count") > limit).select("block"), "large")
        n = large.count()
        if n == 0:
            return rows if done is None else done.unionByName(rows)
        key = small(large, 8, n)
        kept = rows.join(key, "block", "left_anti").select(*rows.columns)
        done = kept if done is None else done.unionByName(kept)
        rows = durable(_halved(rows.join(key, "block", "left_semi")), "blocks")


# --- Gram matrices in numpy -----------------------------------------------------------


def _letters(column) -> tuple[np.ndarray, np.ndarray]:
    """One byte a letter of Latin-1 words, and n + 1 offsets."""
    from reconweave.llm.common import text_buffer

    raw, offsets = text_buffer(column)
    lead = raw == 0xC3
    codes = raw.copy()
    codes[1:][lead[:-1]] += 0x40
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    return codes[~lead], offsets - before[offsets]


def _same_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _verified(i: np.ndarray, j: np.ndarray, head: np.ndarray, tail: np.ndarray, size: np.ndarray, m: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart and belong to the block they were found in."""
    good = np.zeros(len(i), bool)
    step = max(1, (1 << 22) // (m + 1))
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        front, back = _same_letters(head[a, :m], head[b, :m]), _same_letters(tail[a, :m], tail[b, :m])
        equal = size[a] == size[b]
        near = np.where(equal, front + back == m - 1, front + back >= m)
        inside = (front >= lo[a]) & (back >= m - hi[a]) & ((hi[a] == m) | (front < hi[a]))
        good[at : at + step] = near & inside
    return good


def gram_pairs(codes: np.ndarray, offsets: np.ndarray, m: int, block: np.ndarray, lo: np.ndarray, hi: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of near words among words of m or m + 1 letters that stand block by block."""
    size = np.diff(offsets)
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    place = np.arange(len(codes)) - offsets[owner]
    head, tail = np.zeros((n, m + 1), np.uint8), np.zeros((n, m + 1), np.uint8)
    head[owner, place] = codes
    tail[owner, size[owner] - 1 - place] = codes
    used, letter = np.unique(codes, return_inverse=True)
    # squared lengths are whole numbers below 2^24 in single precision, else doubles hold them
    exact = np.float32 if (m + 1) ** 2 < 1 << 23 else np.float64
    counts = np.bincount(owner * len(used) + letter, minlength=n * len(used)).reshape(n, len(used)).astype(exact)
    square = (counts * counts).sum(axis=1)
    firsts, seconds = [], []
    for a in range(0, n, tile):
        rows = slice(a, min(a + tile, n))
        # a block ends where the next begins, so later tiles matter only while the last row's block goes on
        last = rows.stop
        while last < n and block[last] == block[rows.stop - 1]:
            last = min(last + tile, n)
        for b in range(a, last, tile):
            cols = slice(b, min(b + tile, n))
            gap = square[rows, None] + square[None, cols] - 2 * (counts[rows] @ counts[cols].T)
            shift = size[rows, None] - size[None, cols]
            fits = (gap <= 2) & (gap > 0) & (block[rows, None] == block[None, cols]) & ((shift != 0) | (size[rows, None] == m))
            i, j = np.nonzero(fits)
            i, j = i + a, j + b
            keep = i < j
            firsts.append(i[keep])
            seconds.append(j[keep])
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    good = _verified(i, j, head, tail, size, m, lo, hi)
    return i[good], j[good]


def _nearest(i: np.ndarray, j: np.ndarray, n: np.ndarray, words: list[str]):
    """For each word with near words: how many, and the one of largest count, first in code-point order of equals."""
    here, there = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.zeros(len(words), np.int64)
    order[np.argsort(np.array(words, dtype=object), kind="stable")] = np.arange(len(words))
    by = np.lexsort((order[there], -n[there], here))
    here, there = here[by], there[by]
    first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
    return here[first], np.diff(np.r_[first, len(here)]), there[first]


def _groups(batches):
    """Runs of whole blocks of one length m, with at least ``TILE`` words where there are as many."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        key = rows["block"].to_numpy()
        m = rows["m"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (m[1:] != m[:-1])])
        at = 0
        for s in starts[1:]:
            # the last block stays until the next batch shows its end
            if s - at >= TILE or m[s] != m[at]:
                yield rows.slice(at, s - at)
                at = s
        held = rows.slice(at).to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        m = rows["m"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, m[1:] != m[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield rows.slice(a, b - a)


def _scan(batches):
    import pyarrow as pa

    for rows in _groups(batches):
        words = rows["word"].combine_chunks()
        codes, offsets = _letters(words)
        at = [rows[c].to_numpy() for c in ("block", "lo", "hi", "n")]
        i, j = gram_pairs(codes, offsets, int(rows["m"][0].as_py()), *at[:3])
        if not len(i):
            continue
        texts, n = words.to_pylist(), at[3]
        here, near, best = _nearest(i, j, n, texts)
        out = [[texts[k] for k in here], near, n[best], [texts[k] for k in best]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "near", "best_n", "best"])


def near_words(words: DataFrame, limit: int = LIMIT, least: int = LEAST_LETTERS) -> DataFrame:
    """(word, near, best_n, best) of the words with near words: how many, and the most frequent of them.

    ``words`` are distinct, of Latin-1 letters, at least ``least`` of them each.
    """
    rows = blocks(words, limit, least).repartition("m", "block").sortWithinPartitions("m", "block")
    found = map_batches(rows, _scan, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best")))
    out = found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b"))
    return out.select("word", "near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, largest: int) -> DataFrame:
    """(word, root): the last form on the way from each word, by doubling steps; a way has at most log10 of the largest count."""
    out = durable(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(2, math.log10(max(10, largest)) + 1)))):
        onward = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = durable(out.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return out


def group_variants(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = durable(vocabulary(docs), "words")
    out = words.join(near_words(words, limit), "word", "left")
    form = F.col("best_n") >= RATIO * F.col("n")
    out = durable(
        out.select(
            "word",
            "n",
            F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
            F.when(form, F.col("best")).alias("form"),
            F.when(form, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    largest = words.agg(F.max("n")).first()[0] or 0
    last = roots(out.where("form IS NOT NULL"), largest)
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
