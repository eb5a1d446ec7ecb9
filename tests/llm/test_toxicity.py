"""Toxicity: segments against all segments, word odds against plain counts, and accuracy on held-out rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reconweave.llm import toxicity

SCHEMA = "doc_id long, text string, score double, lang string"
DATA = "/root/testdata/sf0.1"


def plain_segments(scores):
    """By definition: split at the best segment, of equals the shortest, then the first, and go on on both sides."""
    def best(lo, hi):
        found = [(sum(scores[i:j]), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
        top = max(found, default=(0, 0, 0))
        if top[0] <= 0:
            return []
        i = -top[2]
        j = i - top[1]
        return [*best(lo, i), (i, j, top[0]), *best(j, hi)]

    return best(0, len(scores))


def test_segments_against_all_segments():
    rng = random.Random(3)
    for _ in range(400):
        scores = np.array([rng.choice([-7, -5, -3, -2, -1, 1, 2, 3, 4, 6]) + rng.random() / 7 for _ in range(rng.randint(0, 14))])
        got = toxicity.maximal_segments(scores)
        want = plain_segments(list(scores))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_words_are_lower_cased_and_end_at_punctuation():
    raw, offsets = toxicity.text_buffer(pa.array(["Ab,éÉ ×1", None, "c"]))
    low, starts, ends = toxicity.words_of(raw, offsets)
    assert [bytes(low[a:b]).decode() for a, b in zip(starts, ends)] == ["ab", "éé", "×1".replace("×", "÷"), "c"]


def made(n, seed=1):
    """Toxic texts have words of two stems with changing endings among others."""
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["xénon", "vilst"]) + rng.choice(common))
        rows.append((i, " ".join(words), 9.0, "x"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def run(spark, rows, labels, most=toxicity.SAMPLE):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), most).collect()}


@pytest.mark.parametrize("most", [20_000, 60])
def test_unseen_words_are_known_by_their_stem(spark, most):
    rows, labels = made(700)
    got = run(spark, rows, labels, most)
    assert len(got) == 700
    held = [i for i, r in got.items() if r.held_out]
    assert held and all((zlib.crc32(str(i).encode()) % 5 == 0) == r.held_out for i, r in got.items())
    truth = {i: t for i, _, t in labels}
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    shown = [r for r in got.values() if r.n_passages]
    assert len(shown) > 50
    texts = {i: t for i, t, *_ in rows}
    for r in shown:
        for span in r.passages.split(","):
            a, b = map(int, span.split(":"))
            assert "xénon" in texts[r.doc_id][a:b] or "vilst" in texts[r.doc_id][a:b] or not truth[r.doc_id]


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = made(200)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    assert {i: r.score for i, r in run(spark, rows, labels).items()} == pytest.approx({i: r.score for i, r in run(spark, rows, other).items()}, abs=1e-9)


def test_nulls_long_texts_and_repeated_rows(spark):
    rows, labels = made(200)
    rows += [(1000, None, 1.0, None), (1001, "", 1.0, ""), (None, "xénon", 1.0, ""), (1002, "abc def " * 100_000 + "xénonab xénonac vilstad", 1.0, "")]
    rows += [rows[0]]
    labels += [(None, 1, 1), (5, None, None), (7, 1, 7)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score < 0.5
    assert by[1002].n_words == 200_003 and by[1002].predicted == 1 and by[1002].passages.endswith(f":{len(rows[203][1])}")
    assert by[None].held_out is (zlib.crc32(b"") % 5 == 0)
    same = [r for r in got if r.doc_id == rows[0][0]]
    assert len(same) == 2 and same[0] == same[1]


def test_without_both_classes(spark):
    rows, _ = made(20)
    assert {r.score for r in run(spark, rows, []).values()} == {0.0}
    assert {r.score for r in run(spark, rows, [(i, 1, 1) for i in range(20)]).values()} == {1.0}
    assert run(spark, [], []) == {}


def test_own_counts_are_left_out():
    odds = toxicity.Odds(np.zeros(len(toxicity.STEMS) * toxicity.BUCKETS + toxicity.BUCKETS, np.float32), np.zeros(len(toxicity.STEMS) * toxicity.BUCKETS + toxicity.BUCKETS, np.float32), 0.1)
    raw, offsets = toxicity.text_buffer(pa.array(["word word"]))
    keys = toxicity.keys_of(*toxicity.words_of(raw, offsets))
    for row in keys:
        odds.toxic[row[0]] = odds.every[row[0]] = 2
    assert odds.scores(keys)[0] > 2
    own = [np.array([2, 2])] * len(keys)
    assert odds.scores(keys, own, np.array([True, True])) == pytest.approx([-toxicity.DRIFT] * 2)


def test_accuracy_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    table = {(r.toxic, r.predicted): r["count"] for r in got}
    hit, missed, wrong = table.get((1, 1), 0), table.get((1, 0), 0), table.get((0, 1), 0)
    assert hit + missed > 50
    assert hit >= 0.9 * (hit + missed) and hit >= 0.9 * (hit + wrong), table


def test_words_of_toxic_texts_alone_have_finite_scores():
    """However often a word occurs, only in toxic texts or only in clean ones, its odds stay finite and grow with its counts."""
    buckets = (len(toxicity.STEMS) + 1) * toxicity.BUCKETS
    toxic, every = np.zeros(buckets, np.float32), np.zeros(buckets, np.float32)
    keys = np.stack([np.arange(4) + i * toxicity.BUCKETS for i in range(len(toxicity.STEMS) + 1)])
    every[keys] = [1000, 1_000_000, 1000, 1_000_000]
    toxic[keys[:, :2]] = every[keys[:, :2]]
    scores = toxicity.Odds(toxic, every, 0.1).scores(keys)
    assert np.isfinite(scores).all()
    assert scores[3] < scores[2] < 0 < scores[0] < scores[1]


def test_law_of_texts_that_mostly_have_no_segment():
    """The fitted lambda is where the likelihood is largest, texts without a segment censored, also where these are most and lengths differ much."""
    rng = np.random.default_rng(5)
    n = np.exp(rng.uniform(1, 9, 4000)).round()
    best = np.where(rng.random(4000) < 0.7, 0, rng.exponential(0.6, 4000))
    law = toxicity.fit_law(np.zeros(4000), n, best, np.maximum(best - 1, 0), np.ones(4000))

    def likelihood(rate):
        return (best > 0).sum() * (np.log(rate) - np.log((n * np.exp(-rate * best)).sum())) - rate * best.sum()

    rates = np.exp(np.linspace(np.log(1e-3), np.log(20), 2000))
    assert abs(law.rate / rates[np.argmax([likelihood(r) for r in rates])] - 1) < 0.02
