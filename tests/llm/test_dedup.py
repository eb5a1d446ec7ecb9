import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from reconweave.llm import exact_dedup, near_dedup

TEXTS = "doc_id long, text string, component string, extra long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in rows], TEXTS).repartition(3)


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 3000):
        for top in (n + 1, 1 << 20, 1 << 50):
            values = np.unique(rng.integers(0, top, n).astype(np.uint64))
            code, low = exact_dedup.golomb_encode(values)
            assert (exact_dedup.golomb_decode(code, low, len(values)) == values).all()
    assert len(exact_dedup.golomb_encode(np.arange(1000, dtype=np.uint64))[0]) < 400


def test_exact_groups_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a b", "a  b", "a\nb", " a b", "", None, "\t", f"text {i % 40}", "z" * 30000])) for i in range(400)] + [(None, "a b"), (3, rng.choice("xy")), (900, "one"), (900, "one")]
    got = exact_dedup.exact_groups(frame(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    size = {i: (len(g), min(x for x in g if x is not None)) for g in groups.values() for i in g}
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id not in (3, 900):
            assert (r.group_size, r.keep_id) == size[r.doc_id]
            assert r.kept == (r.doc_id == r.keep_id)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(frame(spark, rows))
    assert kept.count() == len(groups) and set(kept.columns) == {"doc_id", "text", "component", "extra"}
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_shingle_counts():
    texts = ["", "a", "A b", "a b c d", "a b c d e a b c d e", "x\x1fy z", "É é"]
    texts += ["q" * 600_000 + " " + "é" * 300_000 + " x", " ".join(["ab", "cd", "ef"] * 120_000)]
    for k in (1, 4, 5):
        assert [len(s) for s in near_dedup.shingle_sets(pa.array(texts), k)] == [len(shingles(t, k)) for t in texts]


def test_near_groups_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(12):
        text = rng.choices(vocabulary, k=rng.choice([3, 20, 60, 150]))
        for _ in range(25):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += ["", None, "Solo", "solo", " ".join(vocabulary)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    component, n = brute_components(rows, 4, 80)
    got = near_dedup.near_groups(frame(spark, rows), k=4).collect()
    assert {r.doc_id: r.component_id for r in got} == component
    assert {r.doc_id: r.n_shingles for r in got} == n
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_beside_a_smaller_unlike_text(spark):
    rng = random.Random(5)
    rows = []
    for t in range(40):
        y = [f"t{t}w{i}" for i in range(200)]
        x = [*y[:185], *(f"t{t}x{i}" for i in range(15))]
        z = [*(f"t{t}z{i}" for i in range(70)), *y[70:]]
        rows += [(3 * t, " ".join(z)), (3 * t + 1, " ".join(x)), (3 * t + 2, " ".join(y))]
    component, _ = brute_components(rows, 4, 80)
    assert all(component[3 * t + 2] == 3 * t + 1 for t in range(40))
    rng.shuffle(rows)
    got = near_dedup.near_groups(frame(spark, rows), k=4).collect()
    assert {r.doc_id: r.component_id for r in got} == component


@pytest.mark.parametrize("gain", [0, 2])
def test_split_buckets_lose_no_link(spark, monkeypatch, gain):
    rng = random.Random(15)
    monkeypatch.setattr(near_dedup, "SPLIT", 5)
    monkeypatch.setattr(near_dedup, "GAIN", gain)
    monkeypatch.setattr(near_dedup, "TILE", 7)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for t in range(90):
        own = [f"t{t}w{i}" for i in range(70)]
        for c in range(rng.choice([1, 1, 2])):
            text = [*passage, *own]
            for _ in range(c * 2):
                text[rng.randrange(120, 190)] = f"c{t}"
            rows.append(" ".join(text))
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    component, _ = brute_components(rows, 4, 80)
    assert len(set(component.values())) < len(rows)
    calls = []
    real = near_dedup.split_buckets
    monkeypatch.setattr(near_dedup, "split_buckets", lambda *a: calls.append(real(*a)) or calls[-1])
    got = near_dedup.near_groups(frame(spark, rows), k=4).collect()
    assert calls and (gain or calls[0].where("second >= 0").count() > 0)
    assert {r.doc_id: r.component_id for r in got} == component


def test_long_texts_and_clashing_columns(spark):
    long_text = " ".join(f"w{i % 70001}" for i in range(400_000))
    rows = [(1, long_text, "x", 1), (2, long_text + " end", "x", 1), (3, "a b c d e", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, kept long")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dedup.near_groups(docs, k=4).collect()}
    assert got == {1: (1, len(shingles(long_text, 4))), 2: (1, len(shingles(long_text + " end", 4))), 3: (3, 2)}


def test_near_edges(spark):
    got = near_dedup.near_groups(frame(spark, [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(1, 1, True), (1, 1, True), (2, 2, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_dedup.near_groups(frame(spark, [])).count() == 0


def test_pruning_keeps_similar_pairs():
    least = near_dedup.least_matches(0.8)
    assert len(least) == near_dedup.PERMUTATIONS // near_dedup.BATCH and all(a < b for a, b in zip(least, least[1:], strict=False))
    rng = np.random.default_rng(1)
    for j, expected in ((0.85, 1.0), (0.4, 0.0)):
        a = rng.integers(0, 1 << 32, (2000, near_dedup.PERMUTATIONS), dtype=np.uint32)
        b = np.where(rng.random(a.shape) < j, a, a + np.uint32(1))
        share = len(near_dedup.plausible(a, b, least)) / len(a)
        assert abs(share - expected) < 0.01
