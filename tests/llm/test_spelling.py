"""Spelling variants against a comparison of all words with all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from reconweave.llm import spelling

SCHEMA = "doc_id long, text string, near string, n int"


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None)
    return out


def texts(seed, size, letters="abé"):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(60)]
    words += ["aaaaaaa", "aaaaaaaa", "abaaaaa", "Écoleécole", "écoleécole", "x" * 5000, "x" * 4999]
    words += ["straßenbahn"] * 20 + ["STRASSENBAHN", "strassenbahn"] * 3
    out = []
    for i in range(size):
        some = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for k, w in enumerate(some):
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                some[k] = w[:at] + rng.choice(["", "a", "ab"]) + w[at + 1 :]
        out.append((i, " ".join(some) if some else None))
    return out + [(3, "aaaaaaa aaaaaaa"), (None, "aaaaaaab aaaaaaab"), (None, None)]


@pytest.mark.parametrize("limit", [8192, 40, 3])
def test_groups_against_all_pairs(spark, limit):
    rows = texts(limit, 120)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(docs, limit).collect()}
    want = plain_groups(plain_counts(rows))
    assert got == want
    assert any(f for f, *_ in want.values()) and sum(v[3] for v in want.values()) > 200


def test_chain_of_forms_ends_at_its_last(spark):
    chain = ["aaaaaaab", "aaaaaaabc", "aaaaaaabcd", "aaaaaaabcde", "aaaaaaabcdef"]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms, 200_000).collect()} == {w: chain[-1] for w in chain[:-1]}


def test_no_documents(spark):
    assert spelling.group_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_block_larger_than_a_tile(spark):
    rng = random.Random(4)
    words = sorted({"prefixes" + "".join(rng.choice("abc") for _ in range(rng.choice([7, 8]))) for _ in range(1500)})
    table = spark.createDataFrame([(w, 2 + i % 5) for i, w in enumerate(words)], "word string, n long").repartition(3)
    got = {r.word: (r.near, r.best_n, r.best) for r in spelling.near_words(table).collect()}
    n = {w: 2 + i % 5 for i, w in enumerate(words)}
    want = {}
    for w in words:
        others = [v for v in words if one_edit(w, v)]
        if others:
            best = min(others, key=lambda v: (-n[v], v))
            want[w] = (len(others), n[best], best)
    assert got == want
