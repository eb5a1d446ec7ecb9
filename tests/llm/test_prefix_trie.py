"""The conversation trie against one built turn by turn."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from reconweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, name int"


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
    out = set()
    for node, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(convs[c]) == len(node))
        out.add(
            (cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


def made(seed, n=60, longest=12, words="ab"):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 2), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "bot"]) if rng.random() < 0.3 else "user", rng.choice(words) * rng.randint(1, 2)))
    return rows


def check(spark, rows, monkeypatch=None):
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in prefix_trie.rebuilt_trie(table).collect()]
    want = plain_trie(plain_rebuilt(rows))
    assert len(got) == len(want)
    assert set(got) == want


def test_short_conversations(spark):
    check(spark, made(1))


@pytest.mark.parametrize("block", [1, 2])
def test_every_level_of_the_recursion(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = made(2, n=40, longest=6)
    rows += [(1000, t, "user", "x") for t in range(21)] + [(1001, t, "user", "x") for t in range(16)] + [(1002, t, "user", "x" if t < 17 else "y") for t in range(19)]
    check(spark, rows)


def test_long_conversations(spark):
    rows = made(3, n=20)
    for c, n, odd in ((200, 100, 101), (205, 100, 64), (210, 64, 99), (215, 33, 32), (220, 16, 99), (225, 17, 16)):
        rows += [(c, t, "user", "x" if t < odd else "y") for t in range(n)]
    check(spark, rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", None), (0, 2, None, "é" * 9000), (5, 0, "", ""), (5, 0, "", ""), (5, 3, "a", "b"), (None, 0, "user", "x"), (-1, 0, "user", "x"), (7, 0, "user", "x")]
    rows += [(11, 0, "user", "late"), (12, 5, "user", "x"), (12, 6, "user", "y")]
    check(spark, rows)


def test_pieces_of_members_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    check(spark, [(c, 0, "user", "same") for c in range(0, 300, 5)] + [(c, 9, "user", "same") for c in range(1, 90, 5)])


def test_no_conversations(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []
