import random
import zlib

import numpy as np
import pytest

from reconweave.llm import packing

pytest.importorskip("public_tokenizers")


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    return [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_ids_equal_the_tokenizers_library():
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHéèüñßÀœ"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 14))) + rng.choice(["", "", ".", ",", "!!", "'s", "***"]) for _ in range(400)) for _ in range(20)]
    texts += ["", " ", "a b\x1cc d", "it's we'll I'd 'tis", "1234 5.6 x9y", "<|endoftext|> in text", "é é İstanbul ΑΣ ας", "汉字 かな 😀😀", "a" * 5000, "tab\tnew\nline"]
    for _ in range(2):  # the second time no word is new
        assert packing.token_ids([t.encode() for t in texts], packing.vocabulary()) == reference_ids(texts)


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(packing, "BLOCK_BYTES", 3000)
    words = ["".join(rng.choices("abcdeé1.", k=rng.randint(1, 9))) for _ in range(500)]
    texts = [rng.choice([" ", "\n\t "]).join(rng.choices(words, k=n)) for n in (1, 700, 9000)] + ["x" * 20_000, "a " * 9000 + "<|endoftext|> b " + "c " * 9000]
    assert packing.token_ids([t.encode() for t in texts], packing.vocabulary()) == reference_ids(texts)


def test_patterns_use_each_piece_once():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(1, 30))}
        used = dict.fromkeys(histogram, 0)
        for count, pattern in packing.pack_patterns(histogram, 64):
            assert sum(length * n for length, n in pattern) <= 64
            for length, n in pattern:
                used[length] += count * n
        assert used == histogram


def test_pack_places_every_token(spark):
    texts = ["", None, "short text", "word " * 3000, "word " * 3000] + [f"doc {i} " * (i % 300) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (7, "short text", "x")], "doc_id long, text string, ids string").repartition(4)
    rows = packing.pack(docs, capacity=256).toPandas()
    want = sorted(zlib.crc32(x + np.array([1], "<u4").tobytes()) for x in reference_ids([t or "" for t in texts] + ["no id", "short text"]))
    whole, taken = [], {}
    for row in rows.itertuples():
        assert zlib.crc32(row.ids) == row.ids_crc32 and len(row.ids) == 4 * row.length
        taken.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in taken.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(taken) == list(range(len(taken)))
    for key, doc in rows[rows.doc_id.notna() & (rows.doc_id != 7)].groupby("doc_id"):
        whole.append(zlib.crc32(b"".join(doc.sort_values("start").ids)))
        assert doc.length.sum() == doc.doc_tokens.iloc[0]
    assert set(whole) <= set(want) and len(whole) == len(texts) - 1
    assert rows.length.sum() / (256 * len(taken)) > 0.95


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
