import hashlib
import random
import re
from collections import defaultdict

import corpus_pipeline
from reconweave.llm import mixing

from test_dedup import brute_components
from test_operators import plain_schedule


def corpus():
    rng = random.Random(21)
    vocabulary = {"en": [f"{a}{b}" for a in ("th", "wat", "hous", "ligh", "nigh", "wor") for b in ("e", "er", "ing", "ed", "s", "ly")], "de": [f"{a}{b}" for a in ("sch", "str", "über", "geh", "mög", "würd") for b in ("en", "ung", "lich", "keit", "est", "ern")]}
    rows = []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choices(vocabulary[lang], k=rng.randint(30, 90))), lang, "hot" if i % 5 else f"s{i % 7}", 0))
    for i in range(240, 280):
        text = rows[rng.randrange(200)][1]
        rows.append((i, text.replace(" ", "  ", 3) if i % 2 else re.sub(r"^\S+", "changed", text), "en", "hot", 0))
    rows += [(300, None, "en", "s1", 0), (301, "12 34", "en", "s1", 0), (302, "", None, None, 0)]
    return rows


def brute_order(rows):
    """(slot, place) of each doc_id of (doc_id, text, source) rows, scheduled slot by slot; sources weigh their bytes."""
    size = {i: len(t.encode()) + 8 for i, t, _ in rows}
    by = defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    weight = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    blocks = {}
    for s, ids in by.items():
        at = 0
        for i in sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            blocks.setdefault((s, at // mixing.BLOCK_BYTES), []).append(i)
            at += size[i]
    total = sum(weight.values())
    last = max(-(-(-(-w // mixing.BLOCK_BYTES)) * total // w) for w in weight.values())
    span = 64
    while span < 4 * len(by):
        span *= 2
    out = {}
    for t, block in plain_schedule(weight, last, span).items():
        for place, i in enumerate(blocks.get(block, [])):
            out[i] = (t, place)
    return out


def test_stages_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_BYTES", 500)
    monkeypatch.setattr(mixing.in_order, "__defaults__", (None, 64, 500))
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    after = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == columns
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        after[name] = docs.toPandas()
    text = {i: t or "" for i, t, *_ in rows}
    source = {i: s or "" for i, _, _, s, _ in rows}
    assert set(after["language_id"].doc_id) == set(text) - {300, 301, 302}
    first = {}
    for i in sorted(after["language_id"].doc_id):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text[i]), i)
    assert sorted(after["exact_dedup"].doc_id) == sorted(first.values())
    component, _ = brute_components([(i, text[i]) for i in first.values()], 5, 80)
    near = sorted(i for i, c in component.items() if i == c)
    assert sorted(after["near_dedup"].doc_id) == near
    order = brute_order([(i, text[i], source[i]) for i in near])
    assert sorted(after["mixing"].doc_id) == near
    got = [r.doc_id for r in corpus_pipeline.mixing_stage(spark, spark.read.parquet(str(tmp_path / "2")), "").select("doc_id").collect()]
    assert got == sorted(near, key=order.get)
    packed = after["packing"]
    assert set(packed.doc_id) == set(near)
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()
    # sequences come in the mixed order, each where its longest piece stands
    place = {i: n for n, i in enumerate(sorted(near, key=order.get))}
    stands = [min((-r.length, place[r.doc_id]) for r in rows.itertuples())[1] for _, rows in sorted(packed.groupby("sequence_id"))]
    assert stands == sorted(stands) and sorted(packed.sequence_id.unique()) == list(range(len(stands))) and len(stands) > 3


def test_run_reads_back_every_stage(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 100 and "sequence_id" in out.columns
