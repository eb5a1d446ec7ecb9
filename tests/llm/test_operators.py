import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from reconweave.llm import common,  language_id, licenses, mixing, pii, quality, sharding, warc

EMPTY = "doc_id long, text string, source string, lang string"


def docs(spark, rows, schema=EMPTY):
    return spark.createDataFrame(rows, schema).repartition(3)


# --- personal data


def plain_rules(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_rules_against_plain_patterns():
    rng = random.Random(7)
    parts = ["a@b.co", "x.y@z", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-2000", "+44 20 7946 0958", "é", "ünï@ex.org", "..", "+", "12", "0001.2.3.4", "a@b@c.d", " "]
    for _ in range(600):
        text = rng.choice(["", " "]).join(rng.choices(parts, k=rng.randint(1, 8)))
        assert pii.rule_spans(text) == plain_rules(text), text


def test_field_adds_what_rules_miss(spark):
    rows = [(1, "please call (555) 123-4567 now", None, None), (2, "mail ann@example.com, card 4111111111111111", None, None), (3, None, None, None), (4, "plain words only. 12 of them in 1999", None, None), (None, "", None, None)]
    got = {r.doc_id: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert got[1].spans == "phone:12:26" and got[1].n_phone == 0 and got[1].n_added == 1
    assert got[2].spans == "email:5:20,card:27:43" and got[2].base_sha256 == hashlib.sha256(got[2].spans.encode()).hexdigest()
    assert got[3].spans == got[4].spans == got[None].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_span_recall_and_precision_on_held_out_rows():
    rows = [(text, ",".join(f"{k}:{a}:{b}" for k, a, b in spans)) for text, spans in map(pii.unmark, pii.MARKED)]
    right, found, planted = Counter(), Counter(), Counter()
    for fold in range(4):
        field = pii.fit(tuple(r for i, r in enumerate(rows) if i % 4 != fold))
        held = [pii.unmark(m) for i, m in enumerate(pii.MARKED) if i % 4 == fold]
        ruled = [pii.rule_spans(t) for t, _ in held]
        for (_, gold), r, a in zip(held, ruled, pii.added_spans(field, [t for t, _ in held], ruled), strict=True):
            for kind, lo, hi in gold:
                planted[kind] += 1
                right[kind] += any(k == kind and x < hi and lo < y for k, x, y in r + a)
            for kind, lo, hi in a:
                found[any(x < hi and lo < y for _, x, y in gold)] += 1
    assert sum(right.values()) / sum(planted.values()) >= 0.9, (right, planted)
    assert found[True] / (found[True] + found[False]) >= 0.85, found


def test_stretches_give_the_spans_of_whole_texts():
    rng = random.Random(12)
    rows = [(text, ",".join(f"{k}:{a}:{b}" for k, a, b in spans)) for text, spans in map(pii.unmark, pii.MARKED)]
    field = pii.fit(tuple(rows))
    words = "la thin ententhe schung und. de, Thest of%%% in*** (oder) | eux".split()
    parts = ["555-0134", "(555) 010-2345", "a.b@mail.example.com", "10.0.0.7:80", "4111 1111 1111 1111", 'token = "0d3fe71b4c8a1f9e2b7d6c5a49308f1e2d3c4b5a"', "1999", "12 of 340", "+1 (555) 010-2000"]
    texts = [" ".join(rng.choice(parts) if rng.random() < 0.08 else rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    ruled = [pii.rule_spans(t) for t in texts]
    assert pii.added_spans(field, texts, ruled) == pii.added_spans(field, texts, ruled, whole=True)


def test_secrets_and_edges(spark):
    long_text = "wort und zahl " * 150_000 + 'token = "0d3fe71b4c8a1f9e2b7d6c5a49308f1e2d3c4b5a" ende'
    rows = [(1, 'x token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" y', None, None), (1, "no number", None, None), (2, "same", None, None), (2, "same", None, None), (3, long_text, None, None)]
    schema = "doc_id long, text string, spans string, n_found string"
    got = [(r.doc_id, r.spans, r.n_secret, r.n_found) for r in pii.find_personal_data(docs(spark, rows, schema)).collect()]
    start = long_text.index("0d3f")
    assert sorted(got) == [(1, "", 0, 0), (1, "secret:11:51", 1, 1), (2, "", 0, 0), (2, "", 0, 0), (3, f"secret:{start}:{start + 40}", 1, 1)]
    assert pii.find_personal_data(docs(spark, [], schema)).count() == 0


# --- language


def test_language_fusion(spark):
    rng = random.Random(2)
    speech = {"en": "the and of this that with from house water night", "de": "der die und nicht mit haus wasser nacht schön über"}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choices(speech[lang].split(), k=30)), "h1" if lang == "en" else "h2", lang))
    rows += [(500, None, "h1", "en"), (501, "12 34 !!", "h1", "en"), (502, "the house and the water of this night", "h2", "de"), (503, "нет и да " * 20, None, None), (504, "der und", None, None)]
    got = {r.id: r for r in language_id.identify(language_id.of_documents(docs(spark, rows))).collect()}
    assert all(got[i].language == ("en" if i % 3 else "de") and got[i].kept for i in range(120))
    assert not got[500].kept and not got[501].kept and not got[503].kept
    # strong text evidence wins over a wrong declaration and host
    assert got[502].text_language == "en" and got[502].language == "en"
    assert got[504].language == "de"
    kept = language_id.keep_known_languages(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "lang"] and kept.count() == 122
    assert language_id.identify(language_id.of_documents(docs(spark, []))).count() == 0


def test_a_rare_language_is_known_at_every_size(spark):
    rng = random.Random(8)
    speech = {"en": "the and of this that with from house water night", "fi": "ja on ei se hän että talo vesi yö kanssa"}
    rows = [(i, " ".join(rng.choices(speech["fi" if i % 100 == 7 else "en"].split(), k=30)) + f" {i}", "h", "fi" if i % 100 == 7 else "en") for i in range(1200)]
    got = language_id.identify(language_id.of_documents(docs(spark, rows)), sample=40).collect()
    assert all(r.language == ("fi" if r.id % 100 == 7 else "en") and r.kept for r in got)


def test_pages_evidence(spark):
    page = spark.createDataFrame([(1, "https://www.a.example.de/fr/1", "<html lang='fr-FR'><style>p{}</style><p>le mot</p></html>"), (2, None, None)], "page_id long, url string, html string")
    r = {x.id: x for x in language_id.of_pages(page).collect()}
    assert (r[1].declared, r[1].suffix, r[1].host, r[1].domain, r[1].text.split()) == ("fr-FR", "fr", "www.a.example.de", "example.de", ["le", "mot"])


def plain_trigrams(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    x = [b if 97 <= b <= 122 or b >= 128 else 32 for b in low]
    wrap = lambda v: (v + 2**31) % 2**32 - 2**31
    return [(wrap((a * 961 + b * 31 + c) * 40503) >> 7) & (language_id.BUCKETS - 1) for a, b, c in zip(x, x[1:], x[2:], strict=False) if (a, b, c) != (32, 32, 32)]


def brute_languages(rows):
    """{row: (language, confidence, text language, kept)} of (text, declared, suffix, host, domain) rows, all of which are trained on."""
    texts = {t: d for t, d, *_ in reversed(rows) if t and d}
    size = Counter(texts.values())
    names = sorted(x for x in size if size[x] >= language_id.LEAST_DOCUMENTS)
    counts = {x: Counter(g for t, d in texts.items() if d == x for g in plain_trigrams(t)) for x in names}
    whole = {x: sum(c.values()) + 0.05 * language_id.BUCKETS for x, c in counts.items()}
    k = len(names) + 1
    logs = []
    for t, *_ in rows:
        grams = plain_trigrams(t or "")
        scale = min(len(grams), language_id.EVIDENCE) / max(len(grams), 1)
        own = [scale * sum(math.log((counts[x][g] + 0.05) / whole[x]) for g in grams) for x in names]
        logs.append((own + [-scale * len(grams) * math.log(language_id.BUCKETS / 2)], len(grams)))
    host, domain, corpus = defaultdict(lambda: [0.0] * k), defaultdict(lambda: [0.0] * k), [0.0] * k
    for (_, _, _, h, d), (own, used) in zip(rows, logs, strict=True):
        if used:
            z = [math.exp(v - max(own)) for v in own]
            for i, v in enumerate(z):
                for sums in (host[h, d], domain[d], corpus):
                    sums[i] += v / sum(z)
    flat = [(1 - language_id.OTHER_PRIOR) / (k - 1)] * (k - 1) + [language_id.OTHER_PRIOR]
    smooth = lambda sums, weight, above: [(v + weight * a) / (sum(sums) + weight) for v, a in zip(sums, above, strict=True)]
    base = smooth(corpus, language_id.CORPUS_WEIGHT, flat)
    out = []
    for (_, declared, suffix, h, d), (own, used) in zip(rows, logs, strict=True):
        prior = smooth(host[h, d], language_id.HOST_WEIGHT, smooth(domain[d], language_id.DOMAIN_WEIGHT, base)) if (h, d) in host else base

        def told(tag, trust, i):
            if tag not in names:
                return 0.0
            return math.log(0.5) if i == k - 1 else math.log(trust) if names[i] == tag else math.log((1 - trust) / max(1, k - 2))

        joint = [own[i] + math.log(prior[i]) + told(declared, language_id.TRUST_DECLARED, i) + told(suffix, language_id.TRUST_SUFFIX, i) for i in range(k)]
        label = lambda xs: [*names, "und"][xs.index(max(xs))]
        sure = 1 / sum(math.exp(v - max(joint)) for v in joint)
        out.append((label(joint), sure, label(own), label(joint) != "und" and round(sure, 6) >= language_id.SURE) if used else ("und", 0.0, "und", False))
    return out


def test_fusion_against_brute_force(spark):
    rng = random.Random(13)
    speech = {"en": "the and of this that with from house water night", "de": "der die und nicht mit haus wasser nacht schön über", "fr": "le la les est une dans pour être où maison eau nuit"}
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "en", "de", "fr"])
        text = " ".join(rng.choices(speech[lang].split(), k=rng.choice([1, 2, 5, 30]))) + f" {i}"
        host = rng.choice(["a", "b", "c"])
        rows.append((text, rng.choice([lang, lang, None, "en", "xx"]), rng.choice([lang, None, "fr"]), host, "d" if host < "c" else "e"))
    rows += [(None, "en", None, "a", "d"), ("", "de", "de", "a", "d"), ("1 2 3", "fr", "fr", "z", "y"), ("нет да нет да", None, None, "q", "q"), (rows[3][0], *rows[3][1:])]
    # texts that are declared more than once take the least declaration, as the operator does
    least = {}
    for t, d, *_ in rows:
        if t and d:
            least[t] = min(d, least.get(t, d))
    want = brute_languages([(t, d, *rest) for t, d, *rest in rows])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, declared string, suffix string, host string, domain string").repartition(3)
    got = {r.id: r for r in language_id.identify(df, sample=10_000).collect()}
    for i, (language, sure, text_language, kept) in enumerate(want):
        assert (got[i].language, got[i].text_language, got[i].kept) == (language, text_language, kept), (i, rows[i])
        assert got[i].confidence == pytest.approx(sure, abs=2e-3)


def test_rows_that_share_an_id_are_judged_each_by_itself(spark):
    rng = random.Random(3)
    rows = [(None if i % 2 else 7, " ".join(rng.choices("the and of this house water night from".split(), k=20)) + f" {i}", "h", "en") for i in range(40)]
    rows += [(None, "12 34", "h", "en"), (7, "!!", "h", "en"), (7, None, None, None)]
    kept = language_id.keep_known_languages(docs(spark, rows)).collect()
    assert Counter(r.text for r in kept) == Counter(t for _, t, *_ in rows[:40])


def test_language_edges(spark):
    speech = {"en": "the and of this that with", "de": "der die und nicht mit haus"}
    rows = [(i, f"{speech['en' if i % 2 else 'de']} {i}", "h", "en" if i % 2 else "de", "x", 1.5) for i in range(20)]
    rows += [(50, speech["de"] * 60_000, "h", None, "x", 1.5), (51, rows[3][1], "h", "en", "x", 1.5), (52, "zzz", None, None, "x", 1.5)]
    wide = docs(spark, rows, EMPTY + ", language string, confidence double")
    got = {r.id: r for r in language_id.identify(language_id.of_documents(wide)).collect()}
    assert len(got) == len(rows) and got[50].language == "de" and got[50].confidence > 0.99
    assert (got[51].language, got[51].confidence) == (got[3].language, got[3].confidence)
    assert language_id.keep_known_languages(wide).columns == wide.columns
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert language_id.identify(language_id.of_pages(pages)).count() == 0
    # two languages that declare the same texts tie, and the first is taken
    tied = [(i, f"wort {i // 2}", "h", None if i % 2 else "aa", "x", 1.5) for i in range(12)]
    assert {r.language for r in language_id.identify(language_id.of_documents(docs(spark, tied, EMPTY + ", language string, confidence double"))).collect()} == {"aa"}


def test_country_suffixes(spark):
    page = spark.createDataFrame([(1, "http://x.co.at/", "<p>a"), (2, "http://x.com/", "<p>a"), (3, "http://x.br", "b")], "page_id long, url string, html string")
    assert {r.id: r.suffix for r in language_id.of_pages(page).collect()} == {1: "de", 2: None, 3: "pt"}


# --- mixing


def plain_schedule(weight, slots, span):
    """Cuts by halving and earliest deadlines, job by job."""
    total = sum(weight.values())
    step = 1
    while step * span < slots:
        step *= 2

    def shares(at, lo=None, hi=None):
        base = {s: at * span * w // total for s, w in weight.items()}
        rank = lambda s: (lo is not None and lo[s] <= base[s], hi is not None and hi[s] <= base[s], -(at * span * weight[s] % total), s)
        for s in sorted(weight, key=rank)[: at * span - sum(base.values())]:
            base[s] += 1
        return base

    cut = {0: shares(0), step: shares(step)}
    last = step
    while step > 1:
        for at in range(0, last, step):
            cut[at + step // 2] = shares(at + step // 2, cut[at], cut[at + step])
        step //= 2
    out = {}
    for at in range(last):
        done = dict(cut[at])
        for t in range(at * span, (at + 1) * span):
            due = [(-(-(done[s] + 1) * total // weight[s]), s) for s in weight if done[s] < cut[at + 1][s] and done[s] * total // weight[s] <= t]
            assert due
            s = min(due)[1]
            out[t] = (s, done[s])
            done[s] += 1
    return out


@pytest.mark.parametrize("weight", [{"a": 7, "b": 5, "c": 3, "d": 1}, {"a": 10**14, "b": 3, "c": 10**13 + 7}, {f"s{i:02}": 1 + i * i for i in range(14)}])
def test_schedule_equals_a_simulated_one(spark, weight):
    got = mixing.schedule(spark.createDataFrame(list(weight.items()), "source string, weight long"), 500, 64).collect()
    assert {r.slot: (r.source, r.block) for r in got} == plain_schedule(weight, 500, 64)


def test_deviation_stays_under_a_block(spark):
    weight = {f"s{k:03}": 10**9 // (k + 1) for k in range(120)}
    got = mixing.schedule(spark.createDataFrame(list(weight.items()), "source string, weight long"), 100_000).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got))) and len(got) >= 100_000
    place = {s: i for i, s in enumerate(weight)}
    part = np.array(list(weight.values())) / sum(weight.values())
    count, worst = np.zeros(len(part)), 0.0
    for t, r in enumerate(got):
        i = place[r.source]
        assert r.block == count[i]
        count[i] += 1
        worst = max(worst, np.abs(count - (t + 1) * part).max())
    assert worst < 1


def test_mix_is_whole_and_on_time(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400), rng.choice("aaaaaabbcd") if i % 50 else None, "en") for i in range(800)] + [(5, "same", "a", "en"), (5, "same", "a", "en"), (None, None, "b", None)]
    out = mixing.mix(docs(spark, rows), span=64, block_bytes=1000).toPandas()
    assert len(out) == len(rows)
    assert ((out.slot >= out.release) & (out.slot < out.deadline)).all()
    assert not out.duplicated(["slot", "place"]).any() and not out.drop_duplicates(["source", "block"]).slot.duplicated().any()
    last = out[out.in_mix].slot.max()
    share = out[(out.slot <= last)].groupby("source").size().sum()
    assert share == out.in_mix.sum() < len(rows)
    kept = mixing.mixture(docs(spark, rows), span=64, block_bytes=1000)
    assert kept.columns == ["doc_id", "text", "source", "lang"] and kept.count() == out.in_mix.sum()
    assert mixing.mix(docs(spark, [])).count() == 0


def test_every_document_is_in_the_mixed_order(spark):
    rows = [(i, "z" * 92, "hot" if i % 10 else f"s{i % 40}", "en") for i in range(600)] + [(5, "same", "a", "en"), (5, "same", "a", "en"), (None, None, None, None), (None, "n", "b", "en")]
    got = corpus_pipeline.mixing_stage(spark, docs(spark, rows), "")
    assert got.columns == ["doc_id", "text", "source", "lang"]
    assert Counter(map(tuple, got.collect())) == Counter(rows)
    order = [r.source for r in mixing.in_order(docs(spark, rows[:600]), span=64, block_bytes=1000).collect()]
    assert all(abs(order[:t].count("hot") - 0.9 * t) < 30 for t in range(0, 601, 50))


def test_mix_of_long_texts_and_clashing_columns(spark):
    rows = [(i, "y" * (5_000_000 if i == 3 else 50), "ab"[i % 2], "en", 1, "s") for i in range(60)]
    wide = docs(spark, rows, EMPTY + ", slot long, chunk string")
    out = mixing.mix(wide, span=64, block_bytes=1000).toPandas()
    assert len(out) == 60 and ((out.slot >= out.release) & (out.slot < out.deadline)).all()
    assert Counter(map(tuple, mixing.in_order(wide, span=64, block_bytes=1000).collect())) == Counter(rows)


def test_given_weights(spark):
    rows = [(i, "y" * 92, "ab"[i % 2], "en") for i in range(400)]
    out = mixing.mix(docs(spark, rows), weights={"a": 3, "b": 1}, span=64, block_bytes=1000).toPandas()
    first = out[out.in_mix]
    n = Counter(first.source)
    assert 2.5 < n["a"] / n["b"] < 3.5


# --- archives


def test_archives_round_trip(spark):
    big = "<p>é" + "z" * 1200
    rows = [(1, "http://a/1", big), (9, "http://a/9", big), (4, "http://a/4", big), (2, None, "small"), (3, "http://b", "small"), (5, "http://c\r\nX: y", None), (6, "u", "a\r\n\r\nb" * 300), (None, "n", "null id")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    index = warc.write_archives(pages)
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    html = {i: (h or "").encode() for i, _, h in rows}
    for i, r in got.items():
        assert (r.payload_digest, r.payload_bytes) == (hashlib.sha1(html[i]).hexdigest(), len(html[i]))
        assert r.payload == (None if i in (1, 4) else html[i])
    # any selection reads the same records
    some = {r.page_id for r in warc.read_records(index.where("page_id in (2, 9)")).collect()}
    assert some == {2, 9}
    trip = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert trip[1] == trip[4] == ("revisit", 9) and trip[9] == ("response", None) and trip[2] == trip[3] == ("response", None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_a_long_page_among_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 2000)
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(rng.choices("abcdefghij", k=rng.randint(0, 3000)))) for i in range(120)] + [(500, "http://h/long", "x" * 9_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    index = warc.write_archives(pages)
    records = warc.read_records(index)
    assert records.rdd.getNumPartitions() > 8
    assert {(r.page_id, r.payload.decode()) for r in records.collect()} == {(i, h) for i, _, h in rows}


def test_damaged_record_is_refused():
    row = {"payload": b"x" * 10, "sha1": hashlib.sha1(b"x" * 10).digest(), "record_type": "response", "page_id": 1, "url": "u", "record_id": "r", "refers_to_record": None}
    raw = warc._record(row)
    assert warc.parse_record(raw)["payload"] == b"x" * 10
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(raw.replace(b"xxxxxxxxxx", b"xxxxxxxxxy"))


# --- licences


def brute_scan(text):
    best = {}
    table = defaultdict(set)
    rows = licenses.template_rows(licenses.TEMPLATES, 0.8)
    for name, *_, pair in rows:
        table[name].add(pair)
    flat = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).split()
    text = text or ""
    pieces = [flat(p) for p in re.sub(r"([.!?])[ \t]+", r"\1\n", text).split("\n") + re.split(r"\n[ \t\r]*\n", text) + [text]]
    words = flat(text)
    for word, place, n in licenses.window_rows(licenses.TEMPLATES, licenses.anchor_words(rows, 0.8)):
        pieces += [words[max(0, i - place) :][:n] for i, w in enumerate(words) if w == word]
    for w in pieces:
        mine = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
        scores = [(-round(2 * len(mine & t) / (len(mine) + len(t)), 6), n) for n, t in table.items() if mine and 2000 * len(mine & t) >= 800 * (len(mine) + len(t))]
        if scores:
            s, n = min(scores)
            best[n] = max(best.get(n, 0), -s)
    return {n: s for n, s in best.items() if not any(n == a and b in best for a, b in licenses.contained(licenses.TEMPLATES))}


def test_licence_edges(spark):
    notice = licenses.TEMPLATES["mit/notice"]
    rows = [(1, "x " * 400_000 + notice + " y" * 1000, None, None, "a", 1), (2, notice, None, None, "a", 1), (2, notice, None, None, "a", 1), (None, None, None, None, "a", 1)]
    got = licenses.scan(docs(spark, rows, EMPTY + ", licenses string, best long")).collect()
    assert sorted((r.doc_id or 0, r.licenses) for r in got if r.doc_id) == [(1, "mit/notice"), (2, "mit/notice"), (2, "mit/notice")]


def test_wrapped_headers_above_code(spark):
    code = "\n".join(f"x{i} = f(y{i}, {i})" for i in range(200))
    rows = []
    for i, (_, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        lines, line = [], "#"
        for w in text.split():
            if len(line) + len(w) > 75:
                lines.append(line)
                line = "#"
            line += " " + w
        rows.append((i, "\n".join([*lines, line, code]), None, None))
    rows += [(0, code, None, None), (5, rows[5][1], None, None)]
    got = licenses.scan(docs(spark, rows)).collect()
    names = sorted(licenses.TEMPLATES)
    found = Counter(r.doc_id for r in got if r.licenses and names[r.doc_id] in r.licenses.split(","))
    assert set(found) == set(range(len(names))) and found[5] == 2
    # rows that share a doc_id are judged each by itself
    assert sorted(r.n_licenses for r in got if r.doc_id == 0)[0] == 0


def test_licences_against_brute_force(spark):
    rng = random.Random(8)
    names = sorted(licenses.TEMPLATES)
    rows = []
    for i in range(150):
        w = licenses.TEMPLATES[rng.choice(names)].split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(["word", "the", "under"])
        rows.append((i, rng.choice(["", "Some text. ", "a\n\n"]) + " ".join(w) + rng.choice(["", " More.", "\nnext line"]), None, None))
    rows += [(900, None, None, None), (901, "", None, None), (902, "license", None, None), (903, "x " * 5000, None, None), (None, "Released under the MIT License.", None, None)]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    for i, text, *_ in rows:
        want = brute_scan(text)
        assert (got[i].licenses or "") == ",".join(sorted(want)) and got[i].n_licenses == len(want)
        assert got[i].best == (min(want, key=lambda n: (-want[n], n)) if want else None)
    assert licenses.scan(docs(spark, [])).count() == 0


# --- quality


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup, cover = set(), 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_counts_against_brute_force():
    rng = random.Random(6)
    texts = ["", " ", "\n\n", "a", "a\na\n a\na"] + ["".join(rng.choices(["a ", "b ", "é", "\n", "\t", "#", "x y z ", "[]", "\x1f"], k=rng.randint(0, 60))) for _ in range(400)]
    got = quality.count_rules(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in quality.COUNTS[:5]) == brute_counts(t), repr(t)


def test_forest_separates_junk(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    good = [" ".join(rng.choices(words, k=rng.randint(80, 200))) for _ in range(400)]
    bad = [" ".join(w + "###" for w in rng.choices(words, k=100)) for _ in range(60)]
    rows = [(i, t, None, None) for i, t in enumerate(good + bad)] + [(900, None, None, None), (None, good[0], None, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(400 + i, 0, 0) for i in range(30)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows), labels).collect()}
    assert sum(got[i].kept for i in range(200, 400)) >= 198
    assert not any(got[i].kept for i in range(400, 460))
    assert got[900].base_failed and got[None].kept
    plain = quality.judge(docs(spark, rows), labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in plain)


def plain_score(forest, row):
    """Mean path of a row, walked node by node, as the score."""
    total = 0.0
    for root in forest.roots:
        node = root
        while tuple(forest.child[node]) != (node, node):
            node = forest.child[node][int(row[forest.column[node]] >= forest.value[node])]
        total += forest.path[node]
    return 2 ** (-total / len(forest.roots) / forest.unit)


def test_scores_and_verdicts_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(10, 120))) + rng.choice(["", " ###" * 9, "\nsame line\nsame line"]) for _ in range(150)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(5, texts[6], None, None), (700, "wort " * 300_000, None, None), (701, "\n".join(f"l{i} {i * 7} x" for i in range(200_000)), None, None)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 150)], "doc_id long, quality int, toxic int")
    # one of the rows that share doc_id 5 is trained on, so it is left out of the labels
    labels = labels.where("doc_id <> 5")
    wide = docs(spark, [(*r, 1, "x") for r in rows], EMPTY + ", n_words long, kept string")
    forest, threshold = quality.fit(wide.select("doc_id", "text"), labels)
    got = quality.judge(wide, labels).collect()
    assert len(got) == len(rows)
    by_counts = Counter()
    for i, t, *_ in rows:
        c = {k: v for k, v in quality.count_rules(pa.array([t])).items()}
        assert tuple(int(c[k][0]) for k in quality.COUNTS[:5]) == brute_counts(t)
        failed = bool(quality.base_fails(c)[0])
        score = plain_score(forest, quality.features(c)[0])
        by_counts[i, brute_counts(t), failed, round(score, 6), not failed and score <= threshold + 1e-12] += 1
    assert by_counts == Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, round(r.score, 6), r.kept) for r in got)
    empty = docs(spark, [])
    assert quality.judge(empty, labels).count() == 0


def test_quality_is_fitted_on_every_labelled_document(spark):
    """Box, draws and threshold come from all labelled rows, however many."""
    n = 6_000
    texts = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (F.col("id") * 7 + i * i).cast("string")))).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(1).alias("quality"))
    rows = quality.labelled_features(quality.rule_counts(texts), labels)
    assert rows.count() == n and rows.where("good").count() == n - n // 3
    forest, bound = quality.fit(texts, labels)
    assert 0 < bound <= 1 and len(forest.roots) == quality.TREES
    assert quality.threshold(np.array([0, 5, 0, 0, 0]), np.array([0, 0, 0, 0, 9])) == 2 / quality.STEPS




# --- shards


def test_shards(spark):
    rows = [(i, "t" * (i % 50), None, None) for i in range(3000)] + [(None, None, None, None), (7, "again", None, None)]
    out = sharding.shard_documents(docs(spark, rows), 24).toPandas()
    assert len(out) == len(rows) and set(out["shard"]) == set(range(24))
    for _, s in out.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    moved = out[out["shard"] != out["grown_shard"]]
    assert set(moved["grown_shard"]) == {24} and 60 < len(moved) < 190
    assert out.groupby("shard").size().max() < 2 * len(rows) / 24
    assert sharding.shard_documents(docs(spark, []), 24).count() == 0


def brute_draw(level, weights, key):
    def u(child):
        h = xxhash.xxh64(level.encode(), seed=42).intdigest()
        h = xxhash.xxh64(child.to_bytes(4, "little"), seed=h).intdigest()
        if key is not None:
            h = xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=h).intdigest()
        return ((h >> 11) + 0.5) / (1 << 53)

    return min((-math.log(u(c)) / w, c) for c, w in weights.items())[1] if len(weights) > 1 else next(iter(weights))


def brute_shard(tree, key):
    weight = {r: {c: sum(s.values()) for c, s in racks.items()} for r, racks in tree.items()}
    region = brute_draw("region", {r: sum(w.values()) for r, w in weight.items()}, key)
    return brute_draw("shard", tree[region][brute_draw("rack", weight[region], key)], key)


def test_shards_against_brute_force(spark):
    rows = [(i * 7919 - 500, "é" * (i % 9), None, None) for i in range(400)] + [(None, None, None, None), (5, "a", None, None), (5, "a", None, None), (6, "z" * 3_000_000, None, None)]
    tree = sharding.even_tree(24)
    wide = spark.createDataFrame([(*r, "x", 1) for r in rows], EMPTY + ", shard string, slot long").repartition(3)
    got = sharding.shard_documents(wide, 24).collect()
    text = defaultdict(list)
    for i, t, *_ in rows:
        text[i].append((t or "").encode())
    assert len(got) == len(rows)
    for r in got:
        assert (r["shard"], r["grown_shard"]) == (brute_shard(tree, r["doc_id"]), brute_shard(sharding.grown(tree, 24), r["doc_id"]))
        assert (r["size"], r["text_crc32"]) in [(len(t) + 8, zlib.crc32(t)) for t in text[r["doc_id"]]]


def test_ranks_over_many_buckets(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i % 50) for i in range(1000)], "k string, x long").repartition(4)
    rows = common.with_rank(df, ["k"], ["x"], per_bucket=37).collect()
    for k in "ab":
        own = sorted(r["rank"] for r in rows if r["k"] == k)
        assert own == list(range(len(own)))


def test_growth_inside_a_region_stays_there(spark):
    tree = sharding.even_tree(24)
    heavier = {**tree, 1: {**tree[1], 3: {**tree[1][3], 99: 1.0}}}
    df = spark.range(4000).withColumnRenamed("id", "k")
    rows = sharding.place(sharding.place(df, "k", tree, "old"), "k", heavier, "new").collect()
    rack = {s: (r, c) for r, racks in heavier.items() for c, shards in racks.items() for s in shards}
    for r in rows:
        if r.old != r.new:
            assert rack[r.new][0] == 1
            assert rack[r.old][0] != 1 or rack[r.new][1] == 3
    share = Counter(rack[r.new][0] for r in rows)
    assert abs(share[1] / 4000 - 9 / 25) < 0.04
