"""Language of documents and pages by Bayesian fusion of four kinds of evidence.

1. Text: naive Bayes over hashed byte trigrams, with a class for each language
   that ``LEAST_DOCUMENTS`` different texts of the whole table declare. It is
   trained on ``SAMPLE`` texts in all, shared evenly between the languages (of
   each those first in a hash order). A class "und" with even trigrams stands for all other text (even over half of the
   buckets, so that odd spellings of a known language stay with it). As trigrams of a text
   depend on each other, their log likelihood counts as that of at most
   ``EVIDENCE`` trigrams.
2. Declared language (markup or metadata): its probability under each true
   language, from ``TRUST``.
3. Address suffix: a country domain or a language part of the path, weaker.
4. Host: prior of the languages on the host, from the text evidence of all its
   documents summed by grouped aggregation, smoothed towards the prior of its
   domain, and that towards the prior of the whole corpus.

The posterior is their normalised product. A document is rejected if its text
has no letters, if "und" is most probable, or if no language reaches ``SURE``.

Edge cases: a null or empty text has no text evidence and is rejected; null
declarations, suffixes and hosts give no evidence (a null host is a host of
its own); a null id is carried; repeated rows give repeated results; rows that
share an id are judged each by its own text; a very long text is read whole, in
windows; of languages that are equally probable the first in the alphabet is
taken; an empty table, or one without declared languages to train on, gives
"und" for all rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconweave.llm.common import LOWER, WINDOW, durable, map_batches, small, text_buffer, text_slices

SAMPLE = 4000
BUCKETS = 1 << 14
#: Trigrams that a text counts as at most.
EVIDENCE = 60
TRUST_DECLARED, TRUST_SUFFIX = 0.95, 0.8
#: Documents that the prior above counts as on each level.
HOST_WEIGHT, DOMAIN_WEIGHT, CORPUS_WEIGHT = 20.0, 50.0, 1.0
SURE = 0.5
OTHER = "und"
#: Prior of text in no known language.
OTHER_PRIOR = 1e-3
#: Languages are those that at least so many different texts declare; each is trained on as many at least.
LEAST_DOCUMENTS = 3


#: Bytes as lower-case letters, every other one as a space.
_LETTERS = np.where((LOWER >= 97) & (LOWER <= 122) | (LOWER >= 128), LOWER, 32).astype(np.int32)


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Hashed trigrams of lower-cased bytes, where each byte that is no letter counts as a space; -1 if all are spaces."""
    if len(raw) < 3:
        return np.zeros(0, np.int32)
    x = _LETTERS[raw]
    hashed = ((x[:-2] * 961 + x[1:-1] * 31 + x[2:]) * 40503 >> 7) & (BUCKETS - 1)
    letter = x != 32
    hashed[~(letter[:-2] | letter[1:-1] | letter[2:])] = -1
    return hashed


def windows(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of one text that together hold each of its trigrams once."""
    for lo in range(0, max(len(raw) - 2, 1), WINDOW):
        yield raw[lo : lo + WINDOW + 2]


class TextModel:
    """Log probabilities of trigrams by language, the last class being ``OTHER``."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, OTHER]
        smooth = counts + 0.05
        logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        self.logs = np.vstack([logs, np.full((1, BUCKETS), -np.log(BUCKETS / 2))]).astype(np.float32)

    def sums(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods, one row per text, and the number of trigrams with a letter."""
        grams = trigrams(raw)
        n = len(offsets) - 1
        valid = np.zeros(len(raw) + 1, bool)
        valid[: len(grams)] = grams >= 0
        for cut in (1, 2):
            at = offsets[1:] - cut
            valid[at[at >= 0]] = False
        at = np.flatnonzero(valid)
        edges = np.searchsorted(at, offsets)
        found = grams[at]
        out = np.zeros((n, len(self.languages)))
        for i, logs in enumerate(self.logs):
            total = np.append(0.0, np.cumsum(logs[found], dtype=np.float64))
            out[:, i] = total[edges[1:]] - total[edges[:-1]]
        return out, np.diff(edges)

    def evidence(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods, one row per text, and the number of trigrams with a letter; a long text goes window by window."""
        raw, offsets = text_buffer(column)
        if len(offsets) == 2:
            parts = [self.sums(part, np.array([0, len(part)])) for part in windows(raw)]
            out, used = sum(x for x, _ in parts), sum(x for _, x in parts)
        else:
            out, used = self.sums(raw, offsets)
        return out * (np.minimum(used, EVIDENCE) / np.maximum(used, 1))[:, None], used


def fit(rows: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Train on about ``sample`` different texts of (text, declared), from each language those first in a hash order.

    Languages are counted over all rows. The order is found on hashes alone;
    only the chosen texts are brought together, each once.
    """
    known = rows.where("declared is not null and length(text) > 0").select("text", "declared", F.xxhash64("text").alias("h"))
    texts = durable(known.groupBy("h").agg(F.min("declared").alias("declared")), "hashes")
    sizes = {r.declared: r.n for r in texts.groupBy("declared").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS).collect()}
    languages = sorted(sizes)
    if not languages:
        return TextModel([], np.zeros((0, BUCKETS)))
    each = max(LEAST_DOCUMENTS, sample // len(languages))
    # a bound on hashes leaves about twice as many as are taken, so that no task ranks a whole language
    below = {x: -(1 << 63) + min((1 << 64) - 1, (1 << 64) * (2 * each + 50) // n) for x, n in sizes.items()}
    bounds = known.sparkSession.createDataFrame(list(below.items()), "declared string, below long")
    nth = F.row_number().over(Window.partitionBy("declared").orderBy("h"))
    first = texts.join(F.broadcast(bounds), "declared").where("h <= below").withColumn("nth", nth).where(F.col("nth") <= each)
    first = durable(first.select("h", "declared"), "first")
    chosen = known.join(small(first, 16), ["h", "declared"]).groupBy("h", "declared").agg(F.min("text").alias("text")).select("text", "declared")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for text, declared in zip(batch["text"], batch["declared"].to_pylist(), strict=True):
                times = np.zeros(BUCKETS, np.int64)
                for part in windows(np.frombuffer(text.as_buffer(), np.uint8)):
                    grams = trigrams(part)
                    times += np.bincount(grams[grams >= 0], minlength=BUCKETS)
                at = np.flatnonzero(times)
                yield pa.RecordBatch.from_pydict({"declared": pa.array([declared] * len(at), pa.string()), "gram": at.astype(np.int32),
                    "n": times[at]})

    counted = map_batches(chosen, count, "declared string, gram int, n long").groupBy("declared", "gram").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    for i, language in enumerate(languages):
        own = found[found.declared == language]
        counts[i, own.gram] = own.n
    return TextModel(languages, counts)


# Country domains and the language that most of their pages are in.
COUNTRY_LANGUAGES = {
    "ar": "es", "at": "de", "br": "pt", "cl": "es", "cn": "zh", "co": "es", "cz": "cs", "de": "de", "dk": "da", "es": "es", "fi": "fi",
        "fr": "fr", "gr": "el", "hu": "hu", "ie": "en", "it": "it", "jp": "ja", "kr": "ko",
    "mx": "es", "nl": "nl", "no": "no", "nz": "en", "pe": "es", "pl": "pl", "pt": "pt", "ro": "ro", "ru": "ru", "se": "sv", "sk": "sk",
        "th": "th", "tr": "tr", "tw": "zh", "ua": "uk", "uk": "en", "us": "en", "vn": "vi",
}


def language_tag(declared: Column) -> Column:
    """Primary part of a language tag in lower case; blank as null."""
    tag = F.regexp_extract(F.lower(F.trim(declared.cast("string"))), "^([a-z]{2,3})([-_].*)?$", 1)
    return F.when(F.length(tag) > 0, tag)


def identify(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Language of each row of (id, text, declared, suffix, host, domain), one row each.

    Returns id, language, confidence, text_language, kept. ``declared`` and
    ``suffix`` are language tags.
    """
    return verdicts(rows.withColumn("mark", F.lit(None).cast("long")), sample).drop("mark")


def verdicts(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``identify`` of rows with a ``mark`` (long), which is carried along."""
    rows = rows.select("id", "mark", F.col("text").cast("string").alias("text"), language_tag(F.col("declared")).alias("declared"),
        language_tag(F.col("suffix")).alias("suffix"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("domain", F.lit("")).alias("domain"))
    model = fit(rows, sample)
    names = model.languages
    k = len(names)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, hi in text_slices(batch["text"]):
                logs, used = model.evidence(batch["text"][lo:hi])
                values = pa.array(logs.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, logs.size + 1, k), pa.int32()), values)
                carried = ["id", "mark", "declared", "suffix", "host", "domain"]
                yield pa.RecordBatch.from_arrays([*(batch[c][lo:hi] for c in carried), lists, pa.array(used)], [*carried, "logs", "used"])

    scored = map_batches(rows, score, "id long, mark long, declared string, suffix string, host string, domain string, logs array<double>, used long")
    scored = durable(scored, "scored")

    # text posteriors summed per host, then shrunk level by level; hosts are fewer than documents, yet joins may shuffle
    log = lambda i: F.col("logs")[i]
    top = F.array_max("logs")
    mass = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    soft = [F.sum(F.exp(log(i) - top) / mass).alias(f"p{i}") for i in range(k)]
    hosts = durable(scored.where("used > 0").groupBy("host", "domain").agg(*soft), "hosts")
    sums = [F.sum(f"p{i}").alias(f"q{i}") for i in range(k)]
    corpus = hosts.agg(*sums).first()
    total = sum(x or 0.0 for x in corpus)
    flat = [(1 - OTHER_PRIOR) / max(1, k - 1) if n != OTHER else OTHER_PRIOR for n in names]
    base = [((x or 0.0) + CORPUS_WEIGHT * f) / (total + CORPUS_WEIGHT) for x, f in zip(corpus, flat, strict=True)]
    domains = hosts.groupBy("domain").agg(*sums)
    share = lambda pre, weight, above: [(F.col(f"{pre}{i}") + weight * a) / (sum(F.col(f"{pre}{j}") for j in range(k)) + weight) for i,
        a in enumerate(above)]
    domains = domains.select("domain", F.array(*share("q", DOMAIN_WEIGHT, [F.lit(b) for b in base])).alias("above"))
    priors = hosts.join(domains, "domain").select("host", "domain", F.array(*share("p", HOST_WEIGHT,
        [F.col("above")[i] for i in range(k)])).alias("prior"))
    priors = durable(priors, "priors")

    def told(column: str, trust: float, i: int) -> Column:
        right, wrong = float(np.log(trust)), float(np.log((1 - trust) / max(1, k - 2)))
        known = F.col(column).isin(names[:-1]) if k > 1 else F.lit(False)
        neutral = F.when(F.col(column) == names[i], right).otherwise(wrong) if names[i] != OTHER else F.lit(float(np.log(0.5)))
        return F.when(known, neutral).otherwise(0.0)

    out = scored.join(small(priors, 40 + 8 * k), ["host", "domain"], "left")
    prior = [F.coalesce(F.col("prior")[i], F.lit(b)) for i, b in enumerate(base)]
    joint = F.array(*[log(i) + F.log(prior[i]) + told("declared", TRUST_DECLARED, i) + told("suffix", TRUST_SUFFIX, i) for i in range(k)])
    out = out.withColumn("joint", joint).withColumn("best", F.array_max("joint"))
    place = lambda c: F.element_at(F.array(*map(F.lit, names)), F.array_position(c, F.array_max(c)).cast("int"))
    confidence = F.round(1 / F.aggregate("joint", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best"))), 6)
    language = F.when(F.col("used") > 0, place(F.col("joint"))).otherwise(OTHER)
    out = out.select("id", "mark", language.alias("language"), F.when(F.col("used") > 0, confidence).otherwise(0.0).alias("confidence"),
        F.when(F.col("used") > 0, place(F.col("logs"))).otherwise(OTHER).alias("text_language"))
    return out.withColumn("kept", (F.col("language") != OTHER) & (F.col("confidence") >= SURE))


def of_documents(docs: DataFrame, *more: Column) -> DataFrame:
    """``documents`` as evidence: the declared language, and the source as host."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").alias("declared"),
        F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), F.lit("").alias("domain"), *more)


def of_pages(pages: DataFrame) -> DataFrame:
    """``pages`` as evidence: markup language, language part of the path or country domain, host and its parent domain."""
    html, url = F.col("html").cast("string"), F.col("url").cast("string")
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/:?#]+)", 1))
    path = F.regexp_extract(F.lower(url), "^[a-z]+://[^/]+/([a-z]{2})(/|$)", 1)
    table = F.create_map(*[F.lit(x) for kv in COUNTRY_LANGUAGES.items() for x in kv])
    country = table[F.regexp_extract(host, r"\.([a-z]{2})$", 1)]
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), "(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("id"),
        text.alias("text"),
        F.regexp_extract(html, "(?is)<html[^>]*\\blang\\s*=\\s*[\"']?([a-z-]+)", 1).alias("declared"),
        F.when(F.length(path) > 0, path).otherwise(country).alias("suffix"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
    )


def evidence_mark() -> Column:
    """Hash of all that decides a document's language: rows alike in it and in doc_id have one verdict."""
    return F.xxhash64(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is known, each judged by itself also where rows share a doc_id or have none; all columns as they are."""
    judged = verdicts(of_documents(docs, evidence_mark().alias("mark")))
    gone = durable(judged.where("not kept").select(F.col("id").alias("__gone_id"), F.col("mark").alias("__gone_mark")).distinct(), "gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone_id")) & (evidence_mark() == F.col("__gone_mark"))
    return docs.join(small(gone, 24), same, "left_anti")
