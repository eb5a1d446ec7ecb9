"""Bank narrations: canonical form, rail, reference candidates, entity tokens, similarities."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of payment references, in order of priority.
NEFT = r"\b([A-Z]{4}[NR]\d{1,2}\d{8}\d{4,8})\b"
NEFT_LOOSE = r"([A-Z]{4}\s?[NR]\s?\d[\s]?\d{6,18})"
NUM12 = r"\b(\d{12})\b"
NUM_LONG = r"\b(\d{9,18})\b"
ALNUM = r"\b([A-Z0-9]{14,22})\b"
MIXED = r"\b([A-Z0-9]{10,13})\b"
ENTITY = r"(?i)\b((?:rfnd|disp|pay|setl|rsrv)_[0-9a-zA-Z]+)\b"
RULES = (("neft_rtgs_strict", NEFT), ("neft_rtgs_despaced", NEFT_LOOSE), ("imps_upi_12digit", NUM12), ("numeric_long", NUM_LONG),
    ("alnum_block", ALNUM), ("mixed_numeric_damaged", MIXED))
RAILS = (("NEFT", "neft"), ("IMPS", "imps"), ("RTGS", "rtgs"), ("UPI", "upi_payout"), ("CMS", "corp"))


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"\s+", " "))


def rail(canon: Column) -> Column:
    out = F.lit("")
    for prefix, name in reversed(RAILS):
        out = F.when(canon.startswith(prefix), name).otherwise(out)
    return out


def _kept(name: str, values: Column, text: Callable[[Column], Column] = lambda v: v) -> Column:
    """The matches of a rule that count; ``text`` takes the matched text from an element."""
    if name == "mixed_numeric_damaged":
        digits = lambda v: F.length(F.regexp_replace(text(v), "[^0-9]", ""))
        return F.filter(values, lambda v: (digits(v) >= 8) & (digits(v) < F.length(text(v))))
    return values


def _value(name: str, v: Column) -> Column:
    return F.replace(v, F.lit(" "), F.lit("")) if name == "neft_rtgs_despaced" else v


def _found(canon: Column, name: str, pattern: str) -> Column:
    values = F.regexp_extract_all(canon, F.lit(pattern), F.lit(1))
    return F.transform(_kept(name, values), lambda v: _value(name, v))


def utr_candidates(canon: Column) -> Column:
    """Reference candidates by priority of their shape, each once."""
    return F.array_distinct(F.concat(*[_found(canon, n, p) for n, p in RULES]))


def utr_spans(canon: Column) -> Column:
    """(field, rule, value, start, end) of every match of every rule, where it stands in the canonical text, from 0, end exclusive.

    A match stands behind the texts between matches and the matches before it.
    """

    def spans(name: str, pattern: str) -> Column:
        raw, between = F.regexp_extract_all(canon, F.lit(pattern), F.lit(1)), F.split(canon, pattern, -1)
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + F.length(x))
        starts = F.transform(raw, lambda v, i: F.struct(v.alias("v"), (total(F.slice(between, 1, i + 1)) + total(F.slice(raw, 1, i))).alias("start")))
        kept = _kept(name, starts, lambda s: s["v"])
        span = lambda s: F.struct(F.lit("utr").alias("field"), F.lit(name).alias("rule"), _value(name, s["v"]).alias("value"),
            s["start"].cast("long").alias("start"), (s["start"] + F.length(s["v"])).cast("long").alias("end"))
        return F.transform(kept, span)

    return F.concat(*[spans(n, p) for n, p in RULES])


def entity_tokens(text: Column) -> Column:
    """Lower-cased ids of refunds, disputes, payments, settlements and reserve entries in the raw text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(1)), F.lower))


def _trigrams(s: Column) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3)))
    return F.array_distinct(F.filter(grams, lambda g: F.length(g) == 3))


def trigram_jaccard(canon: Column, utr: Column) -> Column:
    """Jaccard of the trigrams of the narration's letters and digits and of a reference; 0 where either has none."""
    a, b = _trigrams(F.regexp_replace(canon, "[^A-Z0-9]", "")), _trigrams(F.coalesce(utr, F.lit("")))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with the prefix bonus at every score; both empty 1, one empty 0."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine = list(b), []
    for i, c in enumerate(a):
        lo = max(0, i - reach)
        for j in range(lo, min(len(b), i + reach + 1)):
            if free[j] == c:
                free[j] = ""
                mine.append(c)
                break
    if not mine:
        return 0.0
    m = len(mine)
    theirs = [c for c, f in zip(b, free, strict=True) if not f]
    half = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def best_similarity(candidates: Column, utr: Column) -> Column:
    """Highest similarity of the candidates to a reference; without a reference 1, without candidates 0."""

    def best(lists: pd.Series, references: pd.Series) -> pd.Series:
        return pd.Series([1.0 if not u else max((jaro_winkler(c, u) for c in cs), default=0.0) for cs, u in zip(lists, references, strict=True)],
            dtype="float64")

    return F.pandas_udf(best, "double")(candidates, utr)
