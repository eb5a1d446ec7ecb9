"""Money as integer paise: parsing, formatting, rounding. No float touches an amount."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: paise by which a credit may differ from its prediction.
TOLERANCE = 100
AMOUNT = r"^-?\d{1,15}(\.\d{1,2})?$"


def parse(text: Column) -> Column:
    """Rupee text to paise; blank as 0, anything malformed as null."""
    t = F.trim(text)
    return F.when(t == "", F.lit(0).cast("long")).when(t.rlike(AMOUNT), (t.try_cast("decimal(18,2)") * 100).cast("long"))


def fmt(paise: Column) -> Column:
    """``-1234.56`` from paise."""
    a = F.abs(paise)
    return F.concat(F.when(paise < 0, "-").otherwise(""), F.floor(a / 100).cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


def fmt_inr(paise: Column) -> Column:
    """Indian grouping, ``12,34,567.89``: the last three digits, then pairs."""
    a = F.abs(paise)
    whole = F.floor(a / 100).cast("string")
    head = F.reverse(F.regexp_replace(F.reverse(F.substring(whole, F.lit(1), F.length(whole) - 3)), r"(\d{2})(?=\d)", "$1,"))
    grouped = F.when(F.length(whole) > 3, F.concat(head, F.lit(","), F.substring(whole, F.length(whole) - 2, F.lit(3)))).otherwise(whole)
    return F.concat(F.when(paise < 0, "-").otherwise(""), grouped, F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


def pct_of(paise: Column, basis_points: Column | int) -> Column:
    """Share of a non-negative amount, rounded half up to whole paise."""
    bp = F.lit(basis_points) if isinstance(basis_points, int) else basis_points
    return F.floor((paise * bp + 5000) / F.lit(10000).cast("decimal(20,0)")).cast("long")


def lakh(paise: Column) -> Column:
    """Amount in lakh rupees with two decimals."""
    return F.round(paise.cast("decimal(20,0)") / F.lit(10_000_000).cast("decimal(20,0)"), 2).cast("double")
