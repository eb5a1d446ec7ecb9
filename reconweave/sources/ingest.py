"""Validation of incoming files: whole files first, then one declarative pass that gives each row its first failing rule.

Files come as (merchant_id, file, content). A file that fails a gate is refused
whole, with a row that says why. Rows come as text lines with a file name and
line number. The rules of an entity are columns in order; the first that is not
null is the reject reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconweave.functions.durable import small
from reconweave.functions.money import AMOUNT

# Exact headers and the kind of each column. "!" marks required, "±" an amount that may be negative.
ENTITIES: dict[str, dict[str, str]] = {
    "payments": {"payment_id": "id", "order_id": "text", "amount": "amount", "method": "text!", "status": "text!", "created_at_ist": "ts_ist"},
    "orders": {"order_id": "id", "customer_id": "text", "amount": "amount", "created_at_utc": "ts_utc"},
    "settlements": {"settlement_id": "id", "utr": "text", "gross": "amount", "fees": "amount", "gst": "amount", "tds": "amount", "net": "amount",
        "settled_at": "ts_ist", "instant": "flag"},
    "bank": {"bank_txn_id": "id", "value_date": "date", "amount": "amount±", "narration": "text"},
    "refunds": {"refund_id": "id", "payment_id": "text!", "amount": "amount", "created_at_ist": "ts_ist", "netted_flag": "flag"},
    "chargebacks": {"dispute_id": "id", "payment_id": "text!", "amount": "amount", "fee": "amount", "raised_at_ist": "ts_ist",
        "reversed_at_ist": "ts_ist?"},
    "reserve": {"reserve_id": "id", "amount": "amount", "held_on": "date", "release_date": "date", "released_at_ist": "ts_ist?",
        "netted_flag": "flag"},
}
FLAGS_TRUE, FLAGS_FALSE = ("true", "t", "1", "yes", "y"), ("false", "f", "0", "no", "n", "")
MAX_ID, MAX_RAW, MAX_FILE = 128, 400, 64 << 20
SAMPLE = 20
#: A quoted field with doubled quotes inside.
QUOTED = '"([^"]|"")*"'


STAMP = r"^(\d{4}-\d{2}-\d{2})([T ](\d{2}:\d{2}(:\d{2})?))?(Z|[+-]\d{2}:?\d{2})?$"
#: Parts of a timestamp with the group of each, empty where the text is none.
PARTS = {"day": 1, "clock": 3, "zone": 5}


def _stamp(name: str, zone_minutes: int) -> Column:
    """A timestamp's parts as local wall clock; an offset is converted."""
    body, clock, offset = (F.col(f"_{name}_{part}") for part in PARTS)
    full = F.concat(body, F.lit(" "), F.when(clock == "", "00:00:00").when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock))
    local = full.try_cast("timestamp_ntz")
    digits = F.regexp_replace(offset, "[^0-9]", "")
    minutes = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")) * F.when(F.startswith(offset,
        F.lit("-")), -1).otherwise(1)
    shift = F.when(offset == "", F.lit(0)).when(offset == "Z", F.lit(zone_minutes)).otherwise(F.lit(zone_minutes) - minutes)
    return F.when(body != "", local + F.make_dt_interval(mins=shift))


def _value(name: str, kind: str) -> Column:
    """Value of a field from its trimmed text, of a timestamp from its parts."""
    t = F.col(f"_{name}_t")
    if kind.startswith("amount"):
        return (t.try_cast("decimal(18,2)") * 100).cast("long")
    if kind.startswith("ts_"):
        return _stamp(name, 330 if kind.startswith("ts_ist") else 0)
    if kind == "date":
        return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date"))
    if kind == "flag":
        return F.when(F.lower(t).isin(*FLAGS_TRUE), True).when(F.lower(t).isin(*FLAGS_FALSE), False)
    return F.when(t != "", t)


def _rule(name: str, kind: str) -> Column:
    """Reason why a field is rejected, by its trimmed text and value, or null."""
    t, value = F.col(f"_{name}_t"), F.col(name)
    if kind == "id":
        return F.when((t == "") | (F.length(t) > MAX_ID), "MISSING_ID")
    if kind == "text!":
        return F.when(t == "", "MISSING_FIELD")
    if kind.startswith("amount"):
        bad = ~t.rlike(AMOUNT)
        return F.when(bad if kind.endswith("±") else bad | t.startswith("-"), "MALFORMED_AMOUNT")
    if kind.startswith("ts_") or kind == "date":
        return F.when((t != "") & value.isNull() if kind.endswith("?") else value.isNull(), "INVALID_DATE")
    if kind == "flag":
        return F.when(value.isNull(), "MALFORMED_FIELD")
    return F.lit(None).cast("string")


def read_files(spark: SparkSession, path: str, merchant_id: str | None = None) -> DataFrame:
    """(merchant_id, file, content) of files; without a merchant the folder ``merchant_id=`` or the one above ``observable`` names it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if merchant_id is not None:
        merchant = F.lit(merchant_id)
    else:
        named = [F.regexp_extract("path", p, 1) for p in ("/merchant_id=([^/]+)/", "/([^/]+)/observable/")]
        merchant = F.coalesce(*[F.when(m != "", m) for m in named])
    return files.select(merchant.alias("merchant_id"), F.col("path").alias("file"), "content")


def gate_files(files: DataFrame, entity: str, merchants: DataFrame | None = None) -> DataFrame:
    """Files with ``refusal``: why a whole file is refused, or null."""
    if merchants is None:
        files = files.withColumn("known", F.lit(True))
    else:
        known = merchants.select("merchant_id").distinct().withColumn("known", F.lit(True))
        files = files.join(small(known, 32), "merchant_id", "left")
    text = F.when(F.is_valid_utf8(F.col("content")), F.decode("content", "UTF-8"))
    header = F.lower(F.trim(F.split(F.regexp_replace(text, "^\ufeff", ""), "\r?\n")[0]))
    size = F.octet_length("content")
    why = (
        F.when(F.col("known").isNull(), "UNKNOWN_MERCHANT").when(F.coalesce(size, F.lit(0)) == 0, "EMPTY_FILE").when(size > MAX_FILE,
            "FILE_TOO_LARGE")
        .when(text.isNull(), "NOT_UTF8").when(header != ",".join(ENTITIES[entity]), "BAD_HEADER")
    )
    return files.withColumn("refusal", why).drop("known")


def lines_of(files: DataFrame) -> DataFrame:
    """(merchant_id, file, line_no, line) of files that are not refused, header included as line 1."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    rows = files.where("refusal is null").select("merchant_id", "file", F.posexplode(F.split(text, "\r?\n")).alias("n", "line"))
    return rows.select("merchant_id", "file", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def parse_line(line: Column, columns: int) -> Column:
    """Fields of a CSV line as a struct c0, c1, ...: quotes, doubled quotes and commas inside them."""
    schema = ", ".join(f"c{i} string" for i in range(columns))
    return F.from_csv(line, F.lit(schema), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})


def validate(lines: DataFrame, entity: str, committed: DataFrame | None = None, sums: bool = True) -> DataFrame:
    """Each data line with its typed columns, ``reject_reason`` (null if it is accepted) and ``detail``.

    Order: column count, the fields' rules in column order, the sum of a
    settlement, quotes that do not close, a repeated id within the file among
    rows that parse, an id that was committed before. Without ``sums`` a
    settlement may report any net.
    """
    columns = ENTITIES[entity]
    header = ",".join(columns)
    bad_files = lines.where((F.col("line_no") == 1) & (F.lower(F.trim("line")) != header)).select("merchant_id", "file").distinct()
    data = lines.where((F.col("line_no") > 1) & (F.trim("line") != "")).join(bad_files, ["merchant_id", "file"], "left_anti")
    # layer by layer: each text is parsed once, and the generated methods stay small enough to be compiled
    out = data.withColumn("f", parse_line(F.col("line"), len(columns) + 1))
    out = out.withColumns({f"_{n}": F.coalesce(F.col(f"f.c{i}"), F.lit("")) for i, n in enumerate(columns)}).drop("f")
    out = out.withColumns({f"_{n}_t": F.trim(F.col(f"_{n}")) for n in columns})
    out = out.withColumns({f"_{n}_{part}": F.regexp_extract(F.col(f"_{n}_t"), STAMP, group) for n, k in columns.items() if k.startswith("ts_")
        for part, group in PARTS.items()})
    out = out.withColumns({n: _value(n, k) for n, k in columns.items()})
    # quoted commas and quotes do not count
    out = out.withColumn("_bare", F.regexp_replace("line", QUOTED, ""))
    out = out.withColumn("_commas", F.length(F.regexp_replace("_bare", "[^,]", "")))
    out = out.withColumns({f"_{n}_why": _rule(n, k) for n, k in columns.items()})
    reject = lambda reason, detail: F.when(reason.isNotNull(), F.struct(reason.alias("reason"), detail.alias("detail")))
    arity = F.when(F.col("_commas") != len(columns) - 1, "ARITY")
    rules = [reject(arity, F.concat((F.col("_commas") + 1).cast("string"), F.lit(f" fields instead of {len(columns)}")))]
    rules += [reject(F.col(f"_{n}_why"), F.concat(F.lit(f"{n}: "), F.col(f"_{n}"))) for n in columns]
    late = []
    if entity == "settlements" and sums:
        off = F.col("gross") - F.col("fees") - F.col("gst") - F.col("tds") != F.col("net")
        late.append(reject(F.when(off, "MONETARY_INCONSISTENT"), F.lit("net is not gross less fees, gst and tds")))
    open_quote = F.contains("_bare", F.lit('"'))
    late.append(reject(F.when(open_quote, "UNPARSEABLE"), F.lit("a quote does not close")))
    out = out.withColumn("r", F.coalesce(*rules, *late)).select(*data.columns, *columns, "r")
    key = next(iter(columns))
    same = Window.partitionBy("merchant_id", "file", key, F.col("r").isNull()).orderBy("line_no")
    out = out.withColumns({"n": F.row_number().over(same), "first": F.min("line_no").over(same)})
    again = reject(F.when(F.col("n") > 1, "DUPLICATE_IN_FILE"), F.concat(F.lit("same id as line "), F.col("first").cast("string")))
    out = out.withColumn("r", F.coalesce("r", again)).drop("n", "first")
    if committed is not None:
        known = committed.select("merchant_id", F.col(key)).distinct().withColumn("known", F.lit(True))
        before = reject(F.when(F.col("known"), "DUPLICATE_EXISTING"), F.concat(F.lit("already committed: "), F.col(key)))
        out = out.join(known, ["merchant_id", key], "left").withColumn("r", F.coalesce("r", before)).drop("known")
    return out.withColumns({"reject_reason": F.col("r.reason"), "detail": F.col("r.detail")}).drop("r")


def rejects(validated: DataFrame) -> DataFrame:
    """Rejected lines with number, reason, detail and the raw line cut at 400 characters."""
    raw = F.when(F.length("line") > MAX_RAW, F.concat(F.substring("line", 1, MAX_RAW), F.lit("…"))).otherwise(F.col("line"))
    return validated.where("reject_reason is not null").select("merchant_id", "file", "line_no", "reject_reason", "detail", raw.alias("raw_line"))


def refused_files(gated: DataFrame) -> DataFrame:
    """A reject row, line 0, for each file that is refused whole."""
    return gated.where("refusal is not null").select(
        "merchant_id", "file", F.lit(0).cast("long").alias("line_no"), F.col("refusal").alias("reject_reason"),
            F.concat(F.coalesce(F.octet_length("content"), F.lit(0)).cast("string"), F.lit(" bytes")).alias("detail"), F.lit("").alias("raw_line")
    )


def report(validated: DataFrame) -> DataFrame:
    """Rows accepted and rejected by reason."""
    return validated.groupBy("merchant_id", F.coalesce("reject_reason", F.lit("ACCEPTED")).alias("outcome")).agg(F.count("*").alias("n"))


def file_report(gated: DataFrame, validated: DataFrame) -> DataFrame:
    """Of each file, refused ones included: SHA-256, refusal, rows seen, accepted, rejected, rejects by reason, and the first twenty rejected lines."""
    keys = ["merchant_id", "file"]
    bad = F.col("reject_reason").isNotNull()
    # the lines are read once: counted by file and reason, then by file
    n = validated.groupBy(*keys, "reject_reason").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(bad, F.col("line_no")))).alias("lines"))
    rejected = F.when(bad, F.col("n"))
    why = F.when(bad, F.concat_ws(":", "reject_reason", F.col("n").cast("string")))
    first = F.slice(F.sort_array(F.flatten(F.collect_list(F.slice("lines", 1, SAMPLE)))), 1, SAMPLE)
    n = n.groupBy(*keys).agg(F.sum("n").alias("seen"), F.sum(F.when(~bad, F.col("n"))).alias("accepted"), F.sum(rejected).alias("rejected"),
        F.array_join(F.array_sort(F.collect_list(why)), ",").alias("by_reason"),
        F.array_join(F.transform(first, lambda x: x.cast("string")), ",").alias("sample_lines"))
    files = gated.select(*keys, F.sha2("content", 256).alias("sha256"), "refusal")
    out = files.join(n, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("seen", "accepted", "rejected")} | {c: F.coalesce(c,
        F.lit("")) for c in ("by_reason", "sample_lines")})


def ingest(files: DataFrame, entity: str, merchants: DataFrame | None = None, committed: DataFrame | None = None, sums: bool = True) -> dict[str, DataFrame]:
    """Accepted rows, all rejects (of files and of lines) and the report of (merchant_id, file, content) rows."""
    gated = gate_files(files, entity, merchants)
    rows = validate(lines_of(gated), entity, committed, sums)
    accepted = rows.where("reject_reason is null").select("merchant_id", *ENTITIES[entity])
    return {"accepted": accepted, "rejects": refused_files(gated).unionByName(rejects(rows)), "report": file_report(gated, rows)}


#: Names of an entity's file where they are not the entity's.
FILES = {"bank": "{bank,bank_statement}", "reserve": "{reserve,reserve_ledger}"}


def load_dataset(spark: SparkSession, root: str, merchant_id: str | None = None, cards: str | None = None) -> dict[str, DataFrame]:
    """The seven entities, accepted rows only, with the tiers (``rate``) and other terms (``terms``) of the merchants' rate cards.

    Files lie under ``root``/<merchant>/observable with the cards in
    ``root``/<merchant>/config; or each entity is a folder in ``root``/parts with a part
    merchant_id=<merchant> each; or ``merchant_id`` names the one merchant whose files
    are in ``root`` itself. An entity is a file, or a folder of files each with
    the header. ``cards`` is another place of the cards. Settlements are taken
    as they were reported, whether or not their sums agree; ``ingest`` is the
    gate for that.
    """
    flat = merchant_id is not None
    path = lambda e: f"{root}/{FILES.get(e, e)}.csv" if flat else f"{root}/{{*/observable,parts}}/{FILES.get(e, e)}.csv"
    out = {e: ingest(read_files(spark, path(e), merchant_id), e, sums=False)["accepted"] for e in ENTITIES}
    cards = cards or (f"{root}/rate_card_published.json" if flat else f"{root}/{{*/config/rate_card_published.json,parts/rate_cards}}")
    card = spark.read.text(cards, wholetext=True).select(F.col("value").alias("card"))
    if flat:
        card = card.withColumn("merchant_id", F.lit(merchant_id))
    return out | {"rate": rate_tiers(card), "terms": rate_terms(card)}


CARD = "merchant_id string, gst_rate_pct string, tds_rate_pct string, reserve_rate_pct string, instant_surcharge_pct string, dispute_fee string, tolerance_paise bigint, reserve_methods array<string>, methods map<string,array<struct<effective_from:string,pct:string,flat_paise:bigint>>>"


def _basis_points(pct: Column) -> Column:
    return F.round(pct.cast("decimal(9,4)") * 100).cast("long")


def _cards(cards: DataFrame) -> DataFrame:
    """Rate cards parsed; a column ``merchant_id`` beside the text goes before the one inside."""
    read = cards.withColumn("c", F.from_json("card", CARD))
    merchant = F.coalesce("merchant_id", "c.merchant_id") if "merchant_id" in cards.columns else F.col("c.merchant_id")
    return read.select(merchant.alias("merchant_id"), "c")


def rate_tiers(cards: DataFrame) -> DataFrame:
    """(merchant_id, method, effective_from, pct_bp, flat_paise) from rate cards as JSON text in ``card``."""
    card = _cards(cards).select("merchant_id", F.explode("c.methods").alias("method", "tiers"))
    tiers = card.select("merchant_id", "method", F.explode("tiers").alias("t"))
    from_date = F.col("t.effective_from").cast("date").alias("effective_from")
    return tiers.select("merchant_id", "method", from_date, _basis_points(F.col("t.pct")).alias("pct_bp"), "t.flat_paise")


def rate_terms(cards: DataFrame) -> DataFrame:
    """(merchant_id, gst_bp, tds_bp, reserve_bp, reserve_methods, instant_bp, dispute_fee_paise, tolerance_paise); null where a card does not say."""
    card = _cards(cards)
    bp = lambda n, as_: _basis_points(F.col(f"c.{n}")).alias(as_)
    return card.select(
        "merchant_id",
        bp("gst_rate_pct", "gst_bp"),
        bp("tds_rate_pct", "tds_bp"),
        bp("reserve_rate_pct", "reserve_bp"),
        F.array_join("c.reserve_methods", ",").alias("reserve_methods"),
        bp("instant_surcharge_pct", "instant_bp"),
        (F.col("c.dispute_fee").cast("decimal(18,2)") * 100).cast("long").alias("dispute_fee_paise"),
        "c.tolerance_paise",
    )
