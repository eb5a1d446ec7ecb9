"""Files in and results out, as registered queries.

Incoming files are made from the given tables, with faults planted by key, so
that SQL knows the expected reason of each row without parsing anything.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconweave.functions.durable import shared_dir, written
from reconweave.operators import artefact
from reconweave.operators.matching import FEATURES
from reconweave.plans.registry import Entities, on_table, query, run
from reconweave.plans.reconcile import Reconciliation
from reconweave.sources import ingest, normalise, sinks
from reconweave.streaming import jobs

_HEADER = ",".join(ingest.ENTITIES["payments"])
# a payments file per 3,000 orders; every fortieth order has one of eight faults
_LINE = """
    CASE k % 40 WHEN 2 THEN '' WHEN 7 THEN 'pay_' || CAST(k - 7 AS STRING) ELSE 'pay_' || CAST(k AS STRING) END || ',ord_' || CAST(k AS STRING) || ',' ||
    CASE k % 40 WHEN 4 THEN '12.345' WHEN 5 THEN '-7.00' ELSE CAST(k % 1000 AS STRING) || '.50' END || ',' || CASE k % 40 WHEN 3 THEN '' ELSE 'upi' END || ',captured,' ||
    CASE k % 40 WHEN 6 THEN '2025-13-01T10:00:00+05:30' ELSE '2025-11-05T10:00:00+05:30' END || CASE k % 40 WHEN 1 THEN ',more' WHEN 9 THEN '"' ELSE '' END"""
_WHY = "CASE k % 40 WHEN 1 THEN 'ARITY' WHEN 2 THEN 'MISSING_ID' WHEN 3 THEN 'MISSING_FIELD' WHEN 4 THEN 'MALFORMED_AMOUNT' WHEN 5 THEN 'MALFORMED_AMOUNT' WHEN 6 THEN 'INVALID_DATE' WHEN 7 THEN 'DUPLICATE_IN_FILE' WHEN 8 THEN 'DUPLICATE_EXISTING' WHEN 9 THEN 'INVALID_DATE' END"
_ROWS = f"""SELECT k, file, line, CASE WHEN why = 'DUPLICATE_IN_FILE' AND NOT has_first THEN NULL ELSE why END AS why, row_number()
    OVER (PARTITION BY file ORDER BY k) + 1 AS line_no FROM (SELECT k, 'f' || CAST({{div}} AS STRING) || '.csv' AS file, {_LINE} AS line, {_WHY}
    AS why, max(CASE WHEN k % 40 = 0 THEN k END) OVER (ORDER BY k ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) = k - k % 40 AS has_first
    FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM {{orders}}) AS o) AS r"""
_SQL_ROWS = _ROWS.format(div="k // 4000", orders="orders")


#: Rows of the planted files that are a task. Files are few bytes for much work, so their tasks grow with the rows, not with the bytes.
TASK_ROWS = 25_000


def _planted(orders: DataFrame, file: Column, line: str) -> DataFrame:
    """(k, file, line) of planted files, a file whole in its partition."""
    rows = orders.select(F.col("o_orderkey").cast("long").alias("k")).withColumns({"file": file, "line": F.expr(line)})
    return rows.repartition(1 + orders.count() // TASK_ROWS, "file")


def _lines(orders: DataFrame) -> DataFrame:
    """(k, file, line_no, line) of the planted files."""
    rows = _planted(orders, F.concat(F.lit("f"), F.floor(F.col("k") / 4000).cast("string"), F.lit(".csv")), _LINE)
    return rows.withColumn("line_no", (F.row_number().over(Window.partitionBy("file").orderBy("k")) + 1).cast("long"))


def _files(orders: DataFrame) -> DataFrame:
    """The planted files whole, each one of its own size."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    files = _lines(orders).groupBy("file").agg(F.concat(F.lit(_HEADER + "\n"), body).cast("binary").alias("content"))
    return files.select(F.lit("m1").alias("merchant_id"), "file", "content")


def _ingested(orders: DataFrame) -> dict[str, DataFrame]:
    committed = orders.where("o_orderkey % 40 = 8").select(F.lit("m1").alias("merchant_id"),
        F.concat(F.lit("pay_"), F.col("o_orderkey").cast("string")).alias("payment_id"))
    return ingest.ingest(_files(orders), "payments", committed=committed)


@on_table("orders", f"SELECT file, line_no, why AS reject_reason, line AS raw_line FROM ({_SQL_ROWS}) AS r WHERE why IS NOT NULL")
def ingest_rejects(orders):
    """ING-04..12, ING-14: rejected lines of the files with their reasons."""
    return _ingested(orders)["rejects"].select("file", "line_no", "reject_reason", "raw_line")


@on_table("orders", f"""SELECT 'pay_' || CAST(k AS VARCHAR) AS payment_id, (k % 1000) * 100 + 50 AS amount, TIMESTAMP '2025-11-05 10:00:00'
    AS created_at_ist FROM ({_SQL_ROWS}) AS r WHERE why IS NULL AND k % 40 <> 7 UNION ALL
    SELECT 'pay_' || CAST(k - 7 AS VARCHAR), (k % 1000) * 100 + 50, TIMESTAMP '2025-11-05 10:00:00' FROM ({_SQL_ROWS}) AS r
    WHERE why IS NULL AND k % 40 = 7""")
def ingest_accepted(orders):
    """ING-04..12, FN-01: accepted rows of the files, typed."""
    return _ingested(orders)["accepted"].select("payment_id", "amount", "created_at_ist")


@on_table(
    "orders",
    f"""SELECT file, sha256('{_HEADER}' || chr(10) || string_agg(line, chr(10) ORDER BY line_no)) AS sha256, count(*) AS seen, count(*)
        FILTER (why IS NULL) AS accepted, count(why) AS rejected FROM ({_SQL_ROWS}) AS r GROUP BY file""",
)
def ingest_report(orders):
    """ING-15, AG-16: of each file its digest, rows seen, accepted and rejected."""
    return _ingested(orders)["report"].select("file", "sha256", "seen", "accepted", "rejected")


@on_table("orders", f"SELECT file, why AS reject_reason, count(*) AS n FROM ({_SQL_ROWS}) AS r WHERE why IS NOT NULL GROUP BY ALL")
def ingest_reasons(orders):
    """AG-16: rejects by reason."""
    return _ingested(orders)["rejects"].groupBy("file", "reject_reason").agg(F.count("*").alias("n"))


# settlement and bank lines, a file per 3,000 orders; every twentieth has one of the faults that payments cannot have
_SETTLEMENT_LINE = """'setl_' || CAST(k AS STRING) || ',,100.00,2.00,0.36,1.00,' || CASE k % 20 WHEN 1 THEN '96.65' ELSE '96.64' END || ',2025-11-06T18:00:00,' ||
    CASE k % 20 WHEN 2 THEN 'maybe' WHEN 3 THEN 'Y' WHEN 4 THEN 'True' WHEN 5 THEN '' WHEN 6 THEN 'no' WHEN 7 THEN '2' ELSE '1' END"""
_SETTLEMENT_WHY = "CASE k % 20 WHEN 1 THEN 'MONETARY_INCONSISTENT' WHEN 2 THEN 'MALFORMED_FIELD' WHEN 7 THEN 'MALFORMED_FIELD' END"
_BANK_LINE = """'bnk_' || CAST(k AS STRING) || ',2025-11-06,' || CASE k % 20 WHEN 3 THEN '-' ELSE '' END || CAST(k AS STRING) || '.5,' ||
    CASE k % 20 WHEN 1 THEN '"NEFT' WHEN 2 THEN '"NEFT, a"' ELSE 'NEFT' END"""
_BANK_WHY = "CASE k % 20 WHEN 1 THEN 'UNPARSEABLE' END"


def _validated(orders: DataFrame, entity: str, line: str) -> DataFrame:
    """Accepted and rejected lines of an entity's planted files."""
    rows = _planted(orders, F.expr("concat('f', k div 4000)"), line)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    head = F.lit(",".join(ingest.ENTITIES[entity]) + "\n")
    files = rows.groupBy("file").agg(F.concat(head, body).cast("binary").alias("content")).withColumn("merchant_id", F.lit("m1"))
    return ingest.validate(ingest.lines_of(ingest.gate_files(files, entity)), entity)


@on_table("orders", f"""SELECT 'f' || CAST(k // 4000 AS VARCHAR) AS file, {_SETTLEMENT_LINE} AS line, {_SETTLEMENT_WHY} AS reject_reason,
    CASE WHEN k % 20 NOT IN (2, 7) THEN k % 20 NOT IN (5, 6) END AS instant FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) AS o""")
def ingest_settlements(orders):
    """ING-09, ING-10: lines of settlement files with the value of their flag, rejected where it is none, or where the net is not what remains."""
    return _validated(orders, "settlements", _SETTLEMENT_LINE).select("file", "line", "reject_reason", "instant")


@on_table("orders", f"""SELECT 'f' || CAST(k // 4000 AS VARCHAR) AS file, {_BANK_LINE} AS line, {_BANK_WHY} AS reject_reason, (k * 100 + 50) * CASE k % 20 WHEN 3
    THEN -1 ELSE 1 END AS amount, CASE k % 20 WHEN 2 THEN 'NEFT, a' WHEN 1 THEN NULL ELSE 'NEFT' END AS narration
    FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) AS o""")
def ingest_bank_rows(orders):
    """ING-07, ING-13: lines of bank files, with signed amounts and quoted narrations, rejected where a quote does not close."""
    narration = F.when(F.col("reject_reason").isNull(), F.col("narration"))
    return _validated(orders, "bank", _BANK_LINE).select("file", "line", "reject_reason", "amount", narration.alias("narration"))


@on_table("orders", f"""SELECT 'ord_' || CAST(k AS VARCHAR) AS order_id, (k % 1000) * 100 + 50 AS amount FROM ({_SQL_ROWS}) AS r
    WHERE why IS NULL OR why = 'DUPLICATE_EXISTING'""")
def streamed_ingest(orders):
    """ST-01, ST-02: the same files taken in by a stream from a folder, half of them again under other names: each id is accepted once."""
    spark = orders.sparkSession
    root = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    head = F.explode(F.when(F.col("line_no") == 2, F.array(F.lit(_HEADER), "line")).otherwise(F.array("line")))
    rows = _lines(orders).sortWithinPartitions("file", "line_no").select("file", head.alias("line"))

    def drain() -> None:
        job = jobs.ingest_stream(jobs.landing_files(spark, f"{root}/in", "m1"), "payments", f"{root}/out", f"{root}/checkpoint")
        job.awaitTermination()

    rows.write.partitionBy("file").text(f"{root}/in/a")
    drain()
    rows.where("crc32(file) % 2 = 0").write.partitionBy("file").text(f"{root}/in/b")
    drain()
    return spark.read.parquet(f"{root}/out/accepted").select("order_id", "amount")


@on_table(
    "customer",
    """SELECT 'c' || CAST(c_custkey AS VARCHAR) || '.csv' AS file, CASE WHEN c_nationkey = 24 THEN 'UNKNOWN_MERCHANT' WHEN c_custkey % 5 = 0
        THEN 'EMPTY_FILE' WHEN c_custkey % 5 = 1 THEN 'NOT_UTF8' WHEN c_custkey % 5 = 2 THEN 'BAD_HEADER' END AS refusal FROM customer""",
)
def ingest_file_gates(customer):
    """ING-01..03: which whole files are refused, and why; a byte order mark and the case of the header do not matter."""
    k = F.col("c_custkey")
    header = F.lit(_HEADER)
    content = (
        F.when(k % 5 == 0, F.lit("").cast("binary")).when(k % 5 == 1, F.concat(header.cast("binary"), F.unhex(F.lit("0AFF")))).when(k % 5 == 2,
            F.lit("id,amount\n1,2").cast("binary"))
        .when(k % 5 == 3, F.concat(F.unhex(F.lit("EFBBBF")), header.cast("binary"))).otherwise(F.upper(header).cast("binary"))
    )
    merchant = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    files = customer.select(merchant.alias("merchant_id"), F.concat(F.lit("c"), k.cast("string"), F.lit(".csv")).alias("file"),
        content.alias("content"))
    merchants = customer.where("c_nationkey <> 24").select(merchant.alias("merchant_id")).distinct()
    return ingest.gate_files(files, "payments", merchants).select("file", "refusal")


@on_table("part", """SELECT p_partkey, p_name || ', "' || p_brand || '"' AS quoted, p_type AS plain, '' AS missing FROM part""")
def csv_rules(part):
    """SRC-03: quoted commas, doubled quotes and missing trailing fields of CSV lines."""
    quoted = F.concat(F.lit('"'), F.replace(F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = part.select("p_partkey", ingest.parse_line(F.concat(quoted, F.lit(","), "p_type"), 3).alias("f"))
    return rows.select("p_partkey", F.col("f.c0").alias("quoted"), F.col("f.c1").alias("plain"), F.coalesce("f.c2", F.lit("")).alias("missing"))


def _card(rate: DataFrame, terms: DataFrame) -> DataFrame:
    """Rate cards as JSON text, one a merchant."""
    pct = lambda c: F.format_string("%.2f", F.col(c) / 100.0)
    tier = F.struct(F.col("effective_from").cast("string").alias("effective_from"), pct("pct_bp").alias("pct"), F.col("flat_paise").cast("long").alias("flat_paise"))
    per = rate.groupBy("merchant_id", "method").agg(F.array_sort(F.collect_list(tier)).alias("tiers"))
    per = per.groupBy("merchant_id").agg(F.map_from_entries(F.collect_list(F.struct("method", "tiers"))).alias("methods"))
    card = F.struct(
        "merchant_id",
        pct("gst_bp").alias("gst_rate_pct"),
        pct("tds_bp").alias("tds_rate_pct"),
        pct("reserve_bp").alias("reserve_rate_pct"),
        F.split("reserve_methods", ",").alias("reserve_methods"),
        pct("instant_bp").alias("instant_surcharge_pct"),
        pct("dispute_fee_paise").alias("dispute_fee"),
        "tolerance_paise",
        "methods",
    )
    return per.join(terms, "merchant_id").select("merchant_id", F.to_json(card).alias("card"))


@query(
    """SELECT merchant_id, method, effective_from, CAST(pct_bp AS BIGINT) AS pct_bp, CAST(flat_paise AS BIGINT) AS flat_paise
        FROM rate WHERE merchant_id IN (SELECT merchant_id FROM payment)"""
)
def rate_card_tiers(t):
    """SRC-04: tiers read from the rate cards of the merchants with payments, in JSON."""
    known = t["payment"].select("merchant_id").distinct()
    return ingest.rate_tiers(_card(t["rate"].join(known, "merchant_id", "left_semi"), t["terms"]))


@query(
    """SELECT t.merchant_id, count(*) AS payments, CAST(gst_bp AS BIGINT) AS gst_bp, CAST(tds_bp AS BIGINT) AS tds_bp, CAST(reserve_bp AS BIGINT) AS reserve_bp,
        reserve_methods, CAST(instant_bp AS BIGINT) AS instant_bp, CAST(dispute_fee_paise AS BIGINT) AS dispute_fee_paise,
        CAST(tolerance_paise AS BIGINT) AS tolerance_paise FROM terms t JOIN payment p ON p.merchant_id = t.merchant_id GROUP BY ALL"""
)
def rate_card_terms(t):
    """SRC-04: all other terms of the rate cards, with the number of payments that they hold for."""
    terms = ingest.rate_terms(_card(t["rate"], t["terms"]))
    return t["payment"].groupBy("merchant_id").agg(F.count("*").alias("payments")).join(terms, "merchant_id")


#: Most rows of a file of the written dataset: some 25 MB, well under ``ingest.MAX_FILE``, above which a whole file is refused.
FILE_ROWS = 200_000


def _written_dataset(t: Entities) -> str:
    """The derived entities as a dataset of CSV and JSON files, an entity a folder with a part a merchant; no field is changed."""
    from reconweave.functions.money import fmt

    root = f"{shared_dir(t.spark)}/dataset-{uuid.uuid4().hex}"
    clock = F.timestamp_seconds
    stamp = lambda day, sec: F.date_format(clock(F.unix_date(F.col(day)) * 86400 + F.col(sec)), "yyyy-MM-dd'T'HH:mm:ss")
    flag = lambda c: F.col(c).cast("int").cast("string")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    money = lambda c: fmt(F.col(c))
    files = {
        "payments": ("payment", [text("payment_id"), text("order_id"), money("amount_paise"), text("method"), text("status"),
            stamp("capture_date", "capture_sec")]),
        "orders": ("purchase", [text("order_id"), text("customer_id"), money("amount_paise"), text("created_date")]),
        "settlements": ("settlement", [text("settlement_id"), text("utr"), money("gross"), money("fees"), money("gst"), money("tds"),
            money("net"), text("settle_date"), flag("instant")]),
        "bank_statement": ("bank", [text("bank_txn_id"), text("value_date"), money("amount_paise"), text("narration")]),
        "refunds": ("refund", [text("refund_id"), text("payment_id"), money("amount_paise"), stamp("created_date", "created_sec"), flag("netted")]),
        "chargebacks": ("chargeback", [text("dispute_id"), text("payment_id"), money("amount_paise"), money("fee_paise"),
            stamp("raised_date", "raised_sec"), F.coalesce(stamp("reversed_date", "reversed_sec"), F.lit(""))]),
        "reserve_ledger": ("reserve", [text("reserve_id"), money("amount_paise"), text("held_on"), text("release_date"),
            stamp("release_date", "released_sec"), flag("netted")]),
    }
    heads = dict(zip(files, ingest.ENTITIES.values(), strict=True))
    for name, (entity, columns) in files.items():
        rows = t[entity].select("merchant_id", *[c.alias(n) for c, n in zip(columns, heads[name], strict=True)])
        # a large merchant is many tasks and many files, each of which stays under the gate's size
        out = rows.hint("rebalance", F.col("merchant_id")).write.partitionBy("merchant_id").option("maxRecordsPerFile", FILE_ROWS)
        out.option("header", True).option("emptyValue", "").csv(f"{root}/parts/{name}.csv")
    cards = _card(t["rate"], t["terms"])
    cards.repartition(cards.count()).select("card").write.option("maxRecordsPerFile", 1).text(f"{root}/parts/rate_cards")
    return root


#: The fields of each entity, which queries and SQL join to one text.
_FIELDS = {
    "payment": ("payment_id", "order_id", "amount_paise", "method", "status", "capture_date", "capture_sec"),
    "purchase": ("order_id", "customer_id", "amount_paise", "created_date"),
    "settlement": ("settlement_id", "utr", "gross", "fees", "gst", "tds", "net", "settle_date", "instant"),
    "bank": ("bank_txn_id", "value_date", "amount_paise", "narration"),
    "refund": ("refund_id", "payment_id", "amount_paise", "created_date", "created_sec", "netted"),
    "chargeback": ("dispute_id", "payment_id", "amount_paise", "fee_paise", "raised_date", "raised_sec", "reversed_date", "reversed_sec"),
    "reserve": ("reserve_id", "amount_paise", "held_on", "release_date", "released_sec", "netted"),
    "rate": ("method", "effective_from", "pct_bp", "flat_paise"),
}
_AS_TEXT = " UNION ALL ".join(
    f"SELECT '{e}' AS entity, merchant_id, " + " || '|' || ".join(f"coalesce(CAST({c} AS STRING), '')" for c in columns) + f" AS fields FROM {e}"
    for e, columns in _FIELDS.items()
)


@query(_AS_TEXT + " WHERE merchant_id IN (SELECT merchant_id FROM terms)")
def loaded_dataset(t):
    """SRC-01: every field of every row of all entities, written as files, loaded again and made into entities."""
    tables = normalise.entities(ingest.load_dataset(t.spark, _written_dataset(t)))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = [tables[e].select(F.lit(e).alias("entity"), "merchant_id", F.concat_ws("|", *map(text, columns)).alias("fields")) for e, columns in _FIELDS.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    """SELECT merchant_id, settlement_id, bank_txn_id, predicted, residue, membership_proven, within_tolerance, ambiguous, n_members FROM dec"""
)
def run_from_files(t):
    """SRC-01: a whole run over the loaded files; its rows are those of the run over the entities themselves."""
    tables = {n: written(df) for n, df in normalise.entities(ingest.load_dataset(t.spark, _written_dataset(t))).items()}
    d = Reconciliation(tables).decomposition
    return d.select("merchant_id", "settlement_id", "bank_txn_id", "predicted", "residue", "membership_proven", "within_tolerance", "ambiguous", "n_members")


@query("SELECT merchant_id, payment_id, amount_paise, row_number() OVER (ORDER BY payment_id) AS nth FROM payment WHERE merchant_id = 'm1'")
def merchant_scan(t):
    """SRC-05: the rows of one merchant by id, from a table laid out by merchant, so that only its part is read."""
    path = f"{shared_dir(t.spark)}/payments-{uuid.uuid4().hex}"
    t["payment"].write.partitionBy("merchant_id").parquet(path)
    rows = t.spark.read.parquet(path).where("merchant_id = 'm1'").select("merchant_id", "payment_id", "amount_paise")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("merchant_id").orderBy("payment_id")))


# --- results out --------------------------------------------------------------------


@query(
    """SELECT 'payment_link' AS name, merchant_id, count(*) AS n FROM members GROUP BY ALL UNION ALL SELECT 'bank_link', merchant_id, count(*)
        FROM links GROUP BY ALL UNION ALL SELECT 'decomposition', merchant_id, 13 * count(*) FROM dec GROUP BY ALL
       UNION ALL SELECT 'exception', merchant_id, count(*) FROM exc GROUP BY ALL UNION ALL SELECT 'summary', merchant_id, 1
           FROM (SELECT DISTINCT merchant_id FROM dec) AS m"""
)
def saved_run(t):
    """SNK-01, SNK-03: the tables of a run, written all or nothing and read back as a committed run."""
    from reconweave.operators.decompose import components_long

    r = run(t)
    root = f"{shared_dir(t.spark)}/runs-{uuid.uuid4().hex}"
    verdicts = r.verdicts.select("merchant_id", "exception_seq", "settlement_id", "bank_txn_id", "label", "residue", "verdict", "policy_reason",
        "idempotency_key", "resolution")
    tables = {"payment_link": r.members, "bank_link": r.matched["links"], "decomposition": components_long(r.decomposition),
        "exception": verdicts, "summary": r.totals}
    runs = sinks.Runs(t.spark, root)
    runs.save(tables, "1")
    out = None
    for name in tables:
        part = runs.read(name, "1").groupBy(F.lit(name).alias("name"), "merchant_id").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


_F = """
    SELECT f.merchant_id, f.bank_txn_id, f.settlement_id, 'candidate' AS source, round(dl, 6) AS f_abs_amount_delta_log, CAST(sign(amount_paise - net)
        AS DOUBLE) AS f_signed_delta_sign, tol::DOUBLE AS f_delta_within_tolerance,
           round(abs(amount_paise - net) / greatest(abs(net), 1)::DOUBLE, 6) AS f_delta_rel_to_net, banking_days::DOUBLE AS f_banking_day_delta,
               abs(banking_days)::DOUBLE AS f_abs_banking_day_delta, CASE WHEN value_date = settle_date THEN 1.0::DOUBLE ELSE 0.0 END AS f_same_day,
           ex::DOUBLE AS f_utr_exact, CASE WHEN ex = 0 AND utr_hit THEN 1.0::DOUBLE ELSE 0.0 END AS f_utr_repaired, coalesce(repair_confidence,
               0.0)::DOUBLE AS f_utr_repair_confidence, round(tri, 6)::DOUBLE AS f_token_overlap, round(jw, 6)::DOUBLE AS f_jaro_winkler,
           CASE WHEN len(candidates) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS f_narration_has_any_utr, CASE WHEN utr IS NOT NULL THEN 1.0::DOUBLE
               ELSE 0.0 END AS f_settlement_utr_present, CASE WHEN instant THEN 1.0::DOUBLE ELSE 0.0 END AS f_is_instant, round(gap, 6)::DOUBLE
               AS f_amount_rank_gap
    FROM score f JOIN (SELECT merchant_id, bank_txn_id, max(probability) - coalesce(max(probability) FILTER (rn = 2), 0) AS gap FROM (
        SELECT *, row_number() OVER (PARTITION BY merchant_id, bank_txn_id ORDER BY probability DESC) AS rn FROM score) AS s
            GROUP BY ALL) AS g USING (merchant_id, bank_txn_id)"""


@query(_F)
def candidate_features(t):
    """SNK-02, SC-01: all sixteen features of the candidate pairs, as they are handed to training."""
    c = run(t).matched["candidates"]
    return c.select("merchant_id", "bank_txn_id", "settlement_id", F.lit("candidate").alias("source"),
        *[F.round(F.col(f"f_{n}").cast("double"), 6).alias(f"f_{n}") for n in FEATURES])


_MODEL = artefact.bundled()


@query(f"""SELECT merchant_id, bank_txn_id, settlement_id, round(probability, 6) AS probability
    FROM ({artefact.scored_sql(_MODEL, f"({_F}) AS f", "merchant_id, bank_txn_id, settlement_id")}) AS p""")
def artefact_scores(t):
    """SRC-06, SC-03, SC-04, SC-07: pairs scored by a model read from its JSON artefact, its trees and calibration compiled into a column."""
    folder = f"{shared_dir(t.spark)}/model-{uuid.uuid4().hex}"
    t.spark.range(1).select(F.lit(json.dumps(_MODEL)).alias("value")).coalesce(1).write.text(folder)
    model = artefact.compiled(artefact.read(t.spark, folder))
    c = run(t).matched["candidates"].withColumns({f"f_{n}": F.round(F.col(f"f_{n}").cast("double"), 6) for n in FEATURES})
    return model(c).select("merchant_id", "bank_txn_id", "settlement_id", F.round("probability", 6).alias("probability"))


@query(
    """SELECT 'settlement' AS name, merchant_id, settlement_id AS id, CASE WHEN gross % 3 = 0 THEN 0 ELSE net END AS paise FROM settlement
       UNION ALL SELECT 'bank', merchant_id, bank_txn_id, CASE WHEN abs(amount_paise) % 2 = 0 THEN 0 ELSE amount_paise END FROM bank"""
)
def seed_upsert(t):
    """SNK-04: rows seeded twice on disk: settlements are updated where they stood, bank rows that stood are left as they were."""
    root = f"{shared_dir(t.spark)}/seed-{uuid.uuid4().hex}"
    out = []
    for name, key, paise, stood in (("settlement", "settlement_id", "net", "gross % 2 = 0 or gross % 3 = 0"), ("bank", "bank_txn_id", "amount_paise", "abs(amount_paise) % 2 = 0")):
        rows = t[name].select("merchant_id", F.col(key).alias("id"), F.col(paise).cast("long").alias("paise"), F.expr(stood).alias("stood"),
            (F.col("gross") % 3 == 0 if name == "settlement" else F.lit(False)).alias("kept"))
        table = sinks.KeyedTable(t.spark, f"{root}/{name}", ["merchant_id", "id"], "merchant_id string, id string, paise long", 16)
        table.insert(rows.where("stood").select("merchant_id", "id", F.lit(0).cast("long").alias("paise")), ["paise"])
        again = rows.where("not kept").select("merchant_id", "id", "paise")
        if name == "settlement":
            table.upsert(again)
        else:
            table.insert(again, ["paise"])
        out.append(table.read().select(F.lit(name).alias("name"), "merchant_id", "id", "paise"))
    return reduce(DataFrame.unionByName, out)


@query("SELECT merchant_id, bank_txn_id, amount_paise FROM bank WHERE amount_paise > 0")
def inserted_rows(t):
    """SNK-03, JN-21: rows inserted on disk where their key is absent, in two inserts that overlap: each key is there once."""
    rows = t["bank"].where("amount_paise > 0").select("merchant_id", "bank_txn_id", "amount_paise")
    half = rows.where("crc32(bank_txn_id) % 2 = 0")
    root = f"{shared_dir(t.spark)}/insert-{uuid.uuid4().hex}"
    table = sinks.KeyedTable(t.spark, root, ["merchant_id", "bank_txn_id"], "merchant_id string, bank_txn_id string, amount_paise long", 16)
    table.insert(half.unionByName(half), ["amount_paise"])
    table.insert(rows, ["amount_paise"])
    return table.read()


@query("SELECT merchant_id, idempotency_key, verdict FROM chain")
def posted_decisions(t):
    """SNK-05, ST-03: decisions posted in two batches and the second one again: each key is in the ledger once."""
    out = f"{shared_dir(t.spark)}/ledger-{uuid.uuid4().hex}"
    decided = run(t).verdicts
    jobs.post_decisions(decided.where("exception_seq % 2 = 0"), out, 0)
    for _ in range(2):
        jobs.post_decisions(decided, out, 1)
    return jobs.posted(t.spark, out).select("merchant_id", "idempotency_key", "verdict")


@query("SELECT merchant_id, count(*) AS settlements, false AS reflects_current_run FROM dec GROUP BY merchant_id")
def metric_files(t):
    """SRC-07: stored figures read back with where they come from; they never count as those of the present run."""
    path = f"{shared_dir(t.spark)}/metrics-{uuid.uuid4().hex}"
    run(t).totals.select("merchant_id", "settlements").write.json(path)
    stored = t.spark.read.schema("merchant_id string, settlements bigint").json(path).select("*", "_metadata.file_modification_time")
    return stored.where("file_modification_time is not null").select("merchant_id", "settlements", F.lit(False).alias("reflects_current_run"))
