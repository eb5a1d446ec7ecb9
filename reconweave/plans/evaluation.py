"""Evaluation against the derived truth, and checks of the data themselves, as registered queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconweave.functions.durable import shared_dir
from reconweave.operators import decompose, netting, scorer
from reconweave.plans import oracle
from reconweave.plans.queries import PLAN
from reconweave.plans.registry import Entities, query, run
from reconweave.plans.reconcile import PRESETS, Reconciliation
from reconweave.sources import sinks

# Hours to unwind a false match, minutes for a missed one, paise an hour.
UNWIND_HOURS, MISS_MINUTES, RATE_PAISE = 2.5, 6, 120_000
UNPROVABLE = ("ambiguous_candidates", "attribution_ambiguous", "partition_unproven")

_SPLIT = "CASE WHEN {d} <= DATE '2025-11-18' THEN 'train' WHEN {d} <= DATE '2025-11-24' THEN 'dev' ELSE 'test' END"


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def share(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b), 6)


def true_pair() -> Column:
    """Whether a credit was derived from the settlement beside it."""
    return F.substring("bank_txn_id", 4, 100) == F.substring("settlement_id", 5, 100)


@query(
    f"""SELECT *, round(2 * precision_rows * recall_rows / nullif(precision_rows + recall_rows, 0), 6) AS f1_rows,
        round(2 * precision_paise * recall_paise / nullif(precision_paise + recall_paise, 0), 6) AS f1_paise FROM (
         SELECT coalesce(merchant_id, 'all') AS merchant_id, coalesce(split, 'all') AS split, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6)
             AS precision_rows, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall_rows,
                round(tp_paise / nullif(tp_paise + fp_paise, 0)::DOUBLE, 6) AS precision_paise, round(tp_paise / nullif(tp_paise + fn_paise,
                    0)::DOUBLE, 6) AS recall_paise FROM (
           SELECT merchant_id, split, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn,
               coalesce(sum(amount_paise) FILTER (p AND t), 0) AS tp_paise,
                  coalesce(sum(amount_paise) FILTER (p AND NOT t), 0) AS fp_paise, coalesce(sum(amount_paise) FILTER (t AND NOT p), 0) AS fn_paise
                      FROM (
             SELECT merchant_id, {_SPLIT.format(d="settle_date")} AS split, h.solver IS NOT NULL AS p, u.cycle IS NOT NULL AS t, y.amount_paise
             FROM members h FULL JOIN truth u USING (merchant_id, settlement_id, payment_id, settle_date)
                 JOIN payment y USING (merchant_id, payment_id)
           ) AS x GROUP BY ROLLUP (merchant_id, split)
         ) AS y
       ) AS z"""
)
def link_scores(t):
    """EV-01: precision, recall and F1 of payment links by rows and by amount, per split, per merchant and overall."""
    key = ["merchant_id", "settlement_id", "payment_id", "settle_date"]
    p = run(t).members.select(*key, F.lit(True).alias("p"))
    u = t["truth"].select(*key, F.lit(True).alias("u"))
    j = p.join(u, key, "full").join(t["payment"].select("merchant_id", "payment_id", "amount_paise"),
        ["merchant_id", "payment_id"]).withColumn("split", scorer.split_of("settle_date"))
    both, only_p, only_u = F.col("p") & F.col("u"), F.col("u").isNull(), F.col("p").isNull()
    paise = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount_paise"))), F.lit(0))
    s = j.rollup("merchant_id", "split").agg(
        count_if(both).alias("tp"), count_if(only_p).alias("fp"), count_if(only_u).alias("fn"), paise(both).alias("tp_paise"),
            paise(only_p).alias("fp_paise"), paise(only_u).alias("fn_paise")
    )
    x = F.col
    s = s.select(
        F.coalesce("merchant_id", F.lit("all")).alias("merchant_id"), F.coalesce("split", F.lit("all")).alias("split"), "tp", "fp", "fn",
            share(x("tp"), x("tp") + x("fp")).alias("precision_rows"), share(x("tp"), x("tp") + x("fn")).alias("recall_rows"),
        share(x("tp_paise"), x("tp_paise") + x("fp_paise")).alias("precision_paise"),
            share(x("tp_paise"), x("tp_paise") + x("fn_paise")).alias("recall_paise"),
    )
    f1 = lambda a, b: F.round(F.try_divide(2 * x(a) * x(b), x(a) + x(b)), 6)
    return s.withColumns({"f1_rows": f1("precision_rows", "recall_rows"), "f1_paise": f1("precision_paise", "recall_paise")})


def _judged(t: Entities, planted: bool = False) -> DataFrame:
    """Each linked or true payment: predicted and true settlement, refused, genuinely ambiguous, amount, and on demand whether it was planted.

    Amount and method belong to the payment, so all that is known of it and those it could change places with meet in one shuffle by them.
    """
    r = run(t)
    columns = {"predicted": "string", "true": "string", "settle_date": "date", "late": "boolean", "refused": "boolean", "planted": "boolean"}
    near = ["merchant_id", "amount_paise", "method"]

    def part(df: DataFrame, **known: Column) -> DataFrame:
        return df.select(*near, "payment_id", *[known.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in columns.items()])

    parts = [
        part(r.facts, predicted=F.col("settlement_id")), part(r.tied, refused=F.lit(True)),
        part(t["truth"], true=F.col("settlement_id"), settle_date=F.col("settle_date"), late=F.col("capture_date") >= F.lit("2025-11-16").cast("date")),
    ]
    if planted:
        parts.append(part(t["payment"].where("k % 10 = 0"), planted=F.lit(True)))
    rows = reduce(DataFrame.unionByName, parts).repartition(*near)
    both = rows.groupBy(*near, "payment_id").agg(*[F.max(n).alias(n) for n in columns]).where("predicted is not null or true is not null")
    alike = Window.partitionBy(*near, "settle_date", "late")
    flags = {"refused": F.col("refused"), "planted": F.col("planted"), "genuine": F.min("true").over(alike) != F.max("true").over(alike)}
    return both.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()})


_JUDGED = """
    SELECT merchant_id, payment_id, h.settlement_id AS predicted, u.settlement_id AS true_id, s.payment_id IS NOT NULL AS refused, coalesce(g.genuine,
        false) AS genuine, y.amount_paise, y.k % 10 = 0 AS planted
    FROM members h FULL JOIN truth u USING (merchant_id, payment_id) JOIN payment y USING (merchant_id, payment_id) LEFT
        JOIN (SELECT DISTINCT merchant_id, payment_id FROM swap) AS s USING (merchant_id, payment_id)
    LEFT JOIN (SELECT merchant_id, payment_id, min(settlement_id) OVER w <> max(settlement_id) OVER w AS genuine
        FROM truth WINDOW w AS (PARTITION BY merchant_id, settle_date, amount_paise, method, capture_date >= DATE '2025-11-16'))
        AS g USING (merchant_id, payment_id)"""


@query(
    f"""SELECT merchant_id, count(*) FILTER (predicted IS NOT NULL AND NOT refused) AS auto_links, count(*) FILTER (predicted IS NOT NULL
        AND NOT refused AND predicted IS DISTINCT FROM true_id) AS false_links,
               CAST(coalesce(sum(amount_paise) FILTER (predicted IS NOT NULL AND NOT refused AND predicted IS DISTINCT
                   FROM true_id), 0) AS BIGINT) AS false_paise,
               round(count(*) FILTER (predicted IS NOT NULL AND NOT refused) / nullif(count(true_id), 0)::DOUBLE, 6) AS resolution_rate
                   FROM ({_JUDGED}) AS j GROUP BY merchant_id"""
)
def false_matches(t):
    """EV-02: false links among those that would be posted, their value, and the share of true links posted."""
    auto = F.col("predicted").isNotNull() & ~F.col("refused")
    wrong = auto & ~F.col("predicted").eqNullSafe(F.col("true"))
    return _judged(t).groupBy("merchant_id").agg(
        count_if(auto).alias("auto_links"), count_if(wrong).alias("false_links"),
            F.coalesce(F.sum(F.when(wrong, F.col("amount_paise"))), F.lit(0)).alias("false_paise"),
            share(count_if(auto), F.count("true")).alias("resolution_rate")
    )


@query(
    f"""SELECT merchant_id, count(*) FILTER (refused AND true_id IS NOT NULL) AS refused, count(*) FILTER (refused AND true_id IS NOT NULL
        AND genuine) AS justified, count(*) FILTER (genuine) AS genuine, count(*) FILTER (genuine AND NOT refused) AS missed,
               count(*) FILTER (genuine AND planted) AS planted, count(*) FILTER (genuine AND planted AND refused) AS planted_caught, round(count(*)
                   FILTER (refused AND true_id IS NOT NULL AND genuine) / nullif(count(*) FILTER (refused AND true_id IS NOT NULL), 0)::DOUBLE, 6)
                   AS precision,
               round(count(*) FILTER (genuine AND refused) / nullif(count(*) FILTER (genuine), 0)::DOUBLE, 6) AS recall FROM ({_JUDGED}) AS j
                   GROUP BY merchant_id"""
)
def refusal_scores(t):
    """EV-03, SET-04: refused payments against those that truly can change places."""
    refused, genuine = F.col("refused") & F.col("true").isNotNull(), F.col("genuine")
    caught = genuine & F.col("refused")
    return _judged(t, planted=True).groupBy("merchant_id").agg(
        count_if(refused).alias("refused"), count_if(refused & genuine).alias("justified"), count_if(genuine).alias("genuine"),
            count_if(genuine & ~F.col("refused")).alias("missed"), count_if(genuine & F.col("planted")).alias("planted"),
        count_if(caught & F.col("planted")).alias("planted_caught"), share(count_if(refused & genuine), count_if(refused)).alias("precision"),
            share(count_if(caught), count_if(genuine)).alias("recall"),
    )


@query(
    f"""SELECT merchant_id, false_links, CAST(round(false_links * 2.5 * 120000) AS BIGINT) AS false_cost, missed, CAST(round(missed * 0.1 * 120000)
        AS BIGINT) AS missed_cost, CAST(round(false_links * 300000 + missed * 12000) AS BIGINT) AS total_cost,
               CAST((false_links + doubtful // 2) * 300000 AS BIGINT) AS cost_if_nothing_refused FROM (
         SELECT merchant_id, count(*) FILTER (predicted IS NOT NULL AND NOT refused AND predicted IS DISTINCT
             FROM true_id) AS false_links, count(*) FILTER (true_id IS NOT NULL AND predicted IS DISTINCT
             FROM true_id) + count(*) FILTER (refused AND true_id IS NOT NULL) AS missed,
                count(*) FILTER (refused AND genuine AND true_id IS NOT NULL) AS doubtful FROM ({_JUDGED}) AS j GROUP BY merchant_id
       ) AS c"""
)
def cost_of_error(t):
    """EV-05: what false and missed links cost, and what posting everything would."""
    differs = ~F.col("predicted").eqNullSafe(F.col("true"))
    wrong = F.col("predicted").isNotNull() & ~F.col("refused") & differs
    missed = count_if(F.col("true").isNotNull() & differs) + count_if(F.col("refused") & F.col("true").isNotNull())
    c = _judged(t).groupBy("merchant_id").agg(count_if(wrong).alias("false_links"), missed.alias("missed"),
        count_if(F.col("refused") & F.col("genuine") & F.col("true").isNotNull()).alias("doubtful"))
    unwind, miss = UNWIND_HOURS * RATE_PAISE, MISS_MINUTES / 60 * RATE_PAISE
    paise = lambda x: F.round(x).cast("long")
    return c.select(
        "merchant_id", "false_links", paise(F.col("false_links") * unwind).alias("false_cost"), "missed",
            paise(F.col("missed") * miss).alias("missed_cost"), paise(F.col("false_links") * unwind + F.col("missed") * miss).alias("total_cost"),
        paise((F.col("false_links") + F.floor(F.col("doubtful") / 2)) * unwind).alias("cost_if_nothing_refused"),
    )


@query("""SELECT merchant_id, count(*) AS links, count(*) FILTER (substr(bank_txn_id, 4) = substr(settlement_id, 5)) AS correct FROM links
    GROUP BY merchant_id""")
def bank_link_accuracy(t):
    """EV-06: how many bank links name the batch that the credit was derived from."""
    return run(t).matched["links"].groupBy("merchant_id").agg(F.count("*").alias("links"), count_if(true_pair()).alias("correct"))


@query(
    """SELECT merchant_id, CASE WHEN abs(residue) = 0 THEN 'exact' WHEN abs(residue) <= 100 THEN 'to_1_rupee' WHEN abs(residue) <= 10000
        THEN 'to_100_rupees' ELSE 'above' END AS bucket, count(*) AS n, CAST(sum(abs(residue)) AS BIGINT) AS value_paise FROM dec GROUP BY ALL"""
)
def residue_buckets(t):
    """EV-04: residues by size."""
    a = F.abs("residue")
    bucket = F.when(a == 0, "exact").when(a <= 100, "to_1_rupee").when(a <= 10_000, "to_100_rupees").otherwise("above")
    return run(t).decomposition.groupBy("merchant_id", bucket.alias("bucket")).agg(F.count("*").alias("n"),
        F.sum(F.abs("residue")).alias("value_paise"))


@query(
    """SELECT d.merchant_id, net, size, gmv, round(size * 100.0::DOUBLE / gmv, 6) AS pct
        FROM (SELECT merchant_id, CAST(sum(residue) AS BIGINT) AS net, CAST(sum(abs(residue)) AS BIGINT) AS size FROM dec GROUP BY merchant_id) AS d
       JOIN (SELECT merchant_id, CAST(sum(amount_paise) AS BIGINT) AS gmv FROM cap GROUP BY merchant_id) AS p USING (merchant_id)"""
)
def residue_scores(t):
    """EV-04: net and absolute residue, and its share of the captured volume."""
    d = run(t).decomposition.groupBy("merchant_id").agg(F.sum("residue").alias("net"), F.sum(F.abs("residue")).alias("size"))
    p = t["payment"].where("status = 'captured'").groupBy("merchant_id").agg(F.sum("amount_paise").alias("gmv"))
    return d.join(p, "merchant_id").withColumn("pct", F.round(F.col("size") * 100.0 / F.col("gmv"), 6))


@query("""SELECT merchant_id, count(*) FILTER (verdict = 'AUTO_POST' AND label IN ('ambiguous_candidates', 'attribution_ambiguous',
    'partition_unproven')) AS unsafe, count(*) FILTER (verdict = 'AUTO_POST') AS posted FROM verdicts GROUP BY merchant_id""")
def unsafe_posts(t):
    """EV-12: posted items that nothing proves; none is the aim."""
    posted = F.col("verdict") == "AUTO_POST"
    return run(t).verdicts.groupBy("merchant_id").agg(count_if(posted & F.col("label").isin(*UNPROVABLE)).alias("unsafe"),
        count_if(posted).alias("posted"))


@query(
    """SELECT merchant_id, coalesce(s.settlement_id, v.settlement_id) AS settlement_id, coalesce(s.want, 'not expected') AS want, coalesce(v.got,
        'no exception') AS got, coalesce(s.want, 'not expected') = coalesce(v.got, 'no exception') AS equal
       FROM (SELECT merchant_id, settlement_id, CASE WHEN k % 31 = 7 THEN 'duplicate_credit' ELSE 'no exception' END AS want FROM settlement) AS s
       FULL JOIN (SELECT merchant_id, settlement_id, label AS got FROM lab WHERE adjustment = '') AS v USING (merchant_id, settlement_id)"""
)
def expected_outcomes(t):
    """EV-13: the label that was planned for each settlement against the one it got."""
    want = t["settlement"].select("merchant_id", "settlement_id", F.when(F.col("k") % 31 == 7,
        "duplicate_credit").otherwise("no exception").alias("want"))
    got = run(t).classified.where("adjustment = ''").select("merchant_id", "settlement_id", F.col("label").alias("got"))
    j = want.join(got, ["merchant_id", "settlement_id"], "full").withColumns({"want": F.coalesce("want", F.lit("not expected")),
        "got": F.coalesce("got", F.lit("no exception"))})
    return j.withColumn("equal", F.col("want") == F.col("got"))


_FAMILY = "CASE WHEN utr IS NULL THEN 'no reference' WHEN k % 7 = 2 THEN 'cut' WHEN k % 7 = 3 THEN 'confused' WHEN k % 7 = 4 AND k % 3 = 0 THEN 'spaced' WHEN k % 7 = 5 THEN 'missing' ELSE 'clean' END"


@query(
    f"""SELECT family, count(*) AS payouts, count(*) FILTER (verbatim) AS verbatim, count(*) FILTER (repaired = utr) AS recovered, count(*)
        FILTER (linked = settlement_id) AS linked FROM (
          SELECT s.family, s.utr, contains(b.narration, s.utr) AS verbatim, r.utr AS repaired, l.settlement_id AS linked, s.settlement_id
          FROM (SELECT *, {_FAMILY} AS family FROM settlement) AS s JOIN bank b ON b.merchant_id = s.merchant_id AND substr(b.bank_txn_id,
              4) = substr(s.settlement_id, 5) LEFT JOIN repair r ON r.merchant_id = b.merchant_id AND r.bank_txn_id = b.bank_txn_id LEFT
              JOIN links l ON l.merchant_id = b.merchant_id AND l.bank_txn_id = b.bank_txn_id
        ) AS x GROUP BY family"""
)
def reference_recovery(t):
    """EV-14: how many references of each kind of damage survive, are repaired and end in a right link."""
    s = t["settlement"].select("merchant_id", "utr", "settlement_id", F.expr(_FAMILY).alias("family"),
        F.substring("settlement_id", 5, 100).alias("key"))
    b = t["bank"].select("merchant_id", "bank_txn_id", "narration", F.substring("bank_txn_id", 4, 100).alias("key"))
    m = run(t).matched
    j = s.join(b, ["merchant_id", "key"]).join(m["repairs"].select("merchant_id", "bank_txn_id", F.col("utr").alias("repaired")),
        ["merchant_id", "bank_txn_id"], "left")
    j = j.join(m["links"].select("merchant_id", "bank_txn_id", F.col("settlement_id").alias("linked")), ["merchant_id", "bank_txn_id"], "left")
    return j.groupBy("family").agg(
        F.count("*").alias("payouts"), count_if(F.contains("narration", "utr")).alias("verbatim"),
            count_if(F.col("repaired") == F.col("utr")).alias("recovered"), count_if(F.col("linked") == F.col("settlement_id")).alias("linked")
    )


@query(
    """SELECT p.merchant_id, p.payments + s.settlements + b.bank_rows AS records, s.settlements, b.bank_rows, coalesce(m.links, 0) AS links,
        d.matched, coalesce(v.exceptions, 0) AS exceptions, coalesce(v.posted, 0) AS posted, coalesce(v.held, 0) AS held, d.residue_paise,
              coalesce(v.steps, 0) AS steps, coalesce(v.several, 0) AS several FROM (SELECT merchant_id, count(*) AS payments FROM payment
                  GROUP BY ALL) AS p JOIN (SELECT merchant_id, count(*) AS settlements FROM settlement GROUP BY ALL) AS s USING (merchant_id)
       JOIN (SELECT merchant_id, count(*) AS bank_rows FROM bank GROUP BY ALL) AS b USING (merchant_id) LEFT
           JOIN (SELECT merchant_id, count(*) AS links FROM members GROUP BY ALL) AS m USING (merchant_id)
       JOIN (SELECT merchant_id, count(bank_txn_id) AS matched, CAST(sum(abs(residue)) AS BIGINT) AS residue_paise FROM dec
           GROUP BY ALL) AS d USING (merchant_id)
       LEFT JOIN (SELECT merchant_id, count(*) AS exceptions, count(*) FILTER (verdict = 'AUTO_POST') AS posted, count(*)
           FILTER (verdict = 'ESCALATE') AS held, CAST(sum(len(steps)) AS BIGINT) AS steps, count(*) FILTER (len(steps) > 1) AS several
                  FROM verdicts JOIN ("""
    + PLAN
    + """) AS q USING (merchant_id, exception_seq) GROUP BY merchant_id) AS v USING (merchant_id)"""
)
def dataset_summary(t):
    """EV-15: each merchant's records, links, exceptions and lookups in one row."""
    from reconweave.operators.investigate import planned

    r = run(t)
    n = lambda df, name: df.groupBy("merchant_id").agg(F.count("*").alias(name))
    base = n(t["payment"], "payments").join(n(t["settlement"], "settlements"), "merchant_id").join(n(t["bank"], "bank_rows"),
        "merchant_id").join(n(r.members, "links"), "merchant_id", "left")
    d = r.decomposition.groupBy("merchant_id").agg(F.count("bank_txn_id").alias("matched"), F.sum(F.abs("residue")).alias("residue_paise"))
    v = r.verdicts.withColumn("n_steps", F.size(planned()))
    v = v.groupBy("merchant_id").agg(
        F.count("*").alias("exceptions"), count_if(F.col("verdict") == "AUTO_POST").alias("posted"),
            count_if(F.col("verdict") == "ESCALATE").alias("held"), F.sum("n_steps").alias("steps"), count_if(F.col("n_steps") > 1).alias("several")
    )
    out = base.join(d, "merchant_id").join(v, "merchant_id", "left").withColumn("records",
        F.col("payments") + F.col("settlements") + F.col("bank_rows"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("links", "exceptions", "posted", "held", "steps", "several")}
    return out.withColumns(zero).drop("payments")


# --- scores of pairs --------------------------------------------------------------


@query(
    """SELECT CAST(th AS BIGINT) AS threshold_pct, count(*) AS credits, count(*) FILTER (p * 100 >= th) AS covered, count(*) FILTER (p * 100 >= th
        AND good) AS correct FROM (
         SELECT merchant_id, bank_txn_id, max(probability) AS p, substr(bank_txn_id, 4) = substr(max(settlement_id) FILTER (rn = 1), 5) AS good FROM (
           SELECT *, row_number() OVER (PARTITION BY merchant_id, bank_txn_id ORDER BY probability DESC, settlement_id DESC) AS rn FROM score) AS s
               GROUP BY merchant_id, bank_txn_id
       ) AS b, (VALUES (10), (20), (30), (40), (50), (60), (70), (80), (90)) AS v(th) GROUP BY th"""
)
def coverage_curve(t):
    """EV-07: credits covered, and rightly so, by their best candidate at nine thresholds (one array per row, no second table)."""
    best = run(t).matched["candidates"].groupBy("merchant_id", "bank_txn_id").agg(F.max(F.struct("probability", "settlement_id")).alias("b"))
    best = best.select("bank_txn_id", F.col("b.settlement_id").alias("settlement_id"), F.col("b.probability").alias("p"))
    rows = best.select("p", true_pair().alias("good"), F.explode(F.sequence(F.lit(10), F.lit(90), F.lit(10))).alias("th"))
    covered = F.col("p") * 100 >= F.col("th")
    return rows.groupBy(F.col("th").cast("long").alias("threshold_pct")).agg(F.count("*").alias("credits"), count_if(covered).alias("covered"),
        count_if(covered & F.col("good")).alias("correct"))


_PAIRS = "SELECT probability AS p, CASE WHEN substr(bank_txn_id, 4) = substr(settlement_id, 5) THEN 1.0::DOUBLE ELSE 0.0 END AS y FROM score"
_BINS = f"SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM ({_PAIRS}) AS s GROUP BY 1"


def _labelled(t: Entities) -> DataFrame:
    return run(t).matched["candidates"].withColumn("label", true_pair().cast("double"))


@query(f"SELECT bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM ({_BINS}) AS b")
def score_reliability(t):
    """EV-08: reliability of the pairs' probabilities in ten bins."""
    return scorer.reliability(_labelled(t)).select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


@query(f"SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece FROM ({_BINS}) AS b")
def score_calibration_error(t):
    """EV-08: expected calibration error of the pairs' probabilities."""
    return scorer.calibration_error(scorer.reliability(_labelled(t))).select(F.round("ece", 6).alias("ece"))


@query(
    f"""SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM (
          SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM (SELECT round(p, 12) AS p, y
              FROM ({_PAIRS}) AS s) AS s) AS q"""
)
def score_auc(t):
    """EV-09, WIN-13: area under the curve of the pairs' probabilities, by average ranks."""
    return scorer.auc(_labelled(t).withColumn("probability", F.round("probability", 12))).select(F.round("auc", 6).alias("auc"))


@query(
    f"""SELECT merchant_id, bank_txn_id, settlement_id, substr(bank_txn_id, 4) = substr(settlement_id, 5) AS label, {_SPLIT.format(d="settle_date")}
        AS split FROM score"""
)
def labelled_pairs(t):
    """SC-08, SC-09: candidate pairs with their label from the truth, and their split by date."""
    true = t["settlement"].select("merchant_id", "settlement_id", F.concat(F.lit("bnk"), F.substring("settlement_id", 5, 100)).alias("bank_txn_id"))
    rows = scorer.labelled(run(t).matched["candidates"], true)
    return rows.select("merchant_id", "bank_txn_id", "settlement_id", (F.col("label") == 1.0).alias("label"), "split")


@query(
    """SELECT merchant_id, bank_txn_id, settlement_id, banking_days::DOUBLE AS f_banking_day_delta, round(probability, 6) AS probability FROM score
        WHERE length(bank_txn_id) + abs(banking_days) % 2 <> 18"""
)
def vector_scores(t):
    """SC-07, SC-02: scores of feature vectors handed in as arrays; those of a wrong width, here planted, are rejected."""
    from reconweave.operators.matching import FEATURES, prior

    c = run(t).matched["candidates"]
    whole = F.array(*[F.col(f"f_{n}").cast("double") for n in FEATURES])
    wrong = F.length("bank_txn_id") + F.abs("banking_days") % 2 == 18
    rows = c.select("merchant_id", "bank_txn_id", "settlement_id", F.when(wrong,
        F.slice(whole, 1, len(FEATURES) - 1)).otherwise(whole).alias("values"))
    scored = scorer.from_vectors(rows, "values")
    return scored.select("merchant_id", "bank_txn_id", "settlement_id", "f_banking_day_delta", F.round(prior(scored), 6).alias("probability"))


@query()
def trained_scores(t):
    """SC-03..07, SRC-06: pairs scored by boosted trees trained on the train split, saved, loaded and calibrated on dev; without labels of both kinds, the prior's scores."""
    rows = scorer.labelled(run(t).matched["candidates"], _true_links(t))
    model = scorer.trained(rows)
    return (model(rows) if model else rows).select("merchant_id", "bank_txn_id", "settlement_id", "split", "label",
        F.round("probability", 6).alias("probability"))


@query()
def trained_links(t):
    """SC-07, WIN-03: bank links of a run whose pairs are scored by the trained model instead of the prior."""
    model = scorer.trained(scorer.labelled(run(t).matched["candidates"], _true_links(t)))
    m = Reconciliation(t, "full", model, like=run(t)).matched
    return m["links"].select("merchant_id", "bank_txn_id", "settlement_id", F.round("confidence", 6).alias("confidence"), "source")


def _true_links(t: Entities) -> DataFrame:
    return t["settlement"].select("merchant_id", "settlement_id", F.concat(F.lit("bnk"), F.substring("settlement_id", 5, 100)).alias("bank_txn_id"))


@query()
def feature_ablation(t):
    """EV-11: the scorer trained on four subsets of the features: right first choices, and how they differ from those of the amounts alone."""
    return scorer.ablation(scorer.labelled(run(t).matched["candidates"], _true_links(t)))


# --- presets ------------------------------------------------------------------------

_NO_MEMBERS = """SELECT CAST(NULL AS VARCHAR) AS merchant_id, CAST(NULL AS VARCHAR) AS settlement_id, CAST(NULL AS VARCHAR) AS payment_id, CAST(NULL
    AS DATE) AS settle_date, CAST(NULL AS BOOLEAN) AS instant, CAST(NULL AS INTEGER) AS hypothesis, CAST(NULL AS VARCHAR) AS solver WHERE false"""
_GREEDY = """
    SELECT merchant_id, bank_txn_id, settlement_id, probability AS confidence, 'greedy' AS source FROM (
        SELECT *, row_number() OVER (PARTITION BY merchant_id, settlement_id ORDER BY bank_txn_id) AS rs FROM (
            SELECT *, row_number() OVER (PARTITION BY merchant_id, bank_txn_id ORDER BY probability DESC, settlement_id) AS rn FROM score
        ) AS a WHERE rn = 1 AND probability >= 0.55
    ) AS b WHERE rs = 1"""


def _preset_sql(preset: str, body: str) -> str:
    """``body`` over the stages of a preset."""
    on, made = PRESETS[preset], oracle.stages()
    instead = {}
    if "exact" not in on:
        instead["exact"] = """SELECT CAST(NULL AS VARCHAR) AS merchant_id, CAST(NULL AS VARCHAR) AS bank_txn_id, CAST(NULL AS VARCHAR)
            AS settlement_id, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS source WHERE false"""
    if "repair" not in on:
        instead["repair"] = """SELECT CAST(NULL AS VARCHAR) AS merchant_id, CAST(NULL AS VARCHAR) AS bank_txn_id, CAST(NULL AS VARCHAR) AS utr,
            CAST(NULL AS VARCHAR) AS method, CAST(NULL AS DOUBLE) AS confidence WHERE false"""
    if "global" not in on:
        instead["assigned"] = _GREEDY
    if "netting" not in on:
        instead["members"] = _NO_MEMBERS
        instead["dec"] = made["dec"].replace("m.n IS NOT NULL AS membership_proven", "true AS membership_proven")
    return oracle.sql(body, **instead)


#: Presets in which each adds a stage to the one before.
LADDER = [p for p in PRESETS if not p.startswith("stress")]


def _totals(t: Entities, presets: list[str]) -> DataFrame:
    parts = [run(t, p).figures.select(F.lit(i).cast("long").alias("step"), F.lit(p).alias("preset"), "merchant_id", "settlements",
        "credits_matched", "links", "abs_residue") for i, p in enumerate(presets)]
    w = Window.partitionBy("merchant_id").orderBy("step")
    change = lambda c: F.col(c) - F.lag(c).over(w)
    return reduce(DataFrame.unionByName, parts).withColumns({"residue_change": change("abs_residue"), "credits_change": change("credits_matched")})


_ROW = """SELECT merchant_id, count(*) AS settlements, count(bank_txn_id) AS credits_matched, CAST(sum(n_members) AS BIGINT) AS links,
    CAST(sum(abs(residue)) AS BIGINT) AS abs_residue FROM dec GROUP BY merchant_id"""
_ALL = " UNION ALL ".join(f"SELECT {i} AS step, '{p}' AS preset, x.* FROM ({_preset_sql(p, _ROW)}) AS x" for i, p in enumerate(LADDER))


@query(
    None,
    f"""SELECT CAST(step AS BIGINT) AS step, preset, merchant_id, settlements, credits_matched, links, abs_residue, abs_residue - lag(abs_residue)
        OVER w AS residue_change, credits_matched - lag(credits_matched) OVER w AS credits_change
        FROM ({_ALL}) AS u WINDOW w AS (PARTITION BY merchant_id ORDER BY step)""",
)
def preset_totals(t):
    """EV-10: totals under the six presets, with the change from each to the next."""
    return _totals(t, LADDER)


@query()
def stress_totals(t):
    """EV-10: totals under the two stress presets, in which no reference links, so that each credit goes through the scores."""
    return _totals(t, [p for p in PRESETS if p not in LADDER])


@query(None, f"""SELECT '2' AS run_id, 'full' AS preset, merchant_id, settlements, abs_residue FROM ({_preset_sql('full', _ROW)}) AS x""")
def latest_runs(t):
    """WIN-10: of three runs saved on disk, the last of which failed half way, the last that succeeded, with its figures."""
    runs = sinks.Runs(t.spark, f"{shared_dir(t.spark)}/runs-{uuid.uuid4().hex}")
    runs.save({"summary": run(t, "deterministic").totals}, "1", "deterministic")
    runs.save({"summary": run(t).totals}, "2")
    torn = run(t).totals.drop("merchant_id")  # cannot be laid out by merchant
    try:
        runs.save({"summary": run(t).totals, "torn": torn}, "3")
    except PySparkException:
        pass
    last = runs.latest()
    figures = runs.read("summary", last.agg(F.max("run_id")).first()[0]).select("merchant_id", "settlements", "abs_residue")
    return last.join(figures, "merchant_id").select("run_id", "preset", "merchant_id", "settlements", "abs_residue")


# --- data quality -------------------------------------------------------------------


@query(
    """SELECT s.merchant_id, s.settlement_id, s.gross, CAST(sum(u.amount_paise) AS BIGINT) AS members_paise, s.gross = sum(u.amount_paise) AS equal
        FROM settlement s JOIN truth u USING (merchant_id, settlement_id) GROUP BY s.merchant_id, s.settlement_id, s.gross"""
)
def dq_batch_sums(t):
    """DQ-02: linked payments add up to the reported gross."""
    m = t["truth"].groupBy("merchant_id", "settlement_id").agg(F.sum("amount_paise").alias("members_paise"))
    return t["settlement"].join(m, ["merchant_id", "settlement_id"]).select("merchant_id", "settlement_id", "gross", "members_paise",
        (F.col("gross") == F.col("members_paise")).alias("equal"))


@query(
    """SELECT a.merchant_id, a.payment_id, a.first_twin, x.amount_paise = y.amount_paise AND x.method = y.method AND x.settle_date = y.settle_date
        AND x.settlement_id <> y.settlement_id AS ties FROM (
         SELECT a.merchant_id, a.payment_id, min(b.payment_id) AS first_twin FROM swap a
             JOIN swap b ON b.merchant_id = a.merchant_id AND b.settle_date = a.settle_date AND b.amount_paise = a.amount_paise
             AND b.method = a.method AND b.settlement_id <> a.settlement_id GROUP BY ALL
       ) AS a JOIN truth x ON x.merchant_id = a.merchant_id AND x.payment_id = a.payment_id
           JOIN truth y ON y.merchant_id = a.merchant_id AND y.payment_id = a.first_twin"""
)
def dq_ties(t):
    """DQ-04: each payment called ambiguous really ties with its first twin, by the truth."""
    pairs = netting.twins(run(t).tied).select("merchant_id", "payment_id", "first_twin")
    x = t["truth"].select("merchant_id", "payment_id", "amount_paise", "method", "settle_date", "settlement_id")
    y = x.toDF("merchant_id", "first_twin", "amount_y", "method_y", "date_y", "settlement_y")
    j = pairs.join(x, ["merchant_id", "payment_id"]).join(y, ["merchant_id", "first_twin"])
    ties = (F.col("amount_paise") == F.col("amount_y")) & (F.col("method") == F.col("method_y")) & (F.col("settle_date") == F.col("date_y")) & (F.col("settlement_id") != F.col("settlement_y"))
    return j.select("merchant_id", "payment_id", "first_twin", ties.alias("ties"))


#: Rules of the census with the least count that each must have.
CENSUS = {"payment_in_two_batches": 0, "unsettled_status": 0, "credit_off_net": 10, "no_reference": 3, "no_credit": 1, "netted_refunds": 5,
    "separate_refunds": 1, "reversed_disputes": 1, "instant_batches": 1, "holiday_shifted": 5}


@query(
    f"""SELECT rule, n, CAST(least_n AS BIGINT) AS least, n >= least_n AS enough FROM (
         SELECT 'payment_in_two_batches' AS rule, count(*) AS n FROM (SELECT merchant_id, payment_id FROM truth GROUP BY ALL HAVING count(*) > 1) AS a
         UNION ALL SELECT 'unsettled_status', count(*) FROM truth JOIN payment USING (merchant_id, payment_id) WHERE status <> 'captured'
         UNION ALL SELECT 'credit_off_net', count(*) FROM bank b JOIN settlement s ON s.merchant_id = b.merchant_id AND substr(b.bank_txn_id,
             4) = substr(s.settlement_id, 5) WHERE b.amount_paise <> s.net
         UNION ALL SELECT 'no_reference', count(*) FROM settlement WHERE utr IS NULL
         UNION ALL SELECT 'no_credit', count(*) FROM settlement WHERE substr(settlement_id, 5) NOT IN (SELECT substr(bank_txn_id, 4) FROM bank)
         UNION ALL SELECT 'netted_refunds', count(*) FROM refund WHERE netted UNION ALL SELECT 'separate_refunds', count(*) FROM refund
             WHERE NOT netted
         UNION ALL SELECT 'reversed_disputes', count(*) FROM chargeback WHERE reversed_date IS NOT NULL UNION ALL SELECT 'instant_batches', count(*)
             FROM settlement WHERE instant
         UNION ALL SELECT 'holiday_shifted', count(DISTINCT settlement_id) FROM truth
             WHERE NOT instant AND date_diff('day', capture_date, settle_date) > 2
       ) AS r JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in CENSUS.items())}) AS l(rule, least_n) USING (rule)"""
)
def dq_census(t):
    """DQ-03, DQ-05, DQ-07: one count per rule, and whether it is as large as it must be."""
    s, b, u = t["settlement"], t["bank"], t["truth"]
    keyed = s.withColumn("k", F.substring("settlement_id", 5, 100))
    paid = b.select("merchant_id", "amount_paise", F.substring("bank_txn_id", 4, 100).alias("k"))
    parts = {
        "payment_in_two_batches": u.groupBy("merchant_id", "payment_id").count().where("count > 1"),
        "unsettled_status": u.select("merchant_id", "payment_id").join(t["payment"], ["merchant_id", "payment_id"]).where("status <> 'captured'"),
        "credit_off_net": keyed.join(paid, ["merchant_id", "k"]).where("amount_paise <> net"), "no_reference": s.where("utr is null"),
            "no_credit": keyed.join(paid, ["merchant_id", "k"], "left_anti"),
        "netted_refunds": t["refund"].where("netted"), "separate_refunds": t["refund"].where("not netted"),
            "reversed_disputes": t["chargeback"].where("reversed_date is not null"),
        "instant_batches": s.where("instant"),
            "holiday_shifted": u.where("not instant and datediff(settle_date, capture_date) > 2").select("settlement_id").distinct(),
    }
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("rule"), "n", F.lit(CENSUS[n]).cast("long").alias("least"),
        (F.col("n") >= CENSUS[n]).alias("enough")) for n, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


@query(
    """SELECT merchant_id, method, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS value_paise, quantile_disc(amount_paise, 0.5) AS p50,
        quantile_disc(amount_paise, 0.9) AS p90, quantile_disc(amount_paise, 0.99) AS p99, max(amount_paise) AS largest FROM payment
        WHERE status = 'captured' GROUP BY ALL"""
)
def dq_method_mix(t):
    """DQ-06, SRT-04: volume, value and ticket size by method."""
    at = lambda q: F.expr(f"cast(percentile_disc({q}) within group (order by amount_paise) as bigint)")
    p = t["payment"].where("status = 'captured'")
    return p.groupBy("merchant_id", "method").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("value_paise"), at(0.5).alias("p50"),
        at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("amount_paise").alias("largest"))


@query(
    f"""SELECT merchant_id, 'ticket' AS figure, CASE WHEN amount_paise < 1000000 THEN 'under 10,000' WHEN amount_paise < 10000000 THEN 'under 100,000'
        ELSE 'above' END AS part, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS paise FROM cap GROUP BY ALL
        UNION ALL SELECT merchant_id, 'status', status, count(*), CAST(sum(amount_paise) AS BIGINT) FROM payment GROUP BY ALL
        UNION ALL SELECT merchant_id, 'split', {_SPLIT.format(d="settle_date")}, count(*), CAST(sum(gross) AS BIGINT) FROM settlement GROUP BY ALL
        UNION ALL SELECT merchant_id, 'members', CASE WHEN n < 10 THEN 'under 10' WHEN n < 100 THEN 'under 100' ELSE 'above' END, count(*),
            CAST(sum(gross) AS BIGINT) FROM (SELECT merchant_id, settlement_id, count(*) AS n, sum(amount_paise) AS gross FROM truth
            GROUP BY ALL) AS m GROUP BY ALL
        UNION ALL SELECT merchant_id, 'capture days', CAST(days AS VARCHAR), count(*), CAST(sum(gross) AS BIGINT)
            FROM (SELECT merchant_id, settlement_id, count(DISTINCT capture_date) AS days, sum(amount_paise) AS gross FROM truth GROUP BY ALL) AS m
            GROUP BY ALL
        UNION ALL SELECT merchant_id, 'gap', 'credits less net', count(*), CAST(sum(b.amount_paise - s.net) AS BIGINT) FROM settlement s
            JOIN bank b USING (merchant_id) WHERE substr(b.bank_txn_id, 4) = substr(s.settlement_id, 5) GROUP BY ALL"""
)
def dq_volume(t):
    """DQ-06: volume by ticket size, status, split, batch size, capture days of a batch, and the gap between credits and nets."""
    a, p, s = F.col("amount_paise"), t["payment"], t["settlement"]
    batches = t["truth"].groupBy("merchant_id", "settlement_id").agg(F.count("*").alias("n"),
        F.count_distinct("capture_date").cast("string").alias("days"), F.sum("amount_paise").alias("paise"))
    paid = t["bank"].select("merchant_id", "amount_paise", F.substring("bank_txn_id", 4, 100).alias("k"))
    gap = s.withColumn("k", F.substring("settlement_id", 5, 100)).join(paid, ["merchant_id", "k"]).withColumn("paise", a - F.col("net"))
    parts = [
        ("ticket", p.where("status = 'captured'").withColumn("paise", a), F.when(a < 1_000_000, "under 10,000").when(a < 10_000_000,
            "under 100,000").otherwise("above")),
        ("status", p.withColumn("paise", a), F.col("status")),
        ("split", s.withColumn("paise", F.col("gross")), scorer.split_of("settle_date")),
        ("members", batches, F.when(F.col("n") < 10, "under 10").when(F.col("n") < 100, "under 100").otherwise("above")),
        ("capture days", batches, F.col("days")),
        ("gap", gap, F.lit("credits less net")),
    ]
    rows = [df.groupBy("merchant_id", F.lit(figure).alias("figure"), part.alias("part")).agg(F.count("*").alias("n"),
        F.sum("paise").alias("paise")) for figure, df, part in parts]
    return reduce(DataFrame.unionByName, rows)


@query(
    """SELECT merchant_id, method, capture_date, count(DISTINCT effective_from) AS tiers, count(DISTINCT effective_from) = 1 AS one FROM (
         SELECT p.merchant_id, p.method, p.capture_date, t.effective_from FROM (SELECT DISTINCT merchant_id, method, capture_date FROM payment) AS p
         LEFT JOIN tier t ON t.merchant_id = p.merchant_id AND t.method = p.method AND (t.from_date IS NULL OR p.capture_date >= t.from_date)
             AND (t.to_date IS NULL OR p.capture_date < t.to_date)) AS x GROUP BY ALL"""
)
def dq_tiers(t):
    """DQ-08: published tiers in force for each method and date; exactly one is right."""
    from reconweave.operators.fees import with_tier

    rows = with_tier(t["payment"].select("merchant_id", "method", "capture_date").distinct(), t["rate"])
    n = F.count_distinct("effective_from")
    return rows.groupBy("merchant_id", "method", "capture_date").agg(n.alias("tiers"), (n == 1).alias("one"))


@query(
    f"""SELECT merchant_id, settlement_id, bank_txn_id, CAST({' + '.join(decompose.COMPONENTS)} + residue AS BIGINT) AS total, bank_paise,
        {' + '.join(decompose.COMPONENTS)} + residue = bank_paise AS equal FROM dec WHERE bank_txn_id IS NOT NULL"""
)
def dq_component_sums(t):
    """DQ-01: components and residue of a matched settlement add up to its credit."""
    rows = decompose.components_long(run(t).decomposition).where("bank_txn_id is not null")
    key = ["merchant_id", "settlement_id", "bank_txn_id"]
    whole = F.col("component") == "TOTAL_bank_credit"
    s = rows.groupBy(*key).agg(F.sum(F.when(~whole, F.col("amount_paise"))).alias("total"),
        F.sum(F.when(whole, F.col("amount_paise"))).alias("bank_paise"))
    return s.withColumn("equal", F.col("total") == F.col("bank_paise"))


def evaluate(t: Entities) -> dict[str, DataFrame]:
    """All measures of a run against the truth, by name."""
    return {
        "link_scores": link_scores.of(t), "false_matches": false_matches.of(t), "refusal_scores": refusal_scores.of(t),
            "residue_scores": residue_scores.of(t), "cost_of_error": cost_of_error.of(t), "bank_link_accuracy": bank_link_accuracy.of(t),
    }
