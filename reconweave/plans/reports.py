"""What a user of the service reads: overviews, listings, queues and the trace of controls, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconweave.functions.money import fmt_inr
from reconweave.operators import decompose, investigate
from reconweave.plans.lookups import inr
from reconweave.plans.queries import PLAN
from reconweave.plans.registry import query, run

UNNAMED = ("unexplained", "ambiguous_candidates", "attribution_ambiguous", "partition_unproven")


@query(
    """SELECT h.merchant_id, l.bank_txn_id, h.settlement_id, h.payment_id, p.order_id, p.amount_paise, p.method, o.customer_id, o.amount_paise
        AS order_paise, 'full' AS run
       FROM members h LEFT JOIN links l ON l.merchant_id = h.merchant_id AND l.settlement_id = h.settlement_id
           JOIN payment p ON p.merchant_id = h.merchant_id AND p.payment_id = h.payment_id
       LEFT JOIN purchase o ON o.merchant_id = p.merchant_id AND o.order_id = p.order_id"""
)
def evidence_chain(t):
    """JN-19, RPT-02: the payments and orders behind each credit of a run, within their merchant."""
    r = run(t)
    link = r.matched["links"].select("merchant_id", "settlement_id", "bank_txn_id")
    facts = t["payment"].select("merchant_id", "payment_id", "order_id", "amount_paise", "method")
    orders = t["purchase"].select("merchant_id", "order_id", "customer_id", F.col("amount_paise").alias("order_paise"))
    chain = r.members.join(link, ["merchant_id", "settlement_id"], "left").join(facts, ["merchant_id", "payment_id"]).join(orders,
        ["merchant_id", "order_id"], "left")
    return chain.select("merchant_id", "bank_txn_id", "settlement_id", "payment_id", "order_id", "amount_paise", "method", "customer_id",
        "order_paise", F.lit("full").alias("run"))


@query(
    """SELECT d.*, coalesce(m.payments, 0) AS payments, round((credited - off) / nullif(credited, 0)::DOUBLE, 6) AS accounted_share,
        coalesce(v.posted, 0) AS posted, coalesce(v.held, 0) AS held, CAST(coalesce(v.unexplained_paise, 0) AS BIGINT) AS unexplained_paise,
        coalesce(v.unexplained, 0) AS unexplained,
              CAST(coalesce(v.at_risk, 0) AS BIGINT) AS value_at_risk FROM (
         SELECT merchant_id, count(*) AS credits, count(bank_txn_id) AS matched, round(count(bank_txn_id) / count(*)::DOUBLE, 6) AS match_rate,
             CAST(coalesce(sum(bank_paise), 0) AS BIGINT) AS credited,
                CAST(coalesce(sum(abs(residue)) FILTER (bank_txn_id IS NOT NULL), 0) AS BIGINT) AS off, count(*) FILTER (bank_txn_id IS NOT NULL
                    AND membership_proven AND residue = 0) AS proved_to_the_paise FROM dec GROUP BY merchant_id
       ) AS d LEFT JOIN (SELECT merchant_id, count(*) AS payments FROM members GROUP BY ALL) AS m USING (merchant_id)
       LEFT JOIN (SELECT merchant_id, count(*) FILTER (verdict = 'AUTO_POST') AS posted, count(*) FILTER (verdict = 'ESCALATE') AS held,
           sum(abs(residue)) FILTER (label = 'unexplained') AS unexplained_paise,
                         count(*) FILTER (label = 'unexplained') AS unexplained, sum(abs(residue)) FILTER (verdict = 'ESCALATE') AS at_risk
                             FROM verdicts GROUP BY ALL) AS v USING (merchant_id)"""
)
def overview(t):
    """RPT-05: headline figures per merchant; the value at risk is that of the held exceptions."""
    matched = F.col("bank_txn_id").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    count = lambda c: F.count(F.when(c, 1))
    r = run(t)
    d = r.decomposition.groupBy("merchant_id").agg(
        F.count("*").alias("credits"), F.count("bank_txn_id").alias("matched"),
            F.round(F.count("bank_txn_id") / F.count("*"), 6).alias("match_rate"), total("bank_paise").alias("credited"),
            total(F.when(matched, F.abs("residue"))).alias("off"),
        count(matched & F.col("membership_proven") & (F.col("residue") == 0)).alias("proved_to_the_paise"),
    )
    held, unexplained = F.col("verdict") == "ESCALATE", F.col("label") == "unexplained"
    v = r.verdicts.groupBy("merchant_id").agg(
        count(F.col("verdict") == "AUTO_POST").alias("posted"), count(held).alias("held"),
            total(F.when(unexplained, F.abs("residue"))).alias("unexplained_paise"), count(unexplained).alias("unexplained"),
            total(F.when(held, F.abs("residue"))).alias("value_at_risk")
    )
    out = d.join(r.members.groupBy("merchant_id").agg(F.count("*").alias("payments")), "merchant_id", "left").join(v, "merchant_id", "left")
    out = out.withColumn("accounted_share", F.round(F.try_divide((F.col("credited") - F.col("off")).cast("double"), F.col("credited")), 6))
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("payments", "posted", "held", "unexplained_paise", "unexplained",
        "value_at_risk")})


@query("""SELECT merchant_id, label, label IN ('unexplained', 'ambiguous_candidates', 'attribution_ambiguous', 'partition_unproven') AS unnamed,
    count(*) AS n, CAST(sum(abs(residue)) AS BIGINT) AS value_paise, count(*) FILTER (verdict = 'AUTO_POST') AS posted FROM verdicts GROUP BY ALL""")
def exceptions_by_label(t):
    """AG-14, RPT-06: exceptions and their value by label, with those that name no cause marked, and how many were posted."""
    posted = F.count(F.when(F.col("verdict") == "AUTO_POST", 1)).alias("posted")
    out = run(t).verdicts.groupBy("merchant_id", "label").agg(F.count("*").alias("n"), F.sum(F.abs("residue")).alias("value_paise"), posted)
    return out.withColumn("unnamed", F.col("label").isin(*UNNAMED))


@query(
    """SELECT 'solver' AS kind, outcome AS name, count(*) AS n FROM proofs GROUP BY ALL UNION ALL SELECT 'attribution', basis, count(*) FROM owned
        WHERE settlement_id IS NULL GROUP BY ALL
       UNION ALL SELECT 'verdict', verdict, count(*) FROM verdicts GROUP BY ALL UNION ALL SELECT 'group', status, count(*)
           FROM (SELECT DISTINCT merchant_id, settle_date, instant, solver AS status FROM members) AS g GROUP BY ALL"""
)
def outcome_counts(t):
    """AG-14: solver outcomes, refused adjustments by basis, verdicts, and groups by solver."""
    r = run(t)
    count = lambda df, kind, name: df.groupBy(F.lit(kind).alias("kind"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    groups = r.members.select("merchant_id", "settle_date", "instant", "solver").distinct()
    return count(r.proofs, "solver", "outcome").unionByName(count(r.attributed.where("settlement_id is null"), "attribution",
        "basis")).unionByName(count(r.verdicts, "verdict", "verdict")).unionByName(count(groups, "group", "solver"))


@query(
    """SELECT merchant_id, row_number() OVER (PARTITION BY merchant_id ORDER BY kind, size DESC, settlement_id, adjustment) AS nth, kind,
        settlement_id, adjustment, size FROM (
         SELECT merchant_id, 'exception' AS kind, coalesce(settlement_id, '') AS settlement_id, adjustment, CAST(abs(residue) AS BIGINT) AS size
             FROM verdicts WHERE verdict = 'ESCALATE'
         UNION ALL SELECT merchant_id, 'residue', settlement_id, '', CAST(abs(residue) AS BIGINT) FROM dec
             WHERE bank_txn_id IS NOT NULL AND residue <> 0 AND within_tolerance AND NOT ambiguous) AS q"""
)
def attention_queue(t):
    """RPT-07: held exceptions by size, then matched credits with a residue that raised none."""
    r = run(t)
    size = F.abs("residue").alias("size")
    held = r.verdicts.where("verdict = 'ESCALATE'").select("merchant_id", F.lit("exception").alias("kind"),
        F.coalesce("settlement_id", F.lit("")).alias("settlement_id"), "adjustment", size)
    quiet = r.decomposition.where("bank_txn_id is not null and residue <> 0").join(r.exceptions.where("adjustment = ''").select("merchant_id",
        "settlement_id"), ["merchant_id", "settlement_id"], "left_anti")
    both = held.unionByName(quiet.select("merchant_id", F.lit("residue").alias("kind"), "settlement_id", F.lit("").alias("adjustment"), size))
    w = Window.partitionBy("merchant_id").orderBy("kind", F.desc("size"), "settlement_id", "adjustment")
    return both.withColumn("nth", F.row_number().over(w))


_COMPONENTS = (*decompose.COMPONENTS, "residue")
_SHOWN = " || '; ' || ".join(f"'{c} ' || {inr(c)}" for c in _COMPONENTS)


@query(
    f"""SELECT d.merchant_id, d.settlement_id, d.bank_txn_id, d.value_date, b.narration, s.instant, d.n_members AS members,
        CAST(coalesce(d.bank_paise, 0) AS BIGINT) AS bank_paise, {inr("coalesce(d.bank_paise, 0)")} AS bank_fmt, CAST(residue AS BIGINT) AS residue,
        {inr("residue")} AS residue_fmt,
               abs(residue) <= 100 AS small, {_SHOWN} AS components FROM dec d JOIN (SELECT merchant_id, settlement_id, instant
                   FROM settlement) AS s USING (merchant_id, settlement_id) LEFT JOIN (SELECT merchant_id, bank_txn_id, narration
                   FROM bank) AS b ON b.merchant_id = d.merchant_id AND b.bank_txn_id = d.bank_txn_id"""
)
def credits_view(t):
    """RPT-01, AG-10: each settlement's credit with its components in order, as money is written."""
    long = decompose.components_long(run(t).decomposition).where("component <> 'TOTAL_bank_credit'")
    order = F.array_position(F.array(*map(F.lit, _COMPONENTS)), F.col("component"))
    parts = F.array_sort(F.collect_list(F.struct(order.alias("nth"), F.concat("component", F.lit(" "),
        fmt_inr(F.col("amount_paise"))).alias("text"))))
    shown = long.groupBy("merchant_id", "settlement_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "; ").alias("components"))
    d = run(t).decomposition.join(shown, ["merchant_id", "settlement_id"]).join(t["settlement"].select("merchant_id", "settlement_id",
        "instant"), ["merchant_id", "settlement_id"])
    d = d.join(t["bank"].select("merchant_id", "bank_txn_id", "narration"), ["merchant_id", "bank_txn_id"], "left").withColumn("bank_paise",
        F.coalesce("bank_paise", F.lit(0)))
    return d.select(
        "merchant_id", "settlement_id", "bank_txn_id", "value_date", "narration", "instant", F.col("n_members").alias("members"), "bank_paise",
            fmt_inr(F.col("bank_paise")).alias("bank_fmt"), "residue", fmt_inr(F.col("residue")).alias("residue_fmt"),
        (F.abs("residue") <= 100).alias("small"), "components",
    )


@query(
    """SELECT merchant_id, settlement_id, residue = 0 AS exact, abs(residue) > 100 AS off, contains(lower(settlement_id || ' '
        || coalesce(d.bank_txn_id, '') || ' ' || coalesce(narration, '')), 'neft') AS found FROM dec d LEFT
        JOIN bank b USING (merchant_id, bank_txn_id)
       WHERE residue = 0 OR abs(residue) > 100 OR contains(lower(settlement_id || ' ' || coalesce(d.bank_txn_id, '') || ' ' || coalesce(narration,
           '')), 'neft')"""
)
def credit_filters(t):
    """RPT-08: credits by the filters of the list: exact, off by more than a rupee, found by a text."""
    d = run(t).decomposition.join(t["bank"].select("merchant_id", "bank_txn_id", "narration"), ["merchant_id", "bank_txn_id"], "left")
    text = F.lower(F.concat_ws(" ", "settlement_id", F.coalesce("bank_txn_id", F.lit("")), F.coalesce("narration", F.lit(""))))
    out = d.select("merchant_id", "settlement_id", (F.col("residue") == 0).alias("exact"), (F.abs("residue") > 100).alias("off"),
        F.contains(text, F.lit("neft")).alias("found"))
    return out.where("exact or off or found")


@query(
    """SELECT merchant_id, row_number() OVER (PARTITION BY merchant_id ORDER BY settlement_id) AS nth, settlement_id, CAST(residue AS BIGINT)
        AS residue, within_tolerance FROM dec"""
)
def decomposition_listing(t):
    """SRT-03: decompositions by settlement id."""
    w = Window.partitionBy("merchant_id").orderBy("settlement_id")
    return run(t).decomposition.select("merchant_id", F.row_number().over(w).alias("nth"), "settlement_id", "residue", "within_tolerance")


@query("""SELECT merchant_id, row_number() OVER (PARTITION BY merchant_id ORDER BY amount_paise DESC, method, payment_id) AS nth, payment_id,
    settlement_id, amount_paise, method FROM swap""")
def ambiguous_listing(t):
    """SRT-03, RPT-02: ambiguous payments by amount, method and id."""
    w = Window.partitionBy("merchant_id").orderBy(F.desc("amount_paise"), "method", "payment_id")
    return run(t).tied.select("merchant_id", F.row_number().over(w).alias("nth"), "payment_id", "settlement_id", "amount_paise", "method")


@query(
    """SELECT merchant_id, seq, idempotency_key, verdict FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY seq DESC) AS rn
        FROM chain) AS c WHERE rn <= 100"""
)
def ledger_listing(t):
    """RPT-04, SRT-02: the last hundred ledger rows of each merchant."""
    w = Window.partitionBy("merchant_id").orderBy(F.desc("seq"))
    return run(t).ledger().withColumn("rn", F.row_number().over(w)).where("rn <= 100").select("merchant_id", "seq", "idempotency_key", "verdict")


@query("""SELECT merchant_id, count(*) AS payments, min(capture_date) AS first_day, max(capture_date) AS last_day, count(DISTINCT method) AS methods
    FROM payment GROUP BY ALL""")
def merchant_listing(t):
    """RPT-02: merchants with the extent of their payments."""
    return t["payment"].groupBy("merchant_id").agg(F.count("*").alias("payments"), F.min("capture_date").alias("first_day"),
        F.max("capture_date").alias("last_day"), F.count_distinct("method").alias("methods"))


_TRACE = f"""
    SELECT merchant_id, exception_seq, row_number() OVER (PARTITION BY merchant_id, exception_seq ORDER BY phase, step) AS nth, event, text FROM (
        SELECT merchant_id, exception_seq, 1 AS phase, 0 AS step, 'raised' AS event, label AS text FROM verdicts
        UNION ALL SELECT merchant_id, exception_seq, 2, generate_subscripts(steps, 1), 'lookup', unnest(steps) FROM ({PLAN}) AS p
        UNION ALL SELECT merchant_id, exception_seq, 3, 0, 'policy', failed_arms FROM verdicts
        UNION ALL SELECT merchant_id, exception_seq, 4, 0, 'verdict', verdict FROM verdicts
        UNION ALL SELECT v.merchant_id, v.exception_seq, 5, 0, 'ledger', c.hash FROM verdicts v JOIN chain c USING (merchant_id, idempotency_key)
    ) AS e"""


@query(_TRACE)
def control_trace(t):
    """RPT-03: all that happened to each exception, in order: raised, looked up, tested, decided, written to the ledger."""
    r = run(t)
    at = lambda df, phase, event, text: df.select("merchant_id", "exception_seq", F.lit(phase).alias("phase"), F.lit(0).alias("at"),
        F.lit(event).alias("event"), F.col(text).alias("text"))
    steps = r.classified.select("merchant_id", "exception_seq", F.posexplode(investigate.planned()).alias("at", "text"))
    steps = steps.select("merchant_id", "exception_seq", F.lit(2).alias("phase"), "at", F.lit("lookup").alias("event"), "text")
    kept = r.verdicts.select("merchant_id", "exception_seq", "idempotency_key").join(r.ledger().select("merchant_id", "idempotency_key", "hash"),
        ["merchant_id", "idempotency_key"])
    events: DataFrame = at(r.verdicts, 1, "raised", "label").unionByName(steps)
    for part in (at(r.verdicts, 3, "policy", "failed_arms"), at(r.verdicts, 4, "verdict", "verdict"), at(kept, 5, "ledger", "hash")):
        events = events.unionByName(part)
    w = Window.partitionBy("merchant_id", "exception_seq").orderBy("phase", "at")
    return events.select("merchant_id", "exception_seq", F.row_number().over(w).alias("nth"), "event", "text")


@query(
    """SELECT merchant_id, settlement_id, bank_txn_id, residue FROM (
        SELECT merchant_id, settlement_id, bank_txn_id, CAST(residue AS BIGINT) AS residue, row_number() OVER (PARTITION BY merchant_id
            ORDER BY abs(residue) DESC, settlement_id) AS rn FROM dec WHERE bank_txn_id IS NOT NULL
    ) AS x WHERE rn <= 20"""
)
def largest_residues(t):
    """SRT-02: each merchant's twenty matched credits with the largest residue."""
    w = Window.partitionBy("merchant_id").orderBy(F.abs("residue").desc(), "settlement_id")
    d = run(t).decomposition.where("bank_txn_id is not null").withColumn("rn", F.row_number().over(w))
    return d.where("rn <= 20").select("merchant_id", "settlement_id", "bank_txn_id", "residue")
