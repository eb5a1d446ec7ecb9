"""The registered reconciliation queries, each with the SQL that gives the same rows where SQL can.

All run on the full preset. The SQL repeats the stages with plain, often
quadratic statements, proofs and assignments included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconweave.functions import calendar, money, narration
from reconweave.functions.durable import written
from reconweave.operators import adjustments, decompose, fees, investigate, ledger, matching, netting
from reconweave.plans.lookups import EVIDENCE, IMPLIED, PLAN, inr, jaro_winkler
from reconweave.plans.oracle import pct
from reconweave.plans.registry import ORACLE_SQL, QUERIES, Query, entities, on_table, query, run  # noqa: F401
from reconweave.streaming import jobs

# --- functions --------------------------------------------------------------------


@query(
    """SELECT merchant_id, bank_txn_id, CASE WHEN amount_paise < 0 THEN '-' ELSE '' END || CAST(abs(amount_paise) // 100 AS VARCHAR) || '.'
        || lpad(CAST(abs(amount_paise) % 100 AS VARCHAR), 2, '0') AS plain,
       CASE WHEN amount_paise < 0 THEN '-' ELSE '' END || CASE WHEN length(w) > 3 THEN ltrim(reverse(regexp_replace(reverse(left(w, length(w) - 3)),
           '(\\d\\d)', '\\1,', 'g')), ',') || ',' || right(w, 3) ELSE w END || '.' || lpad(CAST(abs(amount_paise) % 100 AS VARCHAR), 2, '0')
           AS grouped,
       amount_paise AS parsed, (abs(amount_paise) * 230 + 5000) // 10000 AS share, CASE WHEN amount_paise < 0 THEN -1
           ELSE 1 END * ((abs(amount_paise) + 50000) // 100000) / 100.0::DOUBLE AS lakh
       FROM (SELECT bank.*, CAST(abs(amount_paise) // 100 AS VARCHAR) AS w FROM bank) AS b"""
)
def fn_money(t):
    """FN-01..05: format, parse back, take a share of, and express in lakh each bank amount."""
    plain = money.fmt(F.col("amount_paise"))
    return t["bank"].select("merchant_id", "bank_txn_id", plain.alias("plain"), money.fmt_inr(F.col("amount_paise")).alias("grouped"),
        money.parse(plain).alias("parsed"), money.pct_of(F.abs("amount_paise"), 230).alias("share"), money.lakh(F.col("amount_paise")).alias("lakh"))


@query(
    """SELECT p.merchant_id, p.payment_id, CAST(c.ord AS BIGINT) AS ord, c.holiday, x.due AS plus_two, CAST(t.ord - c.ord AS BIGINT) AS distance,
        p.capture_date AS day,
       CAST(epoch(p.created_at) AS BIGINT) % 86400 AS second_of_day FROM payment p JOIN cal c ON c.d = p.capture_date
           JOIN due2 x ON x.d = p.capture_date JOIN cal t ON t.d = x.due"""
)
def payment_days(t):
    """FN-06..08, FN-21: of each payment its banking day, two banking days on, their distance, and the date and second of its instant."""
    out = calendar.banking_distance(calendar.add_banking_days(t["payment"], t["cal"], "capture_date", 2, "plus_two"), t["cal"], "capture_date",
        "plus_two", "distance")
    out = calendar.with_ordinal(out, t["cal"].select("d", "ord"), "capture_date",
        "ord").join(F.broadcast(t["cal"].select(F.col("d").alias("capture_date"), "holiday")), "capture_date")
    return out.select("merchant_id", "payment_id", F.col("ord").cast("long").alias("ord"), "holiday", "plus_two",
        F.col("distance").cast("long").alias("distance"), F.to_date("created_at").alias("day"),
        calendar.second_of_day(F.col("created_at")).alias("second_of_day"))


@query(
    """SELECT merchant_id, bank_txn_id, canon, CASE WHEN starts_with(canon, 'NEFT') THEN 'neft' WHEN starts_with(canon, 'IMPS') THEN 'imps'
        WHEN starts_with(canon, 'RTGS') THEN 'rtgs' WHEN starts_with(canon, 'UPI') THEN 'upi_payout' WHEN starts_with(canon, 'CMS') THEN 'corp'
        ELSE '' END AS rail,
       array_to_string(candidates, ',') AS candidates, array_to_string(tokens, ',') AS tokens FROM parsed"""
)
def narration_fields(t):
    """FN-09..13: canonical text, rail, reference candidates and entity tokens."""
    p = matching.parsed(t["bank"])
    return p.select("merchant_id", "bank_txn_id", "canon", "rail", F.array_join("candidates", ",").alias("candidates"),
        F.array_join("tokens", ",").alias("tokens"))


def _spans_sql() -> str:
    parts = []
    for name, pattern in narration.RULES:
        value = "replace(v, ' ', '')" if name == "neft_rtgs_despaced" else "v"
        where = "WHERE length(regexp_replace(v, '[^0-9]', '', 'g')) >= 8 AND length(regexp_replace(v, '[^0-9]', '', 'g')) < length(v)" if name == "mixed_numeric_damaged" else ""
        at = "CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(vs[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
        parts.append(f"""SELECT merchant_id, bank_txn_id, 'utr' AS field, '{name}' AS rule, {value} AS value, start, start + length(v) AS "end" FROM (
            SELECT merchant_id, bank_txn_id, v, {at} AS start FROM (SELECT merchant_id, bank_txn_id, vs, gaps, unnest(vs) AS v,
                generate_subscripts(vs, 1) AS i FROM (
                SELECT merchant_id, bank_txn_id, regexp_extract_all(canon, '{pattern}', 1) AS vs, string_split_regex(canon, '{pattern}') AS gaps
                    FROM parsed) AS a) AS b) AS c {where}""")
    return " UNION ALL ".join(parts)


@query(_spans_sql())
def narration_spans(t):
    """FN-12: where each candidate stands in the canonical text and which rule found it."""
    p = matching.parsed(t["bank"]).select("merchant_id", "bank_txn_id", F.explode(narration.utr_spans(F.col("canon"))).alias("s"))
    return p.select("merchant_id", "bank_txn_id", "s.*")


# --- fees and batches -------------------------------------------------------------


@query(f"SELECT merchant_id, payment_id, effective_from, fee, gst_on_fee, reserve_base, {pct('amount_paise', 1)} AS bp FROM priced")
def payment_fees(t):
    """JN-07, AG-01: as-of rate tier, fee, GST and reserve base of each settled payment."""
    p = fees.payment_fees(t["truth"], t["rate"])
    return p.select("merchant_id", "payment_id", "effective_from", "fee", "gst_on_fee", "reserve_base",
        money.pct_of(F.col("amount_paise"), 1).alias("bp"))


@query(
    f"""SELECT merchant_id, settlement_id, instant, CAST(sum(amount_paise) AS BIGINT) AS gross, CAST(sum(fee) AS BIGINT) AS fee, CAST(sum(gst_on_fee)
        AS BIGINT) AS gst_on_fee, CAST(sum(reserve_base) AS BIGINT) AS reserve_base, count(*) AS n_members,
        CAST(CASE WHEN instant THEN 0 ELSE {pct("sum(reserve_base)", 500)} END AS BIGINT) AS reserve_held FROM priced
            GROUP BY merchant_id, settlement_id, instant"""
)
def batch_fees(t):
    """AG-02, AG-03: sums per batch of what was rounded per payment; the reserve on the summed base."""
    return fees.batch_fees(t["truth"], t["rate"])


@query(
    """SELECT merchant_id, capture_date AS settle_date, true AS instant, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS pool_paise FROM cap
        GROUP BY ALL
       UNION ALL SELECT merchant_id, due, false, count(*), CAST(sum(amount_paise) AS BIGINT) FROM cap JOIN due2 ON d = capture_date GROUP BY ALL"""
)
def payment_pools(t):
    """NET-01, AG-15: pools by capture date and by the date two banking days on."""
    a, b = netting.pools(t["payment"], t["cal"])
    return a.unionByName(b.select(*a.columns)).groupBy(*netting.GROUP).agg(F.count("*").alias("n"), F.sum("amount_paise").alias("pool_paise"))


@query("SELECT merchant_id, settlement_id, payment_id, settle_date, instant, hypothesis FROM h1")
def ordered_blocks(t):
    """WIN-01, WIN-02, NET-02: members of batches by the first order whose running sums hit every total."""
    return run(t).members.where("hypothesis is not null").select("merchant_id", "settlement_id", "payment_id", "settle_date", "instant", "hypothesis")


@query("SELECT merchant_id, settlement_id, payment_id, settle_date, instant, solver FROM members")
def batch_members(t):
    """NET-02, NET-03, NET-06: proved members of all batches, by either solver."""
    return run(t).members.select("merchant_id", "settlement_id", "payment_id", "settle_date", "instant", "solver")


@query(
    """SELECT merchant_id, settle_date, false AS instant, settlement_id, outcome, pool_size, CAST(target AS BIGINT) AS target, states,
        coalesce(payment_ids, '') AS payment_ids FROM proofs LEFT JOIN (
         SELECT merchant_id, settlement_id, string_agg(payment_id, ',' ORDER BY payment_id) AS payment_ids FROM members WHERE solver = 'H2_subset_sum'
             GROUP BY ALL) AS m USING (merchant_id, settlement_id)"""
)
def subset_proofs(t):
    """NET-03, NET-04: unique-subset proofs of the batches that no order explains, with reasons of refusal."""
    p = run(t).proofs
    return p.select("merchant_id", "settle_date", "instant", "settlement_id", "outcome", "pool_size", "target", "states",
        F.array_join("payment_ids", ",").alias("payment_ids"))


@query("SELECT merchant_id, settlement_id, outcome, pool_size, CAST(target AS BIGINT) AS target, states FROM proofs WHERE outcome <> 'UNIQUE'")
def refusals(t):
    """NET-04: batches whose members could not be proved, and on what the proof failed."""
    return netting.refusals(run(t).proofs).drop("reason")


@query(
    """SELECT s.merchant_id, s.settle_date, s.instant, s.n_batches, coalesce(p.n, 0) AS n_items, CAST(coalesce(p.have, 0) AS BIGINT) AS pool_paise,
        CAST(s.want AS BIGINT) AS batch_paise, CAST(coalesce(p.have, 0) - s.want AS BIGINT) AS delta,
              CASE WHEN p.n IS NULL THEN 'no_payments' ELSE coalesce(h.solver, 'failed') END AS status
       FROM (SELECT merchant_id, settle_date, instant, count(*) AS n_batches, sum(gross) AS want FROM settlement GROUP BY ALL) AS s
       LEFT JOIN (SELECT merchant_id, capture_date AS settle_date, true AS instant, count(*) AS n, sum(amount_paise) AS have FROM cap GROUP BY ALL
                  UNION ALL SELECT merchant_id, due, false, count(*), sum(amount_paise) FROM cap JOIN due2 ON d = capture_date
                      WHERE payment_id NOT IN (SELECT payment_id FROM h1i) GROUP BY ALL) AS p USING (merchant_id, settle_date, instant)
       LEFT JOIN (SELECT merchant_id, settle_date, instant, min(solver) AS solver FROM members
           GROUP BY ALL) AS h USING (merchant_id, settle_date, instant)"""
)
def group_status(t):
    """NET-05: totals of each group's pool and batches, and how it was solved."""
    return netting.group_status(t["payment"], t["settlement"], t["cal"], run(t).members)


@query("SELECT merchant_id, payment_id, settlement_id, settle_date, amount_paise, method FROM swap")
def swap_invariant(t):
    """AG-13: payments with an indistinguishable twin in another batch of their date."""
    return run(t).tied


@query("SELECT merchant_id, payment_id, amount_paise FROM cap WHERE payment_id NOT IN (SELECT payment_id FROM members)")
def unassigned_payments(t):
    """SET-06: captured payments in no proved batch."""
    r = run(t)
    return t["payment"].where("status = 'captured'").join(r.members, ["merchant_id", "payment_id"], "left_anti").select("merchant_id",
        "payment_id", "amount_paise")


@query(
    """SELECT a.merchant_id, a.payment_id, a.settlement_id, count(*) AS twins, min(b.payment_id) AS first_twin FROM swap a JOIN swap b
       ON b.merchant_id = a.merchant_id AND b.settle_date = a.settle_date AND b.amount_paise = a.amount_paise AND b.method = a.method
           AND b.settlement_id <> a.settlement_id GROUP BY ALL"""
)
def tie_comparison(t):
    """RPT-09: each ambiguous payment with its twins in other batches, counted by aggregates instead of pairs."""
    return netting.twins(run(t).tied)


# --- matching ---------------------------------------------------------------------


@query("SELECT merchant_id, debit, credit FROM washed")
def wash_pairs(t):
    """JN-02: credits taken back by a return debit within five days."""
    return matching.wash_pairs(matching.parsed(t["bank"])).select("merchant_id", "debit", "credit")


@query("SELECT merchant_id, bank_txn_id, utr, method, confidence FROM repair")
def utr_repairs(t):
    """JN-03..05: what damaged references repair to."""
    return run(t).matched["repairs"]


@query("SELECT merchant_id, bank_txn_id, settlement_id, confidence, source FROM reflinks")
def reference_links(t):
    """JN-01, JN-06: links by exact and by uniquely repaired references."""
    return run(t).matched["referenced"]


@query("SELECT merchant_id, bank_txn_id, settlement_id, round(confidence, 6) AS confidence, source FROM links")
def bank_links(t):
    """SNK-01: all links between credits and settlements."""
    return run(t).matched["links"].withColumn("confidence", F.round("confidence", 6))


@query(
    """SELECT 'credit' AS side, merchant_id, bank_txn_id AS id FROM credits WHERE bank_txn_id NOT IN (SELECT bank_txn_id FROM reflinks)
       UNION ALL SELECT 'settlement', merchant_id, settlement_id FROM settlement WHERE settlement_id NOT IN (SELECT settlement_id FROM reflinks)"""
)
def open_items(t):
    """SET-01: credits and settlements that no reference links."""
    m = run(t).matched
    c = m["credits"].join(m["referenced"], ["merchant_id", "bank_txn_id"], "left_anti").select(F.lit("credit").alias("side"), "merchant_id",
        F.col("bank_txn_id").alias("id"))
    s = t["settlement"].join(m["referenced"], ["merchant_id", "settlement_id"], "left_anti").select(F.lit("settlement").alias("side"),
        "merchant_id", F.col("settlement_id").alias("id"))
    return c.unionByName(s)


@query("""SELECT merchant_id, bank_txn_id, settlement_id, CAST(banking_days AS BIGINT) AS banking_days, utr_hit, abs(amount_paise - net) AS delta
    FROM cand""")
def candidate_pairs(t):
    """JN-08: blocked candidate pairs of open credits and free settlements."""
    c = run(t).matched["candidates"]
    return c.select("merchant_id", "bank_txn_id", "settlement_id", F.col("banking_days").cast("long").alias("banking_days"), "utr_hit",
        F.abs(F.col("amount_paise") - F.col("net")).alias("delta"))


@query(
    """SELECT merchant_id, bank_txn_id, settlement_id, round(dl, 6) AS f_abs_amount_delta_log, ex AS f_utr_exact, round(tri, 6) AS f_token_overlap,
        round(jw, 6) AS f_jaro_winkler, tol AS f_delta_within_tolerance, round(probability, 6) AS probability FROM score"""
)
def pair_features(t):
    """SC-01, SC-02, FN-14..17: features and prior probability of each candidate pair."""
    c = run(t).matched["candidates"]
    r = lambda n: F.round(n, 6).alias(n)
    return c.select("merchant_id", "bank_txn_id", "settlement_id", r("f_abs_amount_delta_log"), "f_utr_exact", r("f_token_overlap"),
        r("f_jaro_winkler"), "f_delta_within_tolerance", r("probability"))


@query("SELECT merchant_id, bank_txn_id, near_tie FROM gaps")
def near_ties(t):
    """WIN-03, WIN-04: credits whose two best candidates are almost as probable."""
    return run(t).matched["candidates"].select("merchant_id", "bank_txn_id", "near_tie").distinct()


@query(
    """SELECT merchant_id, bank_txn_id, settlement_id, round(probability, 6) AS confidence FROM (
         SELECT *, row_number() OVER (PARTITION BY merchant_id, settlement_id ORDER BY bank_txn_id) AS rs FROM (
           SELECT *, row_number() OVER (PARTITION BY merchant_id, bank_txn_id ORDER BY probability DESC, settlement_id) AS rn FROM score
         ) AS a WHERE rn = 1 AND probability >= 0.55
       ) AS b WHERE rs = 1"""
)
def greedy_links(t):
    """JN-13: each credit's most probable settlement, first come first served."""
    return matching.greedy(run(t).matched["candidates"]).select("merchant_id", "bank_txn_id", "settlement_id",
        F.round("confidence", 6).alias("confidence"))


@query("SELECT merchant_id, bank_txn_id, settlement_id, round(confidence, 6) AS confidence, source FROM assigned")
def assignment_links(t):
    """JN-12: optimal one-to-one links within components of the candidate graph."""
    return run(t).matched["links"].where("source in ('global_assignment', 'repaired_utr')").withColumn("confidence", F.round("confidence", 6))


@query("SELECT merchant_id, settlement_id, n_in_window, closest FROM closest")
def closest_credits(t):
    """JN-09: the credit nearest in amount within three banking days of each settlement, and how many there are."""
    return investigate.closest_credits(t["settlement"], t["bank"], t["cal"]).drop("closest_paise")


# --- adjustments ------------------------------------------------------------------


def _adjusted(t: dict[str, DataFrame]) -> DataFrame:
    return adjustments.attach_dates(adjustments.adjustments(t["refund"], t["chargeback"], t["reserve"], t["cal"]), t["settlement"])


@query("SELECT merchant_id, type, adjustment_id, amount_paise, CAST(fee_paise AS BIGINT) AS fee_paise, due_date, sec, settle_date FROM attached")
def attached_adjustments(t):
    """SET-02, AG-06, JN-10: all adjustments with due date and the settlement run they attach to."""
    return _adjusted(t).select("merchant_id", "type", "adjustment_id", "amount_paise", "fee_paise", "due_date", "sec", "settle_date")


@query("""SELECT merchant_id, settle_date, settlement_id, obs_lo, obs_hi, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, equal, n_batches
    FROM win""")
def cycle_windows(t):
    """WIN-05..07: observed and inferred ranges of the day of each batch."""
    return adjustments.cycle_windows(run(t).members, t["payment"])


@query("SELECT merchant_id, type, adjustment_id, settle_date, settlement_id, basis, candidates FROM owned")
def attributions(t):
    """JN-11, WIN-08, WIN-09: the batch that owns each adjustment, or why none is proved to."""
    return run(t).attributed.select("merchant_id", "type", "adjustment_id", "settle_date", "settlement_id", "basis", "candidates")


@query("""SELECT merchant_id, settlement_id, CAST(refund_netted AS BIGINT) AS refund_netted, CAST(chargeback AS BIGINT) AS chargeback,
    CAST(dispute_fee AS BIGINT) AS dispute_fee, CAST(reversal AS BIGINT) AS reversal, CAST(reserve_released AS BIGINT) AS reserve_released FROM ded""")
def batch_deductions(t):
    """AG-05, AG-07, JN-14: deductions of each batch; disputes with a debit of their own count by fee alone."""
    return run(t).deducted


# --- decomposition ----------------------------------------------------------------

_COMPONENTS = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in decompose.COMPONENTS)


@query(f"""SELECT merchant_id, settlement_id, bank_txn_id, bank_paise, membership_proven, {_COMPONENTS}, CAST(predicted AS BIGINT) AS predicted,
    CAST(residue AS BIGINT) AS residue, unmatched, within_tolerance FROM dec""")
def decomposition(t):
    """AG-08, JN-15, NET-06: eleven components, predicted net and residue of every settlement."""
    d = run(t).decomposition
    return d.select("merchant_id", "settlement_id", "bank_txn_id", "bank_paise", "membership_proven", *decompose.COMPONENTS, "predicted",
        "residue", "unmatched", "within_tolerance")


@query(
    "UNPIVOT (SELECT merchant_id, settlement_id, coalesce(bank_txn_id, '') AS bank_txn_id, "
    + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in (*decompose.COMPONENTS, "residue"))
    + ", CAST(coalesce(bank_paise, 0) AS BIGINT) AS TOTAL_bank_credit FROM dec) ON "
    + ", ".join((*decompose.COMPONENTS, "residue", "TOTAL_bank_credit"))
    + " INTO NAME component VALUE amount_paise"
)
def component_rows(t):
    """AG-09, SNK-01: the decomposition in long form."""
    return decompose.components_long(run(t).decomposition).withColumn("bank_txn_id", F.coalesce("bank_txn_id", F.lit("")))


TOTALS = """
    SELECT d.*, coalesce(v.exceptions, 0) AS exceptions, coalesce(v.auto_posted, 0) AS auto_posted, coalesce(v.escalated, 0) AS escalated, CAST(0
        AS BIGINT) AS suppressed FROM (
        SELECT merchant_id, count(*) AS settlements, count(bank_txn_id) AS credits_matched, CAST(sum(residue) AS BIGINT) AS net_residue,
            CAST(sum(abs(residue)) AS BIGINT) AS abs_residue, CAST(sum(gross) AS BIGINT) AS gross,
               count(*) FILTER (within_tolerance AND NOT ambiguous) AS clean, CAST(sum(n_members) AS BIGINT) AS links FROM dec GROUP BY merchant_id
    ) AS d LEFT JOIN (
        SELECT merchant_id, count(*) AS exceptions, count(*) FILTER (verdict = 'AUTO_POST') AS auto_posted, count(*) FILTER (verdict = 'ESCALATE')
            AS escalated FROM verdicts GROUP BY merchant_id
    ) AS v USING (merchant_id)"""


@query(TOTALS)
def run_totals(t):
    """AG-11: totals of a run per merchant."""
    return run(t).totals


@query("""SELECT merchant_id, exception_seq, settlement_id, bank_txn_id, CAST(residue AS BIGINT) AS residue, CAST(batch_value AS BIGINT)
    AS batch_value, ambiguous, unmatched, value_date, unproven AS partition_refusal, basis AS attribution_refusal, adjustment FROM exc""")
def exceptions(t):
    """NET-07, SET-03, SRT-01: what needs a decision, in order."""
    return run(t).exceptions.select("merchant_id", "exception_seq", "settlement_id", "bank_txn_id", "residue", "batch_value", "ambiguous",
        "unmatched", "value_date", "partition_refusal", "attribution_refusal", "adjustment")


# --- decisions --------------------------------------------------------------------


@query("""SELECT merchant_id, settlement_id, n AS n_payments, CAST(gross AS BIGINT) AS batch_gross, CAST(card AS BIGINT) AS card_paise, n_card, n_upi,
    n_netbanking, n_wallet, first_card FROM mix""")
def batch_mix(t):
    """AG-12: methods, gross, card volume and first card payment of each batch."""
    return investigate.batch_mix(run(t).members, t["payment"], t["rate"]).drop("published_bp", "published_from")


@query("""SELECT h.merchant_id, h.settlement_id, f.refund_id, f.payment_id, f.amount_paise FROM members h
    JOIN refund f ON f.merchant_id = h.merchant_id AND f.payment_id = h.payment_id WHERE f.netted""")
def batch_refunds(t):
    """JN-16: netted refunds of the payments of each batch."""
    return investigate.in_batches(run(t).members, t["refund"].where("netted")).select("merchant_id", "settlement_id", "refund_id", "payment_id",
        "amount_paise")


@query("""SELECT h.merchant_id, h.settlement_id, f.dispute_id, f.payment_id, f.amount_paise, f.fee_paise FROM members h
    JOIN chargeback f ON f.merchant_id = h.merchant_id AND f.payment_id = h.payment_id""")
def batch_chargebacks(t):
    """JN-17: disputes of the payments of each batch."""
    return investigate.in_batches(run(t).members, t["chargeback"]).select("merchant_id", "settlement_id", "dispute_id", "payment_id",
        "amount_paise", "fee_paise")


@query("""SELECT s.merchant_id, s.settlement_id, f.reserve_id, f.amount_paise FROM settlement s
    JOIN reserve f ON f.merchant_id = s.merchant_id AND f.release_date = s.settle_date""")
def batch_reserves(t):
    """JN-18: reserve entries that are released on the date of a batch."""
    return investigate.on_run_date(t["settlement"], t["reserve"]).select("merchant_id", "settlement_id", "reserve_id", "amount_paise")


@query("SELECT merchant_id, exception_seq, label, conf AS label_confidence, resolution FROM lab")
def classifications(t):
    """INV-02, INV-06, INV-07: label and resolution of each exception from what its lookups found."""
    return run(t).classified.select("merchant_id", "exception_seq", "label", "label_confidence", "resolution")


@query(
    """SELECT merchant_id, exception_seq, net, reported_gross, n_in_window, closest, n_payments, CAST(batch_gross AS BIGINT) AS batch_gross,
        n_refunds, CAST(refunds_total AS BIGINT) AS refunds_total, r AS refunds_explain,
              n_chargebacks, CAST(chargebacks_total AS BIGINT) AS chargebacks_total, c AS chargebacks_explain, n_reserves, v AS reserves_explain,
                  utr_exact, delta, CAST(bank_days AS BIGINT) AS bank_days FROM sig"""
)
def exception_signals(t):
    """INV-01, INV-05, JN-16..18: what the lookups around each exception found."""
    names = ("net", "reported_gross", "n_in_window", "closest", "n_payments", "batch_gross", "n_refunds", "refunds_total", "refunds_explain",
        "n_chargebacks", "chargebacks_total", "chargebacks_explain", "n_reserves", "reserves_explain", "utr_exact", "delta")
    return run(t).signals.select("merchant_id", "exception_seq", *names, F.col("bank_days").cast("long").alias("bank_days"))


@query(
    """SELECT merchant_id, exception_seq, CAST(card AS BIGINT) AS card_paise, published_bp, CASE WHEN card > 0
        THEN round(abs(residue) * 100.0::DOUBLE / card, 6) ELSE 0.0::DOUBLE END AS implied_pct, variance AS consistent FROM sig"""
)
def rate_checks(t):
    """INV-03: the rate that a residue implies on the card volume, against the published one."""
    return run(t).signals.select("merchant_id", "exception_seq", "card_paise", "published_bp", F.round("implied_pct", 6).alias("implied_pct"),
        F.col("fee_variance").alias("consistent"))


@query(
    f"""SELECT merchant_id, exception_seq, narration, coalesce(len(ctokens), 0) AS n_tokens, utr_exact, round(CASE WHEN utr IS NULL THEN 1.0
        ELSE coalesce(list_max(list_transform(ctokens, lambda c: {jaro_winkler('c', 'utr')})), 0.0) END::DOUBLE, 6) AS similarity FROM sig"""
)
def narration_checks(t):
    """INV-04: what the narration of each exception's credit says about its reference."""
    n = F.when(F.col("tokens").isNull(), 0).otherwise(F.size("tokens")).cast("long")
    return run(t).signals.select("merchant_id", "exception_seq", "narration", n.alias("n_tokens"), "utr_exact",
        F.round("similarity", 6).alias("similarity"))


@query(f"SELECT merchant_id, exception_seq, array_to_string(steps, '>') AS steps FROM ({PLAN}) AS p")
def lookup_plans(t):
    """INV-08: the lookups made for each exception, in order."""
    return investigate.explained(run(t).classified).select("merchant_id", "exception_seq", F.array_join("steps", ">").alias("steps"))


@query(f"SELECT e.* FROM (WITH p AS MATERIALIZED ({PLAN}) {EVIDENCE}) AS e")
def evidence_rows(t):
    """INV-09: each statement of evidence with the row that it is read from."""
    rows = investigate.explained(run(t).classified).select("merchant_id", "exception_seq", F.explode("evidence").alias("e"))
    return rows.select("merchant_id", "exception_seq", "e.*")


@query(
    f"""SELECT p.merchant_id, p.exception_seq, 'Residue ' || {inr('residue')} || ' on ' || {inr('batch_value')} || ': ' || label || '. ' || CASE label
         WHEN 'fee_variance' THEN 'The gap is ' || {IMPLIED} || '% of the card volume above the published '
             || printf('%.2f', published_bp / 100.0) || '%.'
         WHEN 'ambiguous_candidates' THEN 'Equal payments could be exchanged between batches, so nothing is posted.' WHEN 'attribution_ambiguous'
             THEN adjustment || ' fits no batch by its time (' || basis || '), so no payout nets it.'
         WHEN 'duplicate_credit' THEN 'No credit is linked; ' || CAST(n_in_window AS VARCHAR) || ' lie in the window.' WHEN 'partition_unproven'
             THEN 'Members are not proved (' || unproven || '), so the residue shows nothing.'
         WHEN 'unexplained' THEN CAST(len(steps) AS VARCHAR) || ' lookups explain none of it.' ELSE 'The rows found account for it.' END
             || ' Evidence: ' || CAST(coalesce(n, 0) AS VARCHAR) || '.' AS rationale
        FROM ({PLAN}) AS p LEFT JOIN (SELECT merchant_id, exception_seq, count(*) AS n FROM (WITH p AS MATERIALIZED ({PLAN}) {EVIDENCE}) AS e
            GROUP BY ALL) AS e USING (merchant_id, exception_seq)"""
)
def rationales(t):
    """INV-10: the reason of each label in words."""
    return investigate.explained(run(t).classified).select("merchant_id", "exception_seq", "rationale")


@query("SELECT merchant_id, exception_seq, idempotency_key FROM lab")
def idempotency_keys(t):
    """POL-08, FN-18: the key that makes a decision repeatable without effect, bound to the rows that are its evidence."""
    return run(t).classified.select("merchant_id", "exception_seq", "idempotency_key")


@query(
    """SELECT merchant_id, label, count(*) AS n, CAST(sum(abs(residue)) AS BIGINT) AS value_paise FROM lab GROUP BY ALL"""
)
def exceptions_by_label(t):
    """AG-14, RPT-06: exceptions and their value by label."""
    return run(t).classified.groupBy("merchant_id", "label").agg(F.count("*").alias("n"), F.sum(F.abs("residue")).alias("value_paise"))


@query("""SELECT merchant_id, exception_seq, settlement_id, label, conf AS label_confidence, resolution, failed_arms, failed_text, verdict,
    policy_reason FROM verdicts""")
def decisions(t):
    """POL-01..07: verdict of each exception under gates and daily budgets."""
    return run(t).verdicts.select("merchant_id", "exception_seq", "settlement_id", "label", "label_confidence", "resolution", "failed_arms",
        "failed_text", "verdict", "policy_reason")


@query(
    """SELECT v.merchant_id, v.exception_seq, 'SUPPRESSED_DUPLICATE' AS verdict, c.verdict AS prior_verdict FROM verdicts v
        JOIN chain c USING (merchant_id, idempotency_key)"""
)
def decisions_again(t):
    """POL-05, AUD-05: a second run over the same rows decides nothing and carries the verdicts before."""
    r = run(t)
    return r.decided(r.ledger()).select("merchant_id", "exception_seq", "verdict", "prior_verdict")


@query("""SELECT merchant_id, seq, idempotency_key, verdict, payload, prev_hash, hash FROM chain""")
def ledger_rows(t):
    """AUD-01, SNK-05, FN-19: the hash-chained ledger of all decisions."""
    return run(t).ledger().select("merchant_id", "seq", "idempotency_key", "verdict", "payload", "prev_hash", "hash")


@query("""SELECT merchant_id, count(*) AS n_rows, CAST(0 AS BIGINT) AS broken_links, count(*) FILTER (seq % 50 = 7) AS altered, count(*)
    FILTER (seq % 50 = 9) AS unverifiable, max_by(hash, seq) AS head FROM chain GROUP BY merchant_id""")
def ledger_check(t):
    """WIN-12, AUD-02..05: links and contents of the chain, in which every fiftieth verdict was altered afterwards and as many rows lost their number; a second run appends nothing."""
    r = run(t)
    first = written(r.ledger())
    again = r.ledger(first)
    altered = first.unionByName(again).withColumn("verdict", F.when(F.col("seq") % 50 == 7, "ALTERED").otherwise(F.col("verdict")))
    altered = altered.withColumn("canon_seq", F.when(F.col("seq") % 50 != 9, F.col("canon_seq")))
    return ledger.verify_ledger(altered)


# --- event streams in their batch form ------------------------------------------------


@on_table("events", """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, user_id, count(*) AS n FROM events
    GROUP BY ALL HAVING count(*) > 2""")
def rate_flags(events):
    """ST-04: users with more than two events in an hour."""
    return jobs.rate_flags(events, "user_id", "ts", 2,
        "1 hour").select(F.unix_seconds(F.col("window_start").cast("timestamp")).alias("window_start"), "user_id", "n")


@on_table(
    "events",
    """SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS claimed_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,
        event_type DESC) AS rn FROM events) AS e
       WHERE rn = 1 AND event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def stale_items(events):
    """ST-06: users whose last event is a click older than a day at the end of the log."""
    end = events.agg(F.max("ts").alias("ts")).first().ts
    stale = jobs.stale_items(events, "user_id", "ts", "event_type", "click", end, 24 * 60)
    return stale.select("user_id", F.unix_seconds(F.col("claimed_at").cast("timestamp")).alias("claimed_at"))


@on_table(
    "events",
    """SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(sum(value) OVER (PARTITION BY user_id
        ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS until FROM events""",
)
def event_times(events):
    """FN-23, WIN-11: a field of each event's JSON, and the time until the end of each step of its run (user) when steps take ``value``."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.round(F.sum("value").over(w), 4).alias("until"))


@query(
    """SELECT m.merchant_id, c.bank_txn_id AS credit, d.bank_txn_id AS debit FROM (SELECT DISTINCT merchant_id FROM bank) AS m
        JOIN refs c USING (merchant_id) JOIN refs d ON d.merchant_id = c.merchant_id AND d.ref = c.ref AND d.amount_paise = -c.amount_paise
       WHERE c.amount_paise > 0 AND d.value_date BETWEEN c.value_date AND c.value_date + 5 GROUP BY ALL"""
)
def wash_stream(t):
    """ST-05 in its batch form: credits and the debits within five days that take them back, as the stream joins them."""
    rows = matching.parsed(t["bank"]).select("merchant_id", F.col("amount_paise").alias("amount"), F.explode("candidates").alias("ref"),
        F.col("value_date").cast("timestamp").alias("at"), F.col("bank_txn_id").alias("id"))
    return jobs.wash_stream(rows.where("amount > 0"), rows.where("amount < 0")).distinct()


from reconweave.plans import evaluation, exchange, reports  # noqa: E402, F401
