"""The stages once more, as DuckDB SQL over the derived entities: what the queries are held against."""

from __future__ import annotations

from reconweave.functions import narration as N
from reconweave.plans.lookups import DIGEST, inr, jaro_winkler  # noqa: F401
from reconweave.sources.derive import Dialect, entity_sql, ordered

GROUP = "merchant_id, settle_date, instant"
# Fixed values, repeated here so that a wrong one in the operators shows: tolerance in paise, items and states of a subset proof.
TOLERANCE, ITEMS, STATES = 100, 400, 250000


def pct(p: str, bp: object) -> str:
    return f"((({p}) * {bp} + 5000) // 10000)"


def _candidates() -> str:
    parts = []
    for name, pattern in N.RULES:
        found = f"regexp_extract_all(canon, '{pattern}', 1)"
        if name == "neft_rtgs_despaced":
            found = f"list_transform({found}, lambda v: replace(v, ' ', ''))"
        if name == "mixed_numeric_damaged":
            found = f"list_filter({found}, lambda v: length(regexp_replace(v, '[^0-9]', '', 'g')) >= 8 AND length(regexp_replace(v, '[^0-9]', '', 'g')) < length(v))"
        parts.append(found)
    return f"list_concat({', '.join(parts)})"


BODIES: dict[str, str | None] = {
    "tier": """SELECT merchant_id, method, effective_from, pct_bp, flat_paise, CASE WHEN row_number() OVER w > 1 THEN effective_from END AS from_date,
        lead(effective_from) OVER w AS to_date FROM rate WINDOW w AS (PARTITION BY merchant_id, method ORDER BY effective_from)""",
    "priced": f"""
        SELECT x.*, {pct("fee", 1800)} AS gst_on_fee, CASE WHEN method IN ('card', 'wallet') THEN amount_paise - fee - {pct("fee", 1800)} ELSE 0 END
            AS reserve_base FROM (
            SELECT p.merchant_id, p.payment_id, p.settlement_id, p.instant, p.method, p.amount_paise, t.effective_from,
                   {pct("p.amount_paise", "t.pct_bp")} + t.flat_paise + CASE WHEN p.instant THEN {pct("p.amount_paise", 25)} ELSE 0 END AS fee
            FROM truth p JOIN tier t ON t.merchant_id = p.merchant_id AND t.method = p.method
                AND (t.from_date IS NULL OR p.capture_date >= t.from_date) AND (t.to_date IS NULL OR p.capture_date < t.to_date)
        ) AS x""",
    "due2": "SELECT c.d AS d, t.d AS due FROM cal c JOIN cal t ON NOT t.holiday AND t.ord = c.ord + 2 + CASE WHEN c.holiday THEN 1 ELSE 0 END",
    "cap": "SELECT * FROM payment WHERE status = 'captured'",
    "ends": f"""
        SELECT {GROUP}, settlement_id, gross, r AS reverse, CASE WHEN r = 0 THEN sum(gross) OVER (PARTITION BY {GROUP}, r ORDER BY settlement_id)
            ELSE sum(gross) OVER (PARTITION BY {GROUP}, r ORDER BY settlement_id DESC) END AS hi
        FROM settlement, (VALUES (0), (1)) AS v(r)""",
    "h1i": None,
    "h1r": None,
    "h1": "SELECT * FROM h1i UNION ALL SELECT * FROM h1r",
    "proofs": "SELECT * FROM proof1 UNION ALL SELECT * FROM proof2",
    "members": """SELECT merchant_id, settlement_id, payment_id, settle_date, instant, hypothesis, 'H1_ordered_block' AS solver FROM h1 UNION ALL
        SELECT merchant_id, settlement_id, payment_id, settle_date, false, NULL, 'H2_subset_sum' FROM subset1 UNION ALL
        SELECT merchant_id, settlement_id, payment_id, settle_date, false, NULL, 'H2_subset_sum' FROM subset2""",
    "facts": """SELECT h.*, p.amount_paise, p.method, p.capture_date, p.capture_sec, t.effective_from FROM members h
        JOIN payment p USING (merchant_id, payment_id) JOIN tier t ON t.merchant_id = p.merchant_id AND t.method = p.method
        AND (t.from_date IS NULL OR p.capture_date >= t.from_date) AND (t.to_date IS NULL OR p.capture_date < t.to_date)""",
    "swap": """
        SELECT merchant_id, payment_id, settlement_id, settle_date, amount_paise, method FROM (
            SELECT facts.*, min(settlement_id) OVER w AS a, max(settlement_id) OVER w AS b
                FROM facts WINDOW w AS (PARTITION BY merchant_id, settle_date, amount_paise, method, effective_from)
        ) AS f WHERE a <> b""",
    "parsed": f"""
        SELECT b.*, list_filter(raw, lambda v, i: list_position(raw, v) = i) AS candidates, list_filter(toks, lambda v, i: list_position(toks, v) = i)
            AS tokens FROM (
            SELECT a.*, {_candidates()} AS raw, list_transform(regexp_extract_all(narration, '{N.ENTITY}', 1), lambda v: lower(v)) AS toks
            FROM (SELECT bank.*, trim(regexp_replace(upper(narration), '\\s+', ' ', 'g')) AS canon FROM bank) AS a
        ) AS b""",
    "refs": """SELECT merchant_id, bank_txn_id, amount_paise, value_date, narration, unnest(candidates) AS ref, generate_subscripts(candidates, 1) - 1
        AS pos FROM parsed""",
    "washable": """SELECT DISTINCT d.merchant_id, d.bank_txn_id AS taker, c.bank_txn_id AS item, 0 AS place FROM refs d
        JOIN refs c ON c.merchant_id = d.merchant_id AND c.ref = d.ref AND c.amount_paise = -d.amount_paise AND c.amount_paise > 0
        WHERE regexp_matches(upper(d.narration), 'RETURN|REVERSAL|REVERSED') AND abs(date_diff('day', c.value_date, d.value_date)) <= 5""",
    "washed": None,
    "credits": "SELECT * FROM parsed p WHERE amount_paise > 0 AND bank_txn_id NOT IN (SELECT credit FROM washed)",
    "cref": "SELECT r.merchant_id, r.bank_txn_id, r.ref, r.pos FROM refs r JOIN credits USING (merchant_id, bank_txn_id)",
    "known": "SELECT DISTINCT merchant_id, utr FROM settlement WHERE utr IS NOT NULL",
    "tries": """
        SELECT merchant_id, bank_txn_id, pos, utr, 1 AS n, 'exact' AS method, 1.0::DOUBLE AS confidence FROM cref JOIN known USING (merchant_id)
            WHERE ref = utr
        UNION ALL SELECT merchant_id, bank_txn_id, pos, utr, 1, 'despaced', 0.98::DOUBLE FROM cref JOIN known USING (merchant_id)
            WHERE ref <> utr AND regexp_replace(ref, '\\s', '', 'g') = utr
        UNION ALL SELECT merchant_id, bank_txn_id, pos, min(utr), count(DISTINCT utr), 'prefix', 0.94::DOUBLE FROM cref JOIN known USING (merchant_id)
            WHERE length(ref) >= 8 AND starts_with(utr, ref) GROUP BY ALL
        UNION ALL SELECT merchant_id, bank_txn_id, pos, min(utr), count(DISTINCT utr), CASE WHEN whole THEN 'confusion' ELSE 'confusion_prefix' END,
            CASE WHEN whole THEN 0.90::DOUBLE ELSE 0.86::DOUBLE END FROM (
            SELECT merchant_id, bank_txn_id, pos, utr, length(ref) = length(utr) AS whole,
                   len(list_filter(range(1, least(length(ref), length(utr)) + 1), lambda i: substr(ref, i, 1) <> substr(utr, i, 1))) AS differ
            FROM cref JOIN known USING (merchant_id)
            WHERE length(ref) >= 8 AND starts_with(translate(utr, 'OISBZ', '01582'), translate(ref, 'OISBZ', '01582'))
        ) AS f WHERE differ BETWEEN 1 AND 3 GROUP BY merchant_id, bank_txn_id, pos, whole""",
    "repair": """
        SELECT merchant_id, bank_txn_id, utr, method, confidence FROM (
            SELECT *, row_number() OVER (PARTITION BY merchant_id, bank_txn_id ORDER BY CASE WHEN confidence >= 0.98 THEN 0 ELSE 1 END, pos,
                -confidence) AS rn FROM tries WHERE n = 1 OR method = 'prefix'
        ) AS t WHERE rn = 1 AND n = 1""",
    "owner": "SELECT merchant_id, utr, max(settlement_id) AS settlement_id FROM settlement WHERE utr IS NOT NULL GROUP BY ALL",
    "claims": """SELECT c.merchant_id, c.bank_txn_id AS taker, o.settlement_id AS item, min(pos) AS place FROM cref c
        JOIN owner o ON o.merchant_id = c.merchant_id AND o.utr = c.ref GROUP BY ALL""",
    "exact": None,
    "repaired": """
        SELECT merchant_id, bank_txn_id, settlement_id, confidence, 'repaired_utr:' || method AS source FROM (
            SELECT r.*, o.settlement_id, count(*) OVER (PARTITION BY r.merchant_id, o.settlement_id) AS n FROM repair r
                JOIN owner o USING (merchant_id, utr)
            WHERE r.bank_txn_id NOT IN (SELECT bank_txn_id FROM exact) AND o.settlement_id NOT IN (SELECT settlement_id FROM exact)
        ) AS t WHERE n = 1""",
    "reflinks": "SELECT * FROM exact UNION ALL SELECT * FROM repaired",
    "cand": f"""
        SELECT c.merchant_id, c.bank_txn_id, s.settlement_id, c.amount_paise, s.net, c.value_date, s.settle_date, s.instant, s.utr, c.canon,
            c.candidates, r.confidence AS repair_confidence,
               cc.ord - sc.ord AS banking_days, coalesce(r.utr = s.utr, false) AS utr_hit
        FROM credits c JOIN cal cc ON cc.d = c.value_date LEFT JOIN repair r USING (merchant_id, bank_txn_id)
        JOIN settlement s ON s.merchant_id = c.merchant_id JOIN cal sc ON sc.d = s.settle_date
        WHERE abs(cc.ord - sc.ord) <= 3 AND (coalesce(r.utr = s.utr, false) OR abs(c.amount_paise - s.net) <= 5000000)
          AND c.bank_txn_id NOT IN (SELECT bank_txn_id FROM reflinks) AND s.settlement_id NOT IN (SELECT settlement_id FROM reflinks)""",
    "feat": f"""
        SELECT x.*, ln(1 + abs(amount_paise - net)) AS dl, CASE WHEN abs(amount_paise - net) <= {TOLERANCE} THEN 1.0 ELSE 0.0 END AS tol,
               CASE WHEN utr IS NOT NULL AND list_contains(candidates, utr) THEN 1.0 ELSE 0.0 END AS ex,
               CASE WHEN len(ga) = 0 OR len(gb) = 0 THEN 0.0 ELSE len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga,
                   gb)))::DOUBLE END AS tri,
               CASE WHEN utr IS NULL THEN 1.0 ELSE coalesce(list_max(list_transform(candidates, lambda c: {jaro_winkler('c', 'utr')})), 0.0) END AS jw
        FROM (
            SELECT cand.*, list_distinct(list_filter(list_transform(range(1, length(regexp_replace(canon, '[^A-Z0-9]', '', 'g')) - 1),
                lambda i: substr(regexp_replace(canon, '[^A-Z0-9]', '', 'g'), i, 3)), lambda g: length(g) = 3)) AS ga,
                   list_distinct(list_transform(range(1, greatest(length(coalesce(utr, '')) - 1, 1)), lambda i: substr(utr, i, 3))) AS gb
            FROM cand
        ) AS x""",
    "score": """
        SELECT *, greatest(least(1 / (1 + exp(-raw)), 1 - 1e-6), 1e-6) AS probability FROM (
            SELECT *, -3 + 8 * ex + 4.5 * coalesce(repair_confidence, 0) * CASE WHEN ex = 0 AND utr_hit THEN 1
                ELSE 0 END + 2.5 * tol - 0.35 * abs(banking_days) - 0.9 * least(dl, 20) + 1.2 * tri + jw AS raw FROM feat
        ) AS r""",
    "assigned": None,
    "links": "SELECT * FROM reflinks UNION ALL SELECT * FROM assigned",
    "adj": """
        SELECT merchant_id, 'refund' AS type, refund_id AS adjustment_id, amount_paise, 0 AS fee_paise, due AS due_date, created_sec AS sec
            FROM refund JOIN due2 ON d = created_date WHERE netted
        UNION ALL SELECT merchant_id, 'chargeback', dispute_id, amount_paise, fee_paise, due, raised_sec FROM chargeback JOIN due2 ON d = raised_date
        UNION ALL SELECT merchant_id, 'chargeback_reversal', dispute_id, amount_paise, 0, reversed_date, reversed_sec FROM chargeback
            WHERE reversed_date IS NOT NULL
        UNION ALL SELECT merchant_id, 'reserve_release', reserve_id, amount_paise, 0, release_date, released_sec FROM reserve WHERE netted""",
    "attached": """
        SELECT * EXCLUDE rn FROM (
            SELECT a.*, s.settle_date, row_number() OVER (PARTITION BY a.merchant_id, a.type, a.adjustment_id ORDER BY abs(date_diff('day',
                s.settle_date, a.due_date)), s.settle_date) AS rn
            FROM adj a JOIN (SELECT DISTINCT merchant_id, settle_date FROM settlement) AS s USING (merchant_id)
        ) AS t WHERE rn = 1""",
    "obs": """
        SELECT o.*, count(*) OVER d AS k, row_number() OVER w - 1 AS i, lag(obs_hi) OVER w AS prev_hi, lead(obs_lo) OVER w AS next_lo FROM (
            SELECT merchant_id, settle_date, settlement_id, min(capture_sec) AS obs_lo, max(capture_sec) AS obs_hi FROM facts WHERE NOT instant
                GROUP BY ALL
        ) AS o WINDOW d AS (PARTITION BY merchant_id, settle_date), w AS (PARTITION BY merchant_id, settle_date ORDER BY obs_lo, settlement_id)""",
    "win": """
        SELECT merchant_id, settle_date, settlement_id, obs_lo, obs_hi, CASE WHEN eq THEN i * (86400 // k) ELSE coalesce((prev_hi + obs_lo + 1) // 2,
            0) END AS lo,
               CASE WHEN eq THEN (i + 1) * (86400 // k) - 1 ELSE coalesce((obs_hi + next_lo) // 2, 86399) END AS hi, eq AS equal, k AS n_batches
        FROM (SELECT obs.*, bool_and(86400 % k = 0 AND obs_lo >= i * (86400 // k) AND obs_hi <= (i + 1) * (86400 // k) - 1)
            OVER (PARTITION BY merchant_id, settle_date) AS eq FROM obs) AS q""",
    "near": """
        SELECT a.*, w.settlement_id AS s, w.n_batches, a.sec BETWEEN w.obs_lo AND w.obs_hi AS seen, a.sec BETWEEN w.lo AND w.hi AS guess, CASE
            WHEN a.sec < w.obs_lo THEN w.obs_lo - a.sec ELSE a.sec - w.obs_hi END AS far
        FROM attached a LEFT JOIN win w USING (merchant_id, settle_date)""",
    "owned": """
        SELECT merchant_id, type, adjustment_id, amount_paise, fee_paise, due_date, settle_date, sec,
               CASE WHEN n = 1 THEN one WHEN n > 1 AND n_seen = 1 THEN one_seen END AS settlement_id,
               CASE WHEN n = 0 THEN 'no_batches_on_date' WHEN n = 1 THEN 'sole_batch_on_date' WHEN n_seen = 1
                   THEN 'observed_members_bracket_timestamp' WHEN n_seen > 1 THEN 'overlapping_observed_ranges' ELSE 'timestamp_in_inferred_gap' END
                   AS basis,
               coalesce(CASE WHEN n <= 1 THEN one WHEN n_seen > 0 THEN all_seen WHEN n_guess > 0 THEN all_guess ELSE nearest END, '') AS candidates
        FROM (
            SELECT merchant_id, type, adjustment_id, amount_paise, fee_paise, due_date, settle_date, sec, count(s) AS n, count(*) FILTER (seen)
                AS n_seen, count(*) FILTER (guess) AS n_guess, min(s) AS one, min(s) FILTER (seen) AS one_seen,
                   string_agg(s, ',' ORDER BY s) FILTER (seen) AS all_seen, string_agg(s, ',' ORDER BY s) FILTER (guess) AS all_guess, string_agg(s,
                       ',' ORDER BY s) FILTER (far = m) AS nearest
            FROM (SELECT near.*, min(far) OVER (PARTITION BY merchant_id, type, adjustment_id) AS m FROM near) AS x GROUP BY ALL
        ) AS g""",
    "apart": "SELECT DISTINCT merchant_id, unnest(tokens) AS adjustment_id FROM parsed WHERE amount_paise < 0",
    "ded": """
        SELECT o.merchant_id, o.settlement_id, coalesce(sum(o.amount_paise) FILTER (type = 'refund'), 0) AS refund_netted,
            coalesce(sum(o.amount_paise) FILTER (type = 'chargeback' AND p.adjustment_id IS NULL), 0) AS chargeback,
               coalesce(sum(o.fee_paise) FILTER (type = 'chargeback'), 0) AS dispute_fee, coalesce(sum(o.amount_paise)
                   FILTER (type = 'chargeback_reversal'), 0) AS reversal, coalesce(sum(o.amount_paise) FILTER (type = 'reserve_release'), 0)
                   AS reserve_released
        FROM owned o LEFT JOIN apart p USING (merchant_id, adjustment_id) WHERE o.settlement_id IS NOT NULL GROUP BY ALL""",
    "mfee": f"""
        SELECT merchant_id, settlement_id, sum(amount_paise) AS gross, sum(fee) AS fee, sum(g) AS gst, CASE WHEN instant THEN 0
            ELSE {pct("sum(CASE WHEN method IN ('card', 'wallet') THEN amount_paise - fee - g ELSE 0 END)", 500)} END AS held, count(*) AS n
        FROM (SELECT f.*, {pct("fee", 1800)} AS g FROM (SELECT f.*, {pct("amount_paise", "t.pct_bp")} + t.flat_paise + CASE WHEN instant
            THEN {pct("amount_paise", 25)} ELSE 0 END AS fee FROM facts f JOIN tier t USING (merchant_id, method, effective_from)) AS f) AS f
        GROUP BY merchant_id, settlement_id, instant""",
    "gaps": """SELECT merchant_id, bank_txn_id, count(*) > 1 AND max(probability) - max(probability) FILTER (rn = 2) < 0.08 AS near_tie
        FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id, bank_txn_id ORDER BY probability DESC) AS rn FROM score) AS s GROUP BY ALL""",
    "dec": f"""
        SELECT d.*, CASE WHEN bank_txn_id IS NULL THEN -predicted ELSE bank_paise - predicted END AS residue, bank_txn_id IS NULL AS unmatched,
               bank_txn_id IS NOT NULL AND membership_proven AND abs(bank_paise - predicted) <= {TOLERANCE} AS within_tolerance,
               tied OR (bank_txn_id IS NOT NULL AND (NOT membership_proven OR (near AND source <> 'exact_utr'))) AS ambiguous
        FROM (
            SELECT c.*,
                gross + platform_fee + gst_on_fee + tds_194o + refund_netted + chargeback_debit + dispute_fee + dispute_fee_gst + chargeback_reversal + reserve_held + reserve_released AS predicted FROM (
                SELECT s.merchant_id, s.settlement_id, l.bank_txn_id, s.settle_date, b.value_date, b.amount_paise AS bank_paise,
                    coalesce(l.confidence, 0.0) AS confidence, coalesce(l.source, '') AS source, coalesce(g.near_tie, false) AS near, m.n IS NOT NULL
                    AS membership_proven, coalesce(m.n, 0) AS n_members,
                       coalesce(m.gross, s.gross) AS gross, -coalesce(m.fee, s.fees) AS platform_fee, -coalesce(m.gst, s.gst) AS gst_on_fee, -s.tds
                           AS tds_194o, -coalesce(x.refund_netted, 0) AS refund_netted, -coalesce(x.chargeback, 0) AS chargeback_debit,
                       -coalesce(x.dispute_fee, 0) AS dispute_fee, -{pct("coalesce(x.dispute_fee, 0)", 1800)} AS dispute_fee_gst, coalesce(x.reversal,
                           0) AS chargeback_reversal, -coalesce(m.held, 0) AS reserve_held, coalesce(x.reserve_released, 0) AS reserve_released,
                       s.settlement_id IN (SELECT settlement_id FROM swap) AS tied
                FROM settlement s LEFT JOIN links l USING (merchant_id, settlement_id) LEFT
                    JOIN bank b ON b.merchant_id = s.merchant_id AND b.bank_txn_id = l.bank_txn_id LEFT
                    JOIN gaps g ON g.merchant_id = s.merchant_id AND g.bank_txn_id = l.bank_txn_id
                LEFT JOIN mfee m ON m.merchant_id = s.merchant_id AND m.settlement_id = s.settlement_id LEFT
                    JOIN ded x ON x.merchant_id = s.merchant_id AND x.settlement_id = s.settlement_id
            ) AS c
        ) AS d""",
    "exc": """
        SELECT e.*, row_number() OVER (PARTITION BY merchant_id ORDER BY ambiguous, abs(residue) DESC, settlement_id, adjustment) AS exception_seq
            FROM (
            SELECT merchant_id, settlement_id, bank_txn_id, residue, gross AS batch_value, confidence, ambiguous, unmatched, coalesce(value_date,
                settle_date) AS value_date, CASE WHEN NOT membership_proven THEN coalesce(outcome, 'NO_PAYMENTS') END AS unproven, NULL AS basis, ''
                AS adjustment
            FROM dec LEFT JOIN (SELECT merchant_id, settlement_id, outcome FROM proofs) AS o USING (merchant_id, settlement_id)
                WHERE NOT within_tolerance OR ambiguous
            UNION ALL SELECT merchant_id, CASE WHEN candidates <> '' THEN string_split(candidates, ',')[1] END, NULL, amount_paise + fee_paise, 0,
                0.0, true, false, settle_date, NULL, basis, type || ':' || adjustment_id FROM owned WHERE settlement_id IS NULL
        ) AS e""",
    "sig": f"""
        SELECT e.*, s.utr, s.net, s.gross AS reported_gross, s.fees, s.gst, s.settle_date AS run_date, b.amount_paise AS bank_paise, b.value_date
            AS bank_date, b.narration, b.candidates AS ctokens,
               coalesce(r.n, 0) AS n_refunds, coalesce(r.total, 0) AS refunds_total, coalesce(r.ex, false) AS r, coalesce(c.n, 0) AS n_chargebacks,
                   coalesce(c.total, 0) AS chargebacks_total, coalesce(c.ex, false) AS c,
               coalesce(v.n, 0) AS n_reserves, coalesce(v.ex, false) AS v, coalesce(m.n, 0) AS n_payments, coalesce(m.gross, 0) AS batch_gross,
                   coalesce(m.card, 0) AS card, m.first_card, m.first_bp AS published_bp,
               coalesce(n.n_in_window, 0) AS n_in_window, n.closest, e.residue < 0 AND -e.residue * 10000 > coalesce(m.card, 0) * 2
                   AND -e.residue * 10000 < coalesce(m.card, 0) * 150 AS variance,
               coalesce(s.utr IS NOT NULL AND list_contains(b.candidates, s.utr), false) AS utr_exact, b.amount_paise - s.net AS delta,
                   cb.ord - cs.ord AS bank_days
        FROM exc e LEFT JOIN settlement s USING (merchant_id, settlement_id) LEFT
            JOIN parsed b ON b.merchant_id = e.merchant_id AND b.bank_txn_id = e.bank_txn_id
        LEFT JOIN cal cs ON cs.d = s.settle_date LEFT JOIN cal cb ON cb.d = b.value_date LEFT
            JOIN closest n ON n.merchant_id = e.merchant_id AND n.settlement_id = e.settlement_id
        LEFT JOIN (SELECT x.merchant_id, x.exception_seq, count(*) AS n, sum(f.amount_paise) AS total,
            bool_or(abs(f.amount_paise - abs(x.residue)) <= {TOLERANCE}) AS ex FROM exc x
            JOIN members h ON h.merchant_id = x.merchant_id AND h.settlement_id = x.settlement_id
                   JOIN refund f ON f.merchant_id = h.merchant_id AND f.payment_id = h.payment_id WHERE f.netted AND x.adjustment = ''
                       GROUP BY ALL) AS r ON r.merchant_id = e.merchant_id AND r.exception_seq = e.exception_seq
        LEFT JOIN (SELECT x.merchant_id, x.exception_seq, count(*) AS n, sum(f.amount_paise + f.fee_paise) AS total,
            abs(sum(f.amount_paise + f.fee_paise) - abs(any_value(x.residue))) <= {TOLERANCE} AS ex FROM exc x
            JOIN members h ON h.merchant_id = x.merchant_id AND h.settlement_id = x.settlement_id
                   JOIN chargeback f ON f.merchant_id = h.merchant_id AND f.payment_id = h.payment_id WHERE x.adjustment = ''
                       GROUP BY x.merchant_id, x.exception_seq) AS c ON c.merchant_id = e.merchant_id AND c.exception_seq = e.exception_seq
        LEFT JOIN (SELECT x.merchant_id, x.exception_seq, count(*) AS n, bool_or(abs(f.amount_paise - abs(x.residue)) <= {TOLERANCE}) AS ex FROM exc x
            JOIN settlement t ON t.merchant_id = x.merchant_id AND t.settlement_id = x.settlement_id
                   JOIN reserve f ON f.merchant_id = t.merchant_id AND f.release_date = t.settle_date WHERE x.adjustment = ''
                       GROUP BY ALL) AS v ON v.merchant_id = e.merchant_id AND v.exception_seq = e.exception_seq
        LEFT JOIN mix m ON m.merchant_id = e.merchant_id AND m.settlement_id = e.settlement_id AND e.adjustment = ''""",
    "mix": """
        SELECT f.merchant_id, f.settlement_id, count(*) AS n, sum(f.amount_paise) AS gross, coalesce(sum(f.amount_paise) FILTER (f.method = 'card'),
            0) AS card, min(f.payment_id) FILTER (f.method = 'card') AS first_card,
               min_by(t.pct_bp, f.payment_id) FILTER (f.method = 'card') AS first_bp, count(*) FILTER (f.method = 'upi') AS n_upi, count(*)
                   FILTER (f.method = 'card') AS n_card,
               count(*) FILTER (f.method = 'netbanking') AS n_netbanking, count(*) FILTER (f.method = 'wallet') AS n_wallet
        FROM facts f JOIN tier t USING (merchant_id, method, effective_from) GROUP BY ALL""",
    "closest": """
        SELECT merchant_id, settlement_id, count(bank_txn_id) AS n_in_window, min(bank_txn_id) FILTER (rn = 1) AS closest FROM (
            SELECT s.merchant_id, s.settlement_id, b.bank_txn_id, row_number() OVER (PARTITION BY s.merchant_id, s.settlement_id
                ORDER BY abs(b.amount_paise - s.net), b.bank_txn_id) AS rn
            FROM settlement s JOIN cal sc ON sc.d = s.settle_date JOIN (SELECT b.*, c.ord AS o FROM bank b JOIN cal c ON c.d = b.value_date
                WHERE amount_paise > 0) AS b ON b.merchant_id = s.merchant_id AND abs(b.o - sc.ord) <= 3
        ) AS x GROUP BY ALL""",
    "lab0": f"""
        SELECT x.*, CASE label WHEN 'attribution_ambiguous' THEN 0.0 WHEN 'partition_unproven' THEN 0.0 WHEN 'ambiguous_candidates' THEN 0.99
            WHEN 'duplicate_credit' THEN 0.72 WHEN 'timing_offset' THEN 0.90
                    WHEN 'netted_refund' THEN 0.85 WHEN 'chargeback_debit' THEN 0.87 WHEN 'reserve_movement' THEN 0.88 WHEN 'fee_variance' THEN 0.96
                        ELSE 0.55 END::DOUBLE AS conf,
               CASE WHEN label IN ('timing_offset', 'netted_refund', 'reserve_movement', 'chargeback_debit') THEN 'journal_entry'
                   WHEN label = 'fee_variance' THEN CASE WHEN abs(residue) <= 10000 THEN 'journal_entry' ELSE 'chase_platform' END
                    WHEN label IN ('ambiguous_candidates', 'duplicate_credit', 'attribution_ambiguous', 'partition_unproven') THEN 'escalate' ELSE
                        CASE WHEN abs(residue) <= 10000 THEN 'write_off_within_limit' ELSE 'escalate' END END AS resolution
        FROM (
            SELECT sig.*, CASE WHEN basis IS NOT NULL THEN 'attribution_ambiguous' WHEN unproven IS NOT NULL THEN 'partition_unproven' WHEN ambiguous
                THEN 'ambiguous_candidates' WHEN unmatched THEN 'duplicate_credit' WHEN abs(residue) <= {TOLERANCE} THEN 'timing_offset'
                WHEN r THEN 'netted_refund' WHEN c THEN 'chargeback_debit' WHEN v THEN 'reserve_movement' WHEN variance THEN 'fee_variance'
                    ELSE 'unexplained' END AS label
            FROM sig
        ) AS x""",
    "digests": None,
    "lab": """
        SELECT x.*, substr(sha256(concat_ws('|', merchant_id, coalesce(settlement_id, ''), 'resolve_exception', label,
            CAST(CAST(residue AS BIGINT) AS VARCHAR), coalesce(digest, substr(sha256(''), 1, 16)))), 1, 32) AS idempotency_key
        FROM lab0 x LEFT JOIN digests USING (merchant_id, exception_seq)""",
    "gate": """
        SELECT lab.*, concat_ws('; ', CASE WHEN conf < 0.95 THEN 'confidence' END, CASE WHEN NOT (abs(residue) <= 10000 OR (batch_value > 0
            AND abs(residue) <= (batch_value * 10 + 5000) // 10000)) THEN 'residue' END,
                   CASE WHEN label NOT IN ('timing_offset', 'netted_refund', 'reserve_movement', 'fee_variance', 'rounding_drift') THEN 'type' END,
                       CASE WHEN ambiguous THEN 'ambiguous' END) AS failed_arms,
               concat_ws('; ', CASE WHEN conf < 0.95 THEN 'confidence ' || printf('%.4f', conf) || ' is under 0.95' END,
                   CASE WHEN NOT (abs(residue) <= 10000 OR (batch_value > 0 AND abs(residue) <= (batch_value * 10 + 5000) // 10000))
                        THEN 'residue ' || CAST(abs(residue) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(residue) % 100 AS VARCHAR), 2, '0')
                            || ' is over 100.00 and over a thousandth of ' || CASE WHEN batch_value < 0 THEN '-' ELSE '' END
                            || CAST(abs(batch_value) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(batch_value) % 100 AS VARCHAR), 2, '0') END,
                   CASE WHEN label NOT IN ('timing_offset', 'netted_refund', 'reserve_movement', 'fee_variance', 'rounding_drift') THEN label
                       || ' is never posted' END, CASE WHEN ambiguous THEN 'the assignment is ambiguous' END) AS failed_text
        FROM lab""",
    "verdicts": None,
    "chain": None,
}


def _first_come(pairs: str) -> str:
    """(merchant_id, taker, picked): each taker of a merchant, in id order, gets the first of its items that is still free."""
    return f"""
        SELECT merchant_id, taker, picked FROM (
            WITH RECURSIVE queue AS (
                SELECT merchant_id, taker, list(item ORDER BY place, item) AS items, row_number() OVER (PARTITION BY merchant_id ORDER BY taker) AS i
                    FROM {pairs} GROUP BY merchant_id, taker
            ), turn AS (
                SELECT DISTINCT merchant_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS taker, CAST(NULL
                    AS VARCHAR) AS picked FROM queue
                UNION ALL
                SELECT merchant_id, i, CASE WHEN free[1] IS NULL THEN used ELSE list_append(used, free[1]) END, taker, free[1]
                FROM (SELECT q.merchant_id, q.i, t.used, q.taker, list_filter(q.items, lambda x: NOT list_contains(t.used, x)) AS free FROM turn t
                    JOIN queue q ON q.merchant_id = t.merchant_id AND q.i = t.i + 1) AS n
            ) SELECT * FROM turn
        ) AS done WHERE picked IS NOT NULL"""


def _assigned() -> str:
    """Best one-to-one links of each component by trying all: every credit in turn takes a free candidate or none."""
    return """
        SELECT a.merchant_id, a.bank_txn_id, a.settlement_id, s.probability AS confidence, CASE WHEN s.utr_hit THEN 'repaired_utr'
            ELSE 'global_assignment' END AS source FROM (
            WITH RECURSIVE near AS (
                SELECT DISTINCT x.merchant_id, x.bank_txn_id AS a, y.bank_txn_id AS b FROM score x JOIN score y USING (merchant_id, settlement_id)
            ), reach AS (
                SELECT merchant_id, a, b FROM near UNION SELECT r.merchant_id, r.a, n.b FROM reach r
                    JOIN near n ON n.merchant_id = r.merchant_id AND n.a = r.b
            ), label AS (SELECT merchant_id, a AS bank_txn_id, min(b) AS label FROM reach GROUP BY ALL),
            turn AS (SELECT merchant_id, label, bank_txn_id, row_number() OVER (PARTITION BY merchant_id, label ORDER BY bank_txn_id) AS i
                FROM label),
            offer AS (
                SELECT t.merchant_id, t.label, t.i, s.settlement_id, CAST(round(-ln(greatest(s.probability, 1e-9)) * 1e6) AS BIGINT) AS cost
                    FROM turn t JOIN score s USING (merchant_id, bank_txn_id)
                UNION ALL SELECT merchant_id, label, i, NULL, 0 FROM turn
            ), tried AS (
                SELECT DISTINCT merchant_id, label, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS took, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT)
                    AS cost FROM turn
                UNION ALL
                SELECT o.merchant_id, o.label, o.i, list_append(t.took, o.settlement_id), t.n + CASE WHEN o.settlement_id IS NULL THEN 0 ELSE 1 END,
                    t.cost + o.cost
                FROM tried t JOIN offer o ON o.merchant_id = t.merchant_id AND o.label = t.label AND o.i = t.i + 1
                    AND (o.settlement_id IS NULL OR NOT list_contains(t.took, o.settlement_id))
            ), best AS (
                SELECT merchant_id, label, took FROM (
                    SELECT *, row_number() OVER (PARTITION BY merchant_id, label ORDER BY i DESC, n DESC, cost, list_transform(took,
                        lambda x: coalesce(x, '~'))) AS rn FROM tried
                ) AS r WHERE rn = 1
            ) SELECT t.merchant_id, t.bank_txn_id, b.took[t.i] AS settlement_id FROM turn t JOIN best b USING (merchant_id, label)
        ) AS a JOIN score s USING (merchant_id, bank_txn_id, settlement_id) WHERE s.probability >= 0.55"""


def _subsets(nth: int) -> dict[str, str]:
    """The proof of the ``nth`` batch of each regular group that no order explains, on what the earlier ones left.

    ``sums`` grows item by item: each reachable sum with its number of subsets,
    up to two; the one subset of a unique batch is found by going back.
    """
    key = "merchant_id, settle_date"
    gone = "".join(f" AND payment_id NOT IN (SELECT payment_id FROM subset{k})" for k in range(1, nth))
    return {
        f"items{nth}": f"""
            SELECT {key}, payment_id, amount_paise, row_number() OVER w AS i, count(*) OVER (PARTITION BY {key}) AS n, sum(amount_paise)
                OVER (PARTITION BY {key}) AS total FROM (
                SELECT c.merchant_id, due AS settle_date, payment_id, amount_paise FROM cap c JOIN due2 ON d = capture_date
                    WHERE payment_id NOT IN (SELECT payment_id FROM h1){gone}
            ) AS p WHERE ({key}) NOT IN (SELECT ({key}) FROM h1r) WINDOW w AS (PARTITION BY {key} ORDER BY payment_id)""",
        f"tries{nth}": f"""
            SELECT {key}, settlement_id, gross AS target, n, total FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY settlement_id)
                AS nth FROM settlement WHERE NOT instant) AS b
            JOIN (SELECT DISTINCT {key}, n, total FROM items{nth}) AS p USING ({key}) WHERE nth = {nth}""",
        f"sums{nth}": f"""
            WITH RECURSIVE grow AS (
                SELECT {key}, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s, CAST(1 AS BIGINT) AS ways, target, n, CAST(1 AS BIGINT) AS states,
                    CAST(0 AS BIGINT) AS hits FROM tries{nth} WHERE target > 0 AND n <= {ITEMS} AND total >= target
                UNION ALL
                SELECT {key}, i, s, ways, target, n, count(*) OVER (PARTITION BY {key}), coalesce(max(CASE WHEN s = target THEN ways END)
                    OVER (PARTITION BY {key}), 0) FROM (
                    SELECT merchant_id, settle_date, i, s, CAST(least(sum(ways), 2) AS BIGINT) AS ways, target, n FROM (
                        SELECT g.merchant_id, g.settle_date, g.i + 1 AS i, g.s + v.t * x.amount_paise AS s, g.ways, g.target, g.n FROM grow g
                            JOIN items{nth} x ON x.merchant_id = g.merchant_id AND x.settle_date = g.settle_date AND x.i = g.i + 1, (VALUES (0), (1))
                            AS v(t)
                        WHERE g.i < g.n AND g.states <= {STATES} AND g.hits < 2 AND g.s + v.t * x.amount_paise <= g.target
                    ) AS e GROUP BY merchant_id, settle_date, i, s, target, n
                ) AS f
            ) SELECT * FROM grow""",
        f"proof{nth}": f"""
            SELECT {key}, settlement_id, n AS pool_size, target, coalesce(states, 0) AS states,
                   CASE WHEN n > {ITEMS} THEN 'BOUND_ITEMS' WHEN states IS NULL THEN 'NO_EXACT_SUBSET' WHEN hits > 1
                       THEN 'AMBIGUOUS_MULTIPLE_PARTITIONS' WHEN states > {STATES} THEN 'BOUND_STATES' WHEN hits = 1 THEN 'UNIQUE'
                       ELSE 'NO_EXACT_SUBSET' END AS outcome
            FROM tries{nth} LEFT JOIN (SELECT {key}, max_by(states, i) AS states, max_by(hits, i) AS hits FROM sums{nth}
                GROUP BY ALL) AS l USING ({key})""",
        f"subset{nth}": f"""
            SELECT {key}, settlement_id, payment_id FROM (
                WITH RECURSIVE back AS (
                    SELECT p.merchant_id, p.settle_date, p.settlement_id, t.n AS i, p.target AS s, false AS took FROM proof{nth} p
                        JOIN tries{nth} t USING ({key}, settlement_id) WHERE outcome = 'UNIQUE'
                    UNION ALL
                    SELECT b.merchant_id, b.settle_date, b.settlement_id, g.i, g.s, g.s <> b.s FROM back b
                        JOIN items{nth} x ON x.merchant_id = b.merchant_id AND x.settle_date = b.settle_date AND x.i = b.i
                    JOIN sums{nth} g ON g.merchant_id = b.merchant_id AND g.settle_date = b.settle_date AND g.i = b.i - 1
                        AND (g.s = b.s OR g.s = b.s - x.amount_paise)
                ) SELECT * FROM back
            ) AS b JOIN items{nth} x USING ({key}) WHERE took AND x.i = b.i + 1""",
    }


def _verdicts() -> str:
    """Gated exceptions with their verdicts: in order, those that pass take from the budgets of their value date while they fit."""
    return """
        SELECT g.*, CASE WHEN b.posted THEN 'AUTO_POST' ELSE 'ESCALATE' END AS verdict, CASE WHEN failed_arms <> '' THEN failed_arms WHEN b.posted
            THEN 'all arms pass' ELSE 'daily budget' END AS policy_reason
        FROM gate g LEFT JOIN (
            WITH RECURSIVE able AS (
                SELECT merchant_id, value_date, exception_seq, CAST(abs(residue) AS BIGINT) AS size, row_number() OVER (PARTITION BY merchant_id,
                    value_date ORDER BY exception_seq) AS i FROM gate WHERE failed_arms = ''
            ), day AS (
                SELECT DISTINCT merchant_id, value_date, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS exception_seq, CAST(0 AS BIGINT) AS n, CAST(0
                    AS BIGINT) AS total, false AS posted FROM able
                UNION ALL
                SELECT a.merchant_id, a.value_date, a.i, a.exception_seq, CASE WHEN d.n < 60 AND d.total + a.size <= 5000000 THEN d.n + 1
                    ELSE d.n END, CASE WHEN d.n < 60 AND d.total + a.size <= 5000000 THEN d.total + a.size ELSE d.total END, d.n < 60
                    AND d.total + a.size <= 5000000
                FROM day d JOIN able a ON a.merchant_id = d.merchant_id AND a.value_date = d.value_date AND a.i = d.i + 1
            ) SELECT * FROM day WHERE i > 0
        ) AS b ON b.merchant_id = g.merchant_id AND b.exception_seq = g.exception_seq"""


def _chain() -> str:
    """The ledger of all verdicts: each hash over the one before and the canonical text of the row."""
    return """
        SELECT * FROM (
            WITH RECURSIVE one AS (
                SELECT *,
                    '{"label":"' || label || '","residue":"' || CAST(CAST(residue AS BIGINT) AS VARCHAR) || '"}' AS payload FROM (
                    SELECT *, row_number() OVER (PARTITION BY merchant_id, idempotency_key ORDER BY exception_seq) AS again FROM verdicts
                ) AS v WHERE again = 1
            ), line AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY exception_seq) AS seq FROM one),
            links AS (
                SELECT DISTINCT merchant_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS idempotency_key, CAST(NULL AS VARCHAR) AS prev_hash,
                    repeat('0', 64) AS hash FROM line
                UNION ALL SELECT l.merchant_id, l.seq, l.idempotency_key, c.hash, sha256(c.hash || '{"seq":' || CAST(l.seq AS VARCHAR) || ',"timestamp":"' || CAST(l.value_date AS VARCHAR)
                    || '","actor":"reconweave","action":"resolve_exception","entity_type":"settlement","entity_id":"' || coalesce(l.settlement_id, '')
                    || '","idempotency_key":"' || l.idempotency_key || '","model_version":"prior","score":' || printf('%.6f', l.conf)
                    || ',"verdict":"' || l.verdict || '","payload":' || l.payload || ',"prev_hash":"' || c.hash || '"}') FROM links c
                    JOIN line l ON l.merchant_id = c.merchant_id AND l.seq = c.seq + 1
            ) SELECT c.merchant_id, c.seq, c.idempotency_key, c.prev_hash, c.hash, l.verdict, l.payload, l.label, l.residue FROM links c
                JOIN line l USING (merchant_id, seq)
        ) AS c"""


def _blocks(instant: bool) -> str:
    flag = "true" if instant else "false"
    pool = f"""SELECT merchant_id, capture_date AS settle_date, {flag} AS instant, payment_id, amount_paise, capture_sec, created_at FROM cap""" if instant else f"SELECT c.merchant_id, due AS settle_date, {flag} AS instant, payment_id, amount_paise, capture_sec, created_at FROM cap c JOIN due2 ON d = capture_date WHERE payment_id NOT IN (SELECT payment_id FROM h1i)"
    closes = "have >= want" if instant else "have = want"
    key = "CASE k WHEN 0 THEN capture_sec WHEN 1 THEN epoch_us(created_at) ELSE 0 END"
    return f"""
        SELECT merchant_id, settlement_id, payment_id, settle_date, instant, hypothesis FROM (
            SELECT *, min(CASE WHEN hits = n_batches THEN hypothesis END) OVER (PARTITION BY {GROUP}) AS best FROM (
                SELECT *, count(DISTINCT CASE WHEN run = hi THEN settlement_id END) OVER (PARTITION BY {GROUP}, hypothesis) AS hits FROM (
                    SELECT {GROUP}, e.settlement_id, q.payment_id, q.run, e.hi, q.n_batches, q.k * 2 + e.reverse AS hypothesis FROM (
                        SELECT p.*, g.n_batches, k, sum(amount_paise) OVER (PARTITION BY {GROUP}, k ORDER BY {key},
                            payment_id ROWS UNBOUNDED PRECEDING) AS run FROM ({pool}) AS p
                        JOIN (SELECT {GROUP}, want, n_batches FROM (SELECT {GROUP}, sum(gross) AS want, count(*) AS n_batches FROM settlement
                            WHERE instant = {flag} GROUP BY ALL) AS s JOIN (SELECT {GROUP}, sum(amount_paise) AS have FROM ({pool}) AS p2
                            GROUP BY ALL) AS h USING ({GROUP}) WHERE {closes}) AS g USING ({GROUP}),
                        (VALUES (0), (1), (2)) AS ks(k)
                    ) AS q JOIN ends e USING ({GROUP}) WHERE q.run - q.amount_paise >= e.hi - e.gross AND q.run - q.amount_paise < e.hi
                ) AS a
            ) AS b
        ) AS c WHERE hypothesis = best"""


def stages() -> dict[str, str]:
    """All expressions over the entities, each after those that it reads."""
    made = {
        "h1i": _blocks(True),
        "h1r": _blocks(False),
        "washed": f"SELECT merchant_id, taker AS debit, picked AS credit FROM ({_first_come('washable')}) AS w",
        "exact": f"""SELECT merchant_id, taker AS bank_txn_id, picked AS settlement_id, 1.0::DOUBLE AS confidence, 'exact_utr' AS source
            FROM ({_first_come('claims')}) AS w""",
        "assigned": _assigned(),
        "digests": DIGEST,
        "verdicts": _verdicts(),
        "chain": _chain(),
    }
    out: dict[str, str] = {}
    for name, text in BODIES.items():
        if name == "proofs":
            out |= _subsets(1) | _subsets(2)
        out[name] = made[name] if text is None else text
    # the lookups read these two
    late = {n: out.pop(n) for n in ("mix", "closest")}
    at = list(out).index("sig")
    return dict([*list(out.items())[:at], *late.items(), *list(out.items())[at:]])


def sql(body: str, **instead: str) -> str:
    """``body`` after all expressions that it reads, directly or not; ``instead`` replaces some of them."""
    import re

    parts = ordered(entity_sql(Dialect(spark=False))) | stages() | instead
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in parts:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(parts[name])
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({t})" for n, t in parts.items() if n in need) + "\n" + body
