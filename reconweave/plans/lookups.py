"""The lookups around each exception and the evidence that they give, as SQL over ``lab0``, the labelled exceptions."""

from __future__ import annotations


def inr(x: str) -> str:
    """Rupees with Indian grouping of an amount in paise."""
    whole = f"CAST(abs({x}) // 100 AS VARCHAR)"
    grouped = f"CASE WHEN length({whole}) > 3 THEN ltrim(reverse(regexp_replace(reverse(left({whole}, length({whole}) - 3)), '(\\d\\d)', '\\1,', 'g')), ',') || ',' || right({whole}, 3) ELSE {whole} END"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || {grouped} || '.' || lpad(CAST(abs({x}) % 100 AS VARCHAR), 2, '0'))"


def jaro_winkler(a: str, b: str) -> str:
    """Similarity of two texts in SQL, from the places in ``b`` that the letters of ``a`` take in turn; letters out of order count half, no rounding."""
    reach = f"greatest(greatest(length({a}), length({b})) // 2 - 1, 0)"
    near = f"range(greatest(1, i[1] - {reach}), least(length({b}), i[1] + {reach}) + 1)"
    place = f"coalesce(list_filter({near}, lambda j: substr({b}, j, 1) = substr({a}, i[1], 1) AND NOT list_contains(s, j))[1], 0)"
    each = f"list_prepend([]::BIGINT[], list_transform(range(1, length({a}) + 1), lambda i: [i]))"
    taken = f"list_filter(list_reduce({each}, lambda s, i: list_append(s, {place})), lambda j: j > 0)"
    odd = f"len(list_filter(list_zip(w.t, list_sort(w.t)), lambda z: substr({b}, z[1], 1) <> substr({b}, z[2], 1))) / 2.0::DOUBLE"
    m = "len(w.t)::DOUBLE"
    jaro = f"CASE WHEN len(w.t) = 0 THEN 0.0::DOUBLE ELSE ({m} / length({a}) + {m} / length({b}) + ({m} - {odd}) / {m}) / 3 END"
    same = " + ".join(f"CASE WHEN length({a}) >= {n} AND left({a}, {n}) = left({b}, {n}) THEN 1 ELSE 0 END" for n in (1, 2, 3, 4))
    return f"list_transform([{{'t': {taken}}}], lambda w: CASE WHEN len(w.t) = 0 THEN 0.0::DOUBLE ELSE 1 - (1 - ({jaro})) * (1 - 0.1 * ({same})) END)[1]"


#: The residue in percent of the card volume, four decimals, half up in whole numbers.
_PARTS = "(CAST(abs(residue) AS BIGINT) * 2000000 + card) // (2 * card)"
IMPLIED = f"CAST({_PARTS} // 10000 AS VARCHAR) || '.' || lpad(CAST({_PARTS} % 10000 AS VARCHAR), 4, '0')"
#: The lookups of an exception in order, as SQL.
_TOOLS = "list_concat(plan, list_filter(['check_swap_invariance', 'check_duplicate_credit', 'get_refunds', 'get_chargebacks', 'get_reserve_movements', 'check_rate_card'], lambda x: NOT list_contains(plan, x)))"
PLAN = """
    SELECT *, {tools} AS steps FROM (
        SELECT *, CASE WHEN basis IS NOT NULL OR unproven IS NOT NULL THEN [] WHEN ambiguous THEN ['get_settlement', 'check_swap_invariance']
            WHEN unmatched THEN ['get_settlement', 'check_duplicate_credit', 'get_bank_candidates']
            WHEN abs(residue) <= 100 THEN ['get_settlement', 'compare_records'] WHEN residue < 0 AND variance THEN ['get_settlement',
                'compare_records', 'check_rate_card']
            WHEN residue < 0 AND r THEN ['get_settlement', 'compare_records', 'check_rate_card', 'get_refunds'] WHEN residue < 0 AND c
                THEN ['get_settlement', 'compare_records', 'check_rate_card', 'get_refunds', 'get_chargebacks']
            WHEN residue < 0 THEN ['get_settlement', 'compare_records', 'check_rate_card', 'get_refunds', 'get_chargebacks', 'get_reserve_movements']
            WHEN r THEN ['get_settlement', 'compare_records', 'get_refunds'] WHEN c THEN ['get_settlement', 'compare_records', 'get_refunds',
                'get_chargebacks']
            WHEN v THEN ['get_settlement', 'compare_records', 'get_refunds', 'get_chargebacks', 'get_reserve_movements']
            ELSE ['get_settlement', 'compare_records', 'get_refunds', 'get_chargebacks', 'get_reserve_movements', 'get_payments_in_batch'] END AS plan
                FROM lab0
    ) AS p""".format(tools=_TOOLS)


def _of(docs: str, key: str, on: str, claim: str, source: str, tool: str) -> str:
    """Statements about the documents of each exception's batch."""
    return f"""SELECT p.merchant_id, p.exception_seq, '{tool}' AS tool, {claim} AS claim, '{source}' AS source, f.{key} AS source_id, f.amount_paise
        AS paise FROM p {on} JOIN {docs} WHERE p.adjustment = ''"""


_MEMBERS = "JOIN members h ON h.merchant_id = p.merchant_id AND h.settlement_id = p.settlement_id"
_S = "SELECT merchant_id, exception_seq, "
_STATED = " UNION ALL ".join((
    f"{_S}'get_settlement' AS tool, 'reported net ' || {inr('net')} || ' on ' || CAST(run_date AS VARCHAR) AS claim, 'settlement' AS source, settlement_id AS source_id, net AS paise FROM p WHERE net IS NOT NULL",
    f"{_S}'get_settlement', 'reported gross ' || {inr('reported_gross')} || ', fees ' || {inr('fees')} || ', tax ' || {inr('gst')}, 'settlement', settlement_id, reported_gross FROM p WHERE net IS NOT NULL",
    f"""SELECT p.merchant_id, exception_seq, 'get_bank_candidates', 'nearest credit in the window is ' || {inr('b.amount_paise')} || ', off by '
        || {inr('b.amount_paise - net')}, 'bank_txn', closest, b.amount_paise FROM p
        JOIN bank b ON b.merchant_id = p.merchant_id AND b.bank_txn_id = closest""",
    f"{_S}'get_bank_candidates', CAST(n_in_window AS VARCHAR) || ' credits within 3 banking days', 'settlement', settlement_id, 0 FROM p WHERE net IS NOT NULL",
    f"{_S}'get_payments_in_batch', CAST(n_payments AS VARCHAR) || ' payments make up the batch, gross ' || {inr('batch_gross')}, 'settlement', settlement_id, batch_gross FROM p WHERE n_payments > 0",
    f"{_S}'get_payments_in_batch', 'card volume ' || {inr('card')}, 'payment', first_card, card FROM p WHERE first_card IS NOT NULL",
    _of("refund f ON f.merchant_id = h.merchant_id AND f.payment_id = h.payment_id AND f.netted", "refund_id", _MEMBERS,
        f"'netted refund of ' || {inr('f.amount_paise')}", "refund", "get_refunds"),
    _of("chargeback f ON f.merchant_id = h.merchant_id AND f.payment_id = h.payment_id", "dispute_id", _MEMBERS,
        f"'dispute of ' || {inr('f.amount_paise')} || ' with fee ' || {inr('f.fee_paise')}", "chargeback", "get_chargebacks"),
    _of("reserve f ON f.merchant_id = p.merchant_id AND f.release_date = p.run_date", "reserve_id", "",
        f"'reserve of ' || {inr('f.amount_paise')} || ' released on the date'", "reserve", "get_reserve_movements"),
    f"{_S}'inspect_narration', 'narration: ' || narration, 'bank_txn', bank_txn_id, 0 FROM p WHERE bank_paise IS NOT NULL",
    f"{_S}'inspect_narration', 'reference ' || ctokens[1] || CASE WHEN utr_exact THEN ' equals the reference of the settlement' ELSE ' differs from the reference of the settlement' END, 'bank_txn', bank_txn_id, 0 FROM p WHERE len(ctokens) > 0",
    f"""SELECT p.merchant_id, exception_seq, 'check_rate_card', 'published card rate ' || printf('%.2f', published_bp / 100.0) || '% from '
        || CAST(t.effective_from AS VARCHAR), 'rate_card', p.merchant_id, 0 FROM p
        JOIN facts t ON t.merchant_id = p.merchant_id AND t.payment_id = first_card WHERE card > 0""",
    f"{_S}'check_rate_card', 'residue is ' || {IMPLIED} || '% of the card volume', 'settlement', settlement_id, residue FROM p WHERE card > 0",
    f"{_S}'check_swap_invariance', 'payments here could change places with others of the date without any total changing', 'settlement', settlement_id, 0 FROM p WHERE ambiguous",
    f"{_S}'check_duplicate_credit', 'no credit is linked: a payout that came back, or a retry that is not matched', 'settlement', settlement_id, 0 FROM p WHERE unmatched",
    f"{_S}'compare_records', 'credit ' || {inr('bank_paise')} || ' against net ' || {inr('net')} || ': off by ' || {inr('delta')} || ', ' || CAST(bank_days AS VARCHAR) || ' banking days', 'bank_txn', bank_txn_id, delta FROM p WHERE net IS NOT NULL AND bank_paise IS NOT NULL",
))
#: Statements of the lookups that were made, of equal claims one, and those about refusals.
EVIDENCE = f"""
    SELECT merchant_id, exception_seq, claim, source, min(source_id) AS source_id, min(CAST(paise AS BIGINT)) AS paise FROM (
        SELECT s.* EXCLUDE tool FROM ({_STATED}) AS s JOIN p USING (merchant_id, exception_seq) WHERE list_contains(p.steps, s.tool)
        UNION ALL {_S}'the payments of the batch are not proved: ' || unproven, 'settlement', settlement_id, batch_value FROM p
            WHERE unproven IS NOT NULL
        UNION ALL {_S}'the gross is the reported one, not summed from payments', 'settlement', settlement_id, 0 FROM p WHERE unproven IS NOT NULL
        UNION ALL {_S}'adjustment ' || adjustment || ' belongs to no proved batch: ' || basis, 'adjustment', adjustment, residue FROM p
            WHERE basis IS NOT NULL
    ) AS e GROUP BY ALL"""

#: (merchant_id, exception_seq, digest): the kind and id of the row behind each statement, in that order, hashed.
DIGEST = f"""
    SELECT merchant_id, exception_seq, substr(sha256(string_agg(source || ':' || coalesce(source_id, '') || ';', '' ORDER BY source, coalesce(source_id, ''))), 1, 16) AS digest
    FROM (WITH p AS MATERIALIZED ({PLAN}) {EVIDENCE}) AS e GROUP BY merchant_id, exception_seq"""
