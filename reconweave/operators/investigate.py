"""Lookups around each exception, its classification, evidence and rationale, the policy and its budgets.

The lookups are joins keyed by (merchant, exception_seq) that end in one wide
row per exception; plan, evidence and rationale are columns of that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconweave.functions.calendar import with_ordinal
from reconweave.functions.money import fmt, fmt_inr
from reconweave.functions.narration import best_similarity
from reconweave.operators.fees import with_facts, with_tier
from reconweave.operators.matching import WINDOW_DAYS

# Fixed confidence of each label.
LABELS = {
    "attribution_ambiguous": 0.0, "partition_unproven": 0.0, "ambiguous_candidates": 0.99, "duplicate_credit": 0.72, "timing_offset": 0.90,
    "netted_refund": 0.85, "chargeback_debit": 0.87, "reserve_movement": 0.88, "fee_variance": 0.96, "unexplained": 0.55,
}
# Policy limits.
LEAST_CONFIDENCE, MOST_RESIDUE, MOST_SHARE_BP, DAILY_PAISE, DAILY_COUNT = 0.95, 10_000, 10, 5_000_000, 60
ALLOWED = ("timing_offset", "netted_refund", "reserve_movement", "fee_variance", "rounding_drift")
# Lookups without which no label is given, in order, and the most lookups that are planned.
DECISIVE = ("check_swap_invariance", "check_duplicate_credit", "get_refunds", "get_chargebacks", "get_reserve_movements", "check_rate_card")
MAX_STEPS = 6
EVIDENCE = "array<struct<claim:string,source:string,source_id:string,paise:bigint>>"


def closest_credits(settlement: DataFrame, bank: DataFrame, cal: DataFrame) -> DataFrame:
    """The credit nearest in amount within three banking days of each settlement, the first id of equal ones, and how many there are.

    Per (merchant, banking day), credits and the settlements around that day
    lie in one order of amounts, where the nearest credit stands next to a
    settlement; counts come from counts by day. No pairs are made.
    """
    credits = with_ordinal(bank.where("amount_paise > 0"), cal, "value_date", "o")
    days = credits.groupBy("merchant_id", "o").agg(F.count("*").alias("n"))
    prices = credits.groupBy("merchant_id", "o", F.col("amount_paise").alias("at")).agg(F.min("bank_txn_id").alias("bank_txn_id"))
    around = with_ordinal(settlement, cal, "settle_date", "so").withColumn("o",
        F.explode(F.sequence(F.col("so") - WINDOW_DAYS, F.col("so") + WINDOW_DAYS)))
    around = around.select("merchant_id", "o", F.col("net").alias("at"), "settlement_id")
    keys = ["merchant_id", "settlement_id"]
    counts = around.join(days, ["merchant_id", "o"]).groupBy(*keys).agg(F.sum("n").alias("n_in_window"))
    line = prices.unionByName(around, allowMissingColumns=True)
    w = Window.partitionBy("merchant_id", "o").orderBy("at", F.col("bank_txn_id").isNull())
    credit = F.when(F.col("bank_txn_id").isNotNull(), F.struct("at", "bank_txn_id"))
    line = line.withColumns({
        "under": F.last(credit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "over": F.first(credit, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    gap = lambda c: F.when(c.isNotNull(), F.struct(F.abs(c["at"] - F.col("at")).alias("gap"), c["bank_txn_id"].alias("id"),
        c["at"].alias("paise")))
    best = F.array_min(F.array_compact(F.array(gap(F.col("under")), gap(F.col("over")))))
    near = line.where("settlement_id is not null").groupBy(*keys).agg(F.min(best).alias("b"))
    out = settlement.select(*keys).join(near, keys, "left").join(counts, keys, "left")
    return out.select(*keys, F.coalesce("n_in_window", F.lit(0)).alias("n_in_window"), F.col("b.id").alias("closest"),
        F.col("b.paise").alias("closest_paise")).where("n_in_window > 0")


def batch_mix(members: DataFrame, payment: DataFrame, rate: DataFrame) -> DataFrame:
    """Of each batch: payments, gross, card volume, counts by method, and the published tier of its first card payment."""
    keys = ["merchant_id", "settlement_id"]
    facts = ("amount_paise", "method", "capture_date")
    rows = with_tier(with_facts(members, payment, *facts).select(*keys, "payment_id", *facts), rate)
    card = F.col("method") == "card"
    n = lambda m: F.count(F.when(F.col("method") == m, 1)).alias(f"n_{m}")
    first = F.min(F.when(card, F.struct("payment_id", "pct_bp", "effective_from")))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_payments"), F.sum("amount_paise").alias("batch_gross"),
            F.coalesce(F.sum(F.when(card, F.col("amount_paise"))), F.lit(0)).alias("card_paise"),
        n("card"), n("upi"), n("netbanking"), n("wallet"), first.alias("f"),
    )
    return out.select("*", F.col("f.payment_id").alias("first_card"), F.col("f.pct_bp").alias("published_bp"),
        F.col("f.effective_from").alias("published_from")).drop("f")


def in_batches(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with a payment_id, with the batch that holds the payment (refunds, disputes)."""
    return members.select("merchant_id", "settlement_id", "payment_id").join(rows, ["merchant_id", "payment_id"])


def on_run_date(settlement: DataFrame, reserve: DataFrame) -> DataFrame:
    """Reserve entries, netted or not, whose release date is the date of a settlement."""
    return settlement.select("merchant_id", "settlement_id", F.col("settle_date").alias("release_date")).join(reserve,
        ["merchant_id", "release_date"])


def _documents(gaps: DataFrame, rows: DataFrame, id_col: str, size: Column, explains: Column, name: str) -> DataFrame:
    """Count, total, list and explains flag of the rows of each exception's batch."""
    keys = ["merchant_id", "exception_seq"]
    j = gaps.join(rows.withColumns({"doc": F.col(id_col), "size": size}), ["merchant_id", "settlement_id"])
    listed = F.array_sort(F.collect_list(F.struct(F.col("doc").alias("id"), F.col("amount_paise").alias("paise"),
        (F.col("size") - F.col("amount_paise")).alias("fee"))))
    return j.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.sum("size").alias(f"{name}_total"), explains.alias(f"{name}_explain"),
        listed.alias(f"{name}_list"))


def signals(exc: DataFrame, members: DataFrame, t: dict[str, DataFrame], parsed: DataFrame) -> DataFrame:
    """Each exception with what the eleven lookups found; exceptions of a refused adjustment have no batch to look into."""
    keys = ["merchant_id", "exception_seq"]
    of_batch = exc.where("adjustment = ''").select(*keys, "settlement_id", F.abs("residue").alias("gap"), "tolerance_paise")
    close = lambda x: F.abs(x - F.col("gap")) <= F.col("tolerance_paise")
    refunds = _documents(of_batch, in_batches(members, t["refund"].where("netted")), "refund_id", F.col("amount_paise"),
        F.bool_or(close(F.col("amount_paise"))), "refunds")
    disputes = in_batches(members, t["chargeback"])
    disputes = _documents(of_batch, disputes, "dispute_id", F.col("amount_paise") + F.col("fee_paise"),
        F.abs(F.sum("size") - F.first("gap")) <= F.first("tolerance_paise"), "chargebacks")
    held = _documents(of_batch, on_run_date(t["settlement"], t["reserve"]), "reserve_id", F.col("amount_paise"),
        F.bool_or(close(F.col("amount_paise"))), "reserves")
    mix = of_batch.select(*keys, "settlement_id").join(batch_mix(members, t["payment"], t["rate"]),
        ["merchant_id", "settlement_id"]).drop("settlement_id")
    facts = t["settlement"].select("merchant_id", "settlement_id", "utr", "net", F.col("gross").alias("reported_gross"), "fees", "gst",
        "settle_date", "instant")
    bank = parsed.select("merchant_id", "bank_txn_id", F.col("amount_paise").alias("bank_paise"), F.col("value_date").alias("bank_date"),
        "narration", F.col("candidates").alias("tokens"))
    out = exc.join(facts, ["merchant_id", "settlement_id"], "left").join(bank, ["merchant_id", "bank_txn_id"], "left")
    out = out.join(closest_credits(t["settlement"], t["bank"], t["cal"]), ["merchant_id", "settlement_id"], "left")
    out = with_ordinal(with_ordinal(out, t["cal"], "settle_date", "_s"), t["cal"], "bank_date", "_b").withColumn("bank_days",
        F.col("_b") - F.col("_s")).drop("_s", "_b")
    for part in (refunds, disputes, held, mix):
        out = out.join(part, keys, "left")
    for flag in ("refunds_explain", "chargebacks_explain", "reserves_explain"):
        out = out.withColumn(flag, F.coalesce(flag, F.lit(False)))
    for n in ("n_refunds", "refunds_total", "n_chargebacks", "chargebacks_total", "n_reserves", "n_payments", "batch_gross", "card_paise",
        "n_in_window"):
        out = out.withColumn(n, F.coalesce(n, F.lit(0)))
    gap, volume = F.abs("residue"), F.col("card_paise")
    # implied rate above the published one, in percent of the card volume; between 0.02 and 1.50 in integers
    consistent = (F.col("residue") < 0) & (gap * 10_000 > volume * 2) & (gap * 10_000 < volume * 150)
    has = F.coalesce(F.col("utr") != "", F.lit(False))
    return out.withColumns({
        "implied_pct": F.when(volume > 0, gap * 100.0 / volume).otherwise(0.0), "fee_variance": consistent,
        "utr_exact": has & F.coalesce(F.array_contains("tokens", F.col("utr")), F.lit(False)),
            "similarity": best_similarity(F.coalesce("tokens", F.array().cast("array<string>")), F.col("utr")),
        "delta": F.col("bank_paise") - F.col("net"),
    })


def planned() -> Column:
    """The lookups in the order that they are made: as many as the plan needs, six at most, then the decisive ones not yet made."""
    names = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    inside = F.abs("residue") <= F.col("tolerance_paise")
    rest = names("inspect_narration")
    rest = F.when(F.col("residue") < 0, F.concat(names("get_payments_in_batch"),
        rest)).otherwise(F.concat(names("get_payments_in_batch", "check_rate_card"), rest))
    for tool, flag in (("get_reserve_movements", "reserves_explain"), ("get_chargebacks", "chargebacks_explain"), ("get_refunds", "refunds_explain")):
        rest = F.concat(names(tool), F.when(F.col(flag), names()).otherwise(rest))
    rest = F.when(F.col("residue") < 0, F.concat(names("check_rate_card"), F.when(F.col("fee_variance"), names()).otherwise(rest))).otherwise(rest)
    steps = (
        F.when(F.col("attribution_refusal").isNotNull() | F.col("partition_refusal").isNotNull(), names())
        .when(F.col("ambiguous"), names("get_settlement", "check_swap_invariance"))
        .when(F.col("unmatched"), names("get_settlement", "check_duplicate_credit", "get_bank_candidates"))
        .when(inside, names("get_settlement", "compare_records"))
        .otherwise(F.concat(names("get_settlement", "compare_records"), rest))
    )
    first = F.slice(steps, 1, MAX_STEPS)
    return F.concat(first, F.array_except(names(*DECISIVE), first))


def _fact(claim: Column | str, source: str, source_id: str | Column, paise: str | Column = "zero") -> Column:
    claim = F.lit(claim) if isinstance(claim, str) else claim
    size = F.lit(0).cast("long") if isinstance(paise, str) and paise == "zero" else (F.col(paise) if isinstance(paise, str) else paise).cast("long")
    return F.struct(claim.alias("claim"), F.lit(source).alias("source"), (F.col(source_id) if isinstance(source_id,
        str) else source_id).alias("source_id"), size.alias("paise"))


def _when(condition: Column, *facts: Column) -> Column:
    return F.when(condition, F.array(*facts).cast(EVIDENCE)).otherwise(F.array().cast(EVIDENCE))


def implied_text() -> Column:
    """The residue in percent of the card volume, four decimals, half up in whole numbers; a product of paise and 2,000,000 can be beyond a long."""
    rest = F.expr("(CAST(abs(residue) % card_paise AS DECIMAL(20, 0)) * 2000000 + card_paise) div (CAST(card_paise AS DECIMAL(20, 0)) * 2)")
    whole = F.expr("CAST(abs(residue) div card_paise AS DECIMAL(20, 0)) * 100") + F.floor(rest / 10_000)
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((rest % 10_000).cast("string"), 4, "0"))


def lookup_facts() -> dict[str, Column]:
    """What each lookup states, with the row that each statement is read from."""
    inr, x = fmt_inr, F.col
    each = lambda name, text: F.coalesce(F.transform(x(f"{name}_list"), text).cast(EVIDENCE), F.array().cast(EVIDENCE))
    found, credited = x("net").isNotNull(), x("bank_paise").isNotNull()
    token = F.when(x("utr_exact"), " equals the reference of the settlement").otherwise(" differs from the reference of the settlement")
    return {
        "get_settlement": _when(
            found,
            _fact(F.concat(F.lit("reported net "), inr(x("net")), F.lit(" on "), x("settle_date").cast("string")), "settlement", "settlement_id",
                "net"),
            _fact(F.concat(F.lit("reported gross "), inr(x("reported_gross")), F.lit(", fees "), inr(x("fees")), F.lit(", tax "), inr(x("gst"))),
                "settlement", "settlement_id", "reported_gross"),
        ),
        "get_bank_candidates": F.concat(
            _when(x("closest").isNotNull(), _fact(F.concat(F.lit("nearest credit in the window is "), inr(x("closest_paise")),
                F.lit(", off by "), inr(x("closest_paise") - x("net"))), "bank_txn", "closest", "closest_paise")),
            _when(found, _fact(F.concat(x("n_in_window").cast("string"), F.lit(f" credits within {WINDOW_DAYS} banking days")), "settlement",
                "settlement_id")),
        ),
        "get_payments_in_batch": F.concat(
            _when(x("n_payments") > 0, _fact(F.concat(x("n_payments").cast("string"), F.lit(" payments make up the batch, gross "),
                inr(x("batch_gross"))), "settlement", "settlement_id", "batch_gross")),
            _when(x("first_card").isNotNull(), _fact(F.concat(F.lit("card volume "), inr(x("card_paise"))), "payment", "first_card", "card_paise")),
        ),
        "get_refunds": each("refunds", lambda r: F.struct(F.concat(F.lit("netted refund of "), inr(r["paise"])), F.lit("refund"), r["id"],
            r["paise"])),
        "get_chargebacks": each("chargebacks", lambda r: F.struct(F.concat(F.lit("dispute of "), inr(r["paise"]), F.lit(" with fee "),
            inr(r["fee"])), F.lit("chargeback"), r["id"], r["paise"])),
        "get_reserve_movements": each("reserves", lambda r: F.struct(F.concat(F.lit("reserve of "), inr(r["paise"]),
            F.lit(" released on the date")), F.lit("reserve"), r["id"], r["paise"])),
        "inspect_narration": F.concat(
            _when(credited, _fact(F.concat(F.lit("narration: "), x("narration")), "bank_txn", "bank_txn_id")),
            _when(credited & (F.size("tokens") > 0), _fact(F.concat(F.lit("reference "), F.get("tokens", 0), token), "bank_txn", "bank_txn_id")),
        ),
        "check_rate_card": _when(
            x("card_paise") > 0,
            _fact(F.concat(F.lit("published card rate "), F.format_string("%.2f", x("published_bp") / 100.0), F.lit("% from "),
                x("published_from").cast("string")), "rate_card", "merchant_id"),
            _fact(F.concat(F.lit("residue is "), implied_text(), F.lit("% of the card volume")), "settlement",
                "settlement_id", "residue"),
        ),
        "check_swap_invariance": _when(x("ambiguous"),
            _fact("payments here could change places with others of the date without any total changing", "settlement", "settlement_id")),
        "check_duplicate_credit": _when(x("unmatched"), _fact("no credit is linked: a payout that came back, or a retry that is not matched",
            "settlement", "settlement_id")),
        "compare_records": _when(
            found & credited,
            _fact(F.concat(F.lit("credit "), inr(x("bank_paise")), F.lit(" against net "), inr(x("net")), F.lit(": off by "), inr(x("delta")),
                F.lit(", "), x("bank_days").cast("string"), F.lit(" banking days")), "bank_txn", "bank_txn_id", "delta"),
        ),
    }


def evidence() -> Column:
    """What was found, in the order of the lookups, each statement once."""
    facts = lookup_facts()
    unproven = _when(
        F.col("partition_refusal").isNotNull(),
        _fact(F.concat(F.lit("the payments of the batch are not proved: "), F.col("partition_refusal")), "settlement", "settlement_id",
            "batch_value"),
        _fact("the gross is the reported one, not summed from payments", "settlement", "settlement_id"),
    )
    stray = _when(
        F.col("attribution_refusal").isNotNull(), _fact(F.concat(F.lit("adjustment "), F.col("adjustment"),
            F.lit(" belongs to no proved batch: "), F.col("attribution_refusal")), "adjustment", "adjustment", "residue")
    )
    table = F.map_from_arrays(F.array(*map(F.lit, facts)), F.array(*facts.values()))
    steps = _bound(table, lambda found: F.flatten(F.transform("steps", lambda s: F.element_at(found, s))))
    return F.concat(unproven, stray, steps)


def _bound(value: Column, use) -> Column:
    """``use`` of the value, which is computed once a row however often and inside whatever lambda it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(ev: Column) -> Column:
    """The statements, of equal claims the first: equal ones lie side by side in the order of claim and place, so that work grows with n log n."""
    def firsts(placed: Column) -> Column:
        return F.filter(placed, lambda p, i: p["claim"].isNotNull() & ~F.get(placed, i - 1)["claim"].eqNullSafe(p["claim"]))

    def picked(all_: Column) -> Column:
        placed = F.sort_array(F.transform(all_, lambda e, i: F.struct(e["claim"].alias("claim"), i.alias("i"))))
        places = F.sort_array(F.transform(_bound(placed, firsts), lambda p: p["i"]))
        return F.transform(places, lambda i: F.get(all_, i))

    return _bound(ev, picked)


def rationale() -> Column:
    """Why the exception has its label, in words, with the figures that decided."""
    head = F.concat(F.lit("Residue "), fmt_inr(F.col("residue")), F.lit(" on "), fmt_inr(F.col("batch_value")), F.lit(": "), F.col("label"),
        F.lit(". "))
    rate = F.concat(F.lit("The gap is "), implied_text(), F.lit("% of the card volume above the published "),
        F.format_string("%.2f", F.col("published_bp") / 100.0), F.lit("%."))
    why = (
        F.when(F.col("label") == "fee_variance", rate)
        .when(F.col("label") == "ambiguous_candidates", "Equal payments could be exchanged between batches, so nothing is posted.")
        .when(F.col("label") == "attribution_ambiguous", F.concat(F.col("adjustment"), F.lit(" fits no batch by its time ("),
            F.col("attribution_refusal"), F.lit("), so no payout nets it.")))
        .when(F.col("label") == "duplicate_credit", F.concat(F.lit("No credit is linked; "), F.col("n_in_window").cast("string"),
            F.lit(" lie in the window.")))
        .when(F.col("label") == "partition_unproven", F.concat(F.lit("Members are not proved ("), F.col("partition_refusal"),
            F.lit("), so the residue shows nothing.")))
        .when(F.col("label") == "unexplained", F.concat(F.size("steps").cast("string"), F.lit(" lookups explain none of it.")))
        .otherwise("The rows found account for it.")
    )
    return F.concat(head, why, F.lit(" Evidence: "), F.size("evidence").cast("string"), F.lit("."))


def explained(classified: DataFrame) -> DataFrame:
    """``steps``, ``evidence`` and ``rationale`` of each classified exception."""
    out = classified.withColumn("steps", planned())
    return out.withColumn("evidence", evidence()).withColumn("evidence", once(F.col("evidence"))).withColumn("rationale", rationale())


def label() -> Column:
    """The first label whose condition holds."""
    x = F.col
    return (
        F.when(x("attribution_refusal").isNotNull(), "attribution_ambiguous").when(x("partition_refusal").isNotNull(),
            "partition_unproven").when(x("ambiguous"), "ambiguous_candidates")
        .when(x("unmatched"), "duplicate_credit").when(F.abs("residue") <= F.col("tolerance_paise"), "timing_offset").when(x("refunds_explain"), "netted_refund")
        .when(x("chargebacks_explain"), "chargeback_debit").when(x("reserves_explain"), "reserve_movement").when(x("fee_variance"),
            "fee_variance").otherwise("unexplained")
    )


def classify(sig: DataFrame) -> DataFrame:
    """``label``, its confidence and the proposed resolution."""
    conf = F.lit(0.0)
    for name, value in LABELS.items():
        conf = F.when(F.col("label") == name, F.lit(value)).otherwise(conf)
    little = F.abs("residue") <= MOST_RESIDUE
    how = (
        F.when(F.col("label").isin("timing_offset", "netted_refund", "reserve_movement", "chargeback_debit"), "journal_entry")
        .when(F.col("label") == "fee_variance", F.when(little, "journal_entry").otherwise("chase_platform"))
        .when(F.col("label").isin("ambiguous_candidates", "duplicate_credit", "attribution_ambiguous", "partition_unproven"), "escalate")
        .otherwise(F.when(little, "write_off_within_limit").otherwise("escalate"))
    )
    return sig.withColumn("label", label()).withColumn("label_confidence", conf).withColumn("resolution", how)


def evidence_digest(ev: Column) -> Column:
    """16 signs of the hash of the kind and id of the rows that the statements are read from, in the order of kind and id."""
    rows = F.transform(ev, lambda e: F.struct(e["source"].alias("source"), F.coalesce(e["source_id"], F.lit("")).alias("id")))
    text = F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat(r["source"], F.lit(":"), r["id"], F.lit(";"))), "")
    return F.substring(F.sha2(text, 256), 1, 16)


def idempotency(classified: DataFrame) -> DataFrame:
    """``idempotency_key``: hash of merchant, settlement, action, label, residue and the digest of the evidence, so that changed evidence is decided anew."""
    found = explained(classified).withColumn("digest", evidence_digest(F.col("evidence"))).drop("steps", "evidence", "rationale")
    text = F.concat_ws("|", "merchant_id", F.coalesce("settlement_id", F.lit("")), F.lit("resolve_exception"), "label", F.col("residue").cast("string"), "digest")
    return found.withColumn("idempotency_key", F.substring(F.sha2(text, 256), 1, 32)).drop("digest")


def gates(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``failed_arms``: the policy tests an exception fails, and ``failed_text`` with their figures; ``suppressed`` where its key was decided before, with the ``prior_verdict``."""
    share = F.floor((F.col("batch_value") * MOST_SHARE_BP + 5000) / 10_000)
    size = F.abs("residue")
    arms: list[tuple[Column, str, Column]] = [
        (F.col("label_confidence") < LEAST_CONFIDENCE, "confidence", F.concat(F.lit("confidence "),
            F.format_string("%.4f", F.col("label_confidence")), F.lit(f" is under {LEAST_CONFIDENCE}"))),
        (~((size <= MOST_RESIDUE) | ((F.col("batch_value") > 0) & (size <= share))), "residue",
            F.concat(F.lit("residue "), fmt(size), F.lit(f" is over {MOST_RESIDUE // 100}.00 and over a thousandth of "), fmt(F.col("batch_value")))),
        (~F.col("label").isin(*ALLOWED), "type", F.concat(F.col("label"), F.lit(" is never posted"))),
        (F.col("ambiguous"), "ambiguous", F.lit("the assignment is ambiguous")),
    ]
    joined = lambda pick: F.array_join(F.array_compact(F.array(*[F.when(c, pick(n, text)) for c, n, text in arms])), "; ")
    out = rows.withColumns({"failed_arms": joined(lambda n, _: F.lit(n)), "failed_text": joined(lambda _, text: text)})
    if seen is None:
        return out.withColumns({"suppressed": F.lit(False), "prior_verdict": F.lit(None).cast("string")})
    prior = seen.groupBy("merchant_id", "idempotency_key").agg(F.min_by("verdict", "seq").alias("prior_verdict"))
    return out.join(prior, ["merchant_id", "idempotency_key"], "left").withColumn("suppressed", F.col("prior_verdict").isNotNull())


def _budgets(batches):
    """The exceptions that a merchant's day has room for, of rows that come day by day in order; two sums are held."""
    import pyarrow as pa

    day, n, total = None, 0, 0
    for batch in batches:
        posted = []
        for m, d, seq, size in zip(*(batch[c].to_pylist() for c in ("merchant_id", "value_date", "exception_seq", "size")), strict=True):
            if (m, d) != day:
                day, n, total = (m, d), 0, 0
            if n < DAILY_COUNT and total + size <= DAILY_PAISE:
                n, total = n + 1, total + size
                posted.append((m, seq))
        columns = list(zip(*posted, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64()), strict=True)], ["merchant_id", "exception_seq"])


def decide(gated: DataFrame) -> DataFrame:
    """``verdict`` of each exception, with the daily budgets of its merchant and value date.

    In order of ``exception_seq`` an exception that passes the gates is posted
    if count and value still fit, else it is escalated and takes nothing, so
    later smaller ones may fit. A day's rows that pass go by in order, row by row.
    """
    keys = ["merchant_id", "value_date"]
    able = gated.where("failed_arms = '' and not suppressed").select(*keys, F.col("exception_seq").cast("long").alias("exception_seq"), F.abs("residue").alias("size"))
    rows = able.repartition(*keys).sortWithinPartitions(*keys, "exception_seq")
    posted = rows.mapInArrow(_budgets, "merchant_id string, exception_seq long").withColumn("posted", F.lit(True))
    out = gated.join(posted, ["merchant_id", "exception_seq"], "left")
    verdict = F.when(F.col("suppressed"), "SUPPRESSED_DUPLICATE").when(F.col("posted"), "AUTO_POST").otherwise("ESCALATE")
    reason = F.when(F.col("suppressed"), "decided before").when(F.col("failed_arms") != "", F.col("failed_arms"))
    reason = reason.when(F.col("posted"), "all arms pass").otherwise("daily budget")
    return out.withColumn("verdict", verdict).withColumn("policy_reason", reason).drop("posted")
