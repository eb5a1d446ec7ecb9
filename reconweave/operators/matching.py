"""Linking bank credits to settlement batches.

Order of evidence: rows that cancel each other leave first; exact references
link; damaged references that repair to one known reference link; the rest is
blocked into candidates, scored, and assigned one to one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconweave.functions import narration as N
from reconweave.functions.calendar import with_ordinal
from reconweave.functions.durable import written
from reconweave.functions.money import TOLERANCE

# Windows of the candidates, least probability of a link, margin of a near tie.
WINDOW_DAYS, WINDOW_PAISE = 3, 5_000_000
LEAST_PROBABILITY, NEAR_TIE = 0.55, 0.08


def parsed(bank: DataFrame) -> DataFrame:
    """Bank rows with canonical text, rail, reference candidates and entity tokens."""
    with_canon = bank.withColumn("canon", N.canonical(F.col("narration")))
    return with_canon.withColumns({"rail": N.rail(F.col("canon")), "candidates": N.utr_candidates(F.col("canon")),
        "tokens": N.entity_tokens(F.col("narration"))})


def wash_pairs(rows: DataFrame) -> DataFrame:
    """(merchant, debit, credit) pairs that cancel: a return debit and the first free credit of the same amount and a shared reference within five days.

    Debits and credits are each used once, debits in bank order.
    """
    n = F.upper("narration")
    back = n.contains("RETURN") | n.contains("REVERSAL") | n.contains("REVERSED")
    keyed = lambda df, name: df.select("merchant_id", F.col("bank_txn_id").alias(name), F.abs("amount_paise").alias("a"),
        F.col("value_date").alias(f"{name}_date"), F.explode("candidates").alias("ref"))
    debits = keyed(rows.where((F.col("amount_paise") < 0) & back), "debit")
    credits = keyed(rows.where("amount_paise > 0"), "credit")
    near = F.abs(F.datediff("debit_date", "credit_date")) <= 5
    pairs = debits.join(credits, ["merchant_id", "a", "ref"]).where(near).select("merchant_id", "debit", "credit").distinct()
    return first_come(pairs, "debit", "credit")


CHOSEN = "merchant_id string, taker string, taken string"


def _in_turn(batches):
    """The first free item of each taker, of rows that come component by component, taker by taker, best item first; a component's taken items are held."""
    import pyarrow as pa

    component, used, served = None, set(), None
    for batch in batches:
        out = []
        for m, label, who, what in zip(*(batch[c].to_pylist() for c in ("merchant_id", "label", "taker", "taken")), strict=True):
            if (m, label) != component:
                component, used, served = (m, label), set(), None
            if who != served and what not in used:
                used.add(what)
                served = who
                out.append((m, who, what))
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["merchant_id", "taker", "taken"])


def first_come(pairs: DataFrame, taker: str, taken: str, rank: str | None = None) -> DataFrame:
    """One-to-one choice in id order: each taker in turn gets its first still free item.

    ``rank`` orders a taker's items (default: the item's id). A pair that shares
    neither side is chosen at once. The others are split into components, and
    each component is gone through once, in order; how long a queue for one
    item is does not matter.
    """
    order = F.col(rank) if rank else F.lit(0)
    pairs = written(pairs.select("merchant_id", F.col(taker).alias("taker"), F.col(taken).alias("taken"), order.alias("rank")))
    single = lambda c: pairs.groupBy("merchant_id", c).agg(F.count("*").alias("n")).where("n = 1").select("merchant_id", c)
    alone = pairs.join(single("taker"), ["merchant_id", "taker"]).join(single("taken"), ["merchant_id", "taken"]).select("merchant_id", "taker", "taken")
    rest = written(pairs.join(alone, ["merchant_id", "taker", "taken"], "left_anti"))
    chosen = alone
    if not rest.isEmpty():
        labels = component_labels(rest.select("merchant_id", F.col("taker").alias("bank_txn_id"), F.col("taken").alias("settlement_id")))
        rows = rest.join(labels.withColumnRenamed("bank_txn_id", "taker"), ["merchant_id", "taker"])
        rows = rows.repartition("merchant_id", "label").sortWithinPartitions("merchant_id", "label", "taker", "rank", "taken")
        chosen = alone.unionByName(written(rows.select("merchant_id", "label", "taker", "taken").mapInArrow(_in_turn, CHOSEN)))
    return chosen.select("merchant_id", F.col("taker").alias(taker), F.col("taken").alias(taken))


FOLD = ("OISBZ", "01582")


def fold(x: Column) -> Column:
    """Letters that are confused with digits become those digits."""
    return F.translate(x, *FOLD)


def differing(a: Column, b: Column) -> Column:
    """Positions, over the shorter length, where two texts differ."""
    chars = lambda x: F.split(F.substring(x, F.lit(1), F.least(F.length(a), F.length(b))), "")
    return F.size(F.filter(F.zip_with(chars(a), chars(b), lambda p, q: p != q), lambda d: d))


def repairs(rows: DataFrame, settlement: DataFrame) -> DataFrame:
    """(merchant, bank row, reference, method, confidence): what each credit's candidates repair to.

    Candidates go in order. Exact (1.0) or respaced (0.98) hits win at once;
    then a unique known reference that the candidate begins (0.94), where
    several refuse the credit; then a unique one equal up to three confused
    signs (0.90), or begun up to confusions (0.86).
    """
    known = settlement.where("utr is not null and utr <> ''").select("merchant_id", "utr").distinct()
    cand = rows.where("amount_paise > 0").select("merchant_id", "bank_txn_id", F.posexplode("candidates").alias("pos", "cand"))
    keys = ["merchant_id", "bank_txn_id", "pos", "cand"]
    exact = cand.join(known.withColumn("cand", F.col("utr")), ["merchant_id", "cand"]).select(*keys, "utr", F.lit(1).alias("n"),
        F.lit("exact").alias("method"), F.lit(1.0).alias("confidence"))
    respaced = cand.withColumn("flat", F.regexp_replace("cand", r"\s", "")).where("flat <> cand").join(known.withColumn("flat", F.col("utr")),
        ["merchant_id", "flat"])
    respaced = respaced.select(*keys, "utr", F.lit(1).alias("n"), F.lit("despaced").alias("method"), F.lit(0.98).alias("confidence"))
    # each reference stands under all its beginnings of eight signs or more, so that equal beginnings meet by an equi-join, whatever the bank's prefix
    begun = known.select("merchant_id", "utr", F.explode(F.when(F.length("utr") >= 8, F.sequence(F.lit(8), F.length("utr")))).alias("n"))
    begun = begun.select("merchant_id", "utr", F.substring("utr", F.lit(1), F.col("n")).alias("cand"))
    long_enough = cand.where(F.length("cand") >= 8)
    prefix = long_enough.join(begun, ["merchant_id", "cand"])
    folded = long_enough.withColumn("h", fold(F.col("cand"))).join(begun.select("merchant_id", "utr", fold(F.col("cand")).alias("h")),
        ["merchant_id", "h"])
    folded = folded.where(differing(F.col("cand"), F.col("utr")).between(1, 3))
    whole = F.length("utr") == F.length("cand")

    def unique(hits: DataFrame, method: str, confidence: float) -> DataFrame:
        found = hits.groupBy(*keys).agg(F.min("utr").alias("utr"), F.count_distinct("utr").cast("int").alias("n"))
        return found.select(*keys, "utr", "n", F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))

    tries = exact.unionByName(respaced).unionByName(unique(prefix, "prefix", 0.94)).unionByName(unique(folded.where(whole), "confusion",
        0.90)).unionByName(unique(folded.where(~whole), "confusion_prefix", 0.86))
    # exact and respaced look at all candidates before any other method is tried
    stage = F.when(F.col("confidence") >= 0.98, 0).otherwise(1)
    order = F.struct(stage, F.col("pos"), -F.col("confidence"), F.col("n") > 1)
    usable = tries.where("n = 1 or method = 'prefix'")
    best = usable.groupBy("merchant_id", "bank_txn_id").agg(F.min_by(F.struct("utr", "n", "method", "confidence"), order).alias("r"))
    return best.where("r.n = 1").select("merchant_id", "bank_txn_id", "r.utr", "r.method", "r.confidence")


def owner_of_utr(settlement: DataFrame) -> DataFrame:
    """(merchant, utr, settlement): of settlements with one reference the one with the highest id."""
    return settlement.where("utr is not null and utr <> ''").groupBy("merchant_id", "utr").agg(F.max("settlement_id").alias("settlement_id"))


def exact_links(credits: DataFrame, settlement: DataFrame) -> DataFrame:
    """Credits whose narration holds a known reference, each settlement going to the first credit in bank order."""
    cand = credits.select("merchant_id", "bank_txn_id", F.posexplode("candidates").alias("pos", "utr"))
    pairs = cand.join(owner_of_utr(settlement), ["merchant_id", "utr"]).select("merchant_id", "bank_txn_id", "settlement_id", "pos")
    chosen = first_come(pairs, "bank_txn_id", "settlement_id", "pos")
    return chosen.select("merchant_id", "bank_txn_id", "settlement_id", F.lit(1.0).alias("confidence"), F.lit("exact_utr").alias("source"))


def repair_links(credits: DataFrame, settlement: DataFrame, repair: DataFrame, taken: DataFrame) -> DataFrame:
    """Open credits whose repaired reference points to a free settlement that no other open credit claims."""
    keys = ["merchant_id"]
    open_credits = credits.join(taken, [*keys, "bank_txn_id"], "left_anti").select(*keys, "bank_txn_id")
    claims = open_credits.join(repair, [*keys, "bank_txn_id"]).join(owner_of_utr(settlement),
        [*keys, "utr"]).join(taken.select(*keys, "settlement_id"), [*keys, "settlement_id"], "left_anti")
    alone = claims.groupBy(*keys, "settlement_id").agg(F.count("*").alias("n")).where("n = 1").select(*keys, "settlement_id")
    return claims.join(alone, [*keys, "settlement_id"]).select(*keys, "bank_txn_id", "settlement_id", "confidence",
        F.concat(F.lit("repaired_utr:"), "method").alias("source"))


def candidates(credits: DataFrame, settlement: DataFrame, repair: DataFrame, cal: DataFrame) -> DataFrame:
    """Pairs of an open credit and a free settlement: within three banking days, and near in amount or named by the repaired reference.

    Settlements are copied to the seven ordinals around theirs and to the three
    steps of the amount around theirs, so the pairs near in amount come from an
    equi-join on (merchant, ordinal, step); those named by a reference are an
    equi-join of their own.
    """
    named = repair.select("merchant_id", "bank_txn_id", F.col("utr").alias("repaired"), F.col("method"),
        F.col("confidence").alias("repair_confidence"))
    c = with_ordinal(credits, cal, "value_date", "bank_ord").join(named, ["merchant_id", "bank_txn_id"], "left")
    s = with_ordinal(settlement, cal, "settle_date", "settle_ord").select("merchant_id", "settle_ord", "settlement_id", "utr", "net",
        "settle_date", "instant")
    step = lambda x: F.floor(F.col(x) / F.lit(WINDOW_PAISE))
    around = s.withColumn("bank_ord", F.explode(F.sequence(F.col("settle_ord") - WINDOW_DAYS, F.col("settle_ord") + WINDOW_DAYS)))
    around = around.withColumn("step", F.explode(F.sequence(step("net") - 1, step("net") + 1)))
    far = F.abs(F.col("amount_paise") - F.col("net")) > WINDOW_PAISE
    near = c.withColumn("step", step("amount_paise")).join(around, ["merchant_id", "bank_ord", "step"]).where(~far).drop("step")
    told = c.where("repaired is not null").join(s.withColumn("repaired", F.col("utr")), ["merchant_id", "repaired"])
    told = told.where(far & (F.abs(F.col("bank_ord") - F.col("settle_ord")) <= WINDOW_DAYS))
    both = near.unionByName(told)
    return both.withColumns({"utr_hit": F.coalesce(F.col("repaired") == F.col("utr"), F.lit(False)),
        "banking_days": F.col("bank_ord") - F.col("settle_ord")})


# The features in order; the prior's coefficients below.
FEATURES = (
    "abs_amount_delta_log", "signed_delta_sign", "delta_within_tolerance", "delta_rel_to_net", "banking_day_delta", "abs_banking_day_delta",
        "same_day", "utr_exact",
    "utr_repaired", "utr_repair_confidence", "token_overlap", "jaro_winkler", "narration_has_any_utr", "settlement_utr_present", "is_instant",
        "amount_rank_gap",
)


def features(pairs: DataFrame) -> DataFrame:
    """The sixteen features of each candidate pair, as columns ``f_<name>``; the rank gap starts at 0."""
    delta = F.col("amount_paise") - F.col("net")
    has = F.coalesce(F.col("utr") != "", F.lit(False))
    exact = has & F.coalesce(F.array_contains("candidates", F.col("utr")), F.lit(False))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = (
        F.log1p(F.abs(delta).cast("double")), F.signum(delta.cast("double")), one(F.abs(delta) <= TOLERANCE),
            F.abs(delta) / F.greatest(F.abs("net"), F.lit(1)),
        F.col("banking_days").cast("double"), F.abs("banking_days").cast("double"), one(F.col("value_date") == F.col("settle_date")), one(exact),
        one(~exact & F.col("utr_hit")), F.coalesce("repair_confidence", F.lit(0.0)), N.trigram_jaccard(F.col("canon"), F.col("utr")),
            N.best_similarity(F.col("candidates"), F.col("utr")),
        one(F.size("candidates") > 0), one(has), one(F.col("instant")), F.lit(0.0),
    )
    return pairs.withColumns({f"f_{n}": v for n, v in zip(FEATURES, values, strict=True)})


def prior(df: DataFrame) -> Column:
    """Probability of a pair without a trained model."""
    f = lambda n: F.col(f"f_{n}")
    raw = (
        -3 + 8 * f("utr_exact") + 4.5 * f("utr_repair_confidence") * f("utr_repaired") + 2.5 * f("delta_within_tolerance") - 0.35 * f("abs_banking_day_delta")
        - 0.9 * F.least(f("abs_amount_delta_log"), F.lit(20.0)) + 1.2 * f("token_overlap") + f("jaro_winkler")
    )
    return F.greatest(F.least(1 / (1 + F.exp(-raw)), F.lit(1 - 1e-6)), F.lit(1e-6))


def scored(pairs: DataFrame, probability: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Candidates with ``probability``, the rank gap of their credit, and its near-tie flag.

    ``probability`` adds that column from the features (a trained model); the
    prior does without one. The gap between a credit's two best becomes a
    feature, and all are scored again with it.
    """
    rate = probability or (lambda p: p.withColumn("probability", prior(p)))
    keys = ["merchant_id", "bank_txn_id"]

    def gaps(p: DataFrame) -> DataFrame:
        top = p.groupBy(*keys).agg(F.sort_array(F.collect_list("probability"), asc=False).alias("ps"))
        return top.select(*keys, (F.col("ps")[0] - F.coalesce(F.get("ps", 1), F.lit(0.0))).alias("gap"), (F.size("ps") > 1).alias("several"))

    first = features(pairs)
    first = rate(first)
    again = first.join(gaps(first), keys).withColumn("f_amount_rank_gap", F.col("gap")).drop("gap", "several")
    if probability is not None:
        again = rate(again.drop("probability"))
    return again.join(gaps(again), keys).withColumn("near_tie", F.col("several") & (F.col("gap") < NEAR_TIE))


def greedy(cands: DataFrame) -> DataFrame:
    """Each credit's most probable settlement from 0.55 up, kept by the first credit in bank order."""
    w = Window.partitionBy("merchant_id", "bank_txn_id").orderBy(F.desc("probability"), "settlement_id")
    best = cands.withColumn("rn", F.row_number().over(w)).where((F.col("rn") == 1) & (F.col("probability") >= LEAST_PROBABILITY))
    first = Window.partitionBy("merchant_id", "settlement_id").orderBy("bank_txn_id")
    return best.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("merchant_id", "bank_txn_id", "settlement_id",
        F.col("probability").alias("confidence"), F.lit("greedy").alias("source"))


def component_labels(edges: DataFrame) -> DataFrame:
    """(merchant, bank row, label): components of the candidate graph by alternating star steps, whose rounds grow with the logarithm of its size; each round is written."""
    m = "merchant_id"
    e = written(edges.select(m, F.concat(F.lit("c"), "bank_txn_id").alias("a"), F.concat(F.lit("s"), "settlement_id").alias("b")).distinct())
    state = None
    while True:
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64(m, "a", "b"))).first()
        if mark == state:
            break
        state = mark
        both = e.select(m, F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(m, "b", "a"))
        low = both.groupBy(m, "u").agg(F.least(F.min("v"), "u").alias("m"))
        large = both.where("v > u").join(low, [m, "u"]).select(m, "v", "m").distinct()
        step = large.join(large.groupBy(m, "v").agg(F.min("m").alias("least")), [m, "v"])
        pairs = F.array(F.struct(F.col("least").alias("a"), F.col("v").alias("b")), F.struct(F.col("least").alias("a"), F.col("m").alias("b")))
        e = written(step.select(m, F.explode(pairs).alias("e")).select(m, "e.a", "e.b").where("a < b").distinct())
    stars = e.select(m, F.col("b").alias("node"), F.col("a").alias("label")).union(e.select(m, "a", "a").distinct())
    return stars.where("node like 'c%'").select(m, F.expr("substring(node, 2)").alias("bank_txn_id"), "label")


LINKS = "merchant_id string, bank_txn_id string, settlement_id string, confidence double, source string"


def assign_pairs(pairs: list[dict[int, int]]) -> list[int | None]:
    """The column of each row, or None: as many links as possible, then the least total cost, from each row's {column: cost}.

    Augmenting shortest paths over the given pairs only, in whole numbers.
    """
    none = 1 + sum(max(p.values()) for p in pairs if p)  # no link: dearer than all links together
    u, v = [0] * len(pairs), defaultdict(int)
    row_of, column_of = {}, [None] * len(pairs)
    for start in range(len(pairs)):
        best, way, done, heap = {}, {}, {}, []
        i, far = start, 0
        while True:
            # a row's own place for no link is the column -1 - i
            for j, c in [*pairs[i].items(), (-1 - i, none)]:
                there = far + c - u[i] - v[j]
                if j not in done and (j not in best or there < best[j]):
                    best[j], way[j] = there, i
                    heappush(heap, (there, j))
            far, j = heappop(heap)
            while j in done:
                far, j = heappop(heap)
            done[j] = far
            if j not in row_of:
                break
            i = row_of[j]
        u[start] += far
        for k, d in done.items():
            if k in row_of:
                u[row_of[k]] += far - d
                v[k] -= far - d
        while True:
            i = way[j]
            row_of[j], column_of[i], j = i, j, column_of[i]
            if i == start:
                break
    return [j if j >= 0 else None for j in column_of]


def _links(merchant: str, rows: list[tuple]) -> list[tuple]:
    """Links of one component from its (bank row, settlement, probability, named by a reference), sorted by both ids."""
    at = {(x, y): (p, hit) for x, y, p, hit in rows}
    b, s = sorted({x for x, _ in at}), sorted({y for _, y in at})
    row, column = ({x: i for i, x in enumerate(side)} for side in (b, s))
    pairs = [{} for _ in b]
    for (x, y), (p, _) in at.items():
        pairs[row[x]][column[y]] = int(np.round(-np.log(max(p, 1e-9)) * 1e6))
    chosen = [(x, s[j], *at[x, s[j]]) for x, j in zip(b, assign_pairs(pairs), strict=True) if j is not None]
    return [(merchant, x, y, p, "repaired_utr" if hit else "global_assignment") for x, y, p, hit in chosen if p >= LEAST_PROBABILITY]


def _assigned(batches):
    """Links of rows that come component by component; one component is held."""
    import pyarrow as pa

    names = [c.split()[0] for c in LINKS.split(", ")]
    record = lambda out: pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "confidence" else pa.string())
        for n, c in zip(names, list(zip(*out, strict=True)) or [()] * 5, strict=True)], names)
    component, rows = None, []
    for batch in batches:
        out = []
        for m, label, *pair in zip(*(batch[c].to_pylist() for c in PAIR), strict=True):
            if (m, label) != component:
                if rows:
                    out += _links(component[0], rows)
                component, rows = (m, label), []
            rows.append(tuple(pair))
        yield record(out)
    if rows:
        yield record(_links(component[0], rows))


PAIR = ("merchant_id", "label", "bank_txn_id", "settlement_id", "probability", "utr_hit")


def assignment(cands: DataFrame) -> DataFrame:
    """Optimal one-to-one links within each component of the candidate graph.

    As many links as possible, then the least sum of round(-ln p * 10^6); links
    under 0.55 fall away afterwards. Components are solved over their pairs,
    without a matrix and without a cap.
    """
    labels = component_labels(cands)
    rows = cands.join(labels, ["merchant_id", "bank_txn_id"]).select(*PAIR)
    # few bytes but much work, so adaptive execution would put all components into one task: dealt by a number it leaves alone
    dealt = rows.repartition(cands.sparkSession.sparkContext.defaultParallelism * 2, "merchant_id", "label")
    return dealt.sortWithinPartitions(*PAIR[:4]).mapInArrow(_assigned, LINKS)


def without_washed(bank: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parsed bank rows, washed pairs, credits that are not in such a pair)."""
    rows = written(parsed(bank))
    washed = written(wash_pairs(rows))
    gone = washed.select("merchant_id", F.explode(F.array("debit", "credit")).alias("bank_txn_id"))
    return rows, washed, rows.where("amount_paise > 0").join(gone, ["merchant_id", "bank_txn_id"], "left_anti")


def match(
    rows: DataFrame, washed: DataFrame, credits: DataFrame, settlement: DataFrame, cal: DataFrame, use_exact: bool = True,
        use_repair: bool = True, use_global: bool = True,
    probability: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """All stages after ``without_washed``; ``links`` holds the result, the other entries what each stage gave.

    What references leave open is always linked through scored candidates, by
    assignment or, without ``use_global``, greedily.
    """
    repair = written(repairs(credits, settlement)) if use_repair else repairs(credits.limit(0), settlement.limit(0))
    links = exact_links(credits, settlement) if use_exact else rows.sparkSession.createDataFrame([], LINKS)
    if use_repair:
        links = links.unionByName(repair_links(credits, settlement, repair, links))
    referenced = written(links)
    open_credits = credits.join(referenced, ["merchant_id", "bank_txn_id"], "left_anti")
    free = settlement.join(referenced, ["merchant_id", "settlement_id"], "left_anti")
    cands = written(scored(candidates(open_credits, free, repair, cal), probability))
    links = written(referenced.unionByName(assignment(cands) if use_global else greedy(cands)))
    return {"parsed": rows, "washed": washed, "credits": credits, "repairs": repair, "referenced": referenced, "candidates": cands, "links": links}
