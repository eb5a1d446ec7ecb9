"""Steps whose work must stay in proportion: the same results with fewer passes."""

import time

import numpy as np
from pyspark.sql import functions as F

from reconweave.operators import netting
from reconweave.plans import exchange
from reconweave.sources import ingest


def _plainly(amounts, target):
    """Outcome and states by a map of sums that is sorted anew for each item."""
    sums, ways = np.zeros(1, np.int64), np.ones(1, np.int8)
    for a in amounts.tolist():
        ok = sums + a <= target
        merged, back = np.unique(np.concatenate([sums, sums[ok] + a]), return_inverse=True)
        total = np.zeros(len(merged), np.int64)
        np.add.at(total, back, np.concatenate([ways, ways[ok]]))
        sums, ways = merged, np.minimum(total, 2)
        if sums[-1] == target and ways[-1] > 1:
            return "AMBIGUOUS_MULTIPLE_PARTITIONS", len(sums)
        if len(sums) > netting.MAX_STATES:
            return "BOUND_STATES", len(sums)
    return ("UNIQUE" if sums[-1] == target else "NO_EXACT_SUBSET"), len(sums)


def test_subsets_are_counted_by_merges():
    rng = np.random.default_rng(3)
    for nth in range(300):
        amounts = rng.integers(1, (8, 1000, 10**7)[nth % 3], rng.integers(1, 15))
        target = int(amounts[rng.random(len(amounts)) < 0.5].sum()) if nth % 2 else int(rng.integers(1, amounts.sum() + 1))
        outcome, members, states = netting.count_subsets(amounts, target)
        if target > 0:
            assert (outcome, states) == _plainly(amounts, target)
        assert outcome != "UNIQUE" or amounts[members].sum() == target
    amounts = rng.integers(10**6, 10**7, 60)
    took = []
    for count in (lambda: netting.count_subsets(amounts, int(amounts[:30].sum()))[::2], lambda: _plainly(amounts, int(amounts[:30].sum()))):
        began = time.perf_counter()
        found = [count() for _ in range(10)]
        took.append(time.perf_counter() - began)
        assert found[0] == ("BOUND_STATES", found[0][1])
    assert took[0] < took[1] / 2


def test_lines_are_parsed_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    good = [f"p{i},o,1.00,upi,captured,2025-12-01T11:00:00" for i in range(30)]
    bad = [f"q{i},o,x,upi,captured,2025-12-01" for i in range(24)] + ["r,o,1.00,upi,captured,2025-13-01", "p1,o,1.00,upi,captured,2025-12-01"]
    text = "\n".join([",".join(ingest.ENTITIES["payments"]), *bad[:20], *good, *bad[20:]])
    files = spark.createDataFrame([("m", "f", bytearray(text.encode())), ("m", "g", bytearray(b"")), ("m", "h", bytearray(text.split("\n")[0].encode()))],
        "merchant_id string, file string, content binary")
    report = ingest.ingest(files, "payments")["report"]
    got = {r.file: (r.seen, r.accepted, r.rejected, r.by_reason, r.sample_lines) for r in report.collect()}
    lines = ",".join(str(i) for i in range(2, 22))
    assert got == {"f": (56, 30, 26, "DUPLICATE_IN_FILE:1,INVALID_DATE:1,MALFORMED_AMOUNT:24", lines), "g": (0, 0, 0, "", ""), "h": (0, 0, 0, "", "")}
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 1
    rows = ingest.validate(ingest.lines_of(ingest.gate_files(files, "payments")), "payments")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 3


def test_planted_files_are_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    orders = spark.range(20_000).select(F.col("id").alias("o_orderkey"))
    monkeypatch.setattr(exchange, "TASK_ROWS", 1000, raising=False)
    assert exchange._lines(orders).rdd.getNumPartitions() == 21


def test_facts_of_members_are_joined_once(spark):
    """Members that carry what is read of their payments need no payments."""
    from reconweave.operators import adjustments, fees

    members = spark.sql("SELECT 'm' AS merchant_id, concat('s', id % 2) AS settlement_id, concat('p', id) AS payment_id, DATE '2025-11-05' AS settle_date, false AS instant FROM range(6)")
    payment = spark.sql("SELECT 'm' AS merchant_id, concat('p', id) AS payment_id, id div 4 AS amount_paise, 'upi' AS method, DATE '2025-11-03' AS capture_date, id * 10 AS capture_sec FROM range(9)")
    rate = spark.sql("SELECT 'm' AS merchant_id, 'upi' AS method, DATE '2025-01-01' AS effective_from, 0 AS pct_bp, 0 AS flat_paise")
    facts = members.join(payment, ["merchant_id", "payment_id"])
    for one, two in (
        (netting.swap_invariant(facts, None, rate), netting.swap_invariant(members, payment, rate)),
        (adjustments.cycle_windows(facts, None), adjustments.cycle_windows(members, payment)),
    ):
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == two.count() > 0
    assert fees.with_facts(facts, None, *fees.FACTS) is facts


def test_components_are_many_tasks(spark, monkeypatch):
    """Components are few bytes, so adaptive execution would put them all into one task."""
    from reconweave.operators import matching

    cands = spark.sql("SELECT 'm' AS merchant_id, concat('b', id) AS bank_txn_id, concat('s', id) AS settlement_id, 0.9D AS probability, false AS utr_hit FROM range(200)")
    monkeypatch.setattr(matching, "component_labels", lambda e: e.select("merchant_id", "bank_txn_id", F.col("bank_txn_id").alias("label")))
    links = matching.assignment(cands)
    assert links.where("substring(bank_txn_id, 2) = substring(settlement_id, 2) and confidence = 0.9").count() == links.count() == 200
    assert links.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_presets_share_what_no_link_changes():
    from reconweave.plans.reconcile import Reconciliation

    one = Reconciliation({}, "stress_greedy")
    one.made |= {("attributed", True): "attributed", ("fees", True): "fees"}
    two = Reconciliation({}, "stress_global", like=one)
    assert (two.attributed, two.fees) == ("attributed", "fees")


def test_payments_are_judged_in_one_shuffle(spark, monkeypatch):
    from types import SimpleNamespace

    from reconweave.plans import evaluation

    rows = lambda text, names: spark.createDataFrame([("m", *r) for r in text], f"merchant_id string, {names}")
    facts = rows([("p0", "s0", 5, "upi"), ("p1", "s0", 5, "upi"), ("p3", "s1", 7, "upi")], "payment_id string, settlement_id string, amount_paise long, method string")
    truth = rows([("p0", "s0", 5, "upi"), ("p1", "s1", 5, "upi"), ("p2", "s1", 5, "card")], "payment_id string, settlement_id string, amount_paise long, method string")
    truth = truth.selectExpr("*", "DATE '2025-11-05' AS settle_date", "DATE '2025-11-03' AS capture_date")
    payment = rows([("p0", 5, "upi", 10), ("p1", 5, "upi", 1), ("p2", 5, "card", 2), ("p3", 7, "upi", 3), ("p4", 5, "upi", 20)], "payment_id string, amount_paise long, method string, k long")
    stages = SimpleNamespace(facts=facts, members=facts, tied=facts.where("payment_id = 'p1'"))
    monkeypatch.setattr(evaluation, "run", lambda t: stages)
    t = {"truth": truth, "payment": payment}
    cost = evaluation.cost_of_error.of(t).select("false_links", "missed", "cost_if_nothing_refused").first()
    assert tuple(cost) == (1, 3, 300_000)  # p3 is false; p1 and p2 are missed, p1 also as refused
    assert tuple(evaluation.false_matches.of(t).first()) == ("m", 2, 1, 7, 0.666667)
    assert tuple(evaluation.refusal_scores.of(t).first())[:7] == ("m", 1, 1, 2, 1, 1, 0)
    plan = evaluation._judged(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_truth_sorts_only_the_merchants_that_cut_quarters(spark):
    import duckdb

    from reconweave.plans import oracle
    from reconweave.sources import derive

    sf = "/root/testdata/sf0.001"
    text = derive.entity_sql(derive.Dialect(spark=True))["truth"]
    assert text.count("ntile(") == 1 and "merchant_id IN ('m1', 'm2')" in text
    con = duckdb.connect()
    for name in ("orders", "customer", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    columns = "payment_id, settlement_id, cycle, fee, gst, instant"
    want = con.execute(oracle.sql(f"SELECT {columns} FROM truth")).fetchall()
    got = derive.Entities(spark, sf)["truth"].selectExpr(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1000


def test_held_groups_give_what_chunks_give(spark, monkeypatch):
    """Orders by second, instant and id, batches up and down, none at all: one task a group and chunks of all rows agree, and carry the same facts."""
    rows, ends = [], []
    rng = np.random.default_rng(5)
    for nth, order in enumerate(("sec", "at", "id", "none") * 3):
        items = [(f"m{nth}", f"p{nth}-{i:02}", int(rng.integers(0, 9)), int(rng.integers(0, 4)), int(rng.integers(0, 5000))) for i in range(40)]
        rows += items
        by = {"sec": lambda r: (r[3], r[1]), "at": lambda r: (r[4], r[1]), "id": lambda r: r[1], "none": lambda r: (r[2], r[1])}[order]
        amounts = [r[2] for r in sorted(items, key=by)]
        sums = [sum(amounts[:13]), sum(amounts[13:21]), sum(amounts[21:])]
        ends += [(f"m{nth}", f"s{i}", gross) for i, gross in enumerate(sums[::-1] if nth % 2 else sums)]
    day = "DATE '2025-11-05' AS settle_date"
    pool = spark.createDataFrame(rows, "merchant_id string, payment_id string, amount_paise long, capture_sec long, at long")
    pool = pool.selectExpr("*", day, "false AS instant", "timestamp_seconds(at) AS created_at", "concat('x', payment_id) AS method").repartition(3)
    batches = spark.createDataFrame(ends, "merchant_id string, settlement_id string, gross long").selectExpr("*", day, "false AS instant")
    found = []
    for most in (netting.HELD_ROWS, 20):
        monkeypatch.setattr(netting, "HELD_ROWS", most)
        found.append(sorted(map(tuple, netting.ordered_blocks(pool, batches, pool, ("amount_paise", "method")).collect())))
    assert found[0] == found[1] and len({r[0] for r in found[0]}) >= 9
    assert all(r[-1] == f"x{r[2]}" for r in found[0])


def test_rates_of_large_payouts(spark):
    """A day's payout of a large merchant times 2,000,000 is beyond a long: its implied rate and its key are made all the same."""
    from reconweave.operators import investigate

    pairs = [(1, 3), (-250, 10_000), (5, 20_000), (4_700_000_000_000, 900_000_000_000), (-6_400_000_000_001, 1), (9 * 10**17, 9 * 10**18), (0, 7), (3, 2_000_000)]
    rows = spark.createDataFrame(pairs, "residue long, card_paise long").withColumn("text", investigate.implied_text())
    parts = {(r, c): (abs(r) * 2_000_000 + c) // (2 * c) for r, c in pairs}
    assert {(r.residue, r.card_paise): r.text for r in rows.collect()} == {k: f"{n // 10_000}.{n % 10_000:04}" for k, n in parts.items()}
