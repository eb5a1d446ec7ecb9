import datetime as dt

from reconweave.operators import ledger
from reconweave.sources import sinks
from reconweave.streaming import jobs

HEADER = "payment_id,order_id,amount,method,status,created_at_ist"


def test_ingest_stream_commits_each_id_once(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    row = lambda i: f"{i},o,1.00,upi,captured,2025-12-01"
    (landing / "a.csv").write_text("\n".join([HEADER, row("p1"), row("p2"), "p3,o,x,upi,captured,2025-12-01"]))

    def drain():
        q = jobs.ingest_stream(jobs.landing_files(spark, str(landing), "m"), "payments", out, str(tmp_path / "cp"))
        q.awaitTermination(60)
        assert q.exception() is None

    drain()
    (landing / "b.csv").write_text("\n".join([HEADER, row("p2"), row("p4")]))
    (landing / "c.csv").write_bytes(HEADER.encode() + b"\np9,o,\xff,upi,captured,2025-12-01")
    drain()
    drain()
    got = spark.read.parquet(f"{out}/accepted")
    assert sorted(r.payment_id for r in got.collect()) == ["p1", "p2", "p4"]
    bad = spark.read.parquet(f"{out}/rejects")
    assert sorted(r.reject_reason for r in bad.collect()) == ["DUPLICATE_EXISTING", "MALFORMED_AMOUNT", "NOT_UTF8"]


def test_rate_flags_on_a_stream(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    rows = [(1, at + dt.timedelta(seconds=s)) for s in (0, 10, 20)] + [(2, at)] + [(9, at + dt.timedelta(hours=2))]
    spark.createDataFrame(rows, "user long, at timestamp").coalesce(1).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("user long, at timestamp").parquet(str(tmp_path / "e"))
    q = jobs.rate_flags(events, "user", "at", 2).writeStream.format("memory").queryName("flags").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.user, r.n) for r in spark.table("flags").collect()] == [(1, 3)]


def test_wash_stream(spark, tmp_path):
    schema = "merchant_id string, id string, amount bigint, ref string, at timestamp"
    at = dt.datetime(2025, 1, 1)
    spark.createDataFrame([("m", "c1", 100, "r", at), ("m", "c2", 100, "q", at)], schema).write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([("m", "d1", -100, "r", at + dt.timedelta(days=2)), ("m", "d2", -100, "q", at + dt.timedelta(days=6))], schema).write.parquet(str(tmp_path / "d"))
    read = lambda p: spark.readStream.schema(schema).parquet(str(tmp_path / p))
    q = jobs.wash_stream(read("c"), read("d")).writeStream.format("memory").queryName("washed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("washed").collect()] == [("m", "c1", "d1")]


def decisions(spark, keys, label="unexplained"):
    kinds = "merchant_id string, exception_seq int, settlement_id string, idempotency_key string, label_confidence double, verdict string, label string, residue long, value_date date"
    rows = [(m, i, f"s{i}", f"{m}{k}", 0.5, "ESCALATE", label, 7, dt.date(2025, 11, 3)) for i, (m, k) in enumerate(keys, 1)]
    return spark.createDataFrame(rows, kinds)


def test_posting_reads_heads_and_its_own_keys_only(spark, tmp_path):
    out = str(tmp_path)
    first = decisions(spark, [("a", i) for i in range(40)] + [("b", i) for i in range(5)])
    jobs.post_decisions(first, out, 0)
    one = sorted(map(tuple, jobs.posted(spark, out).collect()))
    jobs.post_decisions(first, out, 0)
    assert sorted(map(tuple, jobs.posted(spark, out).collect())) == one and len(one) == 45
    # a second batch repeats a key, and goes on where the chains end
    second = decisions(spark, [("a", 39), ("a", 100), ("c", 1)])
    for _ in range(2):
        jobs.post_decisions(second, out, 1)
    rows = jobs.posted(spark, out)
    assert rows.count() == 47 and {(r.merchant_id, r.seq) for r in rows.collect()} >= {("a", 41), ("c", 1)}
    check = {r.merchant_id: r for r in ledger.verify_ledger(rows).collect()}
    assert all(r.broken_links == r.altered == r.unverifiable == 0 for r in check.values())
    keys = sinks.KeyedTable(spark, f"{out}/keys", ["merchant_id", "idempotency_key"], "merchant_id string, idempotency_key string", 256)
    assert keys.of(decisions(spark, [("a", 3)]), 2).count() < 8 and keys.read(2).count() == 47
    # a batch without rows, then one that only repeats
    jobs.post_decisions(second.limit(0), out, 2)
    jobs.post_decisions(first, out, 3)
    assert jobs.posted(spark, out).count() == 47
