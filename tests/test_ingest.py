import datetime as dt

import pytest

from reconweave.sources import ingest

HEADER = "payment_id,order_id,amount,method,status,created_at_ist"


def lines(spark, rows, header=HEADER, file="f"):
    return spark.createDataFrame([("m", file, i + 1, x) for i, x in enumerate([header, *rows])], "merchant_id string, file string, line_no bigint, line string")


def reasons(spark, entity, rows, header=HEADER, committed=None):
    return {r.line_no - 1: r.reject_reason for r in ingest.validate(lines(spark, rows, header), entity, committed).collect()}


def test_reasons_in_rule_order(spark):
    at = "2025-12-01T11:00:00+05:30"
    rows = [
        f"p1,o1,10.123,upi,captured,{at}", f"p2,o2,10.00,upi,captured", "p3,o3,10.00,upi,captured,2025-13-01", f",o4,10.00,upi,captured,{at}", f"p5,o5,-1.00,upi,captured,{at}",
        f'p6,"o,6",10.00,upi,captured,{at}', f"p7,,7,upi,captured,2025-12-01", f"p6,o8,10.00,upi,captured,{at}", f"p9,o9,1.00,,captured,{at}", "", f"p1,o1,3.00,upi,captured,{at}",
    ]
    got = reasons(spark, "payments", rows)
    assert got == {1: "MALFORMED_AMOUNT", 2: "ARITY", 3: "INVALID_DATE", 4: "MISSING_ID", 5: "MALFORMED_AMOUNT", 6: None, 7: None, 8: "DUPLICATE_IN_FILE", 9: "MISSING_FIELD", 11: None}


def test_offsets_are_converted(spark):
    rows = ["a,o,1.00,upi,captured,2025-12-01T11:00:00Z", "b,o,1.00,upi,captured,2025-12-01T11:00:00+05:30", "c,o,1.00,upi,captured,2025-12-01"]
    got = {r.payment_id: r.created_at_ist for r in ingest.validate(lines(spark, rows), "payments").collect()}
    assert got == {"a": dt.datetime(2025, 12, 1, 16, 30), "b": dt.datetime(2025, 12, 1, 11, 0), "c": dt.datetime(2025, 12, 1)}


def test_settlement_sums_and_known_ids(spark):
    header = ",".join(ingest.ENTITIES["settlements"])
    rows = ["s1,,100.00,2.00,0.36,1.00,96.64,2025-11-04,0", "s2,,100.00,2.00,0.36,1.00,96.65,2025-11-04,1", "s3,u,1.00,0,0,0,1.00,2025-11-04,maybe"]
    known = spark.createDataFrame([("m", "s1"), ("n", "s2")], "merchant_id string, settlement_id string")
    assert reasons(spark, "settlements", rows, header, known) == {1: "DUPLICATE_EXISTING", 2: "MONETARY_INCONSISTENT", 3: "MALFORMED_FIELD"}


def test_wrong_header_fails_the_file(spark):
    assert reasons(spark, "payments", ["p,o,1.00,upi,captured,2025-12-01"], "id,amount") == {}


def test_report_and_cut_lines(spark):
    rows = ["p1,o," + "9" * 500 + ",upi,captured,2025-12-01"]
    v = ingest.validate(lines(spark, rows), "payments")
    assert ingest.report(v).first().outcome == "MALFORMED_AMOUNT"
    assert len(ingest.rejects(v).first().raw_line) == 401


def test_refused_files_leave_a_row(spark):
    head = HEADER.encode()
    files = spark.createDataFrame(
        [("m", "a", bytearray(b"")), ("m", "b", bytearray(head + b"\n\xff")), ("m", "c", bytearray(b"id\n1")), ("z", "d", bytearray(head)), ("m", "e", bytearray(b"\xef\xbb\xbf" + head.upper() + b"\r\np1,o1,1.00,upi,captured,2025-12-01\r\n")), ("m", "f", None)],
        "merchant_id string, file string, content binary",
    )
    out = ingest.ingest(files, "payments", spark.createDataFrame([("m",)], "merchant_id string"))
    assert {r.file: r.reject_reason for r in out["rejects"].collect()} == {"a": "EMPTY_FILE", "b": "NOT_UTF8", "c": "BAD_HEADER", "d": "UNKNOWN_MERCHANT", "f": "EMPTY_FILE"}
    assert [r.payment_id for r in out["accepted"].collect()] == ["p1"]
    report = {r.file: (r.refusal, r.seen, r.accepted) for r in out["report"].collect()}
    assert len(report) == 6 and report["e"] == (None, 1, 1) and report["c"] == ("BAD_HEADER", 0, 0)


def test_open_quotes_and_details(spark):
    v = ingest.validate(lines(spark, ['p1,o1,1.00,upi,captured,2025-12-01"', 'p2,"o""2",1.00,upi,captured,2025-12-01', "p2,o,1.00,upi,captured,2025-12-01", "p3,o,x,upi,captured,2025-12-01"]), "payments")
    got = {r.line_no: (r.reject_reason, r.detail) for r in v.collect()}
    assert got[3] == (None, None) and got[4] == ("DUPLICATE_IN_FILE", "same id as line 3") and got[5] == ("MALFORMED_AMOUNT", "amount: x")
    assert got[2][0] in ("INVALID_DATE", "UNPARSEABLE")


def test_a_large_merchant_is_written_as_many_files_and_loaded_whole(spark, monkeypatch):
    """A merchant's part was one file, refused whole once it was over the gate's size."""
    from reconweave.plans import exchange
    from reconweave.plans.registry import entities

    t = entities(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(exchange, "FILE_ROWS", 40)
    monkeypatch.setattr(ingest, "MAX_FILE", 6000)
    files = ingest.read_files(spark, exchange._written_dataset(t) + "/parts/payments.csv")
    assert files.selectExpr("max(octet_length(content))").first()[0] <= 6000
    loaded = ingest.ingest(files, "payments")["accepted"].select("merchant_id", "payment_id")
    assert sorted(loaded.collect()) == sorted(t["payment"].select("merchant_id", "payment_id").collect())
