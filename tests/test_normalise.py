"""From files to a run: entities of loaded files, and terms by merchant."""

import json

import pytest
from pyspark.sql import functions as F

from reconweave.operators import fees
from reconweave.plans.reconcile import Reconciliation, reconcile
from reconweave.sources import ingest, normalise

HEADS = {"payments": "payments", "orders": "orders", "settlements": "settlements", "bank": "bank_statement", "refunds": "refunds", "chargebacks": "chargebacks",
    "reserve": "reserve_ledger"}


def write(folder, rows, names=HEADS):
    folder.mkdir(parents=True)
    for entity, name in names.items():
        lines = [",".join(ingest.ENTITIES[entity]), *rows.get(entity, [])]
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")


def card(**more):
    base = {"merchant_id": "inside", "gst_rate_pct": "18.0", "tds_rate_pct": "1.0", "reserve_rate_pct": "5.0", "reserve_methods": ["card"], "instant_surcharge_pct": "0.25",
        "dispute_fee": "300.00", "tolerance_paise": 100, "methods": {"card": [{"effective_from": "2025-01-01", "pct": "2.00", "flat_paise": 0}],
            "upi": [{"effective_from": "2025-01-01", "pct": "0.00", "flat_paise": 0}]}}
    return json.dumps(base | more, indent=1)


def rows(fee, gst, held, off=0):
    """Two payments of one day and their batch, whose credit is ``off`` paise more than its parts."""
    gross, tds = 300_000, 3_000
    net = gross - fee - gst - tds - held
    money = lambda p: f"{p // 100}.{p % 100:02d}"
    return {
        "payments": ["pay_1,ord_1,1000.00,card,captured,2025-11-03T10:00:00+05:30", "pay_2,,2000.00,upi,captured,2025-11-03T06:00:00Z", "pay_3,,5.00,upi,failed,2025-11-03T10:00:00+05:30"],
        "settlements": [f"setl_1,111122223333,{money(gross)},{money(fee)},{money(gst)},{money(tds)},{money(net)},2025-11-06T18:00:00+05:30,0"],
        "bank": [f"bnk_1,2025-11-06,{money(net + off)},NEFT-111122223333-PAYOUT"],
    }


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    for merchant, terms, made in (
        ("a", {}, rows(2000, 360, 4882)),
        ("b", {"gst_rate_pct": "12.0", "reserve_methods": [], "tolerance_paise": 40}, rows(2000, 240, 0, off=41)),
        ("c", {"reserve_rate_pct": "10.0", "tolerance_paise": 41}, rows(2000, 360, 9764, off=41)),
    ):
        write(root / merchant / "observable", made)
        (root / merchant / "config").mkdir()
        (root / merchant / "config" / "rate_card_published.json").write_text(card(merchant_id=merchant, **terms))
    return normalise.entities(ingest.load_dataset(spark, str(root)))


def test_entities_of_files(dataset):
    paid = {(r.merchant_id, r.payment_id): r for r in dataset["payment"].collect()}
    assert len(paid) == 9 and paid["a", "pay_2"].capture_sec == 11 * 3600 + 1800 and paid["a", "pay_2"].amount_paise == 200_000
    assert paid["a", "pay_2"].order_id is None
    days = dataset["cal"].agg(F.min("d"), F.max("d")).first()
    assert str(days[0]) < "2025-10-01" and str(days[1]) > "2025-12-01"
    terms = {r.merchant_id: r for r in dataset["terms"].collect()}
    assert (terms["b"].gst_bp, terms["b"].reserve_methods, terms["c"].reserve_bp, terms["a"].dispute_fee_paise) == (1200, "", 1000, 30_000)


def test_each_merchant_is_reconciled_by_its_own_terms(dataset):
    got = {r.merchant_id: r for r in Reconciliation(dataset).decomposition.collect()}
    assert {m: (r.residue, r.within_tolerance, r.membership_proven) for m, r in got.items()} == {"a": (0, True, True), "b": (41, False, True), "c": (41, True, True)}
    assert (got["a"].gst_on_fee, got["b"].gst_on_fee) == (-360, -240)
    assert {m: r.reserve_held for m, r in got.items()} == {"a": -4882, "b": 0, "c": -9764}
    out = reconcile(dataset)
    assert [r.merchant_id for r in out["exception"].collect()] == ["b"]


def test_one_merchant_in_a_folder_of_its_own(spark, tmp_path):
    write(tmp_path / "m", rows(2000, 360, 4882), HEADS | {"bank": "bank", "reserve": "reserve"})
    (tmp_path / "card.json").write_text(card())
    tables = normalise.entities(ingest.load_dataset(spark, str(tmp_path / "m"), "shop", str(tmp_path / "card.json")))
    r = Reconciliation(tables).decomposition.first()
    assert (r.merchant_id, r.residue, r.gst_on_fee) == ("shop", 0, -360)


def test_files_without_rows(spark, tmp_path):
    write(tmp_path / "m", {})
    (tmp_path / "m" / "rate_card_published.json").write_text(card())
    tables = normalise.entities(ingest.load_dataset(spark, str(tmp_path / "m"), "none"))
    assert tables["payment"].count() == 0 and Reconciliation(tables).decomposition.count() == 0


def test_standard_terms_where_none_are_given(spark):
    paid = spark.createDataFrame([("x", "card", 1000), ("y", "upi", 1000)], "merchant_id string, method string, amount_paise long")
    some = spark.createDataFrame([("x", 1200, None, None, None, None, None, 5)], "merchant_id string, gst_bp int, tds_bp int, reserve_bp int, reserve_methods string, instant_bp int, dispute_fee_paise int, tolerance_paise int")
    got = {r.merchant_id: (r.gst_bp, r.reserve_bp, r.tolerance_paise) for r in fees.with_terms(paid, some).collect()}
    assert got == {"x": (1200, 500, 5), "y": (1800, 500, 100)}
    assert fees.with_terms(paid, None).first().gst_bp == 1800
