"""Tables with versions and saved runs: a write that fails leaves what was there."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reconweave.sources import sinks

SCHEMA = "merchant_id string, x int"


@pytest.fixture
def df(spark):
    return spark.createDataFrame([("m", 1), ("n", 2)], SCHEMA)


def torn(df):
    return df.withColumn("x", F.when(F.col("x") > 0, F.raise_error(F.lit("no room"))).cast("int"))


def rows(df):
    return sorted(map(tuple, df.select("merchant_id", "x").collect()))


def test_a_failed_save_leaves_the_run_before_it(spark, tmp_path, df):
    runs = sinks.Runs(spark, str(tmp_path))
    runs.save({"summary": df, "b": df}, "r1")
    with pytest.raises(PySparkException):
        runs.save({"summary": df.limit(1), "b": torn(df)}, "r1")
    assert rows(runs.read("summary", "r1")) == rows(runs.read("b", "r1")) == [("m", 1), ("n", 2)]
    runs.save({"summary": df.limit(1), "b": df.limit(1)}, "r1")
    assert len(rows(runs.read("summary", "r1"))) == 1
    with pytest.raises(ValueError, match="not saved"):
        runs.read("summary", "r2")


def test_the_last_run_that_succeeded(spark, tmp_path, df):
    runs = sinks.Runs(spark, str(tmp_path))
    assert runs.latest().count() == 0 and runs.listing().count() == 0
    runs.save({"summary": df}, "1", "exact")
    runs.save({"summary": df.where("merchant_id = 'm'")}, "2")
    with pytest.raises(PySparkException):
        runs.save({"summary": torn(df)}, "3")
    assert {r.merchant_id: (r.run_id, r.preset) for r in runs.latest().collect()} == {"m": ("2", "full"), "n": ("1", "exact")}
    listed = runs.listing().collect()
    assert [(r.run_id, r.state) for r in listed] == [("3", "FAILED"), ("2", "SUCCEEDED"), ("1", "SUCCEEDED")]
    assert runs.listing(0).count() == 1 and runs.listing(9999).count() == 3
    assert [r.run_id for r in runs.listing(1, before=listed[1].at).collect()] == ["1"]
    read = runs.events("SUCCEEDED")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read and "state" in read.split("PartitionFilters")[1][:80]


def test_inserts_leave_each_key_once_on_disk(spark, tmp_path, df):
    table = sinks.KeyedTable(spark, str(tmp_path), ["merchant_id"], SCHEMA, 4)
    assert table.read().count() == 0 and table.version() == 0
    assert table.insert(df.unionByName(df.withColumn("x", F.col("x") + 10)), ["x"]) == 1
    more = spark.createDataFrame([("m", 9), ("o", 3)], SCHEMA)
    assert table.insert(more, ["x"]) == 2
    assert rows(table.read()) == [("m", 1), ("n", 2), ("o", 3)] and rows(table.read(1)) == [("m", 1), ("n", 2)]
    assert table.upsert(more) == 3
    assert rows(table.read()) == [("m", 9), ("n", 2), ("o", 3)] and rows(table.read(2)) == [("m", 1), ("n", 2), ("o", 3)]
    with pytest.raises(PySparkException):
        table.upsert(torn(more))
    assert table.version() == 3 and rows(table.read()) == [("m", 9), ("n", 2), ("o", 3)]
    # of two writers that start from one version the later fails
    with pytest.raises(PySparkException):
        table.insert(spark.createDataFrame([("p", 1)], SCHEMA), ["x"], before=2)
    assert rows(table.read()) == [("m", 9), ("n", 2), ("o", 3)]


def test_an_insert_reads_only_the_buckets_of_its_rows(spark, tmp_path):
    table = sinks.KeyedTable(spark, str(tmp_path), ["merchant_id"], SCHEMA, 8)
    table.insert(spark.createDataFrame([(f"k{i}", i) for i in range(100)], SCHEMA), ["x"])
    assert table.read(buckets=[3]).count() < 40 and sum(table.read(buckets=[b]).count() for b in range(8)) == 100
