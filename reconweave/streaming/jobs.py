"""Streams: validated ingest, idempotent posting, rate flags, wash pairs, stale work items.

Each is a transformation that also runs on batch tables, so tests and SQL can
hold the same code against known rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reconweave.functions.durable import written
from reconweave.operators import ledger as chain
from reconweave.sources import ingest, sinks


#: Parts of the table of committed ids, of which a micro-batch reads those that its ids fall into.
ID_BUCKETS = 64


def landing_files(spark: SparkSession, folder: str, merchant_id: str) -> DataFrame:
    """Stream of (merchant_id, file, content) of the files that land in a folder."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup",
        True).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return files.select(F.lit(merchant_id).alias("merchant_id"), F.col("path").alias("file"), "content")


def ingest_stream(files: DataFrame, entity: str, out: str, checkpoint: str) -> StreamingQuery:
    """Pass each micro-batch through the gates and rules against what is committed; append accepted rows, rejects and ids.

    A batch writes under its own number, so a replayed batch overwrites itself.
    Committed ids are a table of their own by hash, of which only the parts in
    question are read.
    """
    key = next(iter(ingest.ENTITIES[entity]))
    bucket = F.pmod(F.xxhash64("merchant_id", key), F.lit(ID_BUCKETS)).cast("int")

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        gated = ingest.gate_files(batch, entity).persist()
        rows = ingest.validate(ingest.lines_of(gated), entity)
        # one id in two files of a micro-batch: the file first in name order keeps it
        first = rows.where("reject_reason is null").groupBy("merchant_id", key).agg(F.min("file").alias("_first"))
        rows = rows.join(first, ["merchant_id", key], "left").withColumn("bucket", bucket).persist()
        known = rows.select("merchant_id", key, "bucket").limit(0)
        if number:
            wanted = [r.bucket for r in rows.where("_first is not null").select("bucket").distinct().collect()]
            known = spark.read.schema(f"merchant_id string, {key} string, batch int, bucket int").parquet(f"{out}/ids").where((F.col("batch") < number) & F.col("bucket").isin(wanted))
        rows = rows.join(known.select("merchant_id", key, F.lit(True).alias("_known")), ["merchant_id", key], "left")
        taken = F.col("reject_reason").isNull() & (F.col("_known") | (F.col("file") != F.col("_first")))
        rows = rows.withColumns({"reject_reason": F.when(taken, "DUPLICATE_EXISTING").otherwise(F.col("reject_reason")),
            "detail": F.when(taken, F.concat(F.lit("already committed: "), F.col(key))).otherwise(F.col("detail"))})
        kept = rows.where("reject_reason is null")
        kept.drop("reject_reason", "detail", "line", "_first", "_known", "bucket").write.mode("overwrite").parquet(f"{out}/accepted/batch={number}")
        ingest.refused_files(gated).unionByName(ingest.rejects(rows)).write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        kept.select("merchant_id", key, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/ids/batch={number}")
        rows.unpersist()
        gated.unpersist()

    return files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def post_decisions(decided: DataFrame, out: str, number: int) -> DataFrame:
    """Append one batch of decisions to the ledger of the earlier batches; a replay of the batch gives the same rows.

    The ends of the chains and the keys that were posted are tables of their
    own, with a version a batch. A batch reads the heads and the keys in the buckets
    of its own rows, never the ledger.
    """
    spark = decided.sparkSession
    keys = sinks.KeyedTable(spark, f"{out}/keys", ["merchant_id", "idempotency_key"], "merchant_id string, idempotency_key string", 256)
    heads = sinks.KeyedTable(spark, f"{out}/heads", ["merchant_id"], chain.HEADS, 64)
    entries = written(chain.entries(decided))
    new = chain.chained(entries, keys.of(entries, number), heads.of(entries, number))
    new.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
    rows = spark.read.schema(new.schema).parquet(f"{out}/rows/batch={number}")
    keys.insert(rows.select("merchant_id", "idempotency_key"), ["merchant_id"], number, replay=True)
    heads.upsert(chain.heads(rows), number, replay=True)
    return rows


def posted(spark: SparkSession, out: str) -> DataFrame:
    """The ledger of all batches."""
    return spark.read.parquet(f"{out}/rows").drop("batch")


def rate_flags(events: DataFrame, key: str, at: str, limit: int, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Keys with more than ``limit`` events in a tumbling window; on a stream, windows close behind the watermark."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    counts = rows.groupBy(F.window(at, width).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select(F.col("w.start").alias("window_start"), key, "n")


def wash_stream(credits: DataFrame, debits: DataFrame, days: int = 5) -> DataFrame:
    """Interval join of credits and return debits (merchant_id, amount, ref, at, id): same reference and size, the debit within ``days`` after."""
    c = credits.withWatermark("at", f"{days} days").select("merchant_id", "amount", "ref", F.col("at").alias("c_at"), F.col("id").alias("credit"))
    d = debits.withWatermark("at", f"{days} days").select(F.col("merchant_id").alias("m"), F.col("amount").alias("a"), F.col("ref").alias("r"),
        F.col("at").alias("d_at"), F.col("id").alias("debit"))
    near = F.expr(f"d_at >= c_at AND d_at <= c_at + INTERVAL {days} DAYS")
    return c.join(d, (F.col("merchant_id") == F.col("m")) & (F.col("amount") == -F.col("a")) & (F.col("ref") == F.col("r")) & near).select("merchant_id", "credit", "debit")


def stale_items(events: DataFrame, key: str, at: str, state: str, claimed: str, now, minutes: int) -> DataFrame:
    """Items whose last event is a claim that is older than ``minutes``."""
    last = events.groupBy(key).agg(F.max_by(F.col(state), F.struct(at, state)).alias("state"), F.max(at).alias("at"))
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    return last.where((F.col("state") == claimed) & (F.col("at") < limit)).select(key, F.col("at").alias("claimed_at"))
