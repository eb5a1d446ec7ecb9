"""Written tables between the rounds of iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where it is unset and Spark runs in this process alone, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own[0]


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: executors may be lost, and plans stay short."""
    path = f"{shared_dir(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a side that may be broadcast, by a count of its rows; above it joins shuffle.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast of ``df`` if its counted rows, with the hash table around them, are under the bound."""
    return F.broadcast(df) if df.count() * (row_bytes + 64) <= BROADCAST_BYTES else df
