"""Result tables on disk: keyed tables with versions, whole runs, and the registry of runs.

Nothing that a reader may hold is overwritten. Data goes to folders of its own,
and a version of a table is a manifest that lists them; it counts once it is
written whole. So a write that fails leaves the version before it, and files
stay until no manifest names them.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconweave.functions.durable import written

#: Least and most rows of a listing, and what it has without a wish.
LISTING = {"runs": (1, 200, 20), "ledger": (1, 500, 100)}
EVENTS = "run_id string, preset string, state string, at timestamp, merchant_id string, version string"


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A table, or one without rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class KeyedTable:
    """A table with one row a key, dealt over buckets; each version's manifest names the folders of every bucket.

    An insert or upsert reads and writes the buckets of its rows alone. Writers
    take turns: of two that make one version the later fails, unless it is told to
    ``replay``, to make that version again.
    """

    MANIFEST = "bucket int, folder string"

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.root, self.keys, self.schema, self.buckets = spark, root.rstrip("/"), keys, schema, buckets

    def version(self) -> int:
        """Number of the last whole version, 0 before the first."""
        found = _read(self.spark, self.MANIFEST + ", number int", f"{self.root}/manifest")
        return found.agg(F.max("number")).first()[0] or 0

    def _manifest(self, number: int) -> list:
        """(bucket, folder) rows of a version: as many as there are buckets and folders in them, which :meth:`upsert` and :meth:`insert` keep few."""
        return _read(self.spark, self.MANIFEST, f"{self.root}/manifest/number={number}").collect() if number else []

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (default: the last), of some buckets only if these are given."""
        rows = self._manifest(self.version() if number is None else number)
        paths = sorted({f"{self.root}/data/{r.folder}/bucket={r.bucket}" for r in rows if buckets is None or r.bucket in buckets})
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def of(self, rows: DataFrame, number: int) -> DataFrame:
        """The rows of a version in the buckets in which the keys of ``rows`` lie."""
        touched = [r.bucket for r in self._dealt(rows).select("bucket").distinct().collect()]
        return self.read(number, touched)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _commit(self, rows: DataFrame, before: int, replace: bool, replay: bool) -> int:
        """Write dealt ``rows`` and the manifest of the version after ``before``; with ``replace`` they are all that their buckets hold."""
        folder = uuid.uuid4().hex
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        new = {r.bucket for r in _read(self.spark, self.schema + ", bucket int", f"{self.root}/data/{folder}").select("bucket").distinct().collect()}
        kept = [(r.bucket, r.folder) for r in self._manifest(before) if not (replace and r.bucket in new)]
        lines = kept + [(b, folder) for b in sorted(new)]
        manifest = self.spark.createDataFrame(lines, self.MANIFEST).coalesce(1)
        manifest.write.mode("overwrite" if replay else "errorifexists").parquet(f"{self.root}/manifest/number={before + 1}")
        return before + 1

    def insert(self, new: DataFrame, order: list[str], before: int | None = None, replay: bool = False) -> int:
        """Add the rows whose key is not there yet, of equal keys the first in ``order``; gives the new version's number."""
        before = self.version() if before is None else before
        rows = written(self._dealt(first_rows(new, self.keys, order)))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        there = self.read(before, touched).select(*self.keys)
        return self._commit(rows.join(there, self.keys, "left_anti"), before, False, replay)

    def upsert(self, new: DataFrame, before: int | None = None, replay: bool = False) -> int:
        """Put rows in the place of those with equal keys; keys of ``new`` are unique. Gives the new version's number."""
        before = self.version() if before is None else before
        rows = written(self._dealt(new))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        rest = self._dealt(self.read(before, touched)).join(rows.select(*self.keys), self.keys, "left_anti")
        return self._commit(rest.unionByName(rows.select(*rest.columns)), before, True, replay)


def first_rows(new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in ``order``."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


class Runs:
    """Saved runs under a folder: their tables, and an event for each start, success and failure."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _event(self, run_id: str, preset: str, state: str, merchants: DataFrame | None = None, version: str = "") -> None:
        """A row for each merchant of the run, or one for a run that has none yet."""
        rows = merchants.select("merchant_id").distinct() if merchants is not None else self.spark.range(1).select(F.lit("").alias("merchant_id"))
        at = F.lit(datetime.now(UTC).isoformat()).cast("timestamp")
        event = rows.select(F.lit(run_id).alias("run_id"), F.lit(preset).alias("preset"), at.alias("at"), "merchant_id", F.lit(version).alias("version"))
        event.coalesce(1).write.parquet(f"{self.root}/events/state={state}/event={uuid.uuid4().hex}")

    def save(self, results: dict[str, DataFrame], run_id: str, preset: str = "full", summary: str = "summary") -> None:
        """Write all tables of a run, then the event that makes them count; ``summary`` names the table with all its merchants."""
        self._event(run_id, preset, "RUNNING")
        version = uuid.uuid4().hex
        try:
            for name, df in results.items():
                df.write.partitionBy("merchant_id").parquet(f"{self.root}/{name}/version={version}")
            self._event(run_id, preset, "SUCCEEDED", self.spark.read.parquet(f"{self.root}/{summary}/version={version}"), version)
        except Exception:
            self._event(run_id, preset, "FAILED")
            raise

    def events(self, state: str | None = None) -> DataFrame:
        """All events, or those of one state, whose part alone is read."""
        rows = _read(self.spark, EVENTS, f"{self.root}/events")
        return rows if state is None else rows.where(F.col("state") == state)

    def latest(self) -> DataFrame:
        """(merchant_id, run_id, preset, version): the last run of each merchant that succeeded."""
        last = F.max_by(F.struct("run_id", "preset", "version"), F.struct("at", "version")).alias("r")
        return self.events("SUCCEEDED").groupBy("merchant_id").agg(last).select("merchant_id", "r.*")

    def listing(self, limit: int | None = None, before=None) -> DataFrame:
        """Runs with their present state, newest first, ``before`` a time for the next page."""
        least, most, usual = LISTING["runs"]
        order = F.struct("at", F.col("state") != "RUNNING")
        runs = self.events().groupBy("run_id").agg(F.max_by("preset", order).alias("preset"), F.max_by("state", order).alias("state"), F.max("at").alias("at"))
        runs = runs if before is None else runs.where(F.col("at") < F.lit(before))
        return runs.orderBy(F.desc("at"), "run_id").limit(max(least, min(most, usual if limit is None else limit)))

    def read(self, name: str, run_id: str) -> DataFrame:
        """A table of a run, as it was last saved whole; refuses a run that never was."""
        done = self.events("SUCCEEDED").where(F.col("run_id") == run_id).agg(F.max_by("version", F.struct("at", "version"))).first()[0]
        if done is None:
            raise ValueError(f"run {run_id} was not saved")
        path = f"{self.root}/{name}/version={done}"
        return self.spark.read.option("basePath", path).parquet(path)
