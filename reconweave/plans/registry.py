"""What the registered queries share: derived entities and runs of a session, and the registry itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reconweave.plans.oracle import sql
from reconweave.plans.reconcile import Reconciliation
from reconweave.sources.derive import Entities

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_entities: dict[tuple[str, str], Entities] = {}
_runs: dict[tuple[int, str], Reconciliation] = {}


def entities(spark: SparkSession, sf_dir: str) -> Entities:
    """The derived entities of a directory, written once a session: they stand for tables that a user has on disk."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _entities:
        _entities[key] = Entities(spark, sf_dir)
    return _entities[key]


def run(t: Entities, preset: str = "full") -> Reconciliation:
    """The run of a preset over entities; its stages are shared by the queries of a session."""
    key = (id(t), preset)
    if key not in _runs:
        _runs[key] = Reconciliation(t, preset, like=None if preset == "full" else run(t))
    return _runs[key]


def query(body: str | None = None, text: str | None = None) -> Callable[[Callable], Query]:
    """Register a function of the entity tables under its own name, with the SQL body over the entities, or the whole SQL text."""

    def wrap(f: Callable) -> Query:
        def on_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(entities(spark, sf_dir))

        return _add(f, on_tables, sql(body) if body is not None else text)

    return wrap


def on_table(name: str, text: str | None = None) -> Callable[[Callable], Query]:
    """Register a function of one given table under its own name, with its SQL."""

    def wrap(f: Callable) -> Query:
        def on_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        return _add(f, on_tables, text)

    return wrap


def _add(f: Callable, on_tables: Query, text: str | None) -> Query:
    on_tables.__name__, on_tables.__doc__ = f.__name__, f.__doc__
    on_tables.of = f
    QUERIES[f.__name__] = on_tables
    if text is not None:
        ORACLE_SQL[f.__name__] = text
    return on_tables
