"""Named queries over the test tables, each with its SQL counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandmill.session import ensure_partitions

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table; one that is too small for every core is spread first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return ensure_partitions(df.select(*columns) if columns else df)


def load() -> None:
    """Import the modules that register queries."""
    from strandmill.catalogue import archives, sequences, tabular, text, workflows  # noqa: F401
