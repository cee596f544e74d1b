"""Helpers that the operators share: written intermediate tables and row identities."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.session import fresh_dir

BROADCAST_ROWS = 300_000  # rows of a few numbers
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character unchanged."""
    return F.translate(text, UPPER, LOWER)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    return materialise_at(df, label)[0]


def materialise_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``materialise``, with the path for ``forget``."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that no later plan reads."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` <= BROADCAST_ROWS rows; else Spark chooses."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many ``_`` behind it as make it the name of none of ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def held_out(row_id: Column, modulus: int, remainder: int = 2) -> Column:
    """Whether crc32 of ``row_id`` as text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function whose task gives its memory back when it ends.

    Python workers outlive their tasks, and what their allocators keep counts against the executor.
    """

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
