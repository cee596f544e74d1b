"""Records as JSON documents, one per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_json_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """Every row as one JSON object; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias(column))


def from_json_rows(df: DataFrame, schema: str | T.StructType, column: str = "json") -> DataFrame:
    """The records of a JSON column; a document that does not fit the schema raises."""
    parsed = F.from_json(column, schema, {"mode": "FAILFAST"})
    return df.select(F.inline(F.array(parsed)))
