"""Lazy checks that fail a query when the data breaks a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fail_on(result: DataFrame, violations: DataFrame, message: Column) -> DataFrame:
    """``result``, failing with ``message`` if ``violations`` has a row."""
    first, *others = result.schema.fields
    failing = F.raise_error(message).cast(first.dataType).alias(first.name)
    nothing = (F.lit(None).cast(field.dataType).alias(field.name) for field in others)
    return result.unionByName(violations.select(failing, *nothing))
