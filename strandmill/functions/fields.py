"""Delimited-text fields: strict and optional casts, flags, lists.

Strict forms raise whatever ``spark.sql.ansi.enabled`` says, so a malformed row is
never turned into a silent null. With the setting on, its own casts and array lookups do
that, and their code is small enough for the JVM to compile a wide record as one method.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def tab_fields(line: Column | str) -> Column:
    """Split on tabs; empty columns at the end of a line count as absent."""
    return F.split(F.rtrim(line, F.lit("\t")), "\t")


def _ansi() -> bool:
    return SparkSession.active().conf.get("spark.sql.ansi.enabled") == "true"


def required(fields: Column, index: int, data_type: str = "string") -> Column:
    """Field ``index`` as ``data_type``, or an error."""
    if _ansi():
        # a text line is never null; saying so keeps joins from filtering on a second parse
        text = F.coalesce(fields[index], F.lit(""))
        return text if data_type == "string" else text.cast(data_type)
    raw = F.get(fields, F.lit(index))
    value = raw if data_type == "string" else raw.try_cast(data_type)
    problem = F.concat(
        F.lit(f"column {index + 1} is missing or not {data_type}: "),
        F.coalesce(raw, F.lit("(missing)")),
    )
    return F.coalesce(value, F.raise_error(problem).cast(data_type))


def optional(fields: Column, index: int) -> Column:
    """Field ``index``, or null past the end of the line."""
    return F.get(fields, F.lit(index))


def optional_double(text: Column) -> Column:
    """A double, or null where the text is not a number."""
    return text.try_cast("double")


def strict_flag(text: Column) -> Column:
    """``T`` or ``F`` as a boolean; anything else raises."""
    return (
        F.when(text == "T", F.lit(True))
        .when(text == "F", F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("flag is neither T nor F: "), text)).cast("boolean"))
    )


def bar_list(text: Column) -> Column:
    """Split on ``|``: null gives an empty list, empty pieces at the end are dropped."""
    trimmed = F.rtrim(text, F.lit("|"))
    return (
        F.when(text.isNull() | ((trimmed == "") & (text != "")), F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, r"\|"))
    )


def comma_list(text: Column | str) -> Column:
    """Split on commas, without the empty pieces."""
    return F.array_remove(F.split(text, ","), "")
