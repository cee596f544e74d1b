"""Tabular similarity hits: 12 tab-separated columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill import schemas
from strandmill.functions.fields import required, tab_fields
from strandmill.sources.lines import Paths, read_lines


def parse_hits(lines: DataFrame, *keep: str) -> DataFrame:
    """The ``line`` column as typed hits; a short or non-numeric line raises.

    Columns beyond the twelfth are ignored.
    """
    fields = tab_fields("line")
    columns = [part.strip().split(" ") for part in schemas.HITS.split(",")]
    return lines.select(
        *keep,
        *(
            required(fields, index, data_type.lower()).alias(name)
            for index, (name, data_type) in enumerate(columns)
        ),
    )


def read_hits(spark: SparkSession, path: Paths) -> DataFrame:
    return parse_hits(read_lines(spark, path))


def hit_line() -> F.Column:
    """The columns of a hit as one tab-separated line."""
    names = [part.strip().split(" ")[0] for part in schemas.HITS.split(",")]
    return F.concat_ws("\t", *(F.col(name).cast("string") for name in names)).alias("line")
