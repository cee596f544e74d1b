"""Protein-domain annotations: 11 to 15 tab-separated columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.functions.fields import (
    bar_list,
    optional,
    optional_double,
    required,
    strict_flag,
    tab_fields,
)
from strandmill.sources.lines import Paths, read_lines


def parse_domains(lines: DataFrame, *keep: str) -> DataFrame:
    """The ``line`` column as typed annotations.

    The score is null unless it is a number; columns 12 to 15 may be absent, which
    gives nulls and an empty list of GO terms.
    """
    fields = tab_fields("line")
    return lines.select(
        *keep,
        required(fields, 0).alias("protein_accession"),
        required(fields, 1).alias("sequence_digest"),
        required(fields, 2, "bigint").alias("sequence_length"),
        required(fields, 3).alias("analysis"),
        required(fields, 4).alias("signature_accession"),
        required(fields, 5).alias("signature_description"),
        required(fields, 6, "bigint").alias("start_location"),
        required(fields, 7, "bigint").alias("stop_location"),
        optional_double(required(fields, 8)).alias("score"),
        strict_flag(required(fields, 9)).alias("status"),
        required(fields, 10).alias("date"),
        optional(fields, 11).alias("interpro_accession"),
        optional(fields, 12).alias("interpro_description"),
        bar_list(optional(fields, 13)).alias("go_annotations"),
        optional(fields, 14).alias("pathway_annotations"),
    )


def read_domains(spark: SparkSession, path: Paths) -> DataFrame:
    return parse_domains(read_lines(spark, path))
