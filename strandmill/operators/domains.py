"""Protein-domain annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The analyses the annotation workflow asks for.
ANALYSES = (
    "TIGRFAM",
    "PRODOM",
    "SMART",
    "PROSITEPROFILES",
    "HAMAP",
    "SUPERFAMILY",
    "PRINTS",
    "PANTHER",
    "GENE3D",
    "PIRSF",
    "COILS",
)


def select_analyses(domains: DataFrame, analyses: tuple[str, ...] = ANALYSES) -> DataFrame:
    """Annotations of the named analyses, in any case."""
    return domains.filter(F.upper("analysis").isin(*(name.upper() for name in analyses)))


def distinct_analyses(domains: DataFrame) -> DataFrame:
    """The analyses that occur, in lower case."""
    return domains.select(F.lower("analysis").alias("analysis")).distinct()


def explode_terms(domains: DataFrame, *keep: str) -> DataFrame:
    """One row per GO term."""
    return domains.select(*keep, F.explode("go_annotations").alias("go_term"))


def record_count(df: DataFrame) -> DataFrame:
    """One row with the number of records, every column of which is evaluated.

    A malformed record fails the count as it fails any other action.
    """
    hashed = F.xxhash64(*df.columns)
    # always 1, but the optimiser cannot know and so has to evaluate the record
    one = F.lit(1) + F.shiftrightunsigned(F.shiftrightunsigned(hashed, 1), 63)
    return df.agg(F.coalesce(F.sum(one), F.lit(0)).cast("bigint").alias("n_records"))
