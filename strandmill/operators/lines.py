"""Line filters and word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.patterns import java_pattern
from strandmill.functions.words import count_words


def filter_contains(df: DataFrame, query: str, column: str = "line") -> DataFrame:
    """Rows whose text holds ``query``, literally and case-sensitively."""
    return df.filter(F.col(column).contains(query))


def grep(df: DataFrame, pattern: str, syntax: str = "bre", column: str = "line") -> DataFrame:
    """Rows in which the pattern is found; ``syntax`` is ``bre``, ``java`` or ``fixed``."""
    return df.filter(F.col(column).rlike(java_pattern(pattern, syntax)))


def passthrough(df: DataFrame) -> DataFrame:
    """The identity."""
    return df


def words_per_line(df: DataFrame, rule: str = "space", column: str = "line") -> DataFrame:
    return df.withColumn("n_words", count_words(column, rule))


def total_words(df: DataFrame, rule: str = "space", column: str = "line") -> DataFrame:
    """One row with the number of words, 0 when there are no lines."""
    n_words = F.sum(count_words(column, rule).cast("bigint"))
    return df.agg(F.coalesce(n_words, F.lit(0).cast("bigint")).alias("n_words"))


def count_words_in_matching(df: DataFrame, query: str, column: str = "line") -> DataFrame:
    """Words in the lines that hold ``query``."""
    return total_words(filter_contains(df, query, column), column=column)


def partition_words(df: DataFrame, rule: str = "space", column: str = "line") -> DataFrame:
    """The number of words of every partition that has lines."""
    return (
        df.groupBy(F.spark_partition_id().alias("part_id"))
        .agg(F.sum(count_words(column, rule).cast("bigint")).alias("n_words"))
    )
