"""Similarity hits: union over database splits, cut-offs, best subjects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.sources.hits import parse_hits


def union_hits(splits: list[DataFrame]) -> DataFrame:
    """All hits of several database splits, numbered from 1 in ``split_id``."""
    numbered = [hits.withColumn("split_id", F.lit(n)) for n, hits in enumerate(splits, 1)]
    return reduce(DataFrame.unionByName, numbered)


def read_split_hits(spark: SparkSession, path: str) -> DataFrame:
    """The hits of all splits below ``path``, whichever there are, by folders ``split_id=<n>``."""
    return parse_hits(spark.read.text(path).withColumnRenamed("value", "line"), "split_id")


def filter_evalue(hits: DataFrame, cutoff: float = 1e-5) -> DataFrame:
    return hits.filter(F.col("e_value") <= cutoff)


def top_hits(hits: DataFrame, k: int = 5, by: tuple[str, ...] = ("query_id", "split_id")) -> DataFrame:
    """The hits of the ``k`` best subjects of every ``by`` group, with ``subject_rank``.

    Subjects rank by their best hit: smallest e-value, then largest bit score, then id.

    Hits are read once and shuffled once whole, by group and subject, so that a query with a third of all
    hits is spread by its subjects; windows over one subject's hits spill where they must. Of
    each task's groups only the hits of its first ``k`` subjects go on to the ranking.
    """
    subject = W.partitionBy(*by, "subject_id")
    best = F.min(F.struct("e_value", (-F.col("bit_score")).alias("minus_score"))).over(subject)
    order = W.partitionBy(*by).orderBy("__best.e_value", "__best.minus_score", "subject_id")
    ranked = hits.withColumn("__best", best).withColumn("subject_rank", F.dense_rank().over(order))
    return ranked.filter(F.col("subject_rank") <= k).drop("__best")


def best_hits(hits: DataFrame, k: int = 1) -> DataFrame:
    """The hits of each query's ``k`` best subjects over all splits."""
    return top_hits(hits, k, ("query_id",))
