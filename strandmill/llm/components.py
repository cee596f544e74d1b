"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import forget, materialise_at, small

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One star operation over at most ``rows`` edges (a, b) with a > b.

    Large: every node links its larger neighbours to the smallest node it sees. Small: every
    node links its smaller neighbours and itself to the smallest of them. Both keep the components.
    An edge may come out more than once.
    """
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    joined = near.join(small(least, 2 * rows), "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
    # the edge to the smallest itself carries the node's own link
    return joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), the root being its component's smallest node.

    Rounds grow with the logarithm of the longest path; each round is written to the shared
    folder. Edges with a null end and loops are ignored.
    """
    spark = edges.sparkSession
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now, path = materialise_at(ordered, f"{label}-edges")
    seen, rows = None, now.count()
    for _ in range(MAX_ROUNDS):
        after, after_path = materialise_at(_star(_star(now, True, rows), False, rows).distinct(), f"{label}-stars")
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        forget(spark, path)
        now, path = after, after_path
        if state == seen:
            break
        seen, rows = state, state[0]
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
