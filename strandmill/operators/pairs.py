"""Mate pairs: the left and the right read of one fragment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.sources.fastq import SEPARATOR, parse_fastq, records_per_stretch, sub_block
from strandmill.sources.lines import Paths, read_pieces, small_per_split

FIELDS = ("header", "sequence", "opt_header", "quality_scores")


def read_id(header: Column) -> Column:
    """The part of a header before the first space."""
    return F.substring_index(header, " ", 1)


def _side(reads: DataFrame, side: str, key: str) -> DataFrame:
    return reads.select(key, *(F.col(field).alias(f"{side}_{field}") for field in FIELDS))


def positioned(pieces: DataFrame, fast: bool = False) -> DataFrame:
    """FASTQ pieces as reads numbered from 0, file after file in path order.

    Reads are numbered inside stretches of 65,536 pieces of a split, and what comes before a stretch is added
    from a table of one row per stretch. They are ranked by a window over the stretch, and the table joins in the same
    partitioning. The fast path numbers them as they are scanned, from a table of one row per split.
    A ``.gz`` file is many stretches, so no task sorts a file.
    """
    counts = records_per_stretch(pieces)
    # files after files, then stretches inside a file: the first window has one row per file
    files = counts.groupBy("source").agg(F.sum("n_records").alias("in_file"))
    before_file = W.orderBy("source").rowsBetween(W.unboundedPreceding, -1)
    in_file = W.partitionBy("source").orderBy("block", "sub").rowsBetween(W.unboundedPreceding, -1)
    starts = files.select("source", F.coalesce(F.sum("in_file").over(before_file), F.lit(0)).alias("file_offset"))
    offsets = counts.join(starts, "source").select(
        "source",
        "block",
        "sub",
        "first_seq",
        (F.col("file_offset") + F.coalesce(F.sum("n_records").over(in_file), F.lit(0))).alias("offset"),
    )
    reads = parse_fastq(pieces, fast, with_place=True)
    if fast:
        # one row per split, joined by the hash of its path
        splits = offsets.groupBy(F.xxhash64("source").alias("file_key"), "block").agg(
            F.min("first_seq").alias("first_seq"), F.min("offset").alias("offset")
        )
        reads = reads.withColumn("file_key", F.xxhash64("source")).join(small_per_split(splits), ["file_key", "block"])
        rank = F.col("seq") - F.col("first_seq")
    else:
        in_stretch = W.partitionBy("source", "block", "sub").orderBy("seq")
        reads = reads.withColumn("sub", sub_block()).withColumn("rank", F.row_number().over(in_stretch))
        reads = reads.join(offsets, ["source", "block", "sub"])
        rank = F.col("rank") - 1
    return reads.select(*FIELDS, (F.col("offset") + rank).alias("position"))


def pair_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """The n-th left read with the n-th right read; both carry a ``position``.

    Sides of unequal length fail the query, as every later pair may join different fragments.
    """
    both = _side(left, "left", "position").join(_side(right, "right", "position"), "position", "full")
    problem = F.concat(F.lit("a side has no read at position "), F.col("position"))
    complete = F.col("left_header").isNotNull() & F.col("right_header").isNotNull()
    position = F.when(complete, F.col("position")).otherwise(F.raise_error(problem).cast("bigint"))
    return both.withColumn("position", position)


def pair_by_id(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left and right reads with the same id; an id that repeats on a side fails the query.

    The check counts ids with partial aggregates, so a repeated id is found without
    multiplying its reads.
    """
    sides = [reads.withColumn("read_id", read_id(F.col("header"))) for reads in (left, right)]
    tallies = [
        side.groupBy("read_id").agg(F.count("*").alias("n_reads"), F.first(F.struct(*FIELDS)).alias("read"))
        for side in sides
    ]
    problem = F.concat(F.lit("read id occurs more than once on a side: "), F.col("read_id"))

    def single(tally: DataFrame, name: str) -> DataFrame:
        read = F.when(F.col("n_reads") == 1, F.col("read"))
        checked = F.coalesce(read, F.raise_error(problem).cast(tally.schema["read"].dataType))
        return tally.select("read_id", checked.alias("read")).select(
            "read_id", *(F.col(f"read.{field}").alias(f"{name}_{field}") for field in FIELDS)
        )

    return single(tallies[0], "left").join(single(tallies[1], "right"), "read_id")


def read_fastq_pairs(
    spark: SparkSession, left: Paths, right: Paths, on: str = "position", fast: bool = False
) -> DataFrame:
    """Paired FASTQ files, matched by ``position`` or by ``id``."""
    if on not in ("position", "id"):
        raise ValueError(f"cannot pair on {on!r}")
    sides = [read_pieces(spark, path, SEPARATOR) for path in (left, right)]
    if on == "position":
        return pair_by_position(*(positioned(pieces, fast) for pieces in sides))
    return pair_by_id(*(parse_fastq(pieces, fast) for pieces in sides))
