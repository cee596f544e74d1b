"""Plain text lines, and the splitting of text files into longer pieces."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.session import ensure_partitions

Paths = str | list[str]
BROADCAST_FILES = 2_000_000


def read_lines(spark: SparkSession, path: Paths, multiplier: float | None = None) -> DataFrame:
    r"""One row per line (``\n``, ``\r\n`` or ``\r``); globs and ``.gz`` files work.

    ``multiplier`` asks for that many partitions per default core.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines if multiplier is None else ensure_partitions(lines, multiplier)


def lines_of(df: DataFrame, text: str, *keep: str, newline: str = "\n") -> DataFrame:
    """The lines of a text column, next to the ``keep`` columns."""
    return df.select(*keep, F.explode(F.split(text, newline)).alias("line"))


def write_lines(df: DataFrame, path: str, gzip: bool = False, mode: str = "errorifexists") -> None:
    """One text column to files, one line per row."""
    df.write.mode(mode).text(path, compression="gzip" if gzip else "none")


def from_records(
    spark: SparkSession, rows: Iterable, schema: str, multiplier: float = 3.0
) -> DataFrame:
    """Driver-side records as a DataFrame of ``defaultParallelism * multiplier`` partitions."""
    wanted = max(1, int(spark.sparkContext.defaultParallelism * multiplier))
    return spark.createDataFrame(rows, schema).repartition(wanted)


def read_pieces(spark: SparkSession, path: Paths, separator: str) -> DataFrame:
    """Text files cut at ``separator``, which the pieces themselves lose.

    Plain files stay splittable, so one huge file is read by many tasks. ``source``,
    ``block`` and ``seq`` give a piece's place: file, start of its split, and order
    within that split. ``block_end`` and ``source_size`` tell where the split and the
    file end.
    """
    return spark.read.text(path, lineSep=separator).select(
        F.col("value").alias("piece"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length")).alias("block_end"),
        F.col("_metadata.file_size").alias("source_size"),
    )


def first_pieces(pieces: DataFrame) -> DataFrame:
    """``source`` and the ``seq`` of each file's first piece; a light scan of first splits."""
    return (
        pieces.filter(F.col("block") == 0)
        .groupBy("source")
        .agg(F.min("seq").alias("first_seq"))
    )


def drop_marker(pieces: DataFrame, starts_record: Column | None = None) -> DataFrame:
    """Remove the one character that opens a file; the separator has eaten every other marker.

    The first piece is the first of its file's first split, whatever its text and however the file is
    split. It is found by its number in one table of a number per file, which is broadcast while
    the files are at most ``BROADCAST_FILES``.
    """
    firsts = first_pieces(pieces).select("first_seq")
    if len(pieces.inputFiles()) <= BROADCAST_FILES:
        firsts = F.broadcast(firsts)
    opens = F.col("first_seq").isNotNull()
    if starts_record is not None:
        opens = opens & starts_record
    marked = pieces.join(firsts, F.col("seq") == F.col("first_seq"), "left")
    return marked.withColumn("piece", F.when(opens, F.expr("substring(piece, 2)")).otherwise(F.col("piece"))).select(*pieces.columns)


def small_per_split(per_split: DataFrame) -> DataFrame:
    """Broadcast a table of one row per file split.

    A row is a few numbers (paths are joined by their hash): the 800,000 splits of 100 TB are about
    40 MB. The driver lists every split to plan the scan, so there are no more than it can hold.
    """
    return F.broadcast(per_split)
