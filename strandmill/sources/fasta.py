"""FASTA records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.sequences import wrap
from strandmill.sources.lines import Paths, drop_marker, read_pieces, write_lines

SEPARATOR = "\n>"


def parse_fasta(pieces: DataFrame) -> DataFrame:
    """Pieces cut at ``\\n>`` as ``header`` and one-line ``sequence``."""
    pieces = drop_marker(pieces)
    header = F.substring_index("piece", "\n", 1)
    ends = F.instr("piece", "\n")
    body = F.when(ends > 0, F.substring(F.col("piece"), ends + 1, F.length("piece"))).otherwise("")
    return pieces.select(
        F.rtrim(header, F.lit("\r")).alias("header"),
        F.replace(F.replace(body, F.lit("\n"), F.lit("")), F.lit("\r"), F.lit("")).alias("sequence"),
    )


def read_fasta(spark: SparkSession, path: Paths) -> DataFrame:
    """One row per record; a plain file is split over as many tasks as it has blocks.

    The first character of every file is its marker, whatever it is, and is dropped.
    """
    return parse_fasta(read_pieces(spark, path, SEPARATOR))


def fasta_text(header: Column, sequence: Column, width: int = 75) -> Column:
    """A record as FASTA text without the final line end."""
    body = F.when(sequence == "", "").otherwise(F.concat(F.lit("\n"), wrap(sequence, width)))
    return F.concat(F.lit(">"), header, body)


def format_fasta(df: DataFrame, width: int = 75) -> DataFrame:
    return df.select(fasta_text(F.col("header"), F.col("sequence"), width).alias("line"))


def write_fasta(
    df: DataFrame, path: str, width: int = 75, gzip: bool = False, mode: str = "errorifexists"
) -> None:
    write_lines(format_fasta(df, width), path, gzip, mode)
