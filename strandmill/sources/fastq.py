"""FASTQ records.

Files are cut at a line end followed by ``@``. A quality line may begin with ``@`` too,
and then cuts its record in two: a piece of three lines and a piece with the rest of
the quality line. Whole records never leave their task; only such halves are shuffled,
by stretches of a split, and at most two of them per stretch by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.sources.lines import Paths, drop_marker, read_pieces, write_lines

SEPARATOR = "\n@"
PLACE = ("source", "block", "seq")
SUB_BLOCK_BITS = 16


def sub_block() -> Column:
    """The stretch of 65,536 pieces of its split that a piece is in, so that no window is a whole file."""
    return F.shiftright("seq", SUB_BLOCK_BITS)


def _line(index: int) -> Column:
    return F.rtrim(F.get(F.split("piece", "\n"), F.lit(index)), F.lit("\r"))


def _has_lines(n: int) -> Column:
    """Whether a piece has at least ``n`` lines, without splitting it."""
    return F.substring_index("piece", "\n", n - 1) != F.col("piece")


def _records(pieces: DataFrame, quality: Column, *extra: str) -> DataFrame:
    return pieces.select(
        _line(0).alias("header"),
        _line(1).alias("sequence"),
        _line(2).alias("opt_header"),
        quality.alias("quality_scores"),
        *extra,
    )


def _joined_halves(halves: DataFrame) -> DataFrame:
    """Records from pieces of fewer than four lines; a half without its mate raises."""
    in_split = W.partitionBy("source", "block", sub_block()).orderBy("seq")
    next_is_tail = (F.lead("seq").over(in_split) == F.col("seq") + 1) & ~F.lead("opens").over(in_split)
    after_opener = (F.lag("seq").over(in_split) == F.col("seq") - 1) & F.lag("opens").over(in_split)
    marked = halves.select(
        *PLACE,
        "piece",
        "opens",
        F.when(F.col("opens") & next_is_tail, F.lead(_line(0)).over(in_split)).alias("tail"),
        (~F.col("opens") & F.coalesce(after_opener, F.lit(False))).alias("taken"),
    ).filter(~F.col("taken"))

    # what has no mate yet lies at the ends of stretches: at most one piece at either end
    in_file = W.partitionBy("source").orderBy("block", "seq")
    loose = (
        marked.filter(F.col("tail").isNull())
        .withColumn("tail", F.when(~F.lead("opens").over(in_file), F.lead(_line(0)).over(in_file)))
        .withColumn("taken", ~F.col("opens") & F.coalesce(F.lag("opens").over(in_file), F.lit(False)))
        .filter(~F.col("taken"))
    )
    checked = F.when(F.col("opens") & F.col("tail").isNotNull(), F.col("tail")).otherwise(
        F.raise_error(F.concat(F.lit("incomplete FASTQ record in "), F.col("source"))).cast("string")
    )
    paired = marked.filter(F.col("tail").isNotNull())
    return _records(paired, F.concat(F.lit("@"), F.col("tail")), *PLACE).unionByName(
        _records(loose, F.concat(F.lit("@"), checked), *PLACE)
    )


def parse_fastq(
    pieces: DataFrame, fast: bool = False, with_place: bool = False
) -> DataFrame:
    """Pieces cut at ``\\n@`` as records; see :func:`read_fastq`."""
    counted = pieces.select(*PLACE, "piece", _has_lines(3).alias("opens"), _has_lines(4).alias("whole"))
    pieces = drop_marker(counted, F.col("opens"))
    whole = F.col("whole")
    if fast:
        quality = F.when(whole, _line(3)).otherwise(
            F.raise_error(F.lit("a quality line begins with @; read without fast")).cast("string")
        )
        records = _records(pieces, quality, *PLACE)
    else:
        halves = _joined_halves(pieces.filter(~whole))
        records = _records(pieces.filter(whole), _line(3), *PLACE).unionByName(halves)
    return records if with_place else records.drop(*PLACE)


def records_per_stretch(pieces: DataFrame) -> DataFrame:
    """How many records begin in each stretch of a split (``sub``), and its first ``seq``; one light scan."""
    opens = F.when(_has_lines(3), 1)
    return pieces.groupBy("source", "block", sub_block().alias("sub")).agg(
        F.count(opens).alias("n_records"), F.min("seq").alias("first_seq")
    )


def read_fastq(
    spark: SparkSession,
    path: Paths,
    fast: bool = False,
    with_place: bool = False,
) -> DataFrame:
    """One row per four-line record; lines beyond the fourth are ignored.

    ``fast`` reads the files once instead of twice, for callers who vouch that no
    quality line begins with ``@``; if one does, the query fails. ``with_place`` keeps
    the ``source``, ``block`` and ``seq`` columns that order the records.
    """
    return parse_fastq(read_pieces(spark, path, SEPARATOR), fast, with_place)


def format_fastq(df: DataFrame) -> DataFrame:
    return df.select(
        F.concat(
            F.lit("@"),
            F.concat_ws("\n", "header", "sequence", "opt_header", "quality_scores"),
        ).alias("line")
    )


def write_fastq(df: DataFrame, path: str, gzip: bool = False, mode: str = "errorifexists") -> None:
    write_lines(format_fastq(df), path, gzip, mode)
