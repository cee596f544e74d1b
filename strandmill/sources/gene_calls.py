"""Gene calls: three ``# `` header lines per contig, then one tab-separated line per gene.

Files are cut at a line end followed by ``# ``, so a piece is one header line with the
gene lines below it. The headers are carried down to the genes inside each stretch of a split by a
window, and from stretch to stretch through one row of state for each; no window ever
spans a whole file's lines, a ``.gz`` file's neither, which is one split of many stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.fields import required
from strandmill.sources.fastq import sub_block
from strandmill.sources.lines import Paths, read_pieces

SEPARATOR = "\n# "

# The three header lines, without their leading "# ".
NAME_HEADER = r"^[\w\s-]+$"
COMPOSITION_HEADER = r"^gc = (-?[\d]*\.?[\d]*), rbs = (-?[\d]*\.?[\d]*)$"
SELF_HEADER = r"^self: (.+)$"


def name_header(line: Column) -> Column:
    """The contig of a name header, or null."""
    return F.when(line.rlike(NAME_HEADER), line)


def composition_header(line: Column) -> Column:
    """``gc`` and ``rbs`` of a composition header as text, or null."""
    return F.when(
        line.rlike(COMPOSITION_HEADER),
        F.struct(
            F.regexp_extract(line, COMPOSITION_HEADER, 1).alias("gc"),
            F.regexp_extract(line, COMPOSITION_HEADER, 2).alias("rbs"),
        ),
    )


def self_header(line: Column) -> Column:
    """The value of a ``self`` header, or null."""
    return F.when(line.rlike(SELF_HEADER), F.regexp_extract(line, SELF_HEADER, 1))


def parse_gene(line: Column) -> Column:
    """A gene line as a struct; ``rbs`` is null if any of its three fields is ``-``."""
    fields = F.split(line, "\t")
    site = [required(fields, index) for index in (8, 9, 10)]
    rbs = F.when(
        ~F.array_contains(F.array(*site), "-"),
        F.struct(
            required(fields, 8, "int").alias("start"),
            required(fields, 9, "int").alias("end"),
            required(fields, 10, "float").alias("score"),
        ),
    )
    return F.struct(
        required(fields, 0).alias("gene_id"),
        required(fields, 1, "int").alias("start_pos"),
        required(fields, 2, "int").alias("end_pos"),
        required(fields, 3).alias("strand"),
        required(fields, 4, "int").alias("frame"),
        required(fields, 5).alias("complete_partial"),
        required(fields, 6, "float").alias("gene_score"),
        required(fields, 7).alias("used_model"),
        rbs.alias("rbs"),
    )


HEADERS = ("name", "composition", "self")
STRETCH = ("source", "block", "sub")


def _headed(pieces: DataFrame, sub: Column) -> DataFrame:
    """Pieces as one header and its gene lines; ``stops`` marks a blank line after them, ``sub`` the stretch."""
    text = F.regexp_replace(F.regexp_replace("piece", r"\r(\n|\z)", "$1"), r"\A# ", "")
    lines = F.split(F.rtrim(F.substring_index("text", "\n\n", 1), F.lit("\n")), "\n")
    header = F.get("lines", F.lit(0))
    return (
        pieces.select("source", "block", sub.alias("sub"), "seq", F.col("piece").startswith("# ").alias("marked"), text.alias("text"))
        .withColumn("lines", lines)
        .select(
            *STRETCH,
            "seq",
            (F.col("text").rlike(r"\n\n|\n\z") | (F.col("text") == "")).alias("stops"),
            "marked",
            (F.size("lines") > 1).alias("has_genes"),
            F.expr("slice(lines, 2, size(lines))").alias("gene_lines"),
            header.alias("header"),
            name_header(header).alias("name"),
            composition_header(header).alias("composition"),
            self_header(header).alias("self"),
        )
    )


def _stretch_states(headed: DataFrame) -> DataFrame:
    """Per stretch: the headers that earlier stretches leave open, whether it is its file's first, and where its file ends.

    The windows here run over one row per stretch.
    """
    latest = {
        name: F.max(F.when(F.col(name).isNotNull(), F.struct("seq", F.col(name).alias("value"))))
        for name in HEADERS
    }
    stretches = headed.groupBy(*STRETCH).agg(
        *(column.alias(name) for name, column in latest.items()),
        F.max(F.when(F.col("has_genes"), F.col("seq"))).alias("gene_seq"),
        (F.min(F.when(F.col("stops"), F.col("seq"))) - F.min("seq") + 1).alias("stop_place"),
        F.count("*").alias("last_place"),
    )
    in_order = W.partitionBy("source").orderBy("block", "sub")
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    in_file = W.partitionBy("source")

    def left_open(name: str) -> Column:
        """A header no gene line has closed yet; null inside means closed, null passes on."""
        closed = F.col("gene_seq").isNotNull()
        still_open = F.col(name).isNotNull() & (~closed | (F.col(f"{name}.seq") > F.col("gene_seq")))
        return F.when(still_open, F.struct(F.col(f"{name}.value").alias("value"))).when(
            closed, F.struct(F.lit(None).alias("value"))
        )

    first_stop = F.min(F.when(F.col("stop_place").isNotNull(), F.struct("block", "sub", F.col("stop_place").alias("place"))))
    last = F.max(F.struct("block", "sub", F.col("last_place").alias("place")))
    return stretches.select(
        *STRETCH,
        *(F.last(left_open(n), ignorenulls=True).over(before).alias(f"earlier_{n}") for n in HEADERS),
        (F.row_number().over(in_order) == 1).alias("is_first"),
        F.coalesce(first_stop.over(in_file), last.over(in_file)).alias("end"),
    )


def parse_gene_calls(
    pieces: DataFrame, keep_empty: bool = False, split_sources: bool = True
) -> DataFrame:
    """Pieces cut at ``\\n# `` as one row per contig; see :func:`read_gene_calls`.

    ``split_sources=False`` says that every source is one block, as the output of a
    program is, and evaluates the pieces once.
    """
    headed = _headed(pieces, sub_block() if split_sources else F.lit(0).cast("bigint"))
    in_split = W.partitionBy(*STRETCH).orderBy("seq")
    so_far = in_split.rowsBetween(W.unboundedPreceding, 0)
    before = in_split.rowsBetween(W.unboundedPreceding, -1)

    closed_at = F.max(F.when(F.col("has_genes"), F.col("seq"))).over(before)
    carried = headed.select(
        *STRETCH,
        "header",
        "marked",
        "has_genes",
        "gene_lines",
        F.col("self").isNotNull().alias("ends_header"),
        F.row_number().over(in_split).alias("place"),
        closed_at.alias("closed_at"),
        *(
            F.last(
                F.when(F.col(n).isNotNull(), F.struct("seq", F.col(n).alias("value"))), ignorenulls=True
            ).over(so_far).alias(n)
            for n in HEADERS
        ),
        F.coalesce(*(F.col(n).cast("string") for n in HEADERS)).isNotNull().alias("recognised"),
        "stops",
    )
    if split_sources:
        placed = carried.join(_stretch_states(headed), list(STRETCH))
    else:
        whole = W.partitionBy(*STRETCH)
        stop = F.min(F.when(F.col("stops"), F.col("place"))).over(whole)
        end = F.coalesce(stop, F.max("place").over(whole)).cast("bigint")
        nothing = F.lit(None).cast("struct<value: string>")
        placed = carried.select(
            "*",
            F.struct("block", "sub", end.alias("place")).alias("end"),
            F.lit(True).alias("is_first"),
            *(nothing.alias(f"earlier_{n}") for n in HEADERS if n != "composition"),
            F.lit(None).cast("struct<value: struct<gc: string, rbs: string>>").alias("earlier_composition"),
        )

    def known(name: str, part: str | None = None, data_type: str = "string") -> Column:
        own = F.col(name)
        fresh = own.isNotNull() & (F.col("closed_at").isNull() | (own["seq"] > F.col("closed_at")))
        earlier = F.when(F.col("closed_at").isNull(), F.col(f"earlier_{name}.value"))
        value = F.when(fresh, own["value"]).otherwise(earlier)
        problem = F.concat(F.lit(f"gene calls without a {name} header in "), F.col("source"))
        return F.coalesce(
            (value[part] if part else value).try_cast(data_type),
            F.raise_error(problem).cast(data_type),
        )

    place = F.struct("block", "sub", F.col("place").cast("bigint").alias("place"))
    survives = place <= F.col("end")
    opens_file = F.col("is_first") & (F.col("block") == 0) & (F.col("place") == 1)
    blank_start = opens_file & (F.col("header") == "")
    recognised = F.col("recognised") & (F.col("marked") | ~opens_file)
    emits = F.col("has_genes") | (place == F.col("end"))
    if keep_empty:
        emits = emits | F.col("ends_header")
    unknown = F.raise_error(F.concat(F.lit("unrecognised gene-call header: "), F.col("header")))
    return (
        placed.filter(survives & ~blank_start & (emits | ~recognised))
        .select(
            F.when(recognised, known("name")).otherwise(unknown.cast("string")).alias("name"),
            known("composition", "gc", "float").alias("gc"),
            known("composition", "rbs", "float").alias("rbs"),
            known("self").alias("self"),
            F.transform("gene_lines", parse_gene).alias("predicted_genes"),
        )
    )


def read_gene_calls(spark: SparkSession, path: Paths, keep_empty: bool = False) -> DataFrame:
    """One row per contig with its genes in an array.

    A file ends at its first blank line. A contig without genes is left out unless it is
    the last of its file; ``keep_empty`` keeps them all.
    """
    return parse_gene_calls(read_pieces(spark, path, SEPARATOR), keep_empty)
