"""Contigs, gene calls and gene sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.binding import let
from strandmill.functions.sequences import cut, gene_header, orient
from strandmill.operators.guards import fail_on


def flatten_genes(annotations: DataFrame) -> DataFrame:
    """One row per predicted gene, with its contig's columns."""
    contig = [name for name in annotations.columns if name != "predicted_genes"]
    return annotations.select(
        *(F.col(name).alias(f"contig_{name}") for name in contig), F.inline("predicted_genes")
    )


def _cut_genes(genomic: bool) -> Column:
    """The genes of one contig row as an array of FASTA records.

    The sequence is turned into bytes once per contig, so that cutting a gene out of a
    long contig costs the gene and not the way to it.
    """

    def records(raw: Column) -> Column:
        def record(gene: Column) -> Column:
            part = cut(F.col("sequence"), gene["start_pos"], gene["end_pos"], genomic, raw)
            return F.struct(
                gene_header(F.col("name"), gene["gene_id"]).alias("header"),
                orient(part, gene["strand"], complemented=genomic).alias("sequence"),
            )

        return F.transform("predicted_genes", record)

    one_byte_each = F.octet_length("sequence") == F.length("sequence")
    return let(F.when(one_byte_each, F.col("sequence").cast("binary")), records)


def extract_genes(annotations: DataFrame, contigs: DataFrame, genomic: bool = False) -> DataFrame:
    """The nucleotide sequence of every predicted gene, as FASTA records.

    Annotations find their contig by ``name = header``; a missing contig and a repeated
    header both fail the query. By default a gene is ``[start, end)`` from 0 and a minus
    strand is reversed; ``genomic`` reads 1-based inclusive coordinates and takes the
    reverse complement.

    A contig joins as one row with all its genes, which are cut before they become rows,
    so neither its sequence nor its key is multiplied. A missing contig fails in its row; the check for
    repeated headers reads the headers of the contigs and nothing else, so annotations are evaluated once.
    """
    found = annotations.select("name", "predicted_genes").join(
        contigs.select("header", "sequence"), F.col("name") == F.col("header"), "left"
    )
    missing = F.raise_error(F.concat(F.lit("no contig has the header "), F.coalesce("name", F.lit("null"))))
    genes = F.when(F.col("header").isNotNull(), F.col("predicted_genes")).otherwise(missing.cast(annotations.schema["predicted_genes"].dataType))
    records = found.withColumn("predicted_genes", genes).select(F.inline(_cut_genes(genomic)))
    repeated = contigs.groupBy("header").agg(F.count("*").alias("n")).filter("n > 1")
    return fail_on(records, repeated, F.concat(F.lit("two contigs have the header "), F.coalesce("header", F.lit("null"))))


def filter_min_length(contigs: DataFrame, min_length: int = 300) -> DataFrame:
    return contigs.filter(F.length("sequence") >= min_length)


def total_residues(records: DataFrame) -> DataFrame:
    """One row with the cumulative sequence length."""
    total = F.sum(F.length("sequence").cast("bigint"))
    return records.agg(F.coalesce(total, F.lit(0).cast("bigint")).alias("n_residues"))
