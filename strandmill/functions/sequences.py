"""Sequence expressions: wrapping, cutting, orientation, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC nucleotide codes and their complements, in both cases.
IUPAC_CODES = "ACGTRYKMBDHVacgtrykmbdhv"
IUPAC_COMPLEMENTS = "TGCAYRMKVHDBtgcayrmkvhdb"
# Fixed value: what joins a contig and a gene in the id of a protein.
PROTEIN_ID_JOINT = "?mga?"


def wrap(sequence: Column, width: int) -> Column:
    """Break a sequence into lines of ``width`` characters."""
    return F.regexp_replace(sequence, f"(?s)(.{{{width}}})(?=.)", "$1\n")


def complement(sequence: Column) -> Column:
    return F.translate(sequence, IUPAC_CODES, IUPAC_COMPLEMENTS)


def cut(
    sequence: Column, start: Column, end: Column, genomic: bool = False, raw: Column | None = None
) -> Column:
    """The part of a sequence a gene covers; a range outside the sequence raises.

    By default ``start`` is 0-based and ``end`` exclusive. ``genomic`` reads the same
    pair as 1-based and inclusive. ``raw`` may give the bytes of a sequence of one-byte
    characters, which are reached without counting characters; null where it is not one.
    """
    first = start if genomic else start + 1
    length = end - start + 1 if genomic else end - start
    size = F.length(sequence) if raw is None else F.coalesce(F.octet_length(raw), F.length(sequence))
    valid = (first >= 1) & (length >= 0) & (end <= size)
    part = F.substring(sequence, first, length)
    if raw is not None:
        part = F.when(raw.isNotNull(), F.substring(raw, first, length).cast("string")).otherwise(part)
    problem = F.format_string("gene range %d..%d does not fit its contig", start, end)
    return F.when(valid, part).otherwise(F.raise_error(problem).cast("string"))


def orient(sequence: Column, strand: Column, complemented: bool = False) -> Column:
    """Keep a ``+`` sequence; reverse any other, complemented on request."""
    turned = F.reverse(sequence)
    return F.when(strand == "+", sequence).otherwise(complement(turned) if complemented else turned)


def gene_header(contig: Column, gene_id: Column) -> Column:
    return F.replace(F.concat_ws("_", contig, gene_id), F.lit(" "), F.lit("_"))


def translated_id(parent: Column, gene_id: Column) -> Column:
    """The id a protein gets from its contig and gene."""
    return F.concat(parent, F.lit(PROTEIN_ID_JOINT), gene_id)
