"""The annotation workflow: contigs to genes to similarity hits and protein domains."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from strandmill.operators.genes import extract_genes, total_residues
from strandmill.operators.hits import best_hits
from strandmill.operators.tools import ToolSpec, as_lines, as_pieces, check_tool, run_tool, run_tool_over_splits
from strandmill.plans.workflow import Workflow
from strandmill.session import ensure_partitions
from strandmill.sources.domains import parse_domains
from strandmill.sources.fasta import format_fasta
from strandmill.sources.gene_calls import SEPARATOR, parse_gene_calls
from strandmill.sources.hits import parse_hits


@dataclass
class Annotation:
    """What the workflow produces; every field is a DataFrame of flat records."""

    contigs: DataFrame
    gene_calls: DataFrame
    genes: DataFrame
    hits: DataFrame
    domains: DataFrame
    database_size: int

    def best_hits(self, k: int = 1) -> DataFrame:
        return best_hits(self.hits, k)


def annotate(
    workflow: Workflow,
    contigs: Callable[[], DataFrame],
    database: DataFrame,
    gene_caller: ToolSpec,
    searcher: ToolSpec,
    scanner: ToolSpec,
    n_splits: int = 8,
    multiplier: float = 3.0,
) -> Annotation:
    """Run the workflow with the given programs.

    ``contigs`` gives the assembled contigs and ``database`` the sequences that the
    search database was built from, both as FASTA records. The gene caller prints gene
    calls, the searcher tabular hits and the scanner domain lines; ``{split}`` and
    ``{database_size}`` in the searcher's command are filled in. All programs are looked
    for, on the driver and the executors, before anything runs.
    """
    for tool in (gene_caller, searcher, scanner):
        check_tool(workflow.spark, tool)
    assembled = workflow.keep(workflow.stage("contigs", lambda: ensure_partitions(contigs(), multiplier)))
    caller = replace(gene_caller, separator=SEPARATOR)
    calls = workflow.keep(
        workflow.stage(
            "gene_calls",
            lambda: parse_gene_calls(as_pieces(run_tool(format_fasta(assembled), caller)), split_sources=False),
        )
    )
    genes = workflow.keep(workflow.stage("genes", lambda: extract_genes(calls, assembled)))

    size = workflow.scalar("database_size", lambda: total_residues(database))
    sized = replace(searcher, values={**searcher.values, "database_size": str(size)})
    hits = workflow.stage(
        "hits",
        lambda: parse_hits(
            as_lines(run_tool_over_splits(format_fasta(genes), sized, n_splits), "split_id"), "split_id"
        ),
    )
    domains = workflow.stage(
        "domains", lambda: parse_domains(as_lines(run_tool(format_fasta(genes), scanner)))
    )
    return Annotation(assembled, calls, genes, hits, domains, size)
