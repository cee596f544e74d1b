"""The text workflow: pass lines through, keep those with a query, count their words.

Four variants compute the same number: one column plan, partition functions in memory,
partition functions through checkpointed stages, and external programs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.lines import (
    count_words_in_matching,
    filter_contains,
    passthrough,
    words_per_line,
)
from strandmill.operators.tools import ToolSpec, as_lines, check_tool, run_tool
from strandmill.plans.workflow import Workflow

CAT = ToolSpec(["cat", "{input}"])
WORD_COUNT = ToolSpec(["wc", "-w", "{input}"])


def grep_tool(pattern: str) -> ToolSpec:
    """``grep``; no match is exit code 1 and no failure."""
    return ToolSpec(["grep", "-a", "--", pattern, "{input}"], ok_codes=(0, 1))


def _total(per_part: DataFrame) -> DataFrame:
    n_words = F.sum(F.col("n_words").cast("bigint"))
    return per_part.agg(F.coalesce(n_words, F.lit(0).cast("bigint")).alias("n_words"))


def native(lines: DataFrame, query: str) -> DataFrame:
    """One fused plan of column expressions."""
    return count_words_in_matching(passthrough(lines), query)


def in_memory(lines: DataFrame, query: str) -> DataFrame:
    """The three steps as Python functions over partitions, without files."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.match_substring(batch.column(0), query))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.count_substring_regex(batch.column(0), "[^ ]+")
            yield pa.RecordBatch.from_arrays([words.cast(pa.int32())], ["n_words"])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count(keep(batches))

    return _total(passthrough(lines).select("line").mapInArrow(steps, "n_words INT"))


def through_stages(lines: DataFrame, query: str, workflow: Workflow) -> DataFrame:
    """The three steps as stages that a recovering workflow writes to files."""
    passed = workflow.stage("identity", lambda: passthrough(lines))
    kept = workflow.stage("filter", lambda: filter_contains(passed, query))
    counted = workflow.stage("count", lambda: words_per_line(kept).select("n_words"))
    return _total(counted)


def with_programs(lines: DataFrame, query: str, workflow: Workflow | None = None) -> DataFrame:
    """``cat``, ``grep`` and ``wc -w`` over the partitions."""
    for tool in (CAT, grep_tool(query), WORD_COUNT):
        check_tool(lines.sparkSession, tool)
    stage = workflow.stage if workflow else (lambda _tool, compute: compute())
    passed = stage("cat", lambda: as_lines(run_tool(lines, CAT)))
    kept = stage("grep", lambda: as_lines(run_tool(passed, grep_tool(query))))
    counted = stage("wc", lambda: as_lines(run_tool(kept, WORD_COUNT)))
    first = F.substring_index(F.ltrim("line"), " ", 1)
    return _total(counted.select(first.cast("bigint").alias("n_words")))
