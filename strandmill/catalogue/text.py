"""Line filters, word counts and the variants of the text workflow, over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.catalogue import query, table
from strandmill.operators import lines as ops
from strandmill.operators.tools import (
    ToolSpec,
    as_lines,
    check_tool,
    map_partitions,
    pipe_tool,
    run_tool,
    run_tool_over_splits,
    run_tool_logged,
)
from strandmill.plans import text as plans
from strandmill.plans.workflow import Workflow, materialise
from strandmill.session import fresh_dir
from strandmill.sources.lines import from_records, lines_of, read_lines, write_lines

WORD = "the"
SQL_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
SQL_WORDS = "len(list_filter(string_split(line, ' '), lambda word: word <> ''))"
SQL_TOTAL = f"SELECT CAST(coalesce(sum({SQL_WORDS}), 0) AS BIGINT) AS n_words FROM {SQL_LINES}"
SQL_MATCHING = f"{SQL_TOTAL} WHERE contains(line, '{WORD}')"
# the text has no tabs of its own, so some blanks become tabs on both sides
SQL_TABBED = f"(SELECT doc_id, replace(line, ', ', ',' || chr(9)) AS line FROM {SQL_LINES})"


def lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", *keep, "text")
    return lines_of(documents, "text", *keep)


def tabbed(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    plain = lines(spark, sf_dir, *keep)
    return plain.withColumn("line", F.replace("line", F.lit(", "), F.lit(",\t")))


@query("words_in_matching_lines", SQL_MATCHING)
def words_in_matching_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.native(lines(spark, sf_dir), WORD)


@query("words_no_match", f"{SQL_TOTAL} WHERE contains(line, 'no such phrase')")
def words_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.native(lines(spark, sf_dir), "no such phrase")


@query("words_in_memory", SQL_MATCHING)
def words_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.in_memory(lines(spark, sf_dir), WORD)


@query("words_through_stages", SQL_MATCHING)
def words_through_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    workflow = Workflow(spark, fresh_dir(spark, "text"), "words", recover=True)
    return plans.through_stages(lines(spark, sf_dir), WORD, workflow)


@query("words_with_programs", SQL_MATCHING)
def words_with_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.with_programs(lines(spark, sf_dir), WORD)


@query("filter_contains", f"SELECT doc_id, line FROM {SQL_LINES} WHERE contains(line, '{WORD}')")
def filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.filter_contains(lines(spark, sf_dir, "doc_id"), WORD)


@query(
    "grep_basic",
    f"SELECT doc_id, line FROM {SQL_LINES} WHERE regexp_matches(line, 'th[ae]n* (the|of)|[0-9]{{3}}')",
)
def grep_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.grep(lines(spark, sf_dir, "doc_id"), r"th[ae]n* \(the\|of\)\|[0-9]\{3\}")


@query("grep_java", f"SELECT doc_id, line FROM {SQL_LINES} WHERE regexp_matches(line, '^[A-Z].*(ing|tion)[.]$')")
def grep_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.grep(lines(spark, sf_dir, "doc_id"), "^[A-Z].*(ing|tion)[.]$", "java")


@query("grep_fixed", f"SELECT doc_id, line FROM {SQL_LINES} WHERE contains(line, 'in.')")
def grep_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.grep(lines(spark, sf_dir, "doc_id"), "in.", "fixed")


@query("passthrough", f"SELECT doc_id, line FROM {SQL_LINES}")
def passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.passthrough(lines(spark, sf_dir, "doc_id"))


@query("words_per_line_space", f"SELECT doc_id, CAST({SQL_WORDS} AS INTEGER) AS n_words FROM {SQL_TABBED}")
def words_per_line_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.words_per_line(tabbed(spark, sf_dir, "doc_id")).select("doc_id", "n_words")


@query(
    "words_per_line_whitespace",
    "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\r\\f\\v]+'), "
    f"lambda word: word <> '')) AS INTEGER) AS n_words FROM {SQL_TABBED}",
)
def words_per_line_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.words_per_line(tabbed(spark, sf_dir, "doc_id"), "whitespace").select("doc_id", "n_words")


@query("partition_partials_total", SQL_TOTAL)
def partition_partials_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    partials = ops.partition_words(lines(spark, sf_dir))
    return partials.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"))


@query("lines_gzip_roundtrip", f"SELECT line FROM {SQL_LINES}")
def lines_gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "lines")
    write_lines(lines(spark, sf_dir), path, gzip=True)
    return read_lines(spark, path, multiplier=1)


@query("tool_cat", f"SELECT line FROM {SQL_LINES}")
def tool_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_lines(run_tool(lines(spark, sf_dir), plans.CAT))


@query("tool_grep", f"SELECT line FROM {SQL_LINES} WHERE contains(line, '{WORD}')")
def tool_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_lines(run_tool(lines(spark, sf_dir), plans.grep_tool(WORD)))


@query("tool_pipe_grep", f"SELECT line FROM {SQL_LINES} WHERE contains(line, '{WORD}')")
def tool_pipe_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    piped = ToolSpec(["grep", "-a", "--", WORD], ok_codes=(0, 1))
    return as_lines(pipe_tool(lines(spark, sf_dir), piped))


@query(
    "tool_wc_total",
    "SELECT CAST(sum(len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\r\\f\\v]+'), "
    f"lambda word: word <> ''))) AS BIGINT) AS n_words FROM {SQL_TABBED}",
)
def tool_wc_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = as_lines(run_tool(tabbed(spark, sf_dir), plans.WORD_COUNT))
    return counted.agg(F.sum(F.substring_index("line", " ", 1).cast("bigint")).alias("n_words"))


@query(
    "tool_over_splits",
    f"SELECT CAST(split_id AS INTEGER) AS split_id, split_id || ':' || line AS line FROM {SQL_LINES}, "
    "(SELECT unnest(range(1, 4)) AS split_id)",
)
def tool_over_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = ToolSpec(["sed", "s/^/{split}:/", "{input}"])
    return as_lines(run_tool_over_splits(lines(spark, sf_dir), label, 3), "split_id")


@query("partition_function", f"SELECT doc_id, reverse(line) AS backwards, CAST(length(line) AS BIGINT) AS n FROM {SQL_LINES}")
def partition_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    def backwards(frames):
        for frame in frames:
            yield frame.assign(backwards=frame["line"].str[::-1], n=frame["line"].str.len())[["doc_id", "backwards", "n"]]

    return map_partitions(lines(spark, sf_dir, "doc_id"), backwards, "doc_id BIGINT, backwards STRING, n BIGINT")


@query("tool_availability", "SELECT program, n FROM (VALUES ('cat', true), ('grep', true), ('wc', true)) t(program, available), (SELECT count(*) AS n FROM documents)")
def tool_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All programs are looked for first; the rows are counted only if none is missing."""
    specs = (plans.CAT, plans.grep_tool(WORD), plans.WORD_COUNT)
    for spec in specs:
        check_tool(spark, spec)
    names = F.array(*(F.lit(spec.command()[0]) for spec in specs))
    counted = table(spark, sf_dir, "documents", "doc_id").agg(F.count("*").alias("n"))
    return counted.select(F.explode(names).alias("program"), "n")


@query("tool_output_policy", f"SELECT count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS characters FROM {SQL_LINES}")
def tool_output_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program whose output names a failure fails; one that uses another word does not."""
    checked = ToolSpec(["sed", "s/^/ok:/", "{input}"], fail_patterns=("no such failure in any text",))
    found = as_lines(run_tool(lines(spark, sf_dir), checked))
    return found.agg(F.count("*").alias("n"), F.sum(F.length("line") - 3).alias("characters"))


@query(
    "tool_capture",
    f"SELECT count(*) AS n_rows, CAST(0 AS INTEGER) AS worst_code, 'counted' AS last_word FROM {SQL_LINES}",
)
def tool_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each run and what the same run reported: every line bears the mark that the run wrote to its error stream."""
    marked = ToolSpec(["sh", "-c", 'run=$$-$(date +%N); sed "s/^/$run:/" "$1"; echo "$run" >&2; echo counted >&2', "tool", "{input}"])
    pieces, log = run_tool_logged(lines(spark, sf_dir), marked)
    reported = F.split(F.trim(F.col("stderr"), F.lit("\n")), "\n")
    log = log.select("part_id", "exit_code", "n_rows", F.get(reported, F.lit(0)).alias("run"), F.get(reported, F.lit(1)).alias("last_word"))
    per_run = pieces.join(log, "part_id").groupBy("part_id", "n_rows", "exit_code", "last_word").agg(
        F.count_if(F.col("piece").startswith(F.concat("run", F.lit(":")))).alias("n_same")
    )
    same = F.when(F.col("n_same") == F.col("n_rows"), F.col("n_rows"))
    return per_run.agg(F.sum(same).alias("n_rows"), F.max("exit_code").alias("worst_code"), F.max("last_word").alias("last_word"))


@query("tool_empty_partitions", f"SELECT line FROM {SQL_LINES} WHERE contains(line, '{WORD}')")
def tool_empty_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program that would fail on an empty input is not run for an empty partition.

    Every other partition stays empty. The lines are dealt evenly over the rest, which are as many as the input has splits, or
    more; a hot line goes to another partition from each split.
    """
    strict = ToolSpec(["sh", "-c", 'test -s "$1" && cat "$1"', "tool", "{input}"])
    matching = lines(spark, sf_dir).filter(F.col("line").contains(WORD))
    filled = max(32, spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").rdd.getNumPartitions())
    place = (2 * F.pmod(F.xxhash64(F.spark_partition_id(), "line"), F.lit(filled))).cast("int")
    dealt = matching.withColumn("place", place).repartitionById(2 * filled, "place").drop("place")
    return as_lines(run_tool(dealt, strict))


@query("tool_host_argument", f"SELECT count(*) AS n, true AS named FROM {SQL_LINES}")
def tool_host_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line may depend on the host that runs it."""
    labelled = ToolSpec(lambda host: ["sed", f"s/^/{host}:/", "{input}"])
    found = as_lines(run_tool(lines(spark, sf_dir), labelled))
    named = F.col("line").rlike("^[A-Za-z0-9._-]+:")
    return found.agg(F.count("*").alias("n"), F.min(named).alias("named"))


@query("records_spread", "SELECT n_nationkey, n_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def records_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few rows that the driver holds become a table of several partitions, which all customers are joined with."""
    rows = table(spark, sf_dir, "nation", "n_nationkey", "n_name").collect()
    nations = from_records(spark, rows, "n_nationkey BIGINT, n_name STRING")
    customers = table(spark, sf_dir, "customer", "c_nationkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_customers"))
    return customers.join(nations, "n_nationkey")


@query("row_count_action", f"SELECT count(*) AS n FROM {SQL_LINES}")
def row_count_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action that runs a stage for its own sake, next to the same count as a table."""
    n = materialise(lines(spark, sf_dir))
    return lines(spark, sf_dir).agg(F.count("*").alias("n")).filter(F.col("n") == n)


# some lines get a carriage return, which is a character like any other
SQL_MARKED = "(SELECT doc_id, line || CASE WHEN length(line) % 2 = 0 THEN chr(13) ELSE '' END AS line FROM " + SQL_LINES + ")"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = lines(spark, sf_dir, "doc_id")
    return plain.withColumn("line", F.when(F.length("line") % 2 == 0, F.concat("line", F.lit("\r"))).otherwise(F.col("line")))


@query("grep_crlf", f"SELECT doc_id, line FROM {SQL_MARKED} WHERE regexp_matches(line, '[.]$') AND NOT contains(line, chr(13))")
def grep_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.grep(marked(spark, sf_dir), r"\.$")


@query("grep_stacked", f"SELECT doc_id, line FROM {SQL_MARKED} WHERE regexp_matches(line, 'on+ed') OR regexp_matches(line, '(th){{2}}e')")
def grep_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.grep(marked(spark, sf_dir), r"on**n\+*ned\|on\+\+ed\|\(th\)\{2\}e")
