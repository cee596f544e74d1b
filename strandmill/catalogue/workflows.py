"""Checkpoints, resume and the annotation workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.catalogue import query, table
from strandmill.operators.tools import ToolSpec
from strandmill.plans.annotation import annotate
from strandmill.plans.buckets import resume_buckets
from strandmill.plans.workflow import Workflow, materialise, repartition_by
from strandmill.session import fresh_dir


@query("checkpoint_resume", "SELECT * FROM orders")
def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run of a finished job reads its stage instead of computing it."""
    root = fresh_dir(spark, "resume")
    for recovered in (False, True):
        workflow = Workflow(spark, root, "orders", recover=True)
        result = workflow.stage("orders", lambda: table(spark, sf_dir, "orders"))
        if workflow.timings[-1][-1] is not recovered:
            raise AssertionError("a stage is computed once and then recovered")
    return result


@query(
    "stage_other_query",
    "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice >= 100000 GROUP BY o_custkey",
)
def stage_other_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage of the same name and number that asks for something else is computed."""
    root = fresh_dir(spark, "resume")
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice")

    def customers(least: int) -> DataFrame:
        stage = Workflow(spark, root, "orders", recover=True).stage
        return stage("filter", lambda: orders.filter(F.col("o_totalprice") >= least)).groupBy("o_custkey").agg(F.count("*").alias("n"))

    customers(1)
    return customers(100_000)


def _doubled(orders: DataFrame, root: str, **options) -> DataFrame:
    def double(df: DataFrame) -> DataFrame:
        return df.withColumn("doubled", F.col("o_totalprice") * 2)

    return resume_buckets(orders, double, root, "user", "double", "twice the price", **options)


@query(
    "bucket_resume",
    "SELECT o_orderkey, o_custkey, CAST(o_totalprice * 2 AS DOUBLE) AS doubled FROM orders",
)
def bucket_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second call finds every bucket done and only reads."""
    root = fresh_dir(spark, "buckets")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    for _ in range(2):
        result = _doubled(orders, root, n_buckets=16, at_once=4)
    return result.select("o_orderkey", "o_custkey", "doubled")


@query(
    "bucket_resume_other_input",
    "SELECT o_orderkey, CAST(o_totalprice * 2 AS DOUBLE) AS doubled FROM orders",
)
def bucket_resume_other_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders after all orders at another price: rows of the same schema are not taken for done."""
    root = fresh_dir(spark, "buckets")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    _doubled(orders.withColumn("o_totalprice", -F.col("o_totalprice")), root, n_buckets=4, at_once=2)
    return _doubled(orders, root, n_buckets=4, at_once=2).select("o_orderkey", "doubled")


@query(
    "bucket_resume_after_failure",
    "SELECT o_orderkey, CAST(o_totalprice * 2 AS DOUBLE) AS doubled, o_orderkey % 5 <> 3 AS done_before FROM orders",
)
def bucket_resume_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that fails in one bucket keeps the others; the next run computes that one alone."""
    root = fresh_dir(spark, "buckets")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").withColumn("part", F.col("o_orderkey") % 5)

    def run(fails: bool) -> DataFrame:
        def double(df: DataFrame) -> DataFrame:
            broken = F.when((F.col("part") == 3) & F.lit(fails), F.raise_error(F.lit("stopped midway")).cast("boolean"))
            return df.select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"), F.coalesce(broken, F.lit(fails)).alias("done_before"))

        return resume_buckets(orders, double, root, "user", "double", "twice the price", at_once=2, partition_column="part")

    try:
        run(fails=True)
    except Exception as error:  # noqa: BLE001
        if "stopped midway" not in str(error):
            raise
    return run(fails=False)


@query(
    "bucket_resume_own_bucket_column",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_orderkey % 7 - 2 END AS bucket, CAST(o_totalprice * 2 AS DOUBLE) AS doubled FROM orders",
)
def bucket_resume_own_bucket_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's column of that name is data; named as the partition column, all its values are buckets."""
    root = fresh_dir(spark, "buckets")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").withColumn(
        "bucket", F.when(F.col("o_orderkey") % 7 != 3, F.col("o_orderkey") % 7 - 2)
    )
    plain = _doubled(orders, f"{root}/plain", n_buckets=4, at_once=2)
    named = _doubled(orders, f"{root}/named", at_once=3, partition_column="bucket")
    # what only one of the two has comes on top and fails the comparison
    apart = plain.exceptAll(named).unionByName(named.exceptAll(plain))
    return plain.unionByName(apart).select("o_orderkey", "bucket", "doubled")


@query(
    "recover_on_and_off",
    "SELECT 'on' AS recover, count(*) AS n FROM orders WHERE o_totalprice >= 50000 UNION ALL SELECT 'off', count(*) FROM orders WHERE o_totalprice >= 50000",
)
def recover_on_and_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages give the same rows written or fused; a cached stage is released after its action."""
    parts = []
    for recover in (True, False):
        workflow = Workflow(spark, fresh_dir(spark, "recover"), "orders", recover=recover)
        large = workflow.stage("large", lambda: table(spark, sf_dir, "orders").filter("o_totalprice >= 50000"))
        kept = workflow.keep(repartition_by(large, 0.5))
        n = materialise(kept)
        workflow.release()
        if n != large.count():
            raise AssertionError("the cached stage has other rows")
        parts.append(large.agg(F.count("*").alias("n")).select(F.lit("on" if recover else "off").alias("recover"), "n"))
    return parts[0].unionByName(parts[1])


@query(
    "stage_report",
    "SELECT 'stage_1/orders' AS stage, count(*) AS n_rows, false AS recovered FROM orders UNION ALL SELECT 'stage_2/large', count(*), false FROM orders WHERE o_totalprice >= 50000",
)
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a job: its stages with their rows."""
    return _reported(spark, sf_dir, recover=True)


@query(
    "stage_report_lazy",
    "SELECT 'stage_1/orders' AS stage, count(*) AS n_rows, false AS recovered FROM orders UNION ALL SELECT 'stage_2/large', count(*), false FROM orders WHERE o_totalprice >= 50000",
)
def stage_report_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages that run fused together are counted as they run."""
    return _reported(spark, sf_dir, recover=False)


def _reported(spark: SparkSession, sf_dir: str, recover: bool) -> DataFrame:
    workflow = Workflow(spark, fresh_dir(spark, "report"), "orders", recover=recover)
    orders = workflow.stage("orders", lambda: table(spark, sf_dir, "orders"))
    materialise(workflow.stage("large", lambda: orders.filter("o_totalprice >= 50000")))
    return workflow.report().select("stage", "n_rows", "recovered")


# Stand-ins for the sequence programs, as awk scripts: genes of up to GENE letters over the whole contig,
# on alternating strands; one hit per gene and database split, one domain per gene.
GENE = 300
READ_FASTA = 'BEGIN { RS = ">"; FS = "\\n" } NR > 1 { s = ""; for (i = 2; i <= NF; i++) s = s $i; n = length(s);'
GENE_CALLER = ToolSpec(
    [
        "awk",
        READ_FASTA
        + ' print "# " $1; print "# gc = 0.5, rbs = -1"; print "# self: -";'
        + f' for (k = 0; k * {GENE} < n; k++) {{ e = (k + 1) * {GENE}; if (e > n) e = n;'
        + f' print "gene_" k + 1 "\\t" k * {GENE} "\\t" e "\\t" (k % 2 ? "-" : "+") "\\t0\\t11\\t1.5\\ts\\t-\\t-\\t-" }} }}',
        "{input}",
    ]
)
SEARCHER = ToolSpec(
    [
        "awk",
        READ_FASTA
        + ' print $1 "\\tS{split}\\t99.5\\t" n "\\t0\\t0\\t1\\t" n "\\t1\\t" n "\\t1e-1{split}\\t{database_size}" }',
        "{input}",
    ]
)
SCANNER = ToolSpec(
    [
        "awk",
        READ_FASTA
        + ' a = ($1 ~ /gene_1$/) ? "Gene3D" : "Coils";'
        + ' print $1 "\\td\\t" n "\\t" a "\\tsig\\ttext\\t1\\t" n "\\t-\\tT\\t02-06-2015" }',
        "{input}",
    ]
)
N_SPLITS = 3
# every letter stays; only what FASTA or the stand-ins' separators would read as structure goes
NOT_SEQUENCE = r"[^a-zA-Z]"
SQL_CONTIG_TEXTS = f"(SELECT doc_id, regexp_replace(text, '{NOT_SEQUENCE}', '', 'g') AS s FROM documents)"
SQL_GENES = f"""(SELECT 'doc-' || doc_id || '_gene_' || (k + 1) AS gene, k % 2 = 1 AS minus, substr(s, CAST(k * {GENE} + 1 AS INTEGER), {GENE}) AS part
    FROM (SELECT doc_id, s, unnest(range(0, (length(s) + {GENE - 1}) // {GENE})) AS k FROM {SQL_CONTIG_TEXTS}))"""


def database_sizes(hits: DataFrame) -> DataFrame:
    """The least and the greatest database size of all hits: one row only if every hit has the same."""
    ends = hits.agg(F.min("bit_score").alias("least"), F.max("bit_score").alias("greatest"))
    return ends.select(F.explode(F.array_distinct(F.array("least", "greatest"))).alias("bit_score"))


@query(
    "annotation_workflow",
    f"""SELECT 'contigs' AS kind, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS residues, NULL AS digest FROM {SQL_CONTIG_TEXTS}
        UNION ALL SELECT 'genes', count(*), CAST(sum(length(part)) AS BIGINT),
            CAST(sum(CAST('0x' || left(sha256(gene || ' ' || CASE WHEN minus THEN reverse(part) ELSE part END), 8) AS BIGINT)) AS VARCHAR) FROM {SQL_GENES}
        UNION ALL SELECT 'hits', {N_SPLITS} * count(*), CAST({N_SPLITS} * sum(length(part)) AS BIGINT), NULL FROM {SQL_GENES}
        UNION ALL SELECT 'best hits', count(*), CAST(sum(length(part)) AS BIGINT), 'S{N_SPLITS}' FROM {SQL_GENES}
        UNION ALL SELECT 'domains', count(*), CAST(sum(length(part)) AS BIGINT), NULL FROM {SQL_GENES}
        UNION ALL SELECT 'database size', 1, CAST(sum(length(s)) AS BIGINT), NULL FROM {SQL_CONTIG_TEXTS}""",
)
def annotation_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    workflow = Workflow(spark, fresh_dir(spark, "annotation"), "job", recover=True)
    contigs = table(spark, sf_dir, "documents", "doc_id", "text").select(
        F.concat(F.lit("doc-"), "doc_id").alias("header"),
        F.regexp_replace("text", NOT_SEQUENCE, "").alias("sequence"),
    )
    result = annotate(
        workflow, lambda: contigs, contigs, GENE_CALLER, SEARCHER, SCANNER, N_SPLITS, multiplier=1
    )

    def tally(kind: str, df: DataFrame, residues, digest=None) -> DataFrame:
        columns = (F.count("*").alias("n"), residues.cast("bigint").alias("residues"))
        text = (F.lit(None) if digest is None else digest).cast("string").alias("digest")
        return df.agg(*columns, F.max(text).alias("digest")).select(F.lit(kind).alias("kind"), "n", "residues", "digest")

    # a sum of hashes says the same in any order, so no task needs all genes
    gene = F.conv(F.substring(F.sha2(F.concat_ws(" ", "header", "sequence"), 256), 1, 8), 16, 10).cast("bigint")
    genes = result.genes.agg(
        F.count("*").alias("n"), F.sum(F.length("sequence")).cast("bigint").alias("residues"), F.sum(gene).cast("string").alias("digest")
    ).select(F.lit("genes").alias("kind"), "n", "residues", "digest")
    best = result.best_hits()
    parts = (
        genes,
        tally("hits", result.hits, F.sum("alignment_length")),
        tally("best hits", best, F.sum("alignment_length"), F.col("subject_id")),
        tally("domains", result.domains, F.sum("sequence_length")),
        tally("database size", database_sizes(result.hits), F.max("bit_score")),
    )
    counts = tally("contigs", result.contigs, F.sum(F.length("sequence")))
    for part in parts:
        counts = counts.unionByName(part)
    return counts
