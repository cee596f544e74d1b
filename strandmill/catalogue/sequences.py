"""Sequence formats, gene calls and mate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.catalogue import query, table
from strandmill.functions.binding import let
from strandmill.functions.sequences import translated_id
from strandmill.operators.genes import extract_genes, filter_min_length, flatten_genes, total_residues
from strandmill.operators.pairs import read_fastq_pairs
from strandmill.plans.workflow import Workflow
from strandmill.session import fresh_dir
from strandmill.sources.fasta import read_fasta, write_fasta
from strandmill.sources.fastq import read_fastq, write_fastq
from strandmill.sources.gene_calls import read_gene_calls
from strandmill.sources.lines import write_lines

SQL_CONTIGS = "(SELECT doc_id, 'doc-' || doc_id AS header, replace(text, chr(10), '') AS sequence FROM documents)"


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as contigs."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return documents.select(
        "doc_id",
        F.concat(F.lit("doc-"), "doc_id").alias("header"),
        F.replace("text", F.lit("\n"), F.lit("")).alias("sequence"),
    )


@query("fasta_roundtrip", f"SELECT header, sequence FROM {SQL_CONTIGS}")
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "fasta")
    write_fasta(contigs(spark, sf_dir), path)
    return read_fasta(spark, path)


@query("fasta_gzip_roundtrip", f"SELECT header, sequence FROM {SQL_CONTIGS}")
def fasta_gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "fasta")
    write_fasta(contigs(spark, sf_dir), path, width=60, gzip=True)
    return read_fasta(spark, path)


@query("fasta_marker_headers", f"SELECT '>' || header AS header, sequence FROM {SQL_CONTIGS}")
def fasta_marker_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that begin with the marker themselves keep it, in the first split too."""
    path = fresh_dir(spark, "fasta")
    write_fasta(contigs(spark, sf_dir).withColumn("header", F.concat(F.lit(">"), "header")), path)
    return read_fasta(spark, path)


@query("fasta_total_residues", f"SELECT CAST(sum(length(sequence)) AS BIGINT) AS n_residues FROM {SQL_CONTIGS}")
def fasta_total_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total_residues(contigs(spark, sf_dir))


@query("cached_scalar", f"SELECT CAST(sum(length(sequence)) AS BIGINT) AS n_residues FROM {SQL_CONTIGS}")
def cached_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second workflow of the same job reads what the first one counted."""
    root = fresh_dir(spark, "scalar")
    for _ in range(2):
        workflow = Workflow(spark, root, "size", recover=True)
        size = workflow.scalar("n_residues", lambda: total_residues(contigs(spark, sf_dir)))
    return spark.createDataFrame([(size,)], "n_residues BIGINT")


@query("contig_min_length", f"SELECT header, sequence FROM {SQL_CONTIGS} WHERE length(sequence) >= 300")
def contig_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_min_length(contigs(spark, sf_dir)).select("header", "sequence")


SQL_READS = """(
    SELECT conv_id || ':' || turn || ' ' || role AS header,
           replace(text, chr(10), ' ') AS sequence,
           '+' AS opt_header,
           CASE WHEN turn % 2 = 1 THEN '@' || role ELSE 'I' || role END AS quality_scores
    FROM conversations)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as reads; every odd turn has a quality line that begins with @."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return turns.select(
        F.concat("conv_id", F.lit(":"), "turn", F.lit(" "), "role").alias("header"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("sequence"),
        F.lit("+").alias("opt_header"),
        F.concat(F.when(F.col("turn") % 2 == 1, "@").otherwise("I"), "role").alias("quality_scores"),
    )


@query("fastq_roundtrip", f"SELECT * FROM {SQL_READS}")
def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "fastq")
    write_fastq(reads(spark, sf_dir), path)
    return read_fastq(spark, path)


@query(
    "fastq_fast_roundtrip",
    f"SELECT header, sequence, opt_header, 'I' || quality_scores AS quality_scores FROM {SQL_READS}",
)
def fastq_fast_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "fastq")
    guarded = F.concat(F.lit("I"), "quality_scores")
    write_fastq(reads(spark, sf_dir).withColumn("quality_scores", guarded), path)
    return read_fastq(spark, path, fast=True)


def _mates(spark: SparkSession, sf_dir: str, role: str, fragment: Column) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return turns.filter(F.col("role") == role).select(
        "conv_id",
        "turn",
        F.concat("conv_id", F.lit(":"), fragment, F.lit(" "), "role").alias("header"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("sequence"),
        F.lit("+").alias("opt_header"),
        F.concat(F.lit("@"), "turn").alias("quality_scores"),
    )


def _pair_files(spark: SparkSession, sf_dir: str, complete: bool = False, gzip: bool = False) -> tuple[str, str]:
    """Questions and answers as left and right files, in the order of their turns.

    ``complete`` leaves out questions without an answer and answers without a question.
    """
    left, right = fresh_dir(spark, "left"), fresh_dir(spark, "right")
    questions = _mates(spark, sf_dir, "user", F.col("turn").cast("string"))
    answers = _mates(spark, sf_dir, "assistant", (F.col("turn") - 1).cast("string"))
    if complete:
        asked, answered = (side.select("conv_id", (F.col("turn") + step).alias("turn")) for side, step in ((questions, 1), (answers, -1)))
        questions, answers = questions.join(answered, ["conv_id", "turn"], "left_semi"), answers.join(asked, ["conv_id", "turn"], "left_semi")
    write_fastq(questions.orderBy("conv_id", "turn"), left, gzip)
    write_fastq(answers.orderBy("conv_id", "turn"), right, gzip)
    return left, right


SQL_MATES = """
    WITH mates AS (
        SELECT conv_id, turn, role,
               conv_id || ':' || (CASE WHEN role = 'user' THEN turn ELSE turn - 1 END) AS read_id,
               replace(text, chr(10), ' ') AS sequence,
               row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS position
        FROM conversations c WHERE {which})
    SELECT l.{key} AS {key}, l.sequence AS left_sequence, r.sequence AS right_sequence
    FROM mates l JOIN mates r ON l.{key} = r.{key} AND l.role = 'user' AND r.role = 'assistant'"""


@query("mate_pairs_id", SQL_MATES.format(key="read_id", which="true"))
def mate_pairs_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _pair_files(spark, sf_dir)
    pairs = read_fastq_pairs(spark, left, right, on="id")
    return pairs.select("read_id", "left_sequence", "right_sequence")


SQL_COMPLETE = """EXISTS (
            SELECT 1 FROM conversations m WHERE m.conv_id = c.conv_id
            AND (c.role = 'user' AND m.role = 'assistant' AND m.turn = c.turn + 1 OR c.role = 'assistant' AND m.role = 'user' AND m.turn = c.turn - 1))"""


@query("mate_pairs_position_gzip", SQL_MATES.format(key="position", which=SQL_COMPLETE))
def mate_pairs_position_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _pair_files(spark, sf_dir, complete=True, gzip=True)
    return read_fastq_pairs(spark, left, right, on="position").select("position", "left_sequence", "right_sequence")


@query("mate_pairs_position", SQL_MATES.format(key="position", which=SQL_COMPLETE))
def mate_pairs_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _pair_files(spark, sf_dir, complete=True)
    pairs = read_fastq_pairs(spark, left, right, on="position")
    return pairs.select("position", "left_sequence", "right_sequence")


# every contig has up to four genes k, from k - 1 to length / k
SQL_GENES = f"""(
    SELECT doc_id, header, sequence, k,
           'gene ' || k AS gene_id,
           k - 1 AS start_pos,
           greatest(k - 1, length(sequence) // k) AS end_pos,
           CASE WHEN (doc_id + k) % 2 = 0 THEN '+' ELSE '-' END AS strand
    FROM (SELECT *, unnest(range(1, 1 + least(1 + doc_id % 4, length(sequence)))) AS k
          FROM {SQL_CONTIGS}))"""


def gene_call_files(spark: SparkSession, sf_dir: str, gzip: bool = False) -> str:
    """Gene calls on all documents, as text files."""
    sized = contigs(spark, sf_dir).select("doc_id", "header", F.length("sequence").cast("bigint").alias("n"))
    last = F.least(1 + F.col("doc_id") % 4, F.col("n"))
    numbers = F.filter(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint")), lambda i: i <= last)
    genes = sized.withColumn("ks", numbers)

    def gene_line(i: Column, n: Column) -> Column:
        return F.concat_ws(
            "\t",
            F.concat(F.lit("gene "), i.cast("string")),
            (i - 1).cast("string"),
            F.greatest(i - 1, F.floor(n / i)).cast("string"),
            F.when((F.col("doc_id") + i) % 2 == 0, "+").otherwise("-"),
            F.lit("0"),
            F.lit("11"),
            F.concat(i.cast("string"), F.lit(".5")),
            F.lit("s"),
            F.when(i % 2 == 0, "-").otherwise(i.cast("string")),
            F.lit("7"),
            F.lit("-0.25"),
        )

    block = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), "header"),
        F.concat(F.lit("# gc = 0."), (F.col("doc_id") % 10).cast("string"), F.lit(", rbs = -1")),
        F.lit("# self: b"),
        let(F.col("n"), lambda n: F.transform("ks", lambda i: gene_line(i, n))),
    )
    path = fresh_dir(spark, "gene-calls")
    write_lines(genes.select(block.alias("line")), path, gzip)
    return path


@query(
    "gene_calls_parse",
    f"""SELECT header AS name, CAST('0.' || (doc_id % 10) AS FLOAT) AS gc, CAST(-1 AS FLOAT) AS rbs,
               'b' AS self, gene_id, CAST(start_pos AS INTEGER) AS start_pos,
               CAST(end_pos AS INTEGER) AS end_pos, strand, 0 AS frame, '11' AS complete_partial,
               CAST(k || '.5' AS FLOAT) AS gene_score, 's' AS used_model,
               CASE WHEN k % 2 = 1 THEN CAST(k AS INTEGER) END AS site_start,
               CASE WHEN k % 2 = 1 THEN CAST(-0.25 AS FLOAT) END AS site_score
        FROM {SQL_GENES}""",
)
def gene_calls_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read_gene_calls(spark, gene_call_files(spark, sf_dir))
    return flatten_genes(calls).select(
        F.col("contig_name").alias("name"),
        F.col("contig_gc").alias("gc"),
        F.col("contig_rbs").alias("rbs"),
        F.col("contig_self").alias("self"),
        "gene_id",
        "start_pos",
        "end_pos",
        "strand",
        "frame",
        "complete_partial",
        "gene_score",
        "used_model",
        F.col("rbs.start").alias("site_start"),
        F.col("rbs.score").alias("site_score"),
    )


@query(
    "gene_calls_gzip",
    f"SELECT header AS name, count(*) AS n_genes, CAST(sum(end_pos - start_pos) AS BIGINT) AS residues FROM {SQL_GENES} GROUP BY header",
)
def gene_calls_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not split, whose headers are carried by stretches."""
    genes = flatten_genes(read_gene_calls(spark, gene_call_files(spark, sf_dir, gzip=True)))
    return genes.groupBy(F.col("contig_name").alias("name")).agg(
        F.count("*").alias("n_genes"), F.sum((F.col("end_pos") - F.col("start_pos")).cast("bigint")).alias("residues")
    )


@query(
    "gene_extract",
    f"""SELECT replace(header || '_' || gene_id, ' ', '_') AS header,
               CASE WHEN strand = '+' THEN gene ELSE reverse(gene) END AS sequence
        FROM (SELECT *, substr(sequence, start_pos + 1, end_pos - start_pos) AS gene FROM {SQL_GENES})""",
)
def gene_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read_gene_calls(spark, gene_call_files(spark, sf_dir))
    return extract_genes(calls, contigs(spark, sf_dir))


@query(
    "gene_extract_genomic",
    f"""SELECT replace(header || '_' || gene_id, ' ', '_') AS header,
               CASE WHEN strand = '+' THEN gene
                    ELSE reverse(translate(gene, 'ACGTRYKMBDHVacgtrykmbdhv', 'TGCAYRMKVHDBtgcayrmkvhdb'))
               END AS sequence
        FROM (SELECT *, substr(sequence, start_pos, end_pos - start_pos + 1) AS gene
              FROM (SELECT * REPLACE (start_pos + 1 AS start_pos) FROM {SQL_GENES}))""",
)
def gene_extract_genomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.transform(
        "predicted_genes", lambda gene: gene.withField("start_pos", gene["start_pos"] + 1)
    )
    calls = read_gene_calls(spark, gene_call_files(spark, sf_dir)).withColumn("predicted_genes", shifted)
    return extract_genes(calls, contigs(spark, sf_dir), genomic=True)


@query(
    "gene_translated_ids",
    f"SELECT header || '?mga?' || gene_id AS protein_id FROM {SQL_GENES}",
)
def gene_translated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = flatten_genes(read_gene_calls(spark, gene_call_files(spark, sf_dir)))
    return genes.select(translated_id(F.col("contig_name"), F.col("gene_id")).alias("protein_id"))
