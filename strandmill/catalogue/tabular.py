"""Similarity hits, protein domains and JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.catalogue import query, table
from strandmill.functions.fields import comma_list
from strandmill.operators import domains as domain_ops
from strandmill.operators import hits as hit_ops
from strandmill.plans.workflow import take
from strandmill.session import fresh_dir
from strandmill.sources.domains import parse_domains, read_domains
from strandmill.sources.hits import parse_hits
from strandmill.sources.json_rows import from_json_rows, to_json_rows

HIT_COLUMNS = (
    "query_id, subject_id, percent_identity, alignment_length, mismatch_count, gap_open_count, "
    "query_start, query_end, subject_start, subject_end, e_value, bit_score"
)
SQL_HITS = """(
    SELECT 'Q' || l_orderkey AS query_id,
           'S' || l_suppkey AS subject_id,
           CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS percent_identity,
           CAST(l_partkey AS INTEGER) AS alignment_length,
           CAST(l_linenumber AS INTEGER) AS mismatch_count,
           CAST(l_suppkey AS INTEGER) AS gap_open_count,
           CAST(l_linenumber AS INTEGER) AS query_start,
           CAST(l_linenumber + l_partkey AS INTEGER) AS query_end,
           CAST(l_suppkey + 1 AS INTEGER) AS subject_start,
           CAST(l_suppkey + l_partkey AS INTEGER) AS subject_end,
           CAST(l_linenumber || 'e-' || (4 + l_suppkey % 4) AS DOUBLE) AS e_value,
           CAST(l_partkey || '.5' AS DOUBLE) AS bit_score,
           CAST(l_linenumber AS INTEGER) AS split_id
    FROM lineitem)"""


def hit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tabular hits; the line number is the database split."""
    items = table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )
    part, supplier, number = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    columns = (
        F.concat(F.lit("Q"), "l_orderkey"),
        F.concat(F.lit("S"), supplier),
        F.col("l_quantity").cast("int"),
        part,
        number,
        supplier,
        number,
        number + part,
        supplier + 1,
        supplier + part,
        F.concat(number, F.lit("e-"), 4 + supplier % 4),
        F.concat(part, F.lit(".5")),
    )
    line = F.concat_ws("\t", *(column.cast("string") for column in columns))
    return items.select(line.alias("line"), number.cast("int").alias("split_id"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_hits(hit_lines(spark, sf_dir), "split_id")


@query("hits_parse", f"SELECT {HIT_COLUMNS} FROM {SQL_HITS}")
def hits_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).drop("split_id")


@query("hits_union_splits", f"SELECT {HIT_COLUMNS}, split_id FROM {SQL_HITS}")
def hits_union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each split's hits are files of their own, read back and put together."""
    path = fresh_dir(spark, "hits")
    hit_lines(spark, sf_dir).write.partitionBy("split_id").text(path)
    return hit_ops.read_split_hits(spark, path)


@query("hits_evalue", f"SELECT {HIT_COLUMNS} FROM {SQL_HITS} WHERE e_value <= 1e-5")
def hits_evalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_ops.filter_evalue(hits(spark, sf_dir)).drop("split_id")


SQL_TOP = """
    WITH best AS (
        SELECT {by}, subject_id, e_value, bit_score,
               row_number() OVER (PARTITION BY {by}, subject_id ORDER BY e_value, bit_score DESC) AS n
        FROM {hits}),
    ranked AS (
        SELECT {by}, subject_id,
               row_number() OVER (PARTITION BY {by} ORDER BY e_value, bit_score DESC, subject_id) AS subject_rank
        FROM best WHERE n = 1)
    SELECT h.*, CAST(r.subject_rank AS INTEGER) AS subject_rank
    FROM {hits} h JOIN ranked r USING ({by}, subject_id) WHERE r.subject_rank <= {k}"""


@query("hits_topk", SQL_TOP.format(by="query_id, split_id", hits=SQL_HITS, k=5))
def hits_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_ops.top_hits(hits(spark, sf_dir))


@query("hits_topk_supplier_first", SQL_TOP.format(by="split_id", hits=SQL_HITS, k=5))
def hits_topk_supplier_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Very few, very large groups: the best five subjects of each whole split."""
    return hit_ops.top_hits(hits(spark, sf_dir), 5, ("split_id",))


@query("hits_best", SQL_TOP.format(by="query_id", hits=SQL_HITS, k=1))
def hits_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_ops.best_hits(hits(spark, sf_dir))


@query("hits_count", "SELECT count(*) AS n_records FROM lineitem")
def hits_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_ops.record_count(hits(spark, sf_dir))


@query(
    "hits_first",
    f"SELECT {HIT_COLUMNS} FROM {SQL_HITS} ORDER BY e_value, bit_score DESC, query_id, subject_id, "
    "query_start, percent_identity LIMIT 5",
)
def hits_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    descending = hits(spark, sf_dir).withColumn("minus", -F.col("bit_score"))
    order = ("e_value", "minus", "query_id", "subject_id", "query_start", "percent_identity")
    return take(descending, 5, *order).drop("minus", "split_id")


# Events as domain lines of 11 to 15 columns. The event type gives the analysis, the
# user the number of columns.
SQL_DOMAINS = """(
    SELECT 'P' || user_id AS protein_accession,
           md5(CAST(event_id AS VARCHAR)) AS sequence_digest,
           event_id AS sequence_length,
           CASE event_type WHEN 'click' THEN 'Gene3D' WHEN 'view' THEN 'PANTHER'
                WHEN 'purchase' THEN 'Phobius' WHEN 'error' THEN 'Coils' ELSE event_type END AS analysis,
           'SIG' || event_type AS signature_accession,
           '' AS signature_description,
           user_id AS start_location,
           user_id + event_id AS stop_location,
           TRY_CAST(CASE WHEN event_id % 3 = 0 THEN '-' ELSE event_id || '.5' END AS DOUBLE) AS score,
           event_id % 2 = 0 AS status,
           '02-06-2015' AS date,
           CASE WHEN user_id % 5 >= 1 THEN 'IPR' || user_id END AS interpro_accession,
           CASE WHEN user_id % 5 >= 2 THEN 'domain ' || event_type END AS interpro_description,
           CASE WHEN user_id % 5 >= 3 THEN 'GO:' || user_id || '|GO:' || event_id ELSE '' END AS go_terms,
           CASE WHEN user_id % 5 >= 4 THEN 'KEGG: ' || event_id END AS pathway_annotations
    FROM events)"""


def domain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    event, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    columns = (
        F.concat(F.lit("P"), user),
        F.md5(event.cast("string")),
        event,
        F.when(kind == "click", "Gene3D")
        .when(kind == "view", "PANTHER")
        .when(kind == "purchase", "Phobius")
        .when(kind == "error", "Coils")
        .otherwise(kind),
        F.concat(F.lit("SIG"), kind),
        F.lit(""),
        user,
        user + event,
        F.when(event % 3 == 0, "-").otherwise(F.concat(event, F.lit(".5"))),
        F.when(event % 2 == 0, "T").otherwise("F"),
        F.lit("02-06-2015"),
        F.when(user % 5 >= 1, F.concat(F.lit("IPR"), user)),
        F.when(user % 5 >= 2, F.concat(F.lit("domain "), kind)),
        F.when(user % 5 >= 3, F.concat(F.lit("GO:"), user, F.lit("|GO:"), event)),
        F.when(user % 5 >= 4, F.concat(F.lit("KEGG: "), event)),
    )
    line = F.concat_ws("\t", *(column.cast("string") for column in columns))
    return events.select(line.alias("line"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_domains(domain_lines(spark, sf_dir))


@query("domains_parse", f"SELECT * FROM {SQL_DOMAINS}")
def domains_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array_join("go_annotations", "|").alias("go_terms")
    return domains(spark, sf_dir).select("*", terms).drop("go_annotations")


@query(
    "domains_go_explode",
    f"""SELECT protein_accession, sequence_length, unnest(string_split(go_terms, '|')) AS go_term
        FROM {SQL_DOMAINS} WHERE go_terms <> ''""",
)
def domains_go_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_ops.explode_terms(domains(spark, sf_dir), "protein_accession", "sequence_length")


@query("domains_analyses", f"SELECT DISTINCT lower(analysis) AS analysis FROM {SQL_DOMAINS}")
def domains_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_ops.distinct_analyses(domains(spark, sf_dir))


@query(
    "domains_select",
    f"""SELECT protein_accession, sequence_length, analysis, score FROM {SQL_DOMAINS}
        WHERE analysis IN ('Gene3D', 'PANTHER', 'Coils')""",
)
def domains_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = domain_ops.select_analyses(domains(spark, sf_dir))
    return kept.select("protein_accession", "sequence_length", "analysis", "score")


@query("domains_count", "SELECT count(*) AS n_records FROM events")
def domains_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_ops.record_count(domains(spark, sf_dir))


@query("json_roundtrip", "SELECT * FROM customer")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return from_json_rows(to_json_rows(customers), customers.schema)


@query(
    "tag_list",
    """SELECT p_partkey, unnest(list_filter(string_split(p_type || ',,' || p_brand || ',' || p_name, ','),
                                            lambda tag: tag <> '')) AS tag FROM part""",
)
def tag_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand", "p_name")
    tags = F.concat("p_type", F.lit(",,"), "p_brand", F.lit(","), "p_name")
    return parts.select("p_partkey", F.explode(comma_list(tags)).alias("tag"))


@query("domains_through_files", f"SELECT protein_accession, sequence_length, analysis, score, status FROM {SQL_DOMAINS}")
def domains_through_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "domains")
    domain_lines(spark, sf_dir).write.text(path)
    return read_domains(spark, path).select("protein_accession", "sequence_length", "analysis", "score", "status")
