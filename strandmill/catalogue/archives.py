"""Web archives and outgoing links, over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.catalogue import query, table
from strandmill.operators.links import html_tags, link_occurrences, outlink_sets, outlinks, warc_outlinks
from strandmill.session import fresh_dir
from strandmill.sources import warc

SQL_LINKS = r"""(
    SELECT page_id, url,
           regexp_extract(url, '^https?://[^/?#]*') || regexp_extract(href, '^[^?]+') AS link
    FROM (SELECT page_id, url,
                 regexp_extract(tag, '[aA].+?[hH][rR][eE][fF]=[''"](.+?)[''"]', 1) AS href
          FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<([^>\n\r]*)>', 1)) AS tag
                FROM pages))
    WHERE href LIKE '/%')"""
SQL_OUTLINKS = f"SELECT DISTINCT page_id, link FROM {SQL_LINKS} WHERE link <> url"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url", "html")


@query("page_link_occurrences", f"SELECT page_id, link FROM {SQL_LINKS} WHERE link <> url")
def page_link_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_occurrences(pages(spark, sf_dir), "page_id")


@query("page_outlinks", SQL_OUTLINKS)
def page_outlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlinks(pages(spark, sf_dir), "page_id")


@query(
    "page_outlink_sets",
    f"""SELECT page_id, coalesce(string_agg(link, ' ' ORDER BY link), '') AS links
        FROM pages LEFT JOIN ({SQL_OUTLINKS}) USING (page_id) GROUP BY page_id""",
)
def page_outlink_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = outlink_sets(pages(spark, sf_dir), "page_id")
    return sets.select("page_id", F.array_join("links", " ").alias("links"))


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archive records; every third one is a request."""
    kind = F.when(F.col("page_id") % 3 == 0, "request").when(F.col("page_id") % 3 == 1, "response")
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nServer: test\r\n\r\n"), "html")
    return pages(spark, sf_dir).select(
        kind.otherwise("Response").alias("record_type"),
        F.lit("2015-06-02T00:00:00Z").alias("warc_date"),
        F.concat(F.lit("<urn:page:"), "page_id", F.lit(">")).alias("record_id"),
        F.lit("application/http").alias("content_type"),
        F.create_map(
            F.lit("WARC-Target-URI"), "url", F.lit("WARC-TREC-ID"), F.concat(F.lit("t-"), "page_id")
        ).alias("metadata"),
        body.cast("binary").alias("content"),
    )


def written_archive(spark: SparkSession, sf_dir: str, gzip: bool) -> DataFrame:
    path = fresh_dir(spark, "warc")
    warc.write_warc(page_records(spark, sf_dir), path, gzip)
    return warc.read_warc(spark, path)


SQL_RECORDS = """(
    SELECT CASE page_id % 3 WHEN 0 THEN 'request' WHEN 1 THEN 'response' ELSE 'Response' END AS record_type,
           '2015-06-02T00:00:00Z' AS warc_date,
           '<urn:page:' || page_id || '>' AS record_id,
           url, 't-' || page_id AS trec_id,
           'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Server: test' || chr(13) || chr(10) ||
               chr(13) || chr(10) || html AS text
    FROM pages)"""
SQL_ROUNDTRIP = f"""
    SELECT record_type, warc_date, record_id, 'application/http' AS content_type,
           CAST(strlen(text) AS INTEGER) AS content_length, url, text FROM {SQL_RECORDS}"""


def _whole_records(records: DataFrame) -> DataFrame:
    return records.select(
        "record_type",
        "warc_date",
        "record_id",
        "content_type",
        "content_length",
        warc.target_uri().alias("url"),
        warc.content_text().alias("text"),
    )


@query("warc_roundtrip", SQL_ROUNDTRIP)
def warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_records(written_archive(spark, sf_dir, gzip=False))


@query("warc_gzip_roundtrip", SQL_ROUNDTRIP)
def warc_gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_records(written_archive(spark, sf_dir, gzip=True))


SQL_HEADER = """'WARC/0.18' || chr(10) || 'WARC-Type: ' || record_type || chr(10) || 'WARC-Date: ' || warc_date || chr(10)
        || 'WARC-Target-URI: ' || url || chr(10) || 'WARC-TREC-ID: ' || trec_id || chr(10) || 'WARC-Record-ID: ' || record_id || chr(10)
        || 'Content-Type: application/http' || chr(10) || 'Content-Length: ' || strlen(text) || chr(10) || chr(10) || text"""


@query(
    "warc_nested_records",
    f"""SELECT '<urn:outer:' || record_id || '>' AS record_id, 'capture of' || chr(10) || {SQL_HEADER} || chr(10) || chr(10) || {SQL_HEADER} AS text
        FROM {SQL_RECORDS}""",
)
def warc_nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of archives: every payload holds two whole records, and the splits are so small that most records reach over an end."""
    inner = warc.to_warc_text()
    body = F.concat(F.lit("capture of\n"), inner, F.lit("\n\n"), inner)
    outer = page_records(spark, sf_dir).select(
        "record_type", "warc_date", F.concat(F.lit("<urn:outer:"), "record_id", F.lit(">")).alias("record_id"), "content_type",
        warc.clear_metadata().alias("metadata"), body.cast("binary").alias("content"),
    )
    path = fresh_dir(spark, "warc")
    warc.write_warc(outer, path, line_end="\n")
    records = warc.read_warc(spark, path, split_bytes="64k")
    return records.select("record_id", warc.content_text().alias("text"))


@query(
    "warc_record_numbers",
    "SELECT CAST(count(*) AS BIGINT) AS n_records, CAST(0 AS BIGINT) AS n_gaps FROM pages",
)
def warc_record_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every file the numbers run from 0 without a gap."""
    per_file = (
        written_archive(spark, sf_dir, gzip=False)
        .groupBy("file_path")
        .agg(
            F.count("*").alias("n"),
            (F.max("record_number") + 1 - F.count_distinct("record_number")).alias("gaps"),
        )
    )
    return per_file.agg(F.sum("n").alias("n_records"), F.sum("gaps").alias("n_gaps"))


@query(
    "warc_responses",
    f"SELECT record_id, url FROM {SQL_RECORDS} WHERE lower(record_type) = 'response'",
)
def warc_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = warc.warc_responses(written_archive(spark, sf_dir, gzip=True))
    return responses.select("record_id", warc.target_uri().alias("url"))


@query(
    "warc_metadata",
    f"""SELECT record_id, trec_id, record_type AS known_key, 'kept' AS added_key,
               CAST(3 AS INTEGER) AS n_entries,
               CAST(length('WARC/0.18') + 1
                    + length('WARC-Type: ') + length(record_type) + 1
                    + length('WARC-Date: ') + length(warc_date) + 1
                    + length('WARC-Target-URI: ') + length(url) + 1
                    + length('WARC-TREC-ID: ') + length(trec_id) + 1
                    + length('WARC-Record-ID: ') + length(record_id) + 1
                    + length('Content-Type: application/http') + 1
                    + length('Content-Length: ') + length(CAST(strlen(text) AS VARCHAR)) + 1
                    + strlen(text) AS INTEGER) AS total_length
        FROM {SQL_RECORDS}""",
)
def warc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = written_archive(spark, sf_dir, gzip=True)
    lengths = records.withColumn("total_length", warc.total_record_length())
    added = lengths.withColumn("metadata", warc.put_metadata(F.lit("X-Note"), F.lit("kept")))
    refused = added.withColumn("metadata", warc.put_metadata(F.lit("WARC-Type"), F.lit("changed")))
    return refused.select(
        "record_id",
        warc.trec_id().alias("trec_id"),
        warc.metadata_item("WARC-Type").alias("known_key"),
        warc.metadata_item("X-Note").alias("added_key"),
        F.size("metadata").alias("n_entries"),
        "total_length",
    )


@query(
    "warc_outlinks",
    f"""SELECT '<urn:page:' || page_id || '>' AS record_id, url, link
        FROM (SELECT DISTINCT page_id, url, link FROM {SQL_LINKS} WHERE link <> url AND page_id % 3 <> 0)""",
)
def warc_page_outlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_outlinks(written_archive(spark, sf_dir, gzip=True), "record_id")


@query(
    "warc_metadata_entries",
    f"SELECT record_id, 'X-Note' AS key, trec_id AS value FROM {SQL_RECORDS}",
)
def warc_metadata_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata is cleared, set and listed."""
    records = written_archive(spark, sf_dir, gzip=True)
    cleared = records.withColumn("note", warc.trec_id()).withColumn("metadata", warc.clear_metadata())
    noted = cleared.withColumn("metadata", warc.put_metadata(F.lit("X-Note"), F.col("note")))
    return warc.metadata_entries(noted, "record_id")


@query(
    "page_tags",
    r"SELECT page_id, CAST(len(regexp_extract_all(html, '<([^>\n\r\x{85}\x{2028}\x{2029}]*)>')) AS INTEGER) AS n_tags, "
    r"array_to_string(regexp_extract_all(html, '<([^>\n\r\x{85}\x{2028}\x{2029}]*)>', 1), ' ') AS tags FROM pages",
)
def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_tags(F.col("html"))
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.size(found).alias("n_tags"), F.array_join(found, " ").alias("tags"))


# every form of a link, in a page made of the columns of ``pages``
SQL_FORMS = """(
    SELECT page_id, 'http://h' || page_id || '.example/a/b/c.html' AS base, CAST(page_id AS VARCHAR) AS id FROM pages)"""


@query(
    "page_links_resolved",
    f"""SELECT page_id, unnest([
            'http://h' || id || '.example/a/up/' || id,
            'http://other.example/' || id || '/x',
            'http://h' || id || '.example/a/b/?only=' || id,
            'https://abs.example/' || id || '#part',
            'http://h' || id || '.example/area/' || id,
            'http://h' || id || '.example/a/b/frames/' || id || '.html',
            'http://h' || id || '.example/a/b/i/' || id]) AS link
        FROM {SQL_FORMS}""",
)
def page_links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative, rooted, host-relative and absolute links, queries, and links of other tags."""
    text = lambda *parts: F.concat(*(F.lit(part) if isinstance(part, str) else part for part in parts))
    number = F.col("page_id").cast("string")
    html = text(
        '<p><a class=x href="../up/', number, '?x=1">up</a> <a href="//other.example/', number, '/x">host</a>',
        "<a href='?only=", number, "'>query</a> <a href=\"https://abs.example/", number, '#part">absolute</a>',
        '<area shape=rect href="/area/', number, '"> <frame name=f src="frames/', number, '.html"> <iframe src="./i/', number, '"></iframe>',
        '<a href="mailto:x@example.com">mail</a> <a href="http://h', number, '.example/a/b/c.html">itself</a>',
    )
    made = table(spark, sf_dir, "pages", "page_id").select("page_id", text("http://h", number, ".example/a/b/c.html").alias("url"), html.alias("html"))
    return link_occurrences(made, "page_id")
