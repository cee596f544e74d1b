"""Queries of the operators over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from strandmill.llm.byte_bpe import decode, encode
from strandmill.llm.common import held_out, table
from strandmill.llm.decontaminate import contamination
from strandmill.llm.exact_dedup import exact_duplicates
from strandmill.llm.hard_negatives import hard_negatives
from strandmill.llm.language_id import identify, learn_profiles
from strandmill.llm.line_runs import remove_repeated_runs
from strandmill.llm.main_text import extract
from strandmill.llm.near_dedup import near_duplicates
from strandmill.llm.packing import pack
from strandmill.llm.ppm import score_texts
from strandmill.llm.quotations import reply_ordered
from strandmill.llm.source_audit import source_divergence
from strandmill.llm.url_markov import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    profiles = learn_profiles(documents.where(~held_out(F.col("doc_id"), 4)))
    found = identify(documents, profiles)
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")


@query("op2_quotation_linking")
def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(table(spark, sf_dir, "conversations"))


@query("op3_main_text")
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query(
    "op4_near_dedup",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
        FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(len(ws) - 5, 0) + 1), lambda s: array_to_string(ws[s + 1 : s + least(5, len(ws))], ' '))) AS s
        FROM words WHERE len(ws) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
    reach AS (
        SELECT doc_id AS node, doc_id AS other FROM documents
        UNION
        SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other)
    SELECT node AS doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(other) AS component_id, node = min(other) AS kept
    FROM reach LEFT JOIN sizes ON sizes.doc_id = node GROUP BY node
    """,
)
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op5_exact_dedup",
    """
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
    FROM texts
    """,
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "text")
    return score_texts(documents, documents.where("not held_out"))


@query(
    "op7_decontamination",
    r"""
    WITH item_words AS (
        SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
        FROM benchmark),
    windows AS (
        SELECT item, least(10, len(ws)) AS width, unnest(list_transform(range(0, greatest(len(ws) - 10, 0) + 1), lambda s: array_to_string(ws[s + 1 : s + least(10, len(ws))], ' '))) AS win
        FROM item_words WHERE len(ws) > 0),
    docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
        FROM documents),
    widths AS (SELECT DISTINCT width FROM windows),
    places AS (
        SELECT doc_id, width, unnest(range(0, len(ws) - width + 1)) AS p, ws FROM docs, widths WHERE len(ws) >= width),
    matched AS (
        SELECT doc_id, p, places.width AS width, item
        FROM places JOIN windows ON windows.width = places.width AND win = array_to_string(ws[p + 1 : p + places.width], ' ')),
    hit AS (
        SELECT doc_id, count(DISTINCT pos) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + width)) AS pos FROM matched) GROUP BY doc_id),
    held AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item FROM matched) GROUP BY doc_id)
    SELECT docs.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit ON docs.doc_id = hit.doc_id LEFT JOIN held ON docs.doc_id = held.doc_id
    """,
)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query(
    "op9_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS idx
        FROM documents),
    counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines),
    pairs AS (
        SELECT a.doc_id AS first_doc, b.doc_id AS doc_id, a.idx - b.idx AS shift, b.idx AS idx, b.words AS words
        FROM counted a JOIN counted b ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.idx < b.idx)),
    islands AS (SELECT *, idx - row_number() OVER (PARTITION BY first_doc, doc_id, shift ORDER BY idx) AS island FROM pairs),
    runs AS (
        SELECT doc_id, min(idx) AS low, max(idx) AS high FROM islands
        GROUP BY first_doc, doc_id, shift, island HAVING sum(words) >= 50),
    gone AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS idx FROM runs)
    SELECT lines.doc_id, count(*) AS n_lines, count(gone.idx) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY lines.idx) FILTER (WHERE gone.idx IS NULL), '')) AS text_sha256
    FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.idx = gone.idx GROUP BY lines.doc_id
    """,
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeated_runs(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


def _url_filter_sql(order: int = 4) -> str:
    """The two Markov models and the threshold in SQL, one level of contexts after another."""
    parts = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {})"
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')"
    ordered = sorted(URL_RULES, key=lambda rule: -len(rule[0]))
    chosen = [
        "CASE " + " ".join(f"WHEN {fits.format(*rule[0].split('/', 1))} THEN '{rule[k]}'" for rule in ordered) + " END" for k in (0, 1)
    ]
    levels = []
    for j in range(order + 1):
        low = ("1.0 / 256", "1.0 / 256") if j == 0 else ("q.pa", "q.pb")
        shorter = "" if j == 0 else f"JOIN p{j - 1} q ON q.ctx = right(l.ctx, {j - 1}) AND q.ch = l.ch"
        p = ", ".join(f"CASE WHEN t{x} > 0 THEN ({x} + k{x} * CAST({y} AS DOUBLE)) / (t{x} + k{x}) ELSE CAST({y} AS DOUBLE) END AS p{x}" for x, y in zip("ab", low))
        levels.append(f"""
    l{j} AS (SELECT right(ctx, {j}) AS ctx, ch, sum(a) AS a, sum(b) AS b FROM counted GROUP BY ALL),
    s{j} AS (SELECT ctx, sum(a) AS ta, sum(b) AS tb, count(*) FILTER (a > 0) AS ka, count(*) FILTER (b > 0) AS kb FROM l{j} GROUP BY ctx),
    p{j} AS (SELECT l.ctx, l.ch, {p} FROM l{j} l JOIN s{j} s ON s.ctx = l.ctx {shorter}),""")
    return f"""
    WITH split AS (
        SELECT page_id, translate({parts.format(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {parts.format(2)} AS path FROM pages),
    parsed AS (SELECT *, {chosen[0]} AS rule, {chosen[1]} AS by_rule FROM split),
    urls AS (
        SELECT host, path, count(*) FILTER (by_rule = 'allow') AS n_allow, count(*) FILTER (by_rule = 'block') AS n_block
        FROM parsed GROUP BY host, path),
    padded AS (SELECT *, repeat(chr(2), {order}) || host || path || chr(3) AS p, unnest(range(1, length(host || path) + 2)) AS i FROM urls),
    grams AS (SELECT host, path, n_allow, n_block, substr(p, i, {order}) AS ctx, substr(p, i + {order}, 1) AS ch FROM padded),
    counted AS (SELECT ctx, ch, sum(n_allow) AS a, sum(n_block) AS b FROM grams GROUP BY ALL),{"".join(levels)}
    ratios AS (SELECT ctx, ch, CAST(round((log10(pa) - log10(pb)) * 1000000) AS BIGINT) AS ratio FROM p{order}),
    scored AS (SELECT host, path, n_allow, n_block, sum(ratio) / count(*) AS score FROM grams JOIN ratios USING (ctx, ch) GROUP BY ALL),
    threshold AS (SELECT round(0.5 * (sum(score * n_allow) / sum(n_allow) + sum(score * n_block) / sum(n_block)), 3) AS t FROM scored)
    SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN round(score, 3) < t THEN 'block' ELSE 'allow' END) AS verdict
    FROM parsed JOIN scored USING (host, path), threshold
    """


@query("op10_url_filter", _url_filter_sql())
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("score")


@query("op11_bpe_coding")
def op11_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    decoded = decode(encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query(
    "op12_source_divergence",
    r"""
    WITH docs AS (
        SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
        FROM documents),
    words AS (SELECT d, lang, source, unnest(regexp_extract_all(body, '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM docs),
    kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
    sources AS (SELECT DISTINCT lang, source FROM docs),
    counted AS (SELECT lang, source, term, count(*) AS c FROM words GROUP BY lang, source, term),
    used AS (
        SELECT lang, source, term, coalesce(c, 0) AS c
        FROM sources JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)),
    shares AS (
        SELECT lang, source, term, c, 1 + (CAST(1000000000 AS HUGEINT) * (c + 2)) // (sum(c) OVER w + 2 * count(*) OVER w) AS p
        FROM used WINDOW w AS (PARTITION BY lang, source)),
    of_langs AS (SELECT lang, term, sum(c) AS c FROM used GROUP BY lang, term),
    lang_shares AS (
        SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (c + 2)) // (sum(c) OVER w + 2 * count(*) OVER w) AS q
        FROM of_langs WINDOW w AS (PARTITION BY lang)),
    pairs AS (
        SELECT a.lang AS lang, a.source AS source, b.source AS item, (a.p - b.p) * (a.p - b.p) // (a.p + b.p) AS f
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source),
    valued AS (
        SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(v, 0) AS value
        FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT lang, source, item, sum(f) AS v FROM pairs GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares JOIN lang_shares USING (lang, term) WHERE c > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM valued)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank
    FROM ranked WHERE part = 'pair' OR r <= 10
    """,
)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


@query(
    "op13_hard_negatives",
    """
    WITH sound AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
               CAST(coalesce(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
        FROM sound a, sound b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
    QUALIFY row_number() OVER w <= 10
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    every_seventh = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", every_seventh), F.col("vec_id") % 100 == 0)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
