"""Benchmark decontamination by a prefix-filtered set join on item-sized windows.

A window is ``size`` consecutive words of an item (the whole item if it is shorter). A document
holds a window only if it holds all its words, so one word is a sufficient join prefix: the
window's rarest word, by counts over all documents. Occurrences of these words are joined, the
position of the word in its window bounds where the window can lie, and the words there are
compared in full. Windows of one item that share their rarest word occurrence are tested together.

Only DataFrame functions are used. Documents are read twice, for the counts and for the
join; neither pass shuffles words. The word tables are broadcast in blocks of a fixed
number of rows, so a large benchmark means more passes, not a larger broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import ascii_lower, materialise

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Words in their own case: digits, A-Z, a-z and everything beyond ASCII; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    return F.filter(parts, lambda word: word != "")


def _trimmed(parts: str) -> Column:
    """As ``words_of`` for a split column: only its first and last part can be empty."""
    first = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, first + 1, F.size(parts) - first - last)


def _blocks(df: DataFrame, key: str, block_rows: int) -> list[DataFrame]:
    """``df`` in broadcast blocks of about ``block_rows`` rows by the hash of ``key``."""
    n = max(1, -(-df.count() // block_rows))
    if n == 1:
        return [F.broadcast(df)]
    block = F.pmod(F.xxhash64(key), F.lit(n))
    return [F.broadcast(df.where(block == k)) for k in range(n)]


def word_counts(texts: DataFrame, text_col: str, vocabulary: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, n): occurrences of the words of ``vocabulary`` in all texts, lower-cased."""
    words = texts.select(F.explode(F.split(text_col, SEPARATORS)).alias("w")).select(F.lower("w").alias("word"))
    parts = [words.join(block, "word").groupBy("word").agg(F.count("*").alias("n")) for block in _blocks(vocabulary, "word", block_rows)]
    return reduce(DataFrame.unionAll, parts)


def item_anchors(items: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """(key, at, item_id, width, wins): a rarest word, its place, and the windows that chose it.

    ``wins`` holds (from, text) of the windows whose rarest word is the one at ``at``; equally
    rare words are told apart by the word and then by the place, the first one winning.
    """
    words = items.select("item_row", "item_id", F.posexplode("words").alias("at", "word"))
    keyed = (
        words.withColumn("key", F.lower("word"))
        .join(counts.withColumnRenamed("word", "key"), "key", "left")
        .groupBy("item_row", "item_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word", F.coalesce("n", F.lit(0)).alias("n"), "key"))).alias("ws"))
    )
    width = F.least(F.lit(size), F.size("ws"))
    starts = F.sequence(F.lit(0), F.size("ws") - F.col("width"))
    chosen = lambda s: F.array_min(
        F.transform(F.slice("ws", s + 1, F.col("width")), lambda w: F.struct(w["n"].alias("n"), w["key"].alias("key"), w["at"].alias("at")))
    )
    text = lambda s: F.array_join(F.transform(F.slice("ws", s + 1, F.col("width")), lambda w: w["word"]), " ")
    return (
        keyed.withColumn("width", width)
        .select("item_row", "item_id", "width", F.explode(F.transform(starts, lambda s: F.struct(s.alias("from"), text(s).alias("text"), chosen(s).alias("by")))).alias("w"))
        .groupBy("item_row", "item_id", "width", F.col("w.by.key").alias("key"), F.col("w.by.at").alias("at"))
        .agg(F.collect_list(F.struct(F.col("w.from").alias("from"), F.col("w.text").alias("text"))).alias("wins"))
        .select("key", "at", "item_id", "width", "wins")
    )


def _matches() -> Column:
    """(begin, end) word positions of the anchor's windows that the document holds there."""
    begin = lambda w: F.col("pos") - F.col("at") + w["from"]
    there = lambda w: ascii_lower(F.array_join(F.slice("words", begin(w) + 1, F.col("width")), " "))
    fitting = F.filter(F.col("wins"), lambda w: (begin(w) >= 0) & (begin(w) + F.col("width") <= F.size("words")))
    held = F.filter(fitting, lambda w: there(w) == w["text"])
    return F.transform(held, lambda w: F.struct(begin(w).alias("begin"), (begin(w) + F.col("width")).alias("end")))


def _covered(spans: Column) -> Column:
    """Number of positions that the spans cover together."""
    step = lambda acc, s: F.struct(
        F.greatest(acc["upto"], s["end"]).alias("upto"),
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["upto"], s["begin"]))).cast("long").alias("n"),
    )
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids as strings), spans.

    ``spans`` are the hit (begin, end) word ranges, unmerged. A null or wordless text has no words and no hits; a null or
    wordless item has no window; items with a null id mark words but are not listed. Repeated
    documents each get their row. Other columns are not read.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.transform(words_of(F.col(item_text_col)), ascii_lower).alias("words")).where(F.size("words") > 0)
    # the words are the item's identity: equal rows say the same and may become one
    items = materialise(items.distinct().withColumn("item_row", F.xxhash64("item_id", "words")), "items")
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    vocabulary = items.select(F.explode("words").alias("word")).select(F.lower("word").alias("word")).distinct()
    counts = materialise(word_counts(docs, "text", vocabulary, block_rows), "word-counts")
    anchors = materialise(item_anchors(items, counts, size), "anchors")

    # the null in front gives every document one row that no anchor joins
    split = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", SEPARATORS).alias("parts"))
    placed = split.select("doc_id", "text_key", _trimmed("parts").alias("words"))
    placed = placed.select("doc_id", "text_key", "words", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "words")).alias("pos1", "w"))
    placed = placed.select("doc_id", "text_key", "words", (F.col("pos1") - 1).alias("pos"), F.lower("w").alias("key"))
    found = []
    for k, block in enumerate(_blocks(anchors, "key", block_rows)):
        joined = placed.join(block, "key", "left") if k == 0 else placed.join(block, "key")
        found.append(
            joined.where((F.col("pos") < 0) | F.col("wins").isNotNull()).select(
                "doc_id",
                "text_key",
                F.when(F.col("pos") < 0, F.size("words")).alias("n_words"),
                "item_id",
                F.when(F.col("pos") >= 0, _matches()).alias("spans"),
            )
        )
    # no filter on spans here: it would be pushed below the join, out of generated code, for every word
    per_doc = reduce(DataFrame.unionAll, found).groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.size("spans") > 0, F.col("item_id")))).alias("items"),
    )
    return per_doc.select(
        "doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), "items", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    ).drop("copy")
