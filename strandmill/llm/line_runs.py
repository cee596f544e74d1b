"""Line dedup: repeated runs of lines by prefix doubling over line-ID sequences.

A run is a sequence of consecutive lines of one document. A run of at least ``min_words`` words that
also begins at an earlier place (an earlier document by id, or an earlier line) is a later copy, and its
lines are deleted. For that, every line start needs the longest run that an earlier start shares:
its deepest interval of the longest-common-prefix tree in which it is not the first place.

Suffixes of the line-ID sequences are named by doubling: round k names the run of 2**k lines
at every start by its first place, from the names of its two halves, and drops what occurs once. Then the
rounds are gone through downwards: starts whose runs are equal so far form an interval, which splits by the name
of the next 2**k lines; a start that is not the first place of its part grows by 2**k. The first place of an interval
stands in it for every start that has gone on to longer runs, so no interval loses its first place.

Lines that occur once cut the sequences and take no part. Documents with the same text are one sequence;
the later ones are deleted whole if they have ``min_words`` words. Lines are compared by 128 bits of hash.
Only DataFrame functions are used; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import BROADCAST_ROWS, forget, materialise, materialise_at, small, unused

MIN_WORDS = 50
HOT_SHARE = 1_000  # a name of more than one row in so many is joined by broadcast, so there are fewer of them
_ODD_SPACE = r"^ | $|  |[\t\x0b\f\r]"


def count_words(line: Column) -> Column:
    """Words between white space; by blanks alone where single blanks are the only white space."""
    blanks = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return (
        F.when(line == "", 0)
        .when(line.rlike(_ODD_SPACE), F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")))
        .otherwise(blanks + 1)
        .cast("int")
    )


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_table(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, h, h2, idx, l1, l2, words) per line; (doc, h) names a document, h and h2 its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(F.col(id_col).alias("doc"), text.alias("text"))
    lines = docs.select(
        "doc", _text_hash(F.col("text")).alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"), F.posexplode(F.split("text", "\n")).alias("idx", "line")
    )
    return lines.select("doc", "h", "h2", "idx", F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(1), F.col("line")).alias("l2"), count_words(F.col("line")).alias("words"))


def _with_names(rows: DataFrame, names: DataFrame, key: list[str], dealt_by: list[str], n_rows: int) -> DataFrame:
    """``rows`` that have a name, with it. ``names``: key, first, n (its rows among ``rows``, or more).

    Names of very many rows are broadcast, and these rows are then dealt by ``dealt_by`` in place of the key, so that a
    line that a third of all rows share is spread over all tasks.
    """
    hot_rows = max(1, n_rows // HOT_SHARE)
    hot = F.broadcast(names.where(F.col("n") > hot_rows).select(*key, F.col("first").alias("hot_first")))
    cold = names.where(F.col("n") <= hot_rows).select(F.col(key[0]).alias("cold_0"), F.col(key[1]).alias("cold_1"), F.col("first").alias("cold_first"))
    lone = F.col("hot_first").isNull()
    dealt = rows.join(hot, key, "left").withColumn("dealt", F.when(lone, F.col(key[0])).otherwise(F.xxhash64(*dealt_by)))
    named = dealt.join(cold, (F.col("dealt") == F.col("cold_0")) & (F.col(key[1]) == F.col("cold_1")) & lone, "left")
    return named.withColumn("first", F.coalesce("hot_first", "cold_first")).where(F.col("first").isNotNull()).select(*rows.columns, "first")


def _copies(lines: DataFrame) -> DataFrame:
    """(doc, h, words): documents whose text a document with a smaller id has too."""
    docs = materialise(lines.groupBy("doc", "h", "h2").agg(F.sum("words").alias("words")), "run-docs")
    firsts = docs.groupBy("h", "h2").agg(F.min(F.struct("doc")).alias("first"), F.count("*").alias("n")).where("n > 1")
    named = _with_names(docs, firsts, ["h", "h2"], ["doc"], docs.count())
    return named.where(~F.col("doc").eqNullSafe(F.col("first.doc"))).select("doc", "h", "words")


def _starts(lines: DataFrame, n_lines: int) -> DataFrame:
    """The lines that occur more than once, in order: pos, seg, doc, h, idx, upto, g, g_seg.

    ``pos`` numbers them by document and line, neighbours in a document by consecutive numbers; ``seg`` is the
    first pos of a stretch of neighbouring lines; ``upto`` sums the words of the stretch; ``g`` names the line.
    """
    lines = lines.select("doc", "h", "idx", "l1", "l2", "words")
    repeated = lines.groupBy("l1", "l2").agg(F.count("*").alias("n")).where("n > 1").withColumn("first", F.lit(True))
    active = _with_names(lines, repeated, ["l1", "l2"], ["doc", "idx"], n_lines).drop("first")
    ordered = active.repartitionByRange("doc", "h").sortWithinPartitions("doc", "h", "idx").withColumn("pos", F.monotonically_increasing_id())
    placed = materialise(ordered, "run-lines").withColumn("stretch", F.col("idx") - F.col("pos"))
    placed = placed.selectExpr(
        "*",
        "min(pos) OVER (PARTITION BY doc, h, stretch) AS seg",
        "sum(words) OVER (PARTITION BY doc, h, stretch ORDER BY idx ROWS UNBOUNDED PRECEDING) AS upto",
    )
    placed = materialise(placed.select("pos", "seg", "doc", "h", "idx", "words", "upto", "l1", "l2"), "run-starts")
    return _named(placed, ["l1", "l2"], placed.count(), ["doc", "h", "idx", "words", "upto"])


def _named(rows: DataFrame, key: list[str], most: int, keep: list[str] | None = None) -> DataFrame:
    """``rows``, at most ``most``, whose key occurs more than once, named by the key's first place: g and its stretch g_seg."""
    names = rows.groupBy(*key).agg(F.min(F.struct("pos", "seg")).alias("first"), F.count("*").alias("n")).where("n > 1")
    named = rows.join(F.broadcast(names), key) if most <= BROADCAST_ROWS else _with_names(rows, names, key, ["pos"], most)
    return named.select("pos", "seg", *(keep or []), F.col("first.pos").alias("g"), F.col("first.seg").alias("g_seg"))


def longest_runs(starts: DataFrame) -> DataFrame:
    """(pos, len) of every start that shares a run with an earlier one, ``len`` lines being its longest."""
    spark = starts.sparkSession
    levels, sizes, paths = [starts.select("pos", "seg", "g", "g_seg")], [starts.count()], []
    while sizes[-1]:
        half = 1 << (len(levels) - 1)
        here, rows = levels[-1], sizes[-1]
        after = here.select((F.col("pos") - half).alias("pos"), "seg", F.col("g").alias("g2"))
        pairs = here.select("pos", "seg", "g").join(small(after, rows), ["pos", "seg"])
        named, path = materialise_at(_named(pairs, ["g", "g2"], rows), "run-names")
        levels.append(named)
        sizes.append(named.count())
        paths.append(path)

    runs, runs_path, n_runs = None, None, 0
    for k in range(len(levels) - 1, -1, -1):
        size, names = 1 << k, levels[k]
        later = names.where("pos > g")
        grown = later.select("pos", "seg", F.lit(size).alias("len"), F.col("g").alias("first"), F.col("g_seg").alias("first_seg"))
        if n_runs:
            sharers = runs.select("pos", "seg", "len", "first", F.lit(True).alias("own"))
            standing = runs.select(F.col("first").alias("pos"), F.col("first_seg").alias("seg"), "len", "first", F.lit(False).alias("own"))
            nexts = sharers.unionAll(standing).withColumn("at", F.col("pos") + F.col("len"))
            nexts = nexts.join(small(names.select(F.col("pos").alias("at"), "seg", F.col("g").alias("next")), sizes[k]), ["at", "seg"])
            parts = nexts.groupBy("len", "first", "next").agg(F.min(F.struct("pos", "seg")).alias("least"))
            longer = nexts.where("own").join(small(parts, 2 * n_runs), ["len", "first", "next"]).where(F.col("pos") > F.col("least.pos"))
            longer = longer.select("pos", F.col("least.pos").alias("first_"), F.col("least.seg").alias("first_seg_"))
            kept = runs.join(small(longer, n_runs), "pos", "left").select(
                "pos",
                "seg",
                F.when(F.col("first_").isNull(), F.col("len")).otherwise(F.col("len") + size).alias("len"),
                F.coalesce("first_", "first").alias("first"),
                F.coalesce("first_seg_", "first_seg").alias("first_seg"),
            )
            grown = kept.unionAll(grown.join(small(runs.select("pos"), n_runs), "pos", "left_anti"))
        before = runs_path
        runs, runs_path = materialise_at(grown, "run-lengths")
        n_runs = runs.count()
        if before:
            forget(spark, before)
    forget(spark, *paths)
    return runs.select("pos", "len")


def _merged(spans: Column) -> Column:
    """Sorted spans (begin, end) that neither touch nor overlap, covering the same lines."""
    empty = F.expr("cast(array() as array<struct<begin:int,end:int>>)")

    def step(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(F.size(done) == 0, F.array(span)).when(
            span["begin"] <= last["end"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), empty, step)


def repeated_spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, h, spans, whole): the line ranges to delete of each document that has some.

    ``whole`` marks a document that repeats an earlier one.
    """
    lines = materialise(line_table(documents, id_col, text_col), "run-all-lines")
    copies = materialise(_copies(lines), "run-copies")
    if not lines.where("idx = 0").groupBy("doc", "h").count().where("count > 1").isEmpty():
        lines = lines.dropDuplicates(["doc", "h", "idx"])  # rows that repeat id and text are one document
    first = lines.alias("l").join(copies.alias("c"), F.col("l.doc").eqNullSafe(F.col("c.doc")) & (F.col("l.h") == F.col("c.h")), "left_anti")
    starts = materialise(_starts(first, lines.count()), "run-active")
    runs = longest_runs(starts)
    begins = runs.join(starts.select("pos", "doc", "h", "idx", (F.col("upto") - F.col("words")).alias("before")), "pos")
    ends = begins.withColumn("last", F.col("pos") + F.col("len") - 1).join(starts.select(F.col("pos").alias("last"), "upto"), "last")
    long = ends.where(F.col("upto") - F.col("before") >= min_words)
    spans = long.groupBy("doc", "h").agg(F.collect_list(F.struct(F.col("idx").alias("begin"), (F.col("idx") + F.col("len")).alias("end"))).alias("spans"))
    spans = spans.select("doc", "h", _merged(F.col("spans")).alias("spans"), F.lit(False).alias("whole"))
    none = F.expr("cast(array() as array<struct<begin:int,end:int>>)")
    return spans.unionAll(copies.where(F.col("words") >= min_words).select("doc", "h", none.alias("spans"), F.lit(True).alias("whole")))


def remove_repeated_runs(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with later copies of runs taken out of the text, and ``__lines``, ``__removed`` (numbers of lines).

    A text that loses all its lines is empty. Lines end at a line feed; all other columns are
    passed on, but for those named ``__lines`` or ``__removed``, which are replaced. A null text stays null and has one empty line. A null id
    comes before all others; rows that repeat both id and text are one document and are treated alike. Empty lines have no
    words and go only as part of a longer run.
    """
    decided = materialise(repeated_spans(documents, id_col=id_col, text_col=text_col, min_words=min_words), "run-spans")
    doc, h, spans, whole = unused(documents.columns, "__doc", "__h", "__spans", "__whole")
    numbers = decided.agg(F.sum(F.size("spans") + 2).alias("n")).first()["n"] or 0
    decided = small(decided, numbers).select(F.col("doc").alias(doc), F.col("h").alias(h), F.col("spans").alias(spans), F.col("whole").alias(whole))
    text = F.col(text_col).cast("string")
    joined = documents.join(decided, F.col(id_col).eqNullSafe(F.col(doc)) & (_text_hash(text) == F.col(h)), "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda line, i: ~F.exists(F.col(spans), lambda s: (i >= s["begin"]) & (i < s["end"])))
    n_lines = F.when(text.isNull(), 1).otherwise(F.size(lines))
    removed = F.when(F.col(whole), n_lines).otherwise(
        F.coalesce(F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["begin"]), F.lit(0))
    )
    joined = joined.withColumns({"__lines": n_lines.cast("long"), "__removed": removed.cast("long")})
    cleaned = F.when(F.col(whole), "").when(F.size(spans) > 0, F.array_join(kept, "\n")).otherwise(text)
    return joined.withColumn(text_col, cleaned).drop(doc, h, spans, whole)
