"""How far the sources of a language differ in the terms they use, by a frequent-pattern tree of term rows.

A term's row lists the sources that use it with their counts, in source order. Rows are inserted
into a prefix tree, equal rows once with their multiplicity, so a node stands for all terms that share the
row up to there. The divergence of two sources is a sum over all terms; it is taken apart into what it
would be if neither used any term, a correction for the terms that one of them uses, and a correction for
the terms that both use. The last one is computed once for each node and each of its ancestors, times the
node's multiplicity, in place of once for each term.

The tree is dealt to tasks as ranges of its sorted rows. A task walks its range and holds one path at
a time; a node that two ranges share is counted in both with the multiplicity that it has there, and the
sums are the same wherever the borders lie. All numbers are 64-bit integers: a language may have up to
nine quadrillion occurrences.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.llm.common import forget, materialise_at, small, tidy

MIN_DOCUMENTS = 10
TOP_TERMS = 10
FLUSH_TERMS = 200_000
BLOCK_SOURCES = 256
CHUNK_PAIRS = 1 << 18
BORDER_DEPTH = 4
_BREAKS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: bytes of a text to bytes of its terms: A-Z lower-cased, what no term holds as blanks
_TERM_BYTES = bytes.maketrans(_BREAKS + bytes(range(0x41, 0x5B)), b" " * len(_BREAKS) + bytes(range(0x61, 0x7B)))


def term_counts(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per lang, source and term: n occurrences, docs documents with the term.

    A term is a maximal run of ASCII letters and characters beyond ASCII, with A-Z lower-cased. Null
    values count as ''. Every row is a document. Tasks add up what they read before the shuffle.
    """
    plain = documents.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )

    def rows(found: dict) -> pa.RecordBatch:
        langs, sources, terms, n, docs = [], [], [], [], []
        for (lang, source), (occurrences, holders) in found.items():
            langs += [lang] * len(holders)
            sources += [source] * len(holders)
            terms += [term.decode() for term in holders]
            n += map(occurrences.__getitem__, holders)
            docs += holders.values()
        columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                words = text.as_py().translate(_TERM_BYTES).split()
                occurrences, holders = found[lang, source]
                size -= len(holders)
                occurrences.update(words)
                holders.update(set(words))
                size += len(holders)
                if size >= FLUSH_TERMS:
                    yield rows(found)
                    found.clear()
                    size = 0
        if size:
            yield rows(found)

    counted = plain.mapInArrow(tidy(count), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column) -> Column:
    """1 + floor(1,000,000,000 * count / total) for 0 <= count <= total, three digits at a time, so that nothing overflows."""
    rest, quotient = count, F.lit(0).cast("long")
    for _ in range(3):
        scaled = rest * 1000
        quotient = quotient * 1000 + F.call_function("div", scaled, total)
        rest = scaled % total
    return quotient + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _add_up(low: np.ndarray, high: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact sums of ``value`` by pair."""
    order = np.lexsort((high, low))
    low, high, value = low[order], high[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(low) != 0) | (np.diff(high) != 0))))
    return low[first], high[first], np.add.reduceat(value, first)


class _Walk:
    """A walk over the sorted term rows of one language, and the corrections of the nodes that it has left."""

    def __init__(self, lang: str):
        self.lang, self.counts = lang, []
        self.source = self.p = self.zero = np.zeros(0, np.int64)
        self.left, self.pairs = [], 0

    def leave(self, depth: int) -> None:
        """Close the open nodes below ``depth``; their terms belong to the nodes above, too."""
        while len(self.counts) > depth:
            d, m = len(self.counts) - 1, self.counts.pop()
            if d:
                self.counts[-1] += m
                self.left.append((self.source[: d + 1], self.p[: d + 1], self.zero[: d + 1], m))
                self.pairs += d

    def enter(self, source: np.ndarray, p: np.ndarray, zero: np.ndarray, multiplicity: int) -> None:
        shared = min(len(source), len(self.source))
        apart = np.flatnonzero((source[:shared] != self.source[:shared]) | (p[:shared] != self.p[:shared]))
        self.leave(int(apart[0]) if len(apart) else shared)
        self.source, self.p, self.zero = source, p, zero
        self.counts += [0] * (len(source) - len(self.counts))
        self.counts[-1] += multiplicity

    def corrections(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The sums over all combinations of a node that was left and an ancestor, for the terms that both sources use."""
        left, self.left, self.pairs = self.left, [], 0
        if left:
            depths = [len(path[0]) - 1 for path in left]
            above = [np.concatenate([path[k][:-1] for path in left]) for k in range(3)]
            here = [np.repeat([path[k][-1] for path in left], depths) for k in range(3)]
            p, q, p0, q0 = above[1], here[1], above[2], here[2]
            value = _apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)
            yield _add_up(above[0], here[0], value * np.repeat([path[3] for path in left], depths))


_PAIRS = "lang string, low long, high long, value long"


def _pair_rows(lang: str, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(low), pa.string()), pa.array(low), pa.array(high), pa.array(value)], ["lang", "low", "high", "value"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists of a column and where each list begins."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _tree_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = None
    for batch in batches:
        (source, at), (p, _), (zero, _) = (_lists(batch.column(name)) for name in ("source", "p", "zero"))
        for row, (lang, terms) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("terms").to_pylist())):
            if walk is None or walk.lang != lang:
                if walk is not None:
                    walk.leave(0)
                    for sums in walk.corrections():
                        yield _pair_rows(walk.lang, *sums)
                walk = _Walk(lang)
            part = slice(at[row], at[row + 1])
            walk.enter(source[part], p[part], zero[part], terms)
            if walk.pairs >= CHUNK_PAIRS:
                for sums in walk.corrections():
                    yield _pair_rows(lang, *sums)
    if walk is not None:
        walk.leave(0)
        for sums in walk.corrections():
            yield _pair_rows(walk.lang, *sums)


def _one_sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a source and a block of others: the sum if neither used a term, and the correction for the terms of the source."""
    for batch in batches:
        (p, at), (terms, _) = _lists(batch.column("p")), _lists(batch.column("terms"))
        (others, other_at), (other_zeros, _) = _lists(batch.column("others")), _lists(batch.column("other_zeros"))
        scalars = zip(*(batch.column(name).to_pylist() for name in ("lang", "source", "zero", "kept")))
        for row, (lang, source, zero, kept) in enumerate(scalars):
            other, z = (a[other_at[row] : other_at[row + 1]] for a in (others, other_zeros))
            z, other = z[other != source], other[other != source]
            if not len(other):
                continue
            neither = _apart(z, np.int64(zero))
            value = np.where(other > source, kept * neither, 0)
            step = max(1, CHUNK_PAIRS // len(other))
            for k in range(at[row], at[row + 1], step):
                some = slice(k, min(k + step, at[row + 1]))
                value = value + ((_apart(p[some, None], z[None, :]) - neither) * terms[some, None]).sum(axis=0)
            yield _pair_rows(lang, np.minimum(other, source), np.maximum(other, source), value)


def source_divergence(
    documents: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """One row per lang, source, part and item: value, rank.

    Part ``pair``: the item is another source of the language, the value their divergence; all of
    them. Part ``term``: the item is a term that the source uses more than its language does, the value its
    share of the divergence from the language; the first ``top_terms``. Ranks go by value descending,
    then by item. Terms in fewer than ``min_documents`` documents of the language are left out.

    Null lang, source and text count as ''. A source without terms, and a language without kept
    terms (all its pairs are 0), take part. Repeated rows count each. No other column is read. No rows give no rows.
    """
    spark = documents.sparkSession
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]
    counts = term_counts(documents, text_col=text_col, lang_col=lang_col, source_col=source_col)
    used = F.collect_list(F.struct("source", "n"))
    rows = counts.groupBy("lang", "term").agg(used.alias("used"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    rows, rows_path = materialise_at(rows.where(F.col("docs") >= min_documents).drop("docs"), "term-rows")
    uses = rows.select("lang", "term", "total", F.inline("used"))

    sources = documents.select(*names).distinct()
    langs = sources.groupBy("lang").agg(F.count("*").alias("n_sources"))
    langs = langs.join(rows.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n")), "lang", "left")
    totals = uses.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = sources.join(langs, "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["kept", "lang_n", "source_n"])
    groups = groups.withColumn("number", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    over = F.col("source_n") + 2 * F.col("kept")
    groups = groups.withColumn("over", over).withColumn("zero", F.when(over > 0, _share(F.lit(2).cast("long"), F.when(over > 0, over))).otherwise(F.lit(1)))
    groups, _ = materialise_at(groups, "source-groups")
    n_groups = groups.count()

    uses = uses.join(small(groups, n_groups), ["lang", "source"]).withColumn("p", _share(F.col("n") + 2, F.col("over")))
    uses, uses_path = materialise_at(uses.select("lang", "source", "term", "total", "number", "p", "zero", "kept", "lang_n"), "term-uses")
    forget(spark, rows_path)

    # term rows by their numbers, equal ones once; a row of one source has no pair
    paths = uses.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("number", "p", "zero"))).alias("path"))
    paths = paths.where(F.size("path") > 1).groupBy("lang", "path").agg(F.count("*").alias("terms"))
    # borders are drawn by the beginning of a path and split equal beginnings by hash, so that the sample for them stays small
    border = [F.col("lang"), F.slice("path", 1, BORDER_DEPTH), F.xxhash64("path")]
    paths = paths.repartitionByRange(*border).sortWithinPartitions("lang", "path")
    both = paths.select("lang", F.col("path.number").alias("source"), F.col("path.p").alias("p"), F.col("path.zero").alias("zero"), "terms")
    both = both.mapInArrow(tidy(_tree_corrections), _PAIRS)

    block = F.call_function("div", F.col("number"), F.lit(BLOCK_SOURCES))
    blocks = groups.groupBy("lang", block.alias("block")).agg(F.collect_list(F.struct("number", "zero")).alias("others"))
    blocks = blocks.select("lang", "block", F.col("others.number").alias("others"), F.col("others.zero").alias("other_zeros"))
    histograms = uses.groupBy("lang", "number", "p").agg(F.count("*").alias("terms")).groupBy("lang", "number").agg(F.collect_list(F.struct("p", "terms")).alias("uses"))
    one = groups.where("n_sources > 1").select("lang", "number", "zero", "kept", "n_sources").join(histograms, ["lang", "number"], "left")
    last_block = F.call_function("div", F.col("n_sources") - 1, F.lit(BLOCK_SOURCES))
    one = one.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last_block))).join(small(blocks, n_groups), ["lang", "block"])
    none = F.lit([]).cast("array<long>")
    one = one.select(
        "lang", F.col("number").alias("source"), "zero", "kept", F.coalesce("uses.p", none).alias("p"), F.coalesce("uses.terms", none).alias("terms"), "others", "other_zeros"
    ).mapInArrow(tidy(_one_sided), _PAIRS)

    pairs = both.unionByName(one).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    ends = F.inline(F.array(F.struct(F.col("low").alias("here"), F.col("high").alias("there")), F.struct(F.col("high").alias("here"), F.col("low").alias("there"))))
    pairs = pairs.select("lang", "value", ends)
    for number, name in (("here", "source"), ("there", "item")):
        pairs = pairs.join(small(groups.select("lang", F.col("number").alias(number), F.col("source").alias(name)), n_groups), ["lang", number])
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    q = _share(F.col("total") + 2, F.col("lang_n") + 2 * F.col("kept"))
    more = uses.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).where(F.col("p") > F.col("q"))
    excess = F.col("p") - F.col("q")
    terms = more.select("lang", "source", F.lit("term").alias("part"), "item", F.call_function("div", excess * excess, F.col("p") + F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)
