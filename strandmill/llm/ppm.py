"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of the bytes that
follow, learned from whole texts with A-Z lower-cased. The probability of a byte is found at the
longest context that has been seen; a byte that is new there costs an escape, (distinct bytes) / (all bytes +
distinct bytes), and is looked for in the next shorter context, where the bytes that the longer one
has are excluded; below the empty context every byte left is equally likely. A text's score is
the sum over its bytes and an end byte.

Counts cover all training texts. Shorter contexts are sums over longer ones, so one table of
(context, byte) counts is shuffled. The model is that table, whole: one row per context. What is broadcast is a cache of
bounded size: the probabilities of the most frequent bytes with their full contexts, at most ``cache_nodes``, and the
lowest orders. The documents' other bytes with their contexts are made distinct, joined to the table one order after the other and
joined back, so every probability is that of the whole model. Only if ``max_nodes`` is given is the model pruned: it then keeps
the nodes of at least a least count, chosen so that there are at most that many; what is not kept adds its
count to its context's escape, so the probabilities still sum to one.

The base score is a unigram model of words. Counts of the frequent words, at most
``max_words``, are broadcast; a document's other words are joined to the count table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm.common import materialise, tidy
from strandmill.llm.hashing import word_hashes_of_all

ORDER = 5
CACHE_NODES = 500_000
LOW_NODES = 100_000  # orders 0 and 1 have at most 65,792
MAX_WORDS = 150_000
END_WORD = 1  # the key of the end token
BYTE, WORD = 0, 1
BATCH_BYTES = 1 << 20
HELD_ENTRIES = 1_500_000
LISTS = ("unseen", "unseen_n", "rare", "rare_n")
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch as bytes with A-Z lower-cased, empty for null, about ``BATCH_BYTES`` at a time.

    With each portion goes the row of its first text.
    """
    begin, size, raws = 0, 0, []
    for i, text in enumerate(batch.column("text")):
        raw = (text.as_py() or "").encode().lower()
        if raws and size + len(raw) > BATCH_BYTES:
            yield begin, raws
            begin, size, raws = i, 0, []
        raws.append(raw)
        size += len(raw)
    if raws:
        yield begin, raws


def contexts_and_bytes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end byte of the texts, it and the ``ORDER`` bytes before it as one number.

    Also returns how many numbers each text has. Zero bytes stand before a text and end it.
    """
    pad = b"\0" * ORDER
    data = np.frombuffer(b"".join(part for raw in raws for part in (pad, raw, b"\0")), np.uint8).astype(np.uint64)
    sizes = np.array([len(raw) + 1 for raw in raws], np.int64)
    gram = np.zeros(max(0, len(data) - ORDER), np.uint64)
    for k in range(ORDER + 1):
        gram = gram << np.uint64(8) | data[k : len(data) - ORDER + k]
    begins = np.cumsum(np.concatenate(([0], sizes[:-1] + ORDER)))  # windows that end in padding lie between texts
    keep = np.zeros(len(gram) + 1, np.int8)
    keep[begins] += 1
    np.subtract.at(keep, begins + sizes, 1)
    return gram[np.cumsum(keep[:-1]) > 0], sizes


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def corpus_counts(training: DataFrame) -> DataFrame:
    """(kind, key, n) over all texts: byte with its context, and word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {BYTE: [], WORD: []}

        def rows(kind: int) -> pa.RecordBatch:
            keys, n = _merge(held[kind])
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n)], ["kind", "key", "n"])

        for batch in batches:
            for _, portion in _portions(batch):
                words, _ = word_hashes_of_all(portion)
                words = np.concatenate((words, np.full(len(portion), END_WORD, np.uint64)))
                for kind, keys in ((BYTE, contexts_and_bytes(portion)[0]), (WORD, words)):
                    held[kind].append(np.unique(keys, return_counts=True))
                    if sum(len(p[0]) for p in held[kind]) > HELD_ENTRIES:
                        held[kind] = [_merge(held[kind])]
                        if len(held[kind][0][0]) > HELD_ENTRIES // 2:
                            yield rows(kind)
        for kind in (BYTE, WORD):
            if held[kind]:
                yield rows(kind)

    return training.mapInArrow(tidy(count), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int) -> Column:
    """A condition on n, n >= a least count, that at most ``most`` rows meet.

    The least count is exact up to 4,096 and a power of two beyond.
    """
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    binned = counts.groupBy(step.alias("n")).agg(F.count("*").alias("rows")).collect()
    rows, least = 0, 1 << 62
    for row in sorted(binned, key=lambda r: -r["n"]):
        rows += row["rows"]
        if rows > most:
            break
        least = row["n"]
    return F.col("n") >= least


def _columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size, on the driver."""
    table = df.toArrow()
    return [table.column(c).to_numpy() for c in df.columns]


class Trie:
    """The context trie as sorted arrays, one set for each order."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        """``nodes[j]``: contexts of j bytes with a following byte, as numbers, and their counts; then of each node's
        context the count of all its bytes, kept or not, and how many different ones there are.

        The suffix of every node is a node of the order below.
        """
        self.grams = []
        self.contexts = []
        for j, (keys, counts, totals, kinds) in enumerate(nodes):
            order = np.argsort(keys)
            keys, counts = keys[order].astype(np.uint64), counts[order].astype(np.float64)
            context, first, distinct = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
            total, kind = totals[order][first].astype(np.float64), kinds[order][first].astype(np.float64)
            above = counts * 0
            if j:  # the counts of the same bytes in the context that is one byte shorter
                short = keys & np.uint64((1 << 8 * j) - 1)
                above = self.grams[j - 1][1][np.searchsorted(self.grams[j - 1][0], short)]
            kept, excluded = (np.add.reduceat(x, first) if len(first) else x for x in (counts, above))
            self.grams.append((keys, counts))
            # a byte that is not kept is new to the model: its count is part of the escape's
            self.contexts.append((context, kept, distinct.astype(np.float64), kind + total - kept, excluded))

    @staticmethod
    def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def log10(self, grams: np.ndarray, gone_total: np.ndarray | None = None, gone_distinct: np.ndarray | None = None) -> np.ndarray:
        """log10 of the probability of the last byte of each number after the bytes before it.

        A number that escaped from a context longer than the trie's comes with the count, in the context one byte shorter,
        of the bytes found there, and with how many these are.
        """
        result = np.zeros(len(grams))
        open_ = np.ones(len(grams), bool)  # the byte has not been found yet
        gone_total = np.zeros(len(grams)) if gone_total is None else gone_total
        gone_distinct = np.zeros(len(grams)) if gone_distinct is None else gone_distinct
        for j in range(len(self.grams) - 1, -1, -1):
            keys, counts = self.grams[j]
            context, kept, distinct, escape, excluded = self.contexts[j]
            mine = grams & np.uint64((1 << 8 * (j + 1)) - 1)
            at, known = self._find(context, mine >> np.uint64(8))
            known &= open_
            if not known.any():
                continue
            spot, found = self._find(keys, mine)
            found &= known
            new = escape[at] - gone_distinct
            room = kept[at] - gone_total + new
            result[found] += np.log10(counts[spot[found]] / room[found])
            escaped = known & ~found & (new > 0)
            result[escaped] += np.log10(new[escaped] / room[escaped])
            open_ &= ~found
            gone_total = np.where(known, excluded[at], 0.0)
            gone_distinct = np.where(known, distinct[at], 0.0)
        left = np.maximum(1.0, 256 - gone_distinct)
        result[open_] -= np.log10(left[open_])
        return result


def _levels(grams: DataFrame) -> DataFrame:
    """(level, key, n, above) of every node: its count and that of the same byte in the context one byte shorter."""
    nodes, level = None, grams.select("key", "n")
    for j in range(ORDER, -1, -1):
        short = F.col("key").bitwiseAND((1 << 8 * j) - 1)
        above = F.sum("n").over(W.partitionBy(short)) if j else F.lit(0).cast("long")
        mine = level.select(F.lit(j).alias("level"), "key", "n", above.alias("above"))
        nodes = mine if nodes is None else nodes.unionAll(mine)
        level = level.groupBy(short.alias("key")).agg(F.sum("n").alias("n"))
    return nodes


def _contexts(nodes: DataFrame, kept: Column) -> DataFrame:
    """One row per context with a kept node: the sums ``Trie`` has, and the counts of its kept bytes, at most 256."""
    byte = F.when(kept, F.struct(F.col("key").bitwiseAND(255).alias("byte"), "n"))
    return (
        nodes.groupBy("level", F.shiftright("key", 8).alias("context"))
        .agg(
            F.sum("n").alias("total"),
            F.count("*").alias("kinds"),
            F.sum(F.when(kept, F.col("n"))).alias("held"),
            F.count(byte).alias("distinct"),
            F.sum(F.when(kept, F.col("above"))).alias("excluded"),
            F.map_from_entries(F.collect_list(byte)).alias("bytes"),
        )
        .where("distinct > 0")
        .withColumn("escape", F.col("kinds") + F.col("total") - F.col("held"))
    )


def _exact(asked: DataFrame, contexts: DataFrame, low: list[tuple[np.ndarray, ...]]) -> DataFrame:
    """(key, log) of the distinct ``asked`` keys by the whole model; ``low`` has the nodes of the lowest orders."""
    nothing = F.lit(0.0)
    open_ = asked.select("key", nothing.alias("log"), F.lit(False).alias("found"), nothing.alias("gone_total"), nothing.alias("gone_distinct"))
    for j in range(ORDER, len(low) - 1, -1):
        here = contexts.where(F.col("level") == j).select("context", "held", "distinct", "escape", "excluded", "bytes")
        joined = open_.join(here, F.shiftright(F.col("key").bitwiseAND((1 << 8 * (j + 1)) - 1), 8) == F.col("context"), "left")
        n = F.try_element_at("bytes", F.col("key").bitwiseAND(255))
        new = F.col("escape") - F.col("gone_distinct")
        room = F.col("held") - F.col("gone_total") + new
        known, hit = ~F.col("found") & F.col("context").isNotNull(), n.isNotNull()
        step = F.when(known & hit, F.log10(n / room)).when(known & (new > 0), F.log10(new / room)).otherwise(nothing)
        open_ = joined.select(
            "key",
            (F.col("log") + step).alias("log"),
            (F.col("found") | known & hit).alias("found"),
            F.when(known, F.col("excluded").cast("double")).otherwise(nothing).alias("gone_total"),
            F.when(known, F.col("distinct").cast("double")).otherwise(nothing).alias("gone_distinct"),
        )
    shared = asked.sparkSession.sparkContext.broadcast(low)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            key, log, found, gone_total, gone_distinct = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            log = log.copy()
            log[~found] += trie.log10(key[~found].astype(np.uint64), gone_total[~found], gone_distinct[~found])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(log)], ["key", "log"])

    return open_.mapInArrow(tidy(finish), "key long, log double")


def _lists(owner: np.ndarray, keys: np.ndarray, rows: int) -> list[pa.ListArray]:
    """Of each of ``rows`` owners its different keys, and how often it has each."""
    by = np.lexsort((keys, owner))
    owner, keys = owner[by], keys[by]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))) if len(by) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    repeats = np.diff(np.concatenate((first, [len(by)])))
    offsets = pa.array(np.searchsorted(owner[first], np.arange(rows + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, values) for values in (pa.array(keys[first].astype(np.int64)), pa.array(repeats.astype(np.int64)))]


def score_texts(
    documents: DataFrame, training: DataFrame, *, max_nodes: int | None = None, max_words: int = MAX_WORDS, cache_nodes: int = CACHE_NODES
) -> DataFrame:
    """``documents`` (row columns and ``text``), with n_tokens, n_known, train_tokens, base_score, score in place of the text.

    ``training`` has the training ``text``s. A null text is empty and is scored as its end
    token. Without training texts every byte is equally likely, no token is known, and the base score is that of N = V = 0, log10(1) = 0. Repeated rows
    are scored one by one. A column with the name of a result is replaced by it. ``cache_nodes`` changes no score; ``max_nodes`` prunes the model, by default not at all.
    """
    spark = documents.sparkSession
    counts = materialise(corpus_counts(training.select("text")), "lm-counts")
    grams, words = counts.where(F.col("kind") == BYTE).select("key", "n"), counts.where(F.col("kind") == WORD).select("key", "n")
    totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    train_tokens, unit = totals["n"] or 0, float((totals["n"] or 0) + (totals["v"] or 0) + 1)

    nodes = materialise(_levels(grams), "lm-nodes")
    contexts = materialise(_contexts(nodes, F.lit(True) if max_nodes is None else _most_frequent(nodes, max_nodes)), "lm-contexts")
    sizes = {r["level"]: r["nodes"] for r in contexts.groupBy("level").agg(F.sum("distinct").alias("nodes")).collect()}
    orders = 2
    while orders <= ORDER and sum(sizes.get(j, 0) for j in range(orders + 1)) <= LOW_NODES:
        orders += 1
    entry = F.explode("bytes").alias("byte", "n")
    key = (F.shiftleft("context", 8) + F.col("byte")).alias("key")
    level, *columns = _columns(contexts.where(F.col("level") < orders).select("level", "context", "total", "kinds", entry).select("level", key, "n", "total", "kinds"))
    low = [tuple(c[level == j] for c in columns) for j in range(orders)]  # at most LOW_NODES rows
    full = contexts.where(F.col("level") == ORDER).select("context", (F.col("held") + F.col("escape")).alias("room"), entry).select(key, "n", "room")
    top, top_n, top_room = _columns(full.where(_most_frequent(full, cache_nodes)))  # at most cache_nodes rows
    order = np.argsort(top)
    cache = spark.sparkContext.broadcast((top[order].astype(np.uint64), np.log10(top_n[order] / top_room[order])))
    del level, columns, top, top_n, top_room
    frequent = _most_frequent(words, max_words)
    common, common_n = _columns(words.where(frequent).select("key", "n"))  # at most max_words rows
    common = common.view(np.uint64)
    order = np.argsort(common)
    lexicon = spark.sparkContext.broadcast((common[order], common_n[order]))

    # the caller's columns go along under names of their own, which no column of the work has
    passed = [c for c in documents.columns if c.lower() not in ("text", *RESULTS)]
    others = [f"passed_{k}" for k in range(len(passed))]
    documents = documents.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(passed, others)), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached, cached_log = cache.value
        known, known_n = lexicon.value
        for batch in batches:
            for begin, portion in _portions(batch):
                numbers, sizes = contexts_and_bytes(portion)
                distinct, inverse = np.unique(numbers, return_inverse=True)
                at, found = Trie._find(cached, distinct)
                logs = np.zeros(len(distinct))
                logs[found] = cached_log[at[found]]
                scores = np.add.reduceat(logs[inverse], np.cumsum(np.concatenate(([0], sizes[:-1]))))
                unseen = ~found[inverse]
                lists = _lists(np.repeat(np.arange(len(portion)), sizes)[unseen], numbers[unseen], len(portion))
                words_, n_words = word_hashes_of_all(portion)
                owner = np.repeat(np.arange(len(portion)), n_words + 1)
                keys = np.full(len(owner), END_WORD, np.uint64)
                ends = np.cumsum(n_words + 1) - 1
                inside = np.ones(len(owner), bool)
                inside[ends] = False
                keys[inside] = words_
                at, found = Trie._find(known, keys)
                base = np.bincount(owner[found], np.log10(known_n[at[found]] + 1.0), len(portion)) if found.any() else np.zeros(len(portion))
                n_known = np.bincount(owner[found], minlength=len(portion))
                lists += _lists(owner[~found], keys[~found], len(portion))
                part = batch.slice(begin, len(portion))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), pa.array(n_words + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(scores), *lists],
                    [*others, "n_tokens", "n_common", "base_common", "score_cached", *LISTS],
                )

    schema = T.StructType(
        [documents.schema[c] for c in others]
        + [T.StructField(c, kind) for c, kind in (("n_tokens", T.LongType()), ("n_common", T.LongType()), ("base_common", T.DoubleType()), ("score_cached", T.DoubleType()))]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in LISTS]
    )
    scored = documents.select(*others, "text").mapInArrow(tidy(score), schema)
    scored = materialise(scored.withColumn("row_number_", F.monotonically_increasing_id()), "lm-scored")

    def rest(keys: str, times: str) -> DataFrame:
        return scored.select("row_number_", F.explode(F.arrays_zip(keys, times)).alias("w")).select(
            "row_number_", F.col(f"w.{keys}").alias("key"), F.col(f"w.{times}").alias("times")
        )

    rare, unseen = rest("rare", "rare_n"), rest("unseen", "unseen_n")
    of_words = rare.join(words.where(~frequent), "key").select(
        "row_number_", F.col("times").alias("n_rare"), (F.col("times") * F.log10(F.col("n") + 1)).alias("base_rare"), F.lit(0.0).alias("score_rest")
    )
    of_bytes = unseen.join(materialise(_exact(unseen.select("key").distinct(), contexts, low), "lm-looked-up"), "key").select(
        "row_number_", F.lit(0).cast("long").alias("n_rare"), F.lit(0.0).alias("base_rare"), (F.col("times") * F.col("log")).alias("score_rest")
    )
    looked_up = of_words.unionAll(of_bytes).groupBy("row_number_").agg(*(F.sum(c).alias(c) for c in ("n_rare", "base_rare", "score_rest")))
    return scored.join(looked_up, "row_number_", "left").select(
        *(F.col(o).alias(c) for c, o in zip(passed, others)),
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_common") + F.coalesce("base_rare", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(unit)))).alias("base_score"),
        (F.col("score_cached") + F.coalesce("score_rest", F.lit(0.0))).alias("score"),
    )
