"""Near duplicates by bottom-k sketches of word shingles.

One hash function maps a document's shingles to numbers; the k smallest are its sketch. Two
documents of Jaccard similarity J share about J * k of the k smallest numbers of their union, and
those are in both sketches. Inverted lists of sketch values find the documents that share enough of them: a
document enters the lists of its rarest values only, as many as two sketches of the needed overlap cannot
avoid to share one (a prefix filter), so a passage that many documents hold makes no list. Lists
that share documents form candidate groups. Inside a group the union sketch estimates the similarity of a
pair, and the full shingle sets decide it.

Documents with the same shingle set are one class from the start. Groups are cut into blocks of a bounded
number of classes; a task compares one block, or two blocks, and returns only the links that join what
was apart. Classes already connected are not compared, so a tight group of any size costs one comparison
per class. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm.common import materialise, tidy
from strandmill.llm.components import components
from strandmill.llm.hashing import mix, shingle_hashes, word_hashes

SHINGLE = 5
THRESHOLD = (75, 100)
SKETCH = 64
MISS = 1e-9  # the chance that a sketch hides a link of exactly the threshold
BLOCK_CLASSES = 512
BROADCAST_ROWS = 1_000_000
PORTION = 1_000  # rows that a task turns into arrays at a time
BIT_BUDGET = 1 << 30  # bits of shared shingles that a task holds at most; beyond, sets are intersected pair by pair


def needed_overlap(k: int, threshold: tuple[int, int], miss: float = MISS) -> int:
    """The largest t with P(Binomial(k, threshold) < t) <= miss."""
    p, below = threshold[0] / threshold[1], 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            return t
    return k


def overlap_bounds(k: int, threshold: tuple[int, int]) -> list[int]:
    """For a set of n < k, the least overlap of its sketch with a linked one; the last entry is for n >= k.

    While no union with a linked set can exceed k the sketches are the sets and the bound is exact;
    above, the share of k is taken.
    """
    share = needed_overlap(k, threshold)
    exact = k * threshold[0] // threshold[1]
    return [-(-n * threshold[0] // threshold[1]) if n <= exact else max(1, n * share // k) for n in range(k)] + [share]


def shingle_table(documents: DataFrame, k: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, n, f1, f2, sketch) per row; f1 and f2 identify the shingle set."""
    docs = _keyed(documents, id_col, text_col)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PORTION) for whole in batches for at in range(0, whole.num_rows, PORTION)):
            n, f1, f2, kept = [], [], [], []
            for text in batch.column("text"):
                s = shingle_hashes(word_hashes(text.as_py() or ""), shingle)
                n.append(len(s))
                f1.append(int(s.sum().astype(np.int64)))
                f2.append(int(mix(s ^ np.uint64(0x5555555555555555)).sum().astype(np.int64)))
                kept.append(s[:k].astype(np.int64))
            offsets = np.cumsum([0, *map(len, kept)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    *(pa.array(x, pa.int64()) for x in (n, f1, f2)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*kept, np.zeros(0, np.int64)]))),
                ],
                ["doc_id", "row_key", "n", "f1", "f2", "sketch"],
            )

    schema = T.StructType(
        [docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("row_key", "n", "f1", "f2")), T.StructField("sketch", T.ArrayType(T.LongType()))]
    )
    return docs.mapInArrow(tidy(sketches), schema)


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, row_key); rows with one key have one id and one text."""
    text = F.col(text_col).cast("string")
    return documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("row_key"))


def candidate_groups(classes: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """(class, root): classes whose sketches may overlap enough with another, by group."""
    bounds = overlap_bounds(k, threshold)
    entries = classes.select("class", "n", F.explode("sketch").alias("value"))
    common = entries.groupBy("value").agg(F.count("*").alias("holders")).where("holders > 1")
    need: Column = F.element_at(F.lit(bounds), F.least(F.col("n"), F.lit(k)).cast("int") + 1)
    shared = (
        entries.join(common, "value")
        .groupBy("class", "n")
        .agg(F.array_sort(F.collect_list(F.struct("holders", "value"))).alias("values"))
        .where(F.size("values") >= need)
    )
    # every value that is not shared is rarer still, and already takes its place in the prefix
    prefix = F.slice("values", F.lit(1), F.size("values") - need + 1)
    lists = materialise(shared.select("class", F.explode(F.transform(prefix, lambda v: v["value"])).alias("value")), "sketch-lists")
    roots = lists.groupBy("value").agg(F.min("class").alias("root"))
    return components(lists.join(roots, "value").select(F.col("class").alias("a"), F.col("root").alias("b")), "groups")


def held_bits(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits per set: which of the values that two or more sets hold it holds."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = holders > 1
    kept = shared[column]
    rows, column = rows[kept], (np.cumsum(shared) - 1)[column[kept]]
    words = max(1, -(-int(shared.sum()) // 64))
    bits = np.zeros((len(sets), words), np.uint64)
    np.bitwise_or.at(bits, (rows, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return bits


def in_both(bits: np.ndarray, i: int, others: np.ndarray | slice) -> np.ndarray:
    """Numbers of values that set ``i`` shares with each of ``others``."""
    return np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)


def union_sketch_hits(mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of the k smallest values of the union of two full sketches of k both hold, for each row of ``others``."""
    at = np.searchsorted(mine, others)
    common = mine[np.minimum(at, len(mine) - 1)] == others
    place = np.arange(others.shape[1]) + at - (np.cumsum(common, axis=1) - common)
    return (common & (place < len(mine))).sum(axis=1)


def compare(sets: list[np.ndarray], labels: list, sides: list[int], k: int, threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between classes of different labels, enough to connect all that are linked.

    With classes of two sides only pairs across the sides are compared. Each class is held against all
    others it is not connected with at once, those with the most possible partners first, as they connect most.
    """
    n, share = len(sets), needed_overlap(k, threshold)
    bounds = np.array(overlap_bounds(k, threshold))
    sizes = np.array([len(s) for s in sets])
    least = bounds[np.minimum(sizes, k)]
    sketched = held_bits([s[:k] for s in sets])
    overlap = np.stack([in_both(sketched, i, slice(None)) for i in range(n)])
    possible = (overlap >= np.maximum(least[:, None], least)) & (threshold[1] * np.minimum(sizes[:, None], sizes) >= threshold[0] * np.maximum(sizes[:, None], sizes))
    side = np.array(sides)
    if side.min() != side.max():
        possible &= side[:, None] != side
    np.fill_diagonal(possible, False)
    if not possible.any():
        return []
    full_sketch = sizes >= k
    sketches = np.stack([s[:k] if len(s) >= k else np.zeros(k, np.uint64) for s in sets])
    bits = held_bits(sets) if n * sizes.sum() <= BIT_BUDGET else None
    tree = np.unique(np.array(labels), return_inverse=True)[1]
    found = []
    for i in np.argsort(-possible.sum(axis=1), kind="stable"):
        near = np.flatnonzero(possible[i] & (tree != tree[i]))
        possible[:, i] = False  # every pair is looked at once
        if full_sketch[i] and len(near):
            hits = union_sketch_hits(sketches[i], sketches[near])
            near = near[~full_sketch[near] | (hits >= share)]
        if not len(near):
            continue
        common = in_both(bits, i, near) if bits is not None else np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in near])
        for j in near[threshold[1] * common >= threshold[0] * (sizes[i] + sizes[near] - common)].tolist():
            if tree[i] != tree[j]:
                tree[tree == tree[j]] = tree[i]
                found.append((int(i), j))
    return found


def _full_sets(documents: DataFrame, members: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(root, blocks, block, class, shingles) of the classes in groups, from the whole texts."""
    if members.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    chosen = _keyed(documents, id_col, text_col).join(members, F.col("row_key") == F.col("class")).select("root", "blocks", "block", "class", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PORTION) for whole in batches for at in range(0, whole.num_rows, PORTION)):
            full = [shingle_hashes(word_hashes(text.as_py() or ""), shingle).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "blocks", "block", "class")), pa.array(full, pa.binary())], ["root", "blocks", "block", "class", "shingles"])

    return chosen.mapInArrow(tidy(sets), "root long, blocks int, block int, class long, shingles binary")


def stars(names: list[int], links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(name, smallest name of its tree) for the names that ``links`` join, but for the smallest ones."""
    tree = {i: [i] for pair in links for i in pair}
    for i, j in links:
        if tree[i] is not tree[j]:
            small, large = sorted((tree[i], tree[j]), key=len)
            large += small
            for x in small:
                tree[x] = large
    least = {id(members): min(names[x] for x in members) for members in tree.values()}
    return [(names[i], least[id(members)]) for i, members in tree.items() if names[i] != least[id(members)]]


def _links(rows: DataFrame, k: int, threshold: tuple[int, int], across: bool) -> DataFrame:
    """Links (a, b) found in each (root, task) of rows: root, task, side, class, label, shingles.

    Within a block each class comes with the smallest class that it is connected with there; across
    two blocks labels come in pairs.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def done() -> pa.RecordBatch:
            names = list(held)
            sets, labels, sides = ([held[c][x] for c in names] for x in range(3))
            found = compare(sets, labels, sides, k, threshold)
            pairs = [(labels[i], labels[j]) for i, j in found] if across else stars(names, found)
            return pa.RecordBatch.from_arrays([pa.array([p[x] for p in pairs], pa.int64()) for x in (0, 1)], ["a", "b"])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("root", "task", "side", "class", "label")), batch.column("shingles"))
            for root, task, side, name, label, shingles in rows:
                if (root, task) != key:
                    if len(held) > 1:
                        yield done()
                    key, held = (root, task), {}
                held[name] = (np.frombuffer(shingles.as_py(), np.uint64), label, side)  # a repeated row says the same again
        if len(held) > 1:
            yield done()

    dealt = rows.repartition("root", "task").sortWithinPartitions("root", "task", "class")
    return dealt.select("root", "task", "side", "class", "label", "shingles").mapInArrow(tidy(stream), "a long, b long")


def near_duplicates(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: tuple[int, int] = THRESHOLD,
    sketch: int = SKETCH,
    block_classes: int = BLOCK_CLASSES,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Linked are documents with ``threshold[1] * |intersection| >= threshold[0] * |union|`` of shingle sets. The component's smallest
    id names it and is the one kept. A null, empty or blank text has no shingle and is linked with nothing: its
    component is its own id. Ids that are null are larger than all others and name a component
    only if all its ids are null; rows that repeat the kept id are all kept. Other columns are not read.
    """
    rows = materialise(shingle_table(documents, sketch, shingle, id_col, text_col), "sketches")
    classes = materialise(
        rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("row_key").alias("class"), F.min("doc_id").alias("least_id"), F.first("sketch").alias("sketch")),
        "classes",
    )
    groups = materialise(candidate_groups(classes, sketch, threshold), "groups")
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / block_classes).cast("int").alias("blocks"))
    members = groups.join(sizes, "root").select(
        "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.col("node").alias("class")
    )
    members = materialise(members, "members")
    sets = materialise(_full_sets(documents, members, shingle, id_col, text_col), "shingle-sets")
    inside = sets.select("root", F.col("block").cast("string").alias("task"), F.lit(0).alias("side"), "class", F.col("class").alias("label"), "shingles")
    linked = materialise(_links(inside, sketch, threshold, across=False), "links").select(F.col("a").alias("class"), F.col("b").alias("root"))
    if not members.where("blocks > 1").isEmpty():
        labels = linked.withColumnRenamed("root", "label")
        wide = sets.where("blocks > 1").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
        others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("block"))
        across = wide.select("root", "block", "class", "label", "shingles", F.explode(others).alias("other")).select(
            "root", F.concat_ws("-", F.least("block", "other"), F.greatest("block", "other")).alias("task"), (F.col("block") > F.col("other")).cast("int").alias("side"), "class", "label", "shingles"
        )
        roots = components(_links(across, sketch, threshold, across=True), "links").withColumnRenamed("root", "top")
        joined = labels.join(roots, F.col("label") == F.col("node"), "left").select("class", F.coalesce("top", "label").alias("root"))
        linked = joined.unionAll(roots.where("node <> top").select("node", "top"))
    linked = linked.unionAll(linked.select("root", "root").distinct())
    named = linked.join(classes.select("class", "least_id"), "class")
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_class = classes.select("class", "f1", "f2", "n", "least_id").join(named.join(names, "root").select("class", "component_id"), "class", "left").select(
        "f1", "f2", "n", F.coalesce("component_id", "least_id").alias("component_id")
    )
    return (
        rows.select("doc_id", "n", "f1", "f2")
        .join(by_class, ["f1", "f2", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
