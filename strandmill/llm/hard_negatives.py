"""Hard negatives of anchor vectors by slots between the upper limits of their positives.

An anchor's positives are the nearest rows of its label. Each positive opens a window of scores, from
``low`` to ``high`` percent of its own, and the best rows of other labels inside it are its
negatives. The upper limits of an anchor's windows cut the scores into slots that do not overlap. One
pass over the rows keeps the best few of each slot, in tasks and again after a shuffle of what they kept;
then slots are merged from the lowest up, so that each window's answer is the merged list below its
upper limit, cut at its lower limit. No window scans the rows again.

Rows are packed into blocks of numbers, and anchors, a stated share of the rows, into blocks of their own.
Every block of rows meets every block of anchors, as a search of all queries against all rows must; the
anchors are broadcast while their bytes are few, else both are shuffled by block. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.llm.common import materialise, tidy
from strandmill.session import ensure_partitions

ROWS = 2048
ANCHORS = 1024
SALTS = 8
BROADCAST_BYTES = 32 << 20
HELD_ENTRIES = 1 << 20  # best entries of all anchor blocks that a task holds before it hands them on
_ABOVE = np.iinfo(np.int64).max
_BELOW = np.iinfo(np.int64).min


def _numbers(raw: bytes, n: int) -> np.ndarray:
    """A matrix of ``n`` rows; whole numbers up to 2**24 are kept in single precision."""
    wide = raw[:1] == b"d"
    return np.frombuffer(raw, np.float64 if wide else np.float32, offset=8).reshape(n, -1)


def _raw(values: np.ndarray) -> bytes:
    wide = bool(values.size) and np.abs(values).max() > 1 << 24
    return (b"d" if wide else b"s").ljust(8) + np.ascontiguousarray(values, np.float64 if wide else np.float32).tobytes()


def _quantised(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and floor(scale * x) of the rows of a batch whose components are all finite; short vectors end in zeros."""
    vectors = batch.column("vector")
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width, row = int(sizes.max(initial=0)), np.repeat(np.arange(len(sizes)), sizes)
    values = np.zeros((len(sizes), width))
    values[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    sound = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        values = np.floor(values[sound] * scale)
    if not np.isfinite(values).all():
        raise OverflowError("a component times the scale is no finite number")
    return batch.column("id").to_numpy()[sound], batch.column("label").to_numpy()[sound], values


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floating point where every partial sum fits it, else as integers."""
    width = min(a.shape[1], b.shape[1])  # what one side lacks counts as zeros
    a, b = a[:, :width], b[:, :width]
    bound = np.abs(a).max(initial=0).astype(np.float64) * np.abs(b).sum(axis=1, dtype=np.float64).max(initial=0)
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return exact.astype(np.int64)  # raises where a score does not fit


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are the first ``k`` of their group, by score descending and then by id."""
    order = np.lexsort((ids, -score, group))
    ranked = group[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(ranked)), bool), np.diff(ranked) != 0)))
    place = np.arange(len(ranked)) - np.repeat(start, np.diff(np.append(start, len(ranked))))
    return order[place < k]


class _Best:
    """The first ``k`` entries of each anchor and slot of one block of anchors, and the least score that still counts."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.anchor, self.low, self.high, self.k = anchor, low.copy(), high, k
        self.group, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray, apart: np.ndarray | None, first_anchor: int = 0) -> None:
        """Take in scores of some anchors (rows) and vectors (columns), but for combinations that are not ``apart``."""
        some = slice(first_anchor, first_anchor + len(scores))
        low, high = self.low[some], self.high[some]
        chosen = (scores >= low.min(axis=1)[:, None]) & (scores <= high.max(axis=1)[:, None])
        if apart is not None:
            chosen &= apart
        row, column = np.nonzero(chosen)
        score = scores[row, column]
        slot = (score[:, None] <= high[row]).sum(axis=1) - 1
        counts = score >= low[row, slot]
        row, column, slot, score = row[counts] + first_anchor, column[counts], slot[counts], score[counts]
        if not len(row):
            return
        slots = self.low.shape[1]
        group = np.concatenate((self.group, row * slots + slot))
        score, ids = np.concatenate((self.score, score)), np.concatenate((self.ids, ids[column]))
        kept = _first(group, score, ids, self.k)
        self.group, self.score, self.ids = group[kept], score[kept], ids[kept]
        last = np.flatnonzero(np.diff(self.group, append=-1) != 0)
        full = last[np.diff(last, prepend=-1) == self.k]
        np.maximum.at(self.low, (self.group[full] // slots, self.group[full] % slots), self.score[full])

    def rows(self) -> pa.RecordBatch:
        slots = self.low.shape[1]
        columns = [pa.array(self.anchor[self.group // slots]), pa.array((self.group % slots).astype(np.int32)), pa.array(self.score), pa.array(self.ids)]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "slot", "score", "id"])


def _tiles(same_label: bool, k: int):
    """A function over pairs of a block of rows and a block of anchors: the best entries of each anchor and slot."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Best] = {}
        for batch in batches:
            for tile in batch.to_pylist():
                ids, labels = (np.frombuffer(tile[name], np.int64) for name in ("ids", "labels"))
                anchor, anchor_ids, anchor_labels, low, high = (np.frombuffer(tile[f"anchor_{name}"], np.int64) for name in ("keys", "ids", "labels", "low", "high"))
                values, anchors = _numbers(tile["numbers"], len(ids)), _numbers(tile["anchor_numbers"], len(anchor))
                best = held.get(tile["block"])
                if best is None:
                    best = held[tile["block"]] = _Best(anchor, low.reshape(len(anchor), -1), high.reshape(len(anchor), -1), k)
                if same_label:  # both sides lie in order of labels
                    for label in np.intersect1d(anchor_labels, labels):
                        a, b = (slice(*np.searchsorted(side, [label, label + 1])) for side in (anchor_labels, labels))
                        best.add(_scores(anchors[a], values[b]), ids[b], anchor_ids[a, None] != ids[None, b], a.start)
                else:
                    best.add(_scores(anchors, values), ids, anchor_labels[:, None] != labels[None, :])
            if sum(len(best.ids) for best in held.values()) > HELD_ENTRIES:
                yield from (best.rows() for best in held.values())
                held.clear()
        yield from (best.rows() for best in held.values())

    return search


_ENTRY = "anchor long, slot int, score long, id long"
_BLOCK = "block long, anchor_keys binary, anchor_ids binary, anchor_labels binary, anchor_low binary, anchor_high binary, anchor_numbers binary"


def _pack_anchors(group: pa.Table) -> pa.Table:
    group = group.combine_chunks().sort_by("label")
    parts = [_numbers(raw, 1) for raw in group.column("numbers").to_pylist()]
    values = np.zeros((len(parts), max(part.shape[1] for part in parts)))
    for row, part in enumerate(parts):
        values[row, : part.shape[1]] = part[0]
    low, high = (np.array(group.column(name).to_pylist(), np.int64) for name in ("low", "high"))
    arrays = [group.column(name).to_numpy() for name in ("key", "id", "label")]
    columns = [np.asarray(a, np.int64).tobytes() for a in (*arrays, low, high)] + [_raw(values)]
    names = ["anchor_keys", "anchor_ids", "anchor_labels", "anchor_low", "anchor_high", "anchor_numbers"]
    return pa.table({"block": group.column("block").slice(0, 1), **{name: pa.array([raw], pa.binary()) for name, raw in zip(names, columns)}})


def _windows(scores: list[int], low: int, high: int, slots: int) -> tuple[list[int], list[int]]:
    """The slots of an anchor from the top: their least and greatest scores, padded with slots that nothing is in."""
    limits: dict[int, int] = {}
    for score in scores:
        upper, lower = high * score // 100, -(-low * score // 100)
        if lower <= upper:
            limits[upper] = min(lower, limits.get(upper, lower))
    uppers = sorted(limits, reverse=True)
    lowers = [max(limits[u], below + 1) for u, below in zip(uppers, [*uppers[1:], _BELOW])]
    pad = slots - len(uppers)
    return lowers + [_ABOVE] * pad, uppers + [_BELOW] * pad


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the columns of ``vectors``. A component x becomes floor(scale * x); a
    score is the integer inner product with the anchor; of equal scores the smaller id comes first. An
    anchor's positives are its first ``n_positives`` rows of the same label and another id; a
    positive's negatives are the first ``n_negatives`` rows of another label whose score is from ``low`` to ``high``
    percent of the positive's.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Ids and
    labels are integers. Rows that share an id are rows of their own. What a shorter vector lacks counts as zeros.
    Anchors without positives, and windows without rows, give no rows; scores beyond 64 bits raise. No
    other column is read.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, values = _quantised(batch, scale)
            for at in range(0, len(ids), ROWS):
                part = slice(at, at + ROWS)
                order = np.lexsort((ids[part], labels[part]))
                columns = [ids[part][order].tobytes(), labels[part][order].tobytes(), _raw(values[part][order])]
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()) for raw in columns], ["ids", "labels", "numbers"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, values = _quantised(batch, scale)
            numbers = pa.array([_raw(row[None, :]) for row in values], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), numbers], ["id", "label", "numbers"])

    row_blocks = ensure_partitions(rows.select("id", "label", "vector")).mapInArrow(tidy(pack), "ids binary, labels binary, numbers binary")
    anchors = rows.where("is_anchor").select("id", "label", "vector").mapInArrow(tidy(single), "id long, label long, numbers binary")
    anchors = materialise(anchors.withColumn("key", F.monotonically_increasing_id()), "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.sum(F.length("numbers")).alias("bytes")).first()
    n_blocks = -(-size["n"] // ANCHORS)
    broadcast = (size["bytes"] or 0) <= broadcast_bytes

    def searched(targets: DataFrame, same_label: bool, k: int) -> DataFrame:
        """The first ``k`` entries of each anchor and slot over all rows."""
        dealt = targets.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, n_blocks))))
        blocks = dealt.groupBy("block").applyInArrow(_pack_anchors, _BLOCK)
        tiles = row_blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n_blocks - 1)).cast("long"))))
        if broadcast:
            tiles = tiles.join(F.broadcast(blocks), "block")
        else:  # a block of anchors meets all rows, so its rows are dealt to several tasks
            salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            tiles = tiles.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS))).join(salted, ["block", "salt"]).drop("salt")
        found = tiles.mapInArrow(tidy(_tiles(same_label, k)), _ENTRY)
        place = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
        return found.withColumn("place", place).where(F.col("place") <= k)

    every = anchors.withColumns({"low": F.array(F.lit(_BELOW)), "high": F.array(F.lit(_ABOVE))})
    nearest = searched(every, True, n_positives).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("positives"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits = [_windows(scores, low, high, n_positives) for scores in batch.column("scores").to_pylist()]
            pairs = [pa.array([limit[side] for limit in limits], pa.list_(pa.int64())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), *pairs], ["anchor", "low", "high"])

    nearest = materialise(nearest, "positives")
    limits = nearest.select("anchor", F.col("positives.score").alias("scores")).mapInArrow(tidy(cut), "anchor long, low array<long>, high array<long>")
    limits = limits.where(F.exists("high", lambda u: u > _BELOW))
    targets = anchors.join(limits, anchors["key"] == limits["anchor"]).drop("anchor")
    entries = searched(targets, False, n_negatives)
    in_slots = entries.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "place", "score", "id"))).alias("entries"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                slots: dict[int, list[tuple[int, int]]] = {}
                for entry in row["entries"]:
                    slots.setdefault(entry["slot"], []).append((entry["score"], entry["id"]))
                _, uppers = _windows([p["score"] for p in row["positives"]], low, high, n_positives)
                below, merged = [], {}
                for slot in range(n_positives - 1, -1, -1):  # each slot's scores lie above those of the next
                    below = (slots.get(slot, []) + below)[:n_negatives]
                    merged[uppers[slot]] = below
                for p in row["positives"]:
                    inside = [e for e in merged.get(high * p["score"] // 100, []) if 100 * e[0] >= low * p["score"]]
                    out += [(row["id"], p["id"], rank, e[1], p["score"], e[0]) for rank, e in enumerate(inside, 1)]
            names, kinds = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"], [pa.int64()] * 6
            kinds[2] = pa.int32()
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names)

    answers = in_slots.join(nearest, "anchor").join(anchors.select(F.col("key").alias("anchor"), "id"), "anchor")
    answers = answers.select("id", "positives", "entries")
    return answers.mapInArrow(tidy(merge), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
