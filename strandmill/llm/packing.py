"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens. Full pieces are sequences of their own.
The first chromosome is the best-fit decreasing packing of all other pieces. Pieces of one length are
alike, so it is found from their numbers by length, at most ``capacity`` of them, and pieces take
their places by their rank. Its bins are dealt whole into blocks of about ``block_pieces`` pieces, and each
block is evolved by several islands. A chromosome is a set of bins. Crossover injects well-filled
bins of one parent whole into another, removes the bins that hold a piece twice, and best-fits the
displaced pieces; mutation dissolves poorly filled bins. After an epoch the best packing of every
island migrates to the next island of its block. Then the poorly filled bins of all blocks are dealt
into new, fewer blocks, as long as that saves at least one bin in ``1 / MIN_GAIN`` and more than one block is left.

A packing is fitter with fewer bins and the fittest stays, so there are never more bins than best-fit decreasing
over all pieces gives. A block whose bins are as few as its tokens allow is not evolved.

Tasks hold the lengths of one block at a time; texts are only read by the tokeniser.
"""

from __future__ import annotations

import json
import random
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm.common import materialise, tidy

CAPACITY = 2048
BLOCK_PIECES = 1024
ISLANDS = 2
POPULATION = 6
GENERATIONS = 30
WELL_FILLED = 0.99
MIN_GAIN = 0.001
MEMO_WORDS = 300_000


class ByteBpeEncoder:
    """Token ids as little-endian 32-bit bytes, with a memo of words.

    A byte-level BPE never joins characters across a single blank or line feed between two
    characters that are no white space, so texts are looked up word by word. Texts with other
    white space or the string of an added token, and tokenisers of another kind, are encoded
    whole. The memo is emptied when it is full; that changes no id.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [token["content"] for token in spec.get("added_tokens") or []]
        steps = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec["model"].get("type") == "BPE"
            and spec.get("normalizer") is None
            and steps.get("type") == "ByteLevel"
            and not steps.get("add_prefix_space")
            and steps.get("use_regex", True)
        )
        self.memo_words, self.heads, self.tails = memo_words, {}, {}
        self._ordinary = self._ranked(spec["model"]["vocab"]) if self.by_word else None
        self.line_feed = self._word("\n") if self.by_word else b""

    @cached_property
    def whole(self):
        """The library's tokeniser, loaded when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _word(self, text: str) -> bytes:
        return np.array(self._ordinary(text), "<u4").tobytes()

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _ranked(vocab: dict[str, int]):
        """The same vocabulary as byte ranks, which encodes a single word sooner."""
        import public_tokenizers
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocab.items() if all(c in byte_of for c in token) and not token.startswith("<|")}
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _add(self, text: str) -> None:
        if len(self.tails) + len(self.heads) > self.memo_words:
            self.tails.clear()
            self.heads.clear()
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            for memo, blank, words in ((self.heads, "", (first,)), (self.tails, " ", rest)):
                for word in words:
                    if word not in memo:
                        plain = word and not word[0].isspace() and not word[-1].isspace()
                        memo[word] = self._word(blank + word) if plain else None

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word or any(token in text for token in self.added):
            return self._encode(text)
        for _ in range(2):
            try:
                out = []
                for line in text.split("\n"):
                    words = line.split(" ")
                    out.append(self.heads[words[0]])
                    del words[0]
                    out.extend(map(self.tails.__getitem__, words))
                    out.append(self.line_feed)
                out.pop()
                return b"".join(out)
            except KeyError:
                self._add(text)
            except TypeError:  # a word that is empty or has white space at its ends
                break
        return self._encode(text)


@cache
def encoder(path: str) -> ByteBpeEncoder:
    """The encoder of a Python worker, whose memo serves all the tasks that the worker runs."""
    return ByteBpeEncoder(path)


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, after a shorter first one if that is needed."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n_tokens, capacity)]


def tokenised_pieces(documents: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document and its end token."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = encode(text.as_py()) + end
                for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))]
    )
    return docs.mapInArrow(tidy(pieces), schema)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over ``counts`` pieces of each length: its runs and its number of bins.

    A run (start, bin, per_bin) says that the pieces from place ``start`` on, counted from the longest piece, fill the bins from ``bin`` on
    with ``per_bin`` each. The best bin for a piece is also the best for the next one of that length while it has
    room, so alike bins are filled together, and there are a few runs per length and room, however many pieces.
    """
    alike: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first bin, number of bins)
    mask, runs, n_bins, start = 0, [], 0, 0  # bit r of the mask: some bins have room r

    def put(room: int, first: int, number: int) -> None:
        nonlocal mask
        if number and room:
            alike[room].append((first, number))
            mask |= 1 << room

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            wide = mask >> length
            if wide:
                room = length + (wide & -wide).bit_length() - 1
                first, number = alike[room].pop()
                if not alike[room]:
                    mask ^= 1 << room
            else:
                room, first, number = capacity, n_bins, -(-left // (capacity // length))
                n_bins += number
            per_bin = room // length
            filled = min(number, left // per_bin)
            if filled:
                runs.append((start, first, per_bin))
                put(room - per_bin * length, first, filled)
                start, left = start + filled * per_bin, left - filled * per_bin
            if left and filled < number:
                runs.append((start, first + filled, left))
                put(room - left * length, first + filled, 1)
                start, left, filled = start + left, 0, filled + 1
            put(room, first + filled, number - filled)
    return np.array(runs, "int64").reshape(-1, 3), n_bins


def seeded(loose: DataFrame, capacity: int) -> DataFrame:
    """``loose`` (uid, length) with ``bin``, its bin in the best-fit decreasing packing of all its rows."""
    counts = {row["length"]: row["n"] for row in loose.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    shared = loose.sparkSession.sparkContext.broadcast(best_fit_decreasing(counts, capacity)[0])
    # places from the longest piece on: a range of rows per task, and the rows before it from one count per task
    ranged = loose.repartitionByRange(F.desc("length"), "uid").sortWithinPartitions(F.desc("length"), "uid")
    ranged = materialise(ranged.withColumn("at", F.monotonically_increasing_id()), "pack-order")
    sizes = {row["task"]: row["n"] for row in ranged.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count("*").alias("n")).collect()}
    before = np.concatenate(([0], np.cumsum([sizes.get(k, 0) for k in range(max(sizes, default=0) + 1)])))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, first, per_bin = shared.value.T
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            place = before[at >> 33] + (at & ((1 << 33) - 1))
            run = np.searchsorted(start, place, "right") - 1
            bins = first[run] + (place - start[run]) // per_bin[run]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("length"), pa.array(bins)], ["uid", "length", "bin"])

    return ranged.mapInArrow(tidy(places), "uid long, length long, bin long")


class Packer:
    """Packings of one block: lists of bins, each a list of piece numbers."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.random = lengths, capacity, random.Random(seed)

    def load(self, bin_: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, bin_))

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins are fitter, and among equally many those with the larger mean squared fill."""
        return -len(bins), sum(self.load(b) ** 2 for b in bins) / (len(bins) * self.capacity**2) if bins else 0.0

    def best_fit(self, bins: list[list[int]], pieces: list[int]) -> list[list[int]]:
        """``bins`` with ``pieces`` added in order, each where it leaves the least room."""
        by_room: dict[int, list[int]] = {}
        mask = 0  # bit r: some bin has room r
        for k, b in enumerate(bins):
            room = self.capacity - self.load(b)
            by_room.setdefault(room, []).append(k)
            mask |= 1 << room
        for p in pieces:
            need = self.lengths[p]
            wide = mask >> need
            if wide:
                room = need + (wide & -wide).bit_length() - 1
                k = by_room[room].pop()
                if not by_room[room]:
                    mask ^= 1 << room
                bins[k].append(p)
            else:
                k, room = len(bins), self.capacity
                bins.append([p])
            by_room.setdefault(room - need, []).append(k)
            mask |= 1 << (room - need)
        return bins

    def decreasing(self, pieces: list[int], noise: float = 0.0) -> list[int]:
        if not noise:
            return sorted(pieces, key=lambda p: -self.lengths[p])
        return sorted(pieces, key=lambda p: -self.lengths[p] * (1 - noise * self.random.random()))

    def crossover(self, into: list[list[int]], source: list[list[int]]) -> list[list[int]]:
        """``into`` with some of the best-filled bins of ``source`` put in whole."""
        ranked = sorted(source, key=self.load, reverse=True)
        chosen = [b for b in ranked[: max(1, len(ranked) // 2)] if self.random.random() < 0.6] or ranked[:1]
        injected = {p for b in chosen for p in b}
        kept = [b for b in into if injected.isdisjoint(b)]
        displaced = [p for b in into if not injected.isdisjoint(b) for p in b if p not in injected]
        return self.best_fit([list(b) for b in (*kept, *chosen)], self.decreasing(displaced))

    def mutate(self, bins: list[list[int]]) -> list[list[int]]:
        """Dissolve the emptiest bins and a few others, and best-fit what they held."""
        ranked = sorted(bins, key=self.load)
        n = max(2, len(ranked) // 10)
        out = [*ranked[:n], *self.random.sample(ranked[n:], min(2, len(ranked) - n))] if len(ranked) > n else ranked
        gone = {id(b) for b in out}
        displaced = self.decreasing([p for b in out for p in b], 0.2)
        return self.best_fit([list(b) for b in ranked if id(b) not in gone], displaced)

    def evolve(self, given: list[list[list[int]]], population: int, generations: int) -> list[list[int]]:
        """The fittest packing found from the given ones and new best-fit ones.

        A given one that has as few bins as the tokens allow is returned as it is.
        """
        fewest = -(-sum(self.lengths) // self.capacity)
        optimal = [x for x in given if len(x) <= fewest]
        if optimal:
            return max(optimal, key=self.fitness)
        all_pieces = list(range(len(self.lengths)))
        people = [*given, self.best_fit([], self.decreasing(all_pieces))]
        while len(people) < population:
            people.append(self.best_fit([], self.decreasing(all_pieces, 0.3)))
        ranked = sorted(((self.fitness(x), k, x) for k, x in enumerate(people)), reverse=True)
        for generation in range(generations):
            if len(ranked[0][2]) <= fewest:
                break
            a, b = self.random.sample(range(len(ranked)), 2) if len(ranked) > 1 else (0, 0)
            child = self.mutate(self.crossover(ranked[min(a, b)][2], ranked[max(a, b)][2]))
            scored = (self.fitness(child), len(people) + generation, child)
            if scored[0] > ranked[-1][0]:
                ranked = sorted([*ranked[:-1], scored], reverse=True)
        return ranked[0][2]


def _epoch(rows: DataFrame, capacity: int, population: int, generations: int) -> DataFrame:
    """Evolve every (block, island) of ``rows``; ``given`` numbers the packings that it starts from.

    ``rows``: block, island, given, uid, length, bin (null: not packed yet). Of the result, ``bin`` is the smallest
    uid in the bin and ``load`` the bin's tokens.
    """

    def island(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        uids = np.sort(frame["uid"].unique())
        number = np.searchsorted(uids, frame["uid"].to_numpy())
        lengths = np.zeros(len(uids), "int64")
        lengths[number] = frame["length"].to_numpy()
        given = []
        for _, one in frame.assign(number=number)[frame["bin"].notna().to_numpy()].groupby("given"):
            bins: dict[int, list[int]] = {}
            for label, piece in zip(one["bin"].tolist(), one["number"].tolist()):
                bins.setdefault(label, []).append(piece)
            given.append(list(bins.values()))
        packer = Packer(lengths.tolist(), capacity, seed=int(key[0]) * 1_000 + int(key[1]))
        bins = packer.evolve(given, population, generations)
        order = np.concatenate([np.array(b, "int64") for b in bins])
        sizes = [len(b) for b in bins]
        return pd.DataFrame(
            {
                "block": np.int64(key[0]),
                "island": np.int32(key[1]),
                "uid": uids[order],
                "length": lengths[order],
                "bin": np.repeat([uids[min(b)] for b in bins], sizes),
                "load": np.repeat([packer.load(b) for b in bins], sizes),
            }
        )

    return rows.groupBy("block", "island").applyInPandas(island, "block long, island int, uid long, length long, bin long, load long")


def _size(packing: DataFrame) -> tuple[int, int]:
    """The numbers of pieces and of bins of a packing; a bin is named by one of its pieces."""
    row = packing.agg(F.count("*").alias("pieces"), F.count(F.when(F.col("uid") == F.col("bin"), 1)).alias("bins")).first()
    return row["pieces"], row["bins"]


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    block_pieces: int = BLOCK_PIECES,
    islands: int = ISLANDS,
    population: int = POPULATION,
    generations: int = GENERATIONS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and is one end token; a null or repeated id is packed like any
    other row, its pieces carrying that id; an empty table gives an empty result. Other columns are not read.
    """
    pieces = materialise(
        tokenised_pieces(documents, tokenizer_path, id_col, text_col, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces"
    )
    loose = seeded(pieces.where(F.col("length") < capacity).select("uid", "length"), capacity)

    def dealt(rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("block", F.pmod(F.xxhash64("bin"), F.lit(max(1, -(-n // block_pieces)))))

    packed = ["uid", "length", "bin"]
    starts = dealt(loose, loose.count()).select("block", F.explode(F.array(*(F.lit(i) for i in range(islands)))).alias("island"), F.lit(0).alias("given"), *packed)
    first = materialise(_epoch(starts, capacity, population, generations), "pack-first")
    arrivals = first.select("block", "island", F.lit(0).alias("given"), *packed)
    if islands > 1:
        arrivals = arrivals.unionAll(first.select("block", ((F.col("island") + 1) % islands).alias("island"), F.lit(1).alias("given"), *packed))
    second = materialise(_epoch(arrivals, capacity, population, generations), "pack-second")
    bins = second.groupBy("block", "island").agg(F.count(F.when(F.col("uid") == F.col("bin"), 1)).alias("n"))
    best = bins.groupBy("block").agg(F.min_by("island", F.struct("n", "island")).alias("island"))
    elite = materialise(second.join(best, ["block", "island"]).select(*packed, "load"), "pack-elite")

    well_filled = F.col("load") >= WELL_FILLED * capacity
    packings, poor = [elite.where(well_filled)], elite.where(~well_filled)
    n, n_bins = _size(poor)
    while n:
        again = dealt(poor, n).select("block", F.lit(0).alias("island"), F.lit(0).alias("given"), *packed)
        after = materialise(_epoch(again, capacity, population, 2 * generations), "pack-again").select(*packed, "load")
        packings.append(after.where(well_filled))
        poor = after.where(~well_filled)
        saved = n_bins - _size(after)[1]
        if n <= block_pieces or saved < max(1, MIN_GAIN * n_bins):
            break
        n, n_bins = _size(poor)
    final = reduce(DataFrame.unionAll, [*packings, poor])
    in_bin = "PARTITION BY bin ORDER BY uid"
    placed = final.select(
        "uid", F.col("bin").alias("sequence_id"), (F.expr(f"sum(length) OVER ({in_bin} ROWS UNBOUNDED PRECEDING)") - F.col("length")).alias("offset")
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.where(F.col("length") == capacity).select(*columns, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.where(F.col("length") < capacity).join(placed, "uid").select(*columns, "sequence_id", "offset").unionAll(whole)
