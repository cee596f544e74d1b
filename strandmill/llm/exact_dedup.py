"""Exact duplicates by an extendible-hash index on shared files.

The index holds one entry per distinct text: its hash key, whether other texts have the
same key, and what its group of equal texts needs. Texts are grouped by key and bytes, with
partial aggregates, so equal texts meet as one row however many there are. A directory of
``2**depth`` cells over the key's leading bits is doubled while a bucket is overfull; entries
are written by bucket, each owner task writing the key range of its buckets. Every document then
looks its entry up by key; only where a key has a chain are bytes compared again.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import materialise

CELL_BITS = 12
HOT_SHARE = 1_000  # a group with more than one row in so many is looked up by broadcast, so there are fewer of them
MIN_CAPACITY = 1_000


def hash_key(text: Column, bits: int) -> Column:
    """The leading ``bits`` of a 64-bit hash, as a number from 0."""
    key = F.shiftrightunsigned(F.xxhash64(text), 1)  # 63 bits, so never negative
    return F.shiftrightunsigned(key, 63 - bits) if bits < 63 else key


def directory(cells: dict[int, int], bits: int, capacity: int) -> list[tuple[int, int]]:
    """Buckets as (first cell, local depth), by doubling a directory over ``2**bits`` cells.

    A bucket of more than ``capacity`` keys is split by one more bit until it fits or has one
    cell. ``cells`` counts the keys of each cell: at most ``2**bits`` numbers, whatever the data.
    """
    buckets, pending = [], [(0, 0)]
    while pending:
        first, depth = pending.pop()
        width = 1 << (bits - depth)
        if width > 1 and sum(cells.get(c, 0) for c in range(first, first + width)) > capacity:
            pending += [(first, depth + 1), (first + width // 2, depth + 1)]
        else:
            buckets.append((first, depth))
    return sorted(buckets)


def build_index(docs: DataFrame, key_bits: int = 63, capacity: int | None = None) -> DataFrame:
    """The written index of ``docs`` (doc_id, text): one entry per distinct text.

    Columns: bucket, key, chained (the key has more than one text), digest, keep_id, group_size. The buckets
    only lay the written entries out; equality and chains are decided by grouping on key and text.
    """
    cell_bits = min(CELL_BITS, key_bits)
    # grouping by the text compares bytes; the key only says where the group lives
    groups = docs.groupBy(hash_key(F.col("text"), key_bits).alias("key"), "text").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    digest = F.sha2(F.col("text"), 256)
    heads = materialise(groups.select("key", digest.alias("digest"), "keep_id", "group_size"), "dedup-heads")
    cell = F.shiftrightunsigned("key", key_bits - cell_bits).cast("int")
    cells = {row["cell"]: row["n"] for row in heads.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
    if capacity is None:
        capacity = max(MIN_CAPACITY, 2 * sum(cells.values()) >> (cell_bits // 2))
    buckets = directory(cells, cell_bits, capacity)
    owners = [0] * (1 << cell_bits)
    for number, (first, depth) in enumerate(buckets):
        width = 1 << (cell_bits - depth)
        owners[first : first + width] = [number] * width
    bucket = F.element_at(F.split(F.lit(",".join(map(str, owners))), ",").cast("array<int>"), cell + 1)
    chains = heads.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key", F.lit(True).alias("chained"))
    entries = heads.join(chains, "key", "left").select(
        bucket.alias("bucket"), "key", F.coalesce("chained", F.lit(False)).alias("chained"), "digest", "keep_id", "group_size"
    )
    return materialise(entries.repartitionByRange(F.col("bucket"), F.col("key")).sortWithinPartitions("bucket", "key", "keep_id"), "dedup-index")


def exact_duplicates(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 63, capacity: int | None = None
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; null texts count as empty. A null id is
    smaller than every other; of repeated rows with the kept id each is marked kept. An
    empty table gives an empty result. Other columns are not read. ``key_bits`` shortens the
    hash, which makes collision chains (tests); ``capacity`` is the number of keys in a bucket.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    index = build_index(docs, key_bits, capacity)
    probes = docs.select("doc_id", hash_key(F.col("text"), key_bits).alias("key"), F.sha2("text", 256).alias("text_sha256"))

    total = index.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    simple = index.where("not chained").select("key", "keep_id", "group_size")
    hot_size = max(1, total // HOT_SHARE)
    hot = F.broadcast(simple.where(F.col("group_size") > hot_size).select("key", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size")))
    cold = simple.where(F.col("group_size") <= hot_size)
    # a hot row gets a key of its own that no entry has, so that it is dealt out evenly
    dealt = F.when(F.col("hot_size").isNull(), F.col("key")).otherwise(-1 - F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(1 << 62)))
    looked_up = (
        probes.join(hot, "key", "left")
        .withColumn("key", dealt)
        .join(cold, "key", "left")
        .select(
            "doc_id",
            "key",
            F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_id")).alias("keep_id"),
            F.coalesce("hot_size", "group_size").alias("group_size"),
            "text_sha256",
        )
    )
    chained = index.where("chained")
    if not chained.isEmpty():
        looked_up = looked_up.where(F.col("group_size").isNotNull()).unionByName(_chain_lookup(docs, chained, key_bits))
    return looked_up.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def _chain_lookup(docs: DataFrame, chained: DataFrame, key_bits: int) -> DataFrame:
    """The documents whose key has a chain, with their groups told apart by their bytes."""
    keyed = docs.withColumn("key", hash_key(F.col("text"), key_bits))
    of_chain = keyed.join(chained.select("key").distinct(), "key", "left_semi")
    groups = of_chain.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return of_chain.join(groups, ["key", "text"]).select("doc_id", "key", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"))
