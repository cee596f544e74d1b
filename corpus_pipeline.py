"""A training corpus from raw documents, in five stages over the table ``documents``.

Language ID drops documents in no known language; line dedup deletes later copies of
repeated passages, and documents that lose all their lines; of every group of near duplicates one
document stays; documents with benchmark passages go; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import materialise, table, unused
from strandmill.llm.decontaminate import contamination
from strandmill.llm.language_id import UNDETERMINED, identify, learn_profiles
from strandmill.llm.line_runs import remove_repeated_runs
from strandmill.llm.near_dedup import near_duplicates
from strandmill.llm.packing import pack

MIN_LANGUAGE_SCORE = 0.2
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``dropped``; ids are broadcast if they are few enough."""
    (name,) = unused(docs.columns, "__dropped")
    ids = materialise(dropped.select(F.col("doc_id").alias(name)).distinct(), "dropped")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that the table's labels name."""
    profiles = learn_profiles(docs)
    # the whole row goes along in place of the id, so that no join brings it back
    judged = identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), profiles, id_col="row")
    kept = judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select("doc_id.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; one that has nothing left goes."""
    cleaned = remove_repeated_runs(docs).where(F.col("__removed") < F.col("__lines"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return _without(docs, near_duplicates(docs).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in their sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
