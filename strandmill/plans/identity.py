"""What a stage computes, as a mark that changes with its plan, its input and its recipe."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DRIVER_ROWS = re.compile(r"LogicalRDD|LocalRelation|ExternalRDD|InMemoryRelation")
_NUMBERED = re.compile(r"#\d+L?|plan_id=\d+|\b[A-Za-z$.]*@[0-9a-f]+|lambda \w+_\d+")


def _plan(df: DataFrame) -> str:
    """The analysed plan as text, without the numbers that differ from run to run."""
    spark = df.sparkSession
    key = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    spark.conf.set(key, 10_000)
    try:
        return _NUMBERED.sub("", df._jdf.queryExecution().analyzed().toString())
    finally:
        spark.conf.set(key, before)


def _files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Name, size and modification time of every file; one listing per folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    by_folder = defaultdict(set)
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(path))
        by_folder[where.getParent().toString()].add(where.getName())
    found = []
    for folder, names in by_folder.items():
        where = jvm.org.apache.hadoop.fs.Path(folder)
        for status in where.getFileSystem(conf).listStatus(where):
            if status.getPath().getName() in names:
                found.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return sorted(found)


def _content(df: DataFrame) -> str:
    """The rows as a multiset, for inputs that are no files; reads them once."""
    named = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    rows = named.select(F.xxhash64(*named.columns).alias("h")) if named.columns else named.select(F.lit(0).alias("h"))
    count, total, parity = rows.agg(F.count("*"), F.sum(F.col("h").cast("decimal(20,0)")), F.bit_xor("h")).head()
    return f"{count} {total} {parity}"


def mark_of(df: DataFrame, *recipe: str) -> str:
    """Eight characters that tell two results apart by plan, schema, input files and recipe.

    Rows that live in no file (made on the driver or by an RDD) are told apart by their content. What a
    Python function does is not part of a plan: put its version into ``recipe``.
    """
    plan = _plan(df)
    parts = [plan, df.schema.json(), *recipe, *_files(df.sparkSession, df.inputFiles())]
    if _DRIVER_ROWS.search(plan):
        parts.append(_content(df))
    return f"{zlib.crc32(chr(0).join(parts).encode()):08x}"
