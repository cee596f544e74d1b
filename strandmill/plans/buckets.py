"""Bucket-wise resume: work that is done for a bucket is not done again."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, unquote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.plans.identity import mark_of
from strandmill.plans.workflow import SUCCESS, path_exists

BUCKET = "__bucket"
MAX_BUCKETS = 10_000
NULL = "%null"  # no quoted value is written like this


def with_bucket(df: DataFrame, n_buckets: int) -> DataFrame:
    """Spread rows over buckets by all their columns, so that no single key fills one."""
    if BUCKET in df.columns:
        raise ValueError(f"the column {BUCKET} is reserved")
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*df.columns), F.lit(n_buckets)).cast("int"))


def _folder(path: str, uid: str, stage: str, mark: str) -> str:
    return f"{path}/{quote(uid, safe='')}/{stage}-{mark}"


def _name(bucket) -> str:
    return NULL if bucket is None else quote(str(bucket), safe="")


def done_buckets(spark: SparkSession, path: str, uid: str, stage: str, mark: str) -> set[str | None]:
    """Buckets finished by this user for this stage and mark: those whose folders were committed."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{_folder(path, uid, stage, mark)}/bucket=*/{SUCCESS}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    names = [status.getPath().getParent().getName().removeprefix("bucket=") for status in found or []]
    return {None if name == NULL else unquote(name) for name in names}


def resume_buckets(
    df: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    path: str,
    uid: str,
    stage: str,
    recipe: str,
    n_buckets: int = 64,
    at_once: int = 4,
    partition_column: str | None = None,
) -> DataFrame:
    """``compute`` over ``df``, bucket by bucket, kept under ``path``.

    Every bucket that is not done yet is a job of its own, ``at_once`` of them side by side. Its files and the
    mark that it is done are committed together, so a run that is cut off loses the buckets that were running
    and no others, and repeats no rows. A bucket that fails holds up no other; its failure is raised at the end. Work is known by the mark of the input (plan, files), the schema of the result and
    ``recipe``, which names what ``compute`` does: another input or recipe starts anew.

    The input is read once, into a copy that is partitioned by bucket. If the table is partitioned by a column
    already, ``partition_column`` names it; its values, null among them, are then the buckets, ``MAX_BUCKETS`` of
    them at most, and no copy is made. ``compute`` must work on each row alone; the column ``__bucket`` that it sees
    is not in the result.
    """
    spark = df.sparkSession
    bucketed = with_bucket(df, n_buckets) if partition_column is None else df.withColumn(BUCKET, F.col(partition_column).cast("string"))
    schema = compute(bucketed).drop(BUCKET).schema
    mark = mark_of(df, stage, str(n_buckets), str(partition_column), recipe, schema.json())
    target = _folder(path, uid, stage, mark)
    if partition_column is None:
        buckets = [str(bucket) for bucket in range(n_buckets)]
    else:
        buckets = [row[0] for row in bucketed.select(BUCKET).distinct().limit(MAX_BUCKETS + 1).collect()]
        if len(buckets) > MAX_BUCKETS:
            raise ValueError(f"{partition_column} has more than {MAX_BUCKETS} values; name no column, and rows are spread over n_buckets")
    done = done_buckets(spark, path, uid, stage, mark)
    pending = [bucket for bucket in buckets if bucket not in done]
    if not buckets:
        return compute(bucketed).limit(0).drop(BUCKET)
    if pending and partition_column is None:
        staged = f"{target}-input"
        if not path_exists(spark, f"{staged}/{SUCCESS}"):
            # adaptive execution splits large buckets and merges small ones
            bucketed.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(staged)
        bucketed = spark.read.schema(bucketed.schema).parquet(staged).select(*bucketed.columns)

    def run(bucket) -> None:
        chosen = F.col(BUCKET).isNull() if bucket is None else F.col(BUCKET) == F.lit(bucket).cast(bucketed.schema[BUCKET].dataType)
        compute(bucketed.filter(chosen)).drop(BUCKET).write.mode("overwrite").parquet(f"{target}/bucket={_name(bucket)}")

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(run), bucket) for bucket in pending]
    for job in jobs:  # all have ended; the first failure is raised
        job.result()
    return spark.read.schema(schema).parquet(f"{target}/bucket=*")
