"""Stages of a workflow: naming, checkpoints, resume, caching and timing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandmill.plans.identity import mark_of

SUCCESS = "_SUCCESS"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file exists in whichever file system the path names."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target)


class Workflow:
    """Numbered stages below ``root``.

    With ``recover`` every stage is written as a table and read back; one that finished
    in an earlier run of the same job is only read. A stage is known by its number, its tool and
    the mark of what it computes (plan, input files, recipe), so a job that asks for something
    else, or of another input, computes it. A stage without its ``_SUCCESS`` file is
    overwritten. Without ``recover`` stages stay lazy and run fused together; their rows are observed as
    the first action that needs them reads them.
    """

    def __init__(self, spark: SparkSession, root: str, job_id: str, recover: bool = False):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/{job_id}"
        self.recover = recover
        self.timings: list[tuple[str, float, int | None, bool]] = []
        self._n_stages = 0
        self._kept: list[DataFrame] = []
        self._observed: dict[int, Observation] = {}

    def stage_path(self, tool: str, mark: str) -> str:
        """The folder of the next stage; every call counts one up."""
        self._n_stages += 1
        return f"{self.path}/stage_{self._n_stages}/{tool}-{mark}"

    def stage(self, tool: str, compute: Callable[[], DataFrame], recipe: str = "") -> DataFrame:
        """The result of a stage, computed or recovered.

        ``compute`` gives the plan and is always called; its work is done only if it has to be. ``recipe``
        names what the plan does not show: the version of a Python function, the arguments of a program.
        """
        started = time.monotonic()
        result = compute()
        if not self.recover:
            self._n_stages += 1
            self._observed[len(self.timings)] = observation = Observation()
            self.timings.append((f"stage_{self._n_stages}/{tool}", time.monotonic() - started, None, False))
            return result.observe(observation, F.count(F.lit(1)).alias("n_rows"))
        path = self.stage_path(tool, mark_of(result, recipe))
        recovered = path_exists(self.spark, f"{path}/{SUCCESS}")
        if not recovered:
            result.write.mode("overwrite").parquet(path)
        result = self.spark.read.schema(result.schema).parquet(path)
        rows = result.count()  # from the footers of the written files
        self.timings.append((f"stage_{self._n_stages}/{tool}", time.monotonic() - started, rows, recovered))
        return result

    def scalar(self, name: str, compute: Callable[[], DataFrame], recipe: str = ""):
        """The one value of a one-row result, kept like a stage."""
        started = time.monotonic()
        result = compute()
        path = f"{self.path}/scalars/{name}-{mark_of(result, recipe)}" if self.recover else ""
        recovered = self.recover and path_exists(self.spark, f"{path}/{SUCCESS}")
        schema = result.schema
        value = (self.spark.read.schema(schema).parquet(path) if recovered else result).head()[0]
        if self.recover and not recovered:
            self.spark.createDataFrame([(value,)], schema).coalesce(1).write.mode("overwrite").parquet(path)
        self.timings.append((f"scalars/{name}", time.monotonic() - started, 1, recovered))
        return value

    def keep(self, df: DataFrame) -> DataFrame:
        """Cache a result that several stages read, unless it is a written table already."""
        if self.recover:
            return df
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def release(self) -> None:
        """Drop the caches; only after the actions that read them."""
        while self._kept:
            self._kept.pop().unpersist()

    def report(self) -> DataFrame:
        """Stage, seconds, rows and whether it was recovered.

        A lazy stage has the seconds of its planning, since it runs fused with others, and the rows
        that the first action on it read; none before there was one.
        """
        rows = list(self.timings)
        for index, observation in self._observed.items():
            if observation._jo.getRowOrEmpty().isDefined():  # get would wait for an action
                stage, seconds, _, recovered = rows[index]
                rows[index] = (stage, seconds, observation.get["n_rows"], recovered)
        return self.spark.createDataFrame(rows, "stage STRING, seconds DOUBLE, n_rows BIGINT, recovered BOOLEAN")


def repartition_by(df: DataFrame, multiplier: float) -> DataFrame:
    """Exactly ``defaultParallelism * multiplier`` partitions."""
    return df.repartition(max(1, int(df.sparkSession.sparkContext.defaultParallelism * multiplier)))


def take(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows, in an order if one is given."""
    return (df.orderBy(*order) if order else df).limit(n)


def materialise(df: DataFrame) -> int:
    """Run a stage for its own sake; the number of its rows."""
    return df.agg(F.count("*")).head()[0]
