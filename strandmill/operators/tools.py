"""External programs over the partitions of a DataFrame.

A partition's text column is streamed to the program, through a file or its standard
input, and the program's output is streamed back as rows, cut at a separator. Every
task attempt works in a folder of its own under the executor's Spark directory and
removes it, so retries and speculative attempts cannot meet. Nothing but the rows the
task returns outlives it; what a run reported is a row beside those of its output.
"""

from __future__ import annotations

import os
import shutil
import socket
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.session import fresh_dir

NOT_FOUND = 127
CHUNK = 1 << 20
ROWS_PER_BATCH = 10_000
CHARACTERS_PER_BATCH = 8 << 20
LOG_CHARACTERS = 1 << 20
PIECES = "part_id INT, piece STRING, seq BIGINT"
LOG = "part_id INT, host STRING, exit_code INT, n_rows BIGINT, seconds DOUBLE, stdout STRING, stderr STRING"
_ARROW = pa.schema(
    [
        ("part_id", pa.int32()),
        ("split_id", pa.int32()),
        ("piece", pa.string()),
        ("seq", pa.int64()),
        ("host", pa.string()),
        ("exit_code", pa.int32()),
        ("n_rows", pa.int64()),
        ("seconds", pa.float64()),
        ("stdout", pa.string()),
        ("stderr", pa.string()),
    ]
)
_ROWS = "part_id INT, split_id INT, piece STRING, seq BIGINT, " + LOG.split(", ", 1)[1]


class ToolError(RuntimeError):
    """A program that is missing or broke its exit policy."""


@dataclass(frozen=True)
class ToolSpec:
    """How a program is called and when its run counts as a success.

    ``argv`` is a list, or a function from the host name to one. ``{input}``,
    ``{output}``, ``{part}`` and ``{split}`` in it are replaced. Without ``{output}``
    the program's standard output is its result. ``environment`` is put on top of the
    host's; by default it pins the locale, so that hosts count and match alike.
    """

    argv: list[str] | Callable[[str], list[str]]
    ok_codes: tuple[int, ...] = (0,)
    fail_patterns: tuple[str, ...] = ()
    help_arg: str = "--help"
    separator: str = "\n"
    values: dict[str, str] = field(default_factory=dict)
    environment: dict[str, str] = field(default_factory=lambda: {"LC_ALL": "C.UTF-8"})

    def command(self, **places: str) -> list[str]:
        argv = self.argv(socket.gethostname()) if callable(self.argv) else self.argv
        words = list(argv)
        for name, value in {**self.values, **places}.items():
            words = [word.replace("{" + name + "}", str(value)) for word in words]
        return words


@contextmanager
def _attempt_folder() -> Iterator[str]:
    folder = tempfile.mkdtemp(prefix="tool-", dir=SparkFiles.getRootDirectory())
    try:
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _write_rows(batch: pa.RecordBatch, sink) -> int:
    """The rows as lines; the text is joined in Arrow and written as it lies there."""
    column = batch.column(0)
    if column.null_count:
        raise ToolError("a null row has no line; filter nulls or give them a text")
    if len(column):
        lines = pc.binary_join_element_wise(column.cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
        begin, end = lines.offset, lines.offset + len(lines)
        offsets = np.frombuffer(lines.buffers()[1], np.int64)
        sink.write(memoryview(lines.buffers()[2])[offsets[begin] : offsets[end]])
    return len(column)


def _cut_file(path: str, separator: str) -> Iterator[str]:
    """The rows of an output file, read in chunks; a final line end closes the last row."""
    mark = separator.encode()
    held: list[bytes] = []  # chunks of a row that has not ended yet
    with open(path, "rb") as source:
        while chunk := source.read(CHUNK):
            tail = held[-1][1 - len(mark) :] if held and len(mark) > 1 else b""
            if mark not in tail + chunk:
                held.append(chunk)
                continue
            *whole, rest = b"".join([*held, chunk]).split(mark)
            held = [rest]
            for row in whole:
                yield row.decode("utf-8", "replace")
    rest = b"".join(held)
    if separator == "\n":
        if rest:
            yield rest.decode("utf-8", "replace")
    elif rest := rest.removesuffix(b"\n"):
        yield rest.decode("utf-8", "replace")


def _batch(part_id: int, split_id: int, n: int, **columns: list) -> pa.RecordBatch:
    """Rows of one run; columns that are not given are null."""
    columns |= {"part_id": [part_id] * n, "split_id": [split_id] * n}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW
    )


def _batches(part_id: int, split_id: int, rows: Iterator[str]) -> Iterator[pa.RecordBatch]:
    def batch(ready: list[str], start: int) -> pa.RecordBatch:
        return _batch(part_id, split_id, len(ready), piece=ready, seq=list(range(start, start + len(ready))))

    ready: list[str] = []
    start = size = 0
    for row in rows:
        ready.append(row)
        size += len(row)
        if len(ready) == ROWS_PER_BATCH or size >= CHARACTERS_PER_BATCH:
            yield batch(ready, start)
            start += len(ready)
            ready, size = [], 0
    if ready:
        yield batch(ready, start)


@dataclass
class _Run:
    output: str
    exit_code: int
    n_rows: int
    seconds: float
    stdout: str
    stderr: str


def _read_text(path: str, most: int = LOG_CHARACTERS) -> str:
    """The end of a file, ``most`` bytes of it."""
    with open(path, "rb") as source:
        source.seek(max(0, os.path.getsize(path) - most))
        return source.read().decode("utf-8", "replace")


def _check_run(spec: ToolSpec, command: list[str], code: int, stdout: str, stderr: str) -> None:
    if code not in spec.ok_codes:
        raise ToolError(f"{command} ended with exit code {code}: {_read_text(stderr, 4000)}")
    patterns = [pattern.lower().encode() for pattern in spec.fail_patterns]
    if patterns:
        found = _find_any(stdout, patterns)
        if found is not None:
            raise ToolError(f"{command} reported a failure: {found}")


def _find_any(path: str, patterns: list[bytes]) -> str | None:
    """The line (4,000 bytes of it at most) around the first of the lower-case ``patterns``; read in chunks that overlap."""
    overlap = max(map(len, patterns)) + 4000
    held = b""
    with open(path, "rb") as source:
        while chunk := source.read(CHUNK):
            data = held + chunk
            lower = data.lower()
            at = min((k for k in map(lower.find, patterns) if k >= 0), default=-1)
            if at >= 0:
                begin = max(lower.rfind(b"\n", 0, at) + 1, at - 2000)
                return data[begin : at + 2000].split(b"\n", 1)[0].decode("utf-8", "replace").strip()
            held = data[-overlap:]
    return None


def _execute(spec: ToolSpec, folder: str, source: str, part_id: int, feed: Callable | None) -> _Run:
    """One run of the program in ``folder``; ``feed`` writes its standard input, if it reads one."""
    output, stdout, stderr = (os.path.join(folder, name) for name in ("output", "stdout", "stderr"))
    command = spec.command(input=source, output=output, part=str(part_id))
    environment = os.environ | spec.environment
    started = time.monotonic()
    n_rows = 0
    with open(stdout, "wb") as out, open(stderr, "wb") as err:
        try:
            if feed is None:
                code = subprocess.run(
                    command, stdin=subprocess.DEVNULL, stdout=out, stderr=err, cwd=folder, env=environment
                ).returncode
            else:
                process = subprocess.Popen(
                    command, stdin=subprocess.PIPE, stdout=out, stderr=err, cwd=folder, env=environment
                )
                try:
                    n_rows = feed(process.stdin)
                    process.stdin.close()
                except BrokenPipeError:
                    pass  # the program stopped reading; its exit code decides
                finally:
                    code = process.wait()
        except FileNotFoundError as missing:
            raise ToolError(f"{command[0]} is not available on {socket.gethostname()}") from missing
    _check_run(spec, command, code, stdout, stderr)
    writes_file = any(output in word for word in command)
    return _Run(output if writes_file else stdout, code, n_rows, time.monotonic() - started, stdout, stderr)


def _runs(
    specs: dict[int, ToolSpec], batches: Iterator[pa.RecordBatch], through: str, part_id: int
) -> Iterator[tuple[int, _Run]]:
    """A run per program over all batches; none when there are no rows. The files of a run are there until the next."""
    first = next((batch for batch in batches if batch.num_rows), None)
    if first is None:
        return

    def feed(sink) -> int:
        return _write_rows(first, sink) + sum(_write_rows(batch, sink) for batch in batches)

    with _attempt_folder() as folder:
        source, n_rows = os.path.join(folder, "input"), 0
        if through == "file":
            with open(source, "wb", CHUNK) as sink:
                n_rows = feed(sink)
        for number, spec in specs.items():
            place = os.path.join(folder, str(number))
            os.mkdir(place)
            run = _execute(spec, place, source, part_id, feed if through == "pipe" else None)
            yield number, replace(run, n_rows=n_rows) if through == "file" else run
            shutil.rmtree(place, ignore_errors=True)


def _task(specs: dict[int, ToolSpec], through: str, rows: bool = True, log: bool = False):
    """What the programs put out, and a row of what each run reported; both come from the same run."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()
        for number, run in _runs(specs, iter(batches), through, part_id):
            if rows and os.path.exists(run.output):
                yield from _batches(part_id, number, _cut_file(run.output, specs[number].separator))
            if log:
                yield _batch(
                    part_id, number, 1, host=[socket.gethostname()], exit_code=[run.exit_code], n_rows=[run.n_rows],
                    seconds=[run.seconds], stdout=[_read_text(run.stdout)], stderr=[_read_text(run.stderr)],
                )

    return task


def run_tool(df: DataFrame, spec: ToolSpec, through: str = "file") -> DataFrame:
    """Run a program once per partition over the one text column of ``df``.

    Gives the output as ``piece``, with the partition in ``part_id`` and the order within
    it in ``seq``. An empty partition runs nothing. ``through`` is ``file``, where the
    program reads ``{input}``, or ``pipe``, where it reads its standard input.
    """
    return df.mapInArrow(_task({0: spec}, through), _ROWS).select("part_id", "piece", "seq")


def pipe_tool(df: DataFrame, spec: ToolSpec) -> DataFrame:
    return run_tool(df, spec, "pipe")


def tool_log(df: DataFrame, spec: ToolSpec, through: str = "file") -> DataFrame:
    """Run a program like :func:`run_tool` and return what each run reported instead.

    Of each stream the last ``LOG_CHARACTERS`` bytes are kept.
    """
    logged = df.mapInArrow(_task({0: spec}, through, rows=False, log=True), _ROWS)
    return logged.select("part_id", "host", "exit_code", "n_rows", "seconds", "stdout", "stderr")


def run_tool_logged(df: DataFrame, spec: ToolSpec, through: str = "file") -> tuple[DataFrame, DataFrame]:
    """The output of :func:`run_tool` and the log of :func:`tool_log`, both of one and the same run of each partition.

    The program runs when this is called. Rows and log are written once, to the shared
    folder, in files apart, so that the log is read without the output.
    """
    path = fresh_dir(df.sparkSession, "tool-run")
    rows = df.mapInArrow(_task({0: spec}, through, log=True), _ROWS).drop("split_id")
    rows.withColumn("is_log", F.col("host").isNotNull()).write.partitionBy("is_log").parquet(path)
    written = df.sparkSession.read.schema(rows.schema.add("is_log", "boolean")).option("basePath", path).parquet(path)
    log = written.filter("is_log").select("part_id", "host", "exit_code", "n_rows", "seconds", "stdout", "stderr")
    return written.filter("not is_log").select("part_id", "piece", "seq"), log


def run_tool_over_splits(df: DataFrame, spec: ToolSpec, n_splits: int) -> DataFrame:
    """Run a program once per partition and database split ``{split}``.

    A task evaluates its partition of ``df`` once, into one input file, and runs the program on it for one split
    after another. The plan does not depend on ``n_splits``; nothing is shuffled. Programs may not change their input.
    """
    specs = {split: replace(spec, values={**spec.values, "split": str(split)}) for split in range(1, n_splits + 1)}
    return df.mapInArrow(_task(specs, "file"), _ROWS).select("part_id", "piece", "seq", "split_id")


def as_lines(pieces: DataFrame, *keep: str) -> DataFrame:
    """Tool output as a ``line`` column."""
    return pieces.select(*keep, F.col("piece").alias("line"))


def as_pieces(pieces: DataFrame) -> DataFrame:
    """Tool output in the shape that the multi-line format parsers take."""
    return pieces.select(
        "piece",
        F.col("part_id").cast("string").alias("source"),
        F.lit(0).cast("bigint").alias("block"),
        "seq",
    )


def map_partitions(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """A Python function over whole partitions, as iterators of pandas frames."""
    return df.mapInPandas(function, schema)


def is_available(spec: ToolSpec) -> bool:
    """Whether the program starts on this host; only exit code 127 says it does not."""
    program = spec.command(input="", output="", part="0", split="1")[0]
    if shutil.which(program) is None:
        return False
    run = subprocess.run(
        [program, spec.help_arg],
        stdin=subprocess.DEVNULL,
        stdout=subprocess.DEVNULL,
        stderr=subprocess.DEVNULL,
    )
    return run.returncode != NOT_FOUND


def check_tool(spark: SparkSession, spec: ToolSpec) -> None:
    """Fail unless the program starts on the driver and wherever a task lands now."""
    if not is_available(spec):
        raise ToolError(f"{spec.command()[0]} is not available on the driver")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and not is_available(spec):
                yield pa.RecordBatch.from_pydict({"host": [socket.gethostname()]})

    slots = spark.sparkContext.defaultParallelism
    hosts = spark.range(0, slots, 1, slots).mapInArrow(probe, "host STRING").distinct().collect()
    if hosts:
        raise ToolError(f"{spec.command()[0]} is not available on {sorted(r.host for r in hosts)}")
