import os
import socket

import pytest
from pyspark.sql import functions as F

from strandmill.catalogue.text import tool_empty_partitions
from strandmill.operators.tools import (
    ToolError,
    ToolSpec,
    as_lines,
    check_tool,
    is_available,
    map_partitions,
    pipe_tool,
    run_tool,
    run_tool_logged,
    run_tool_over_splits,
    tool_log,
)


def shell(script, **options):
    return ToolSpec(["sh", "-c", script, "tool", "{input}", "{output}"], **options)


def output(df):
    return sorted(row.piece for row in df.collect())


@pytest.fixture
def numbers(spark):
    return spark.range(0, 25_000, 1, 3).select(F.col("id").cast("string").alias("line"))


def test_one_run_per_partition_over_all_batches(spark, numbers):
    counts = run_tool(numbers, ToolSpec(["wc", "-l", "{input}"])).collect()
    assert sorted(row.part_id for row in counts) == [0, 1, 2]
    assert sum(int(row.piece.split()[0]) for row in counts) == 25_000


@pytest.mark.parametrize("through", ["file", "pipe"])
def test_output_rows_keep_their_order(numbers, through):
    argv = ["cat", "{input}"] if through == "file" else ["cat"]
    rows = run_tool(numbers, ToolSpec(argv), through).orderBy("part_id", "seq").collect()
    assert [int(row.piece) for row in rows] == list(range(25_000))


def test_output_file_and_empty_lines(spark, lines):
    df = lines("", "a", "", "é\tb", "").coalesce(1)
    assert output(run_tool(df, shell('cat "$1" > "$2"; echo noise'))) == ["", "", "", "a", "é\tb"]


def test_empty_partitions_run_nothing(spark, lines):
    df = lines("a").repartition(4)
    assert run_tool(df.filter("line = 'x'"), shell("exit 3")).count() == 0
    assert output(run_tool(df, ToolSpec(["cat", "{input}"]))) == ["a"]


def test_exit_codes(lines):
    df = lines("a")
    for code in (1, 2):
        with pytest.raises(Exception, match=f"exit code {code}: oh no"):
            run_tool(df, shell(f"echo oh no >&2; exit {code}")).collect()
    assert output(run_tool(df, shell("exit 1", ok_codes=(0, 1)))) == []
    with pytest.raises(Exception, match="exit code 2"):
        run_tool(df, shell("exit 2", ok_codes=(0, 1))).collect()
    with pytest.raises(Exception, match="is not available"):
        run_tool(df, ToolSpec(["no-such-program"])).collect()


def test_output_patterns_fail_a_run(lines):
    spec = shell("echo fine; echo Kernel PANIC now", fail_patterns=("panic", "already exists"))
    with pytest.raises(Exception, match="reported a failure: Kernel PANIC now"):
        run_tool(lines("a"), spec).collect()


def test_a_program_may_stop_reading(numbers):
    assert output(pipe_tool(numbers.coalesce(1), ToolSpec(["head", "-n", "2"]))) == ["0", "1"]


def test_log(lines):
    row = tool_log(lines("a", "b").coalesce(1), shell("echo out; echo err >&2")).head()
    assert (row.exit_code, row.n_rows, row.stdout, row.stderr) == (0, 2, "out\n", "err\n")
    assert row.host == socket.gethostname() and row.seconds >= 0


def test_rows_and_log_come_from_one_run(spark, lines, tmp_path):
    script = f'echo run >> {tmp_path}/runs; (cat "$1"; echo "$$") > "$2"; echo "$$" >&2'
    pieces, log = run_tool_logged(lines("a", "b", "c").repartition(2), shell(script))
    for _ in range(2):
        by_part = {r.part_id: r for r in log.collect()}
        rows = sorted((r.part_id, r.seq, r.piece) for r in pieces.collect())
        assert sorted(p for *_, p in rows if not p.isdigit()) == ["a", "b", "c"]
        assert {part: p for part, _, p in rows if p.isdigit()} == {part: r.stderr.strip() for part, r in by_part.items()}
    assert sum(r.n_rows for r in by_part.values()) == 3
    assert (tmp_path / "runs").read_text().count("run") == len(by_part)


def test_splits_read_their_partition_once(spark, lines, tmp_path):
    seen = tmp_path / "seen"

    def note(frames):
        for frame in frames:
            with open(seen, "a") as out:
                out.write("x" * len(frame))
            yield frame

    spec = ToolSpec(["sed", "s/^/{split}:/", "{input}"])
    noted = map_partitions(lines("a", "b").coalesce(1), note, "line STRING")
    plans = [run_tool_over_splits(noted, spec, n)._jdf.queryExecution().executedPlan().toString() for n in (2, 50)]
    assert plans[0].count("\n") == plans[1].count("\n") and "Exchange" not in plans[0].replace("SinglePartition", "")
    rows = run_tool_over_splits(noted, spec, 4).collect()
    assert sorted(r.piece for r in rows) == sorted(f"{n}:{x}" for n in range(1, 5) for x in "ab")
    assert all(r.piece.startswith(f"{r.split_id}:") for r in rows) and seen.read_text() == "xx"


def test_a_failure_is_found_in_one_huge_line(lines, monkeypatch):
    from strandmill.operators import tools

    monkeypatch.setattr(tools, "CHUNK", 5000)
    spec = shell("head -c 40000 /dev/zero | tr '\\0' x; printf 'PaNic now'; head -c 9000 /dev/zero | tr '\\0' y", fail_patterns=("panic now",))
    with pytest.raises(Exception, match="reported a failure: x+PaNic now"):
        run_tool(lines("a"), spec).collect()


def test_splits_and_host_dependent_arguments(lines):
    spec = ToolSpec(lambda host: ["sh", "-c", f"echo {host} {{split}} {{size}}"], values={"size": "7"})
    rows = as_lines(run_tool_over_splits(lines("a").coalesce(1), spec, 3), "split_id").collect()
    assert sorted(map(tuple, rows)) == [(n, f"{socket.gethostname()} {n} 7") for n in (1, 2, 3)]


def test_availability(spark):
    check_tool(spark, ToolSpec(["cat", "{input}"]))
    assert is_available(ToolSpec(["false"]))
    with pytest.raises(ToolError, match="not available on the driver"):
        check_tool(spark, ToolSpec(["no-such-program"]))


def test_exit_code_127_means_missing(tmp_path):
    program = tmp_path / "broken"
    program.write_text("#!/bin/sh\nexit 127\n")
    program.chmod(0o755)
    assert not is_available(ToolSpec([str(program)]))


def test_attempt_folders_are_removed(lines):
    row = run_tool(lines("a").coalesce(1), shell('pwd > "$2"')).head()
    assert not os.path.exists(row.piece)


def test_partition_functions(numbers):
    def sizes(frames):
        import pandas as pd

        yield pd.DataFrame({"n": [sum(len(frame) for frame in frames)]})

    assert sorted(r.n for r in map_partitions(numbers, sizes, "n INT").collect()) == [8333, 8333, 8334]


def test_lines_of_one_kind_are_dealt_over_many_tasks_beside_empty_ones(spark, tmp_path):
    rows = spark.range(0, 400, 1, 8).select(F.concat(F.lit("the same\nthe line "), "id", F.lit("\nno match")).alias("text"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    found = tool_empty_partitions(spark, str(tmp_path))
    assert output(found.select(F.col("line").alias("piece"))) == sorted(["the same"] * 400 + [f"the line {n}" for n in range(400)])
    sizes = [row["count"] for row in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 16 and max(sizes) <= 200 and found.rdd.getNumPartitions() >= 2 * len(sizes)
