"""Compare every registered query that has SQL with it, the way rows are compared as multisets.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def sql_rows(connection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(row[i] for i in order) for row in cursor.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(row) for row in df.select(*names).collect())


def compare(spark, connection, name, query, sql, sf_dir) -> str:
    """An empty string, or what differs."""
    expected_names, expected = sql_rows(connection, sql)
    names, rows = spark_rows(query(spark, sf_dir))
    if names != expected_names:
        return f"columns {names} instead of {expected_names}"
    if rows != expected:
        extra, missing = rows - expected, expected - rows
        return (
            f"{rows.total()} rows instead of {expected.total()}; "
            f"extra {str(next(iter(extra), None))[:400]}; missing {str(next(iter(missing), None))[:400]}"
        )
    if not rows.total():
        return "no rows"
    return ""


def main(sf_dir: str = "/root/testdata/sf0.01", *chosen: str) -> int:
    import __spark_entry__ as driver
    from strandmill.session import build_session

    spark = build_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__log__level="ERROR",
    )
    connection = connect(sf_dir)
    oracles = driver.oracle_sql()
    bad = 0
    for name, query in driver.queries().items():
        if name not in oracles or chosen and name not in chosen:
            continue
        started = time.monotonic()
        try:
            problem = compare(spark, connection, name, query, oracles[name], sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = str(error)[:1500]
        bad += bool(problem)
        print(f"{name:32} {time.monotonic() - started:6.2f}s {problem or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(*sys.argv[1:])))
