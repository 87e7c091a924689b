"""Run every query and its SQL on the same tables: ``python -m checks.compare DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES


def session(cpus: str = "*") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return str(value)
    value = float(value)
    return "0" if value == 0 else repr(round(value, 5)) if math.isfinite(value) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def main(folder: str, names: list[str]) -> int:
    spark, con, bad = session("8"), database(folder), 0
    for name in names or QUERIES:
        begun = time.perf_counter()
        try:
            found = QUERIES[name](spark, folder)
            mine = _rows(found.columns, [tuple(r) for r in found.collect()])
        except Exception as error:  # noqa: BLE001
            print(f"{name:28s} FAILED {type(error).__name__}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.perf_counter() - begun
        if name not in ORACLE:
            print(f"{name:28s} rows {len(mine):7d}  {took:6.1f} s (no SQL)", flush=True)
            continue
        begun = time.perf_counter()
        result = con.execute(ORACLE[name])
        columns = [d[0] for d in result.description]
        theirs = _rows(columns, result.fetchall())
        asked = time.perf_counter() - begun
        same = mine == theirs and sorted(columns) == sorted(found.columns)
        bad += not same
        print(f"{name:28s} {'ok  ' if same else 'DIFF'} {len(mine):7d} {len(theirs):7d}  {took:6.1f} s  sql {asked:5.1f} s", flush=True)
        if not same:
            print("   columns", sorted(found.columns), sorted(columns))
            print("   only Spark", [r for r in mine if r not in set(theirs)][:4])
            print("   only SQL  ", [r for r in theirs if r not in set(mine)][:4])
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
