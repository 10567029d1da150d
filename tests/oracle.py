"""Run registered queries next to their SQL in DuckDB and compare whole results.

    python tests/oracle.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    return v


def _kind(v):
    if isinstance(v, bool):
        return "bool"
    return type(v).__name__


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))
    return [columns[i] for i in order], out


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    names, got = _rows([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    expected_names, expected = _rows(cur.fetchall(), [d[0] for d in cur.description])
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}; first got {got[:1]} expected {expected[:1]}"
    for a, b in zip(got, expected):
        if a != b or [_kind(x) for x in a] != [_kind(x) for x in b]:
            return f"{a} != {b}"
    if not got:
        return "no rows"
    return None


def spark_session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = spark_session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            if sql is None:
                problem = None if fn(spark, sf_dir).count() else "no rows"
                label = "rows"
            else:
                problem, label = compare(fn(spark, sf_dir), con, sql), "same"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else label:5} {time.time() - start:6.2f}s {name}" + (f"\n      {problem}" if problem else ""), flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
