"""Tables of a file database, read in ranges and followed as a stream."""

from __future__ import annotations

import sqlite3
from datetime import date, datetime
from decimal import Decimal

import pytest

from loomframe.sources import dbapi as D
from loomframe.streaming.streams import finish, land

SCHEMA = "id long, name string, price double, cost decimal(10,2), day date, at timestamp_ntz, good boolean"


def fill(path, rows):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE IF NOT EXISTS t (id INTEGER, name TEXT, price REAL, cost REAL, day TEXT, at TEXT, good INTEGER, other TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?, 'unread')", rows)


def row(n):
    return (n, f"n{n}" if n % 7 else None, n / 4, n / 100, f"2024-01-{n % 28 + 1:02d}", f"2024-01-01T00:00:{n % 60:02d}.5", n % 2)


def expected(n):
    return (n, f"n{n}" if n % 7 else None, n / 4, Decimal(n).scaleb(-2), date(2024, 1, n % 28 + 1), datetime(2024, 1, 1, 0, 0, n % 60, 500_000), bool(n % 2))


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_table_in_ranges(spark, tmp_path, partitions):
    path = str(tmp_path / "a.db")
    fill(path, [*map(row, range(-30, 500)), (None, "none", None, None, None, None, None)])
    df = D.read_database(spark, "sqlite3", [path], "t", SCHEMA, "id", partitions)
    found = [tuple(r) for r in df.collect()]
    assert df.rdd.getNumPartitions() == partitions
    assert sorted(found, key=str) == sorted([*map(expected, range(-30, 500)), (None, "none", *[None] * 5)], key=str)
    query = D.read_database(spark, "sqlite3", {"database": path}, "(SELECT id, price * 2 AS twice FROM t WHERE id > 490 AND name || '' <> '{}') q", "id long, twice double", "id", 2)
    assert sorted(map(tuple, query.collect())) == [(n, n / 2) for n in range(491, 500) if n % 7]


def test_empty_table_and_missing_schema(spark, tmp_path):
    path = str(tmp_path / "b.db")
    fill(path, [])
    assert D.read_database(spark, "sqlite3", [path], "t", SCHEMA, "id", 8).count() == 0
    with pytest.raises(Exception, match="name the columns"):
        spark.read.format("loomframe_dbapi").options(module="sqlite3", table="t").load()


def test_cut_points():
    assert D.cut_points(0, 10, 4) == [2, 5, 7] and D.cut_points(0, 2, 10) == [1]
    assert D.cut_points("a", "z", 4) == [] == D.cut_points(None, None, 4) == D.cut_points(3, 3, 4)


def test_only_new_rows_after_a_restart(spark, tmp_path):
    path, out, checkpoint = str(tmp_path / "c.db"), str(tmp_path / "out"), str(tmp_path / "cp")
    fill(path, map(row, range(40)))
    for news in (range(0), range(0), range(40, 43)):
        fill(path, map(row, news))
        stream = D.stream_database(spark, "sqlite3", [path], "t", "id long, name string", "id", 3)
        finish(land(stream, out, checkpoint), 120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(43))
