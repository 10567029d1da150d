"""Readers, writers and versioned datasets on small files."""

import json

import pytest
from pyspark.sql import functions as F

from loomframe.session import new_path, shared_dir
from loomframe.sources import incremental as I
from loomframe.sources import readers as R
from loomframe.sources import sinks as S


def test_csv_header_marks_and_collisions(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,name\n1,x\n2,y\n", encoding="utf-8")
    df = R.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name"]
    twice = R.clean_header(spark.createDataFrame([(1, 2)], ["﻿id", "id"]))
    assert twice.columns == ["id", "id__1"]


def test_json_rows_document(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"rows": [{"a": 1}, {"a": 2}]}, indent=1))
    rows = R.read_json(spark, str(tmp_path / "a.json"), rows="rows", multi_line=True)
    assert sorted(r.a for r in rows.collect()) == [1, 2]


def test_absent_connectors_say_what_is_missing(spark):
    with pytest.raises(RuntimeError, match="spark-avro"):
        R.read_avro(spark, "/tmp/none")
    with pytest.raises(RuntimeError, match="Kafka"):
        R.read_kafka(spark, "localhost:1", "t")


def test_jdbc_options():
    made = R.jdbc_options("jdbc:x", query="SELECT 1", partition=("id", 0, 100, 4))
    assert made["dbtable"] == "(SELECT 1) AS q"
    assert made["numPartitions"] == "4"
    with pytest.raises(ValueError):
        R.jdbc_options("jdbc:x")


def test_failfast_and_permissive_parsing(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("oops",)], "value string")
    kept = R.parse_value(df, "value", "json", "a int", "PERMISSIVE").select("value_parsed.a").collect()
    assert [r.a for r in kept] == [1, None]
    with pytest.raises(Exception):
        R.parse_value(df, "value", "json", "a int").select("value_parsed.a").collect()
    with pytest.raises(ValueError):
        R.parse_value(df, "value", "json")


def test_partition_rules(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, kind string")
    with pytest.raises(ValueError):
        S.write_files(df, str(tmp_path / "x"), "csv", partition_by=["kind"])
    with pytest.raises(ValueError):
        S.write_files(df, str(tmp_path / "x"), partition_by=["absent"])


def test_commits_versions_and_empty_append(spark):
    root = new_path(spark, "test")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert S.commit(rows, root) == 1
    assert S.commit(rows, root, "append_only_new_rows", ["id"]) is None
    news = spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string")
    assert S.commit(news, root, "append_only_new_rows", ["id"]) == 2
    assert {r.id for r in S.read_dataset(spark, root, since=1).collect()} == {3}
    assert S.read_dataset(spark, root, as_of=1).count() == 2
    assert S.commit(news, root, "snapshot_replace", ["id"]) == 3
    assert S.read_dataset(spark, root).count() == 3
    assert S.read_dataset(spark, root, since=3) is None


def test_stored_and_new_columns_stay(spark):
    root = new_path(spark, "columns")
    S.commit(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, extra string"), root)
    S.commit(spark.createDataFrame([(2, "B")], "id int, v string"), root, "snapshot_replace", ["id"])
    S.commit(spark.createDataFrame([(3, "c", 7)], "id int, v string, n int"), root, "always_append")
    rows = S.read_dataset(spark, root)
    assert {(r.id, r.v, r.extra, r.n) for r in rows.collect()} == {(1, "a", "x", None), (2, "B", None, None), (3, "c", None, 7)}
    assert [r.version for r in S.read_dataset(spark, root, version="version").filter("id = 3").collect()] == [3]


def test_changelog_compares_with_the_newest_version(spark):
    root = new_path(spark, "resent")
    for v, number in (("a", 1), ("b", 2), ("b", None), ("a", 3)):
        assert S.commit(spark.createDataFrame([(1, v)], "id int, v string"), root, "changelog", ["id"]) == number


def test_two_writers_of_one_number(spark):
    root = new_path(spark, "race")
    assert S.commit(spark.createDataFrame([(1,)], "id int"), root) == 1
    assert S._claim(spark, root, 2) == 2  # another writer, still at work
    assert S.commit(spark.createDataFrame([(2,)], "id int"), root, "always_append") == 3
    assert sorted(r.id for r in S.read_dataset(spark, root).collect()) == [1, 2]


def test_remove_flag_polarity_and_missing_flag(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", None)], "id int, v string, keep string")
    new = spark.createDataFrame([(1, "A", "yes"), (2, "B", "off"), (3, "C", None)], "id int, v string, keep string")
    out = S.snapshot_replace_and_remove(old, new, ["id"], "keep")
    assert {(r.id, r.v) for r in out.collect()} == {(1, "A"), (3, "c")}


def test_changelog_keeps_input_duplicates(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None)], "id int, v string")
    assert S.changelog(old, new, ["id"]).count() == 3


def test_watermark_boundary(spark):
    rows = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, None)], "id int, ts int")
    state = I.watermark_state(rows.filter("id = 1"), "ts")
    assert {r.id for r in I.watermark_filter(rows, "ts", 10, state).collect()} == {2, 3}
    assert {r.id for r in I.watermark_filter(rows, "ts", 10).collect()} == {1, 2, 3}
    moved = I.watermark_state(rows, "ts", state)
    assert [r.watermark for r in moved.collect()] == [11]


def test_row_hash_ignores_column_order(spark):
    from loomframe.operators.transforms import row_hash

    df = spark.createDataFrame([(1, "x")], "a int, b string")
    one, two = df.select(row_hash(["a", "b"])).first()[0], df.select(row_hash(["b", "a"])).first()[0]
    assert one == two


def test_output_kind_checks(spark, tmp_path):
    df = spark.createDataFrame([("u",)], "uri string")
    with pytest.raises(ValueError):
        S.write_media(df, str(tmp_path / "m"), "uri", "hologram")
    with pytest.raises(ValueError):
        S.write_geotemporal(df, str(tmp_path / "g"), "t", "geom")
    with pytest.raises(ValueError):
        S.resolve("snapshot_replace_and_remove", None, df)


def test_default_mode():
    assert S.default_mode() == "overwrite"
    assert S.default_mode(streaming=True) == S.default_mode(incremental=True) == "append"


def test_shared_folder_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert spark.range(3).select(F.col("id")).count() == 3
