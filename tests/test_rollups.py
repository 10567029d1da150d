"""Percentiles, grouping sets and sketches against plain Python; commits against sets of rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import rollups, skew
from loomframe.session import new_path
from loomframe.sources import sinks as S


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.5, 0.951, 1.0])
@pytest.mark.parametrize("task_rows", [2_000_000, 40])
def test_percentiles(spark, monkeypatch, fraction, task_rows):
    monkeypatch.setattr(skew.running_before, "__defaults__", (task_rows, *skew.running_before.__defaults__[1:]))
    draw = random.Random(4)
    groups = {
        "hot": [draw.gauss(0, 1) for _ in range(5000)], "ties": [1.0] * 2500 + [2.0] * 2500, "far": [1e300, -1e300, *range(500)], "one": [3.5], "two": [1.0, 2.0],
        None: [draw.choice([1.0, 1.5, 9.0]) for _ in range(700)],
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("one", None), ("none", None)]
    found = rollups.percentile_exact(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", fraction, "p").collect()
    assert {r.k: pytest.approx(r.p, rel=1e-12) for r in found} == {k: np.percentile(v, 100 * fraction) for k, v in groups.items()}


def test_percentile_without_keys_and_rows(spark):
    df = spark.range(1001).select(F.col("id").alias("v"))
    assert rollups.percentile_exact(df, [], "v", 0.5, "p").first().p == 500
    assert rollups.percentile_exact(df.limit(0), ["v"], "v", 0.5, "p").count() == 0


def test_lattice_equals_spark(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None]), draw.choice([1, 2]), draw.choice([True, False, None]), draw.choice([None, 1.5, 2.0])) for _ in range(300)]
    df = spark.createDataFrame(rows, "x string, y int, z boolean, v double")
    metrics = {"n": ("count", None), "known": ("count", "v"), "total": ("sum", "v"), "least": ("min", "v"), "mean": ("avg", "v")}
    made = [F.count(F.lit(1)).alias("n"), F.count("v").alias("known"), F.sum("v").alias("total"), F.min("v").alias("least"), F.avg("v").alias("mean")]
    of = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    keys = ["x", "y", "z"]
    expected = df.cube(*keys).agg(F.grouping_id().alias("grouping_id"), *made)
    assert of(rollups.grouping_sets(df, rollups.cube(keys), metrics)) == of(expected)
    expected = df.rollup(*keys).agg(F.grouping_id().alias("grouping_id"), *made)
    assert of(rollups.grouping_sets(df, rollups.rollup(keys), metrics)) == of(expected)
    total = rollups.grouping_sets(df.limit(0), [["x"], []], {"n": ("count", None), "mean": ("avg", "v")}).collect()
    assert [tuple(r) for r in total] == [(None, 1, 0, None)]


def test_merged_sketches_equal_those_of_all_rows(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("g"), (F.col("id") % 50).alias("f"), "id")
    merged = rollups.merge_sketches(rollups.sketch(df, ["g", "f"], ["id"], ["id"]), ["g"]).select(
        "g", rollups.distinct_estimate("distinct_id").alias("d"), rollups.quantile_estimate("quantiles_id", 0.5).alias("q")
    )
    for r in merged.collect():
        assert abs(r.d - 20_000 / 7) < 0.05 * 20_000 / 7 and abs(r.q - 10_000) < 800


def test_row_and_file_changes(spark):
    root, schema = new_path(spark, "changes"), "id int, v string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    S.commit(rows((1, "a"), (2, "b"), (2, "b"), (3, None)), root)
    S.commit(rows((4, "d")), root, "always_append")
    of = lambda since, until=None: sorted((tuple(r) for r in S.read_changes(spark, root, since, until).collect()), key=str)
    assert of(1) == [(4, "d", "added")] and S.read_changes(spark, root, 2) is None
    S.commit(rows((1, "a"), (2, "b"), (3, None), (4, "D"), (4, "D")), root)
    assert of(2) == sorted([(2, "b", "removed"), (4, "d", "removed"), (4, "D", "added"), (4, "D", "added")], key=str)
    assert of(1, 2) == [(4, "d", "added")]
    files = S.file_changes(spark, root, 2).collect()
    assert {(r.version, r.change) for r in files} == {(1, "removed"), (2, "removed"), (3, "added")}
    assert {r.version for r in S.manifest(spark, root, 2).collect()} == {1, 2} and S.manifest(spark, root + "-none").count() == 0


def test_writers_that_share_a_base_lose_no_row(spark, monkeypatch):
    root, schema, claim = new_path(spark, "shared"), "id int, v string", S._claim
    S.commit(spark.createDataFrame([(1, "x"), (2, "x")], schema), root)

    def later(*args):
        monkeypatch.setattr(S, "_claim", claim)
        S.commit(spark.createDataFrame([(1, "A")], schema), root, "snapshot_replace", ["id"])  # the other writer is first
        return claim(*args)

    monkeypatch.setattr(S, "_claim", later)
    assert S.commit(spark.createDataFrame([(2, "B")], schema), root, "snapshot_replace", ["id"]) == 3
    assert {tuple(r) for r in S.read_dataset(spark, root).collect()} == {(1, "A"), (2, "B")}


def test_a_writer_that_never_ends_is_named(spark):
    root = new_path(spark, "stuck")
    S.commit(spark.createDataFrame([(1, "x")], "id int, v string"), root)
    S._claim(spark, root, 2)
    with pytest.raises(TimeoutError, match="_taken"):
        S.commit(spark.createDataFrame([(1, "y")], "id int, v string"), root, "snapshot_replace", ["id"], wait=0.5)
