"""Event time: resampling, sessions over cut keys, and streams with state, late rows and restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomframe.operators import skew
from loomframe.operators import timeseries as TS
from loomframe.streaming import stateful as K

DAY = datetime(2024, 1, 1)


def points_of(spark, rows):
    return spark.createDataFrame([(k, DAY + timedelta(seconds=s) if s is not None else None, p, v) for k, s, p, v in rows], "k string, ts timestamp_ntz, p int, v double")


def test_resample(spark):
    rows = [("a", 0, 0, 1.0), ("a", 25, 1, 6.0), ("a", 25, 2, 5.0), ("a", 40, 3, 8.0), ("b", 3, 0, 2.0), ("c", None, 0, 1.0), ("d", 10, 0, None), ("e", 20, 0, 9.0)]
    found = TS.resample(points_of(spark, rows), ["k"], "ts", "p", "v", timedelta(seconds=10)).collect()
    got = sorted((r.k, int((r.tick - DAY).total_seconds()), r.previous, r.next, r.linear) for r in found)
    line = lambda s: 5.0 + 3.0 * ((s - 25) / 15)
    assert got == [("a", 0, 1.0, 1.0, 1.0), ("a", 10, 1.0, 6.0, 1.0 + 5.0 * 0.4), ("a", 20, 1.0, 6.0, 1.0 + 5.0 * 0.8), ("a", 30, 5.0, 8.0, line(30)), ("a", 40, 8.0, 8.0, 8.0), ("e", 20, 9.0, 9.0, 9.0)]
    assert TS.resample(points_of(spark, []), ["k"], "ts", "p", "v", timedelta(seconds=10)).count() == 0


@pytest.mark.parametrize("task_rows", [2_000_000, 50])
def test_sessions_over_cuts(spark, monkeypatch, task_rows):
    monkeypatch.setattr(skew.running_before, "__defaults__", (task_rows, *skew.running_before.__defaults__[1:]))
    draw, rows, at = random.Random(2), [], 0
    for n in range(600):
        at += draw.choice([1, 5, 10, 11, 60])
        rows.append(("hot" if n % 3 else "b", at, n, 0.0))
    df = points_of(spark, [*rows, ("hot", None, 9999, 0.0)])
    expected, last, number = {}, {}, {}
    for k, s, p, _ in rows:
        if k not in last or s - last[k] > 10:
            number[k] = number.get(k, 0) + 1
        last[k], expected[p] = s, number[k]
    numbered = TS.sessions(df.repartition(5), ["k"], "ts", ["p"], timedelta(seconds=10))
    assert {r.p: r.session for r in numbered.collect()} == expected
    assert TS.session_summary(numbered, ["k"], "ts").agg(F.sum("events")).first()[0] == 600


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).parquet(f"{path}/*")


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema = "k string, ts timestamp"
    late = 0
    for n, seconds in enumerate([[0, 5, 400, 4000], [1, 2, 8000]]):  # the second landing holds two rows behind the watermark
        rows = [("a", DAY + timedelta(seconds=s)) for s in seconds]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
        stream = stream_of(spark, tmp_path / "in", schema).withWatermark("ts", "1 minute")
        late += K.late_rows(K.run_once(K.session_counts(stream, ["k"], "ts", "1 minute"), f"{tmp_path}/out", f"{tmp_path}/cp"))
    found = sorted((r.started, r.events) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [(int((s - DAY).total_seconds()), n) for s, n in found] == [(0, 2), (400, 1), (4000, 1)]
    assert late == 2


def test_events_in_order_across_restarts(spark, tmp_path):
    """State outlives the stream: ids and the greatest sequence are known after a restart; old ids are forgotten by timer."""
    schema = "id string, agg string, seq long, ts timestamp"
    landings = [
        [("e1", "x", 5, 0), ("e1", "x", 5, 1), ("e2", "x", 3, 2), ("f1", "y", 1, 0)],
        [("e2", "x", 3, 10), ("e3", "x", 5, 11), ("e4", "x", 6, 12), ("e4", "x", 6, 12)],
        [("z", "w", 1, 100_000)],
        [("z", "w", 1, 100_001)],
        [("e1", "x", 5, 100_002), ("f2", "y", 2, 100_003)],
    ]
    for n, rows in enumerate(landings):
        df = spark.createDataFrame([(i, a, s, DAY + timedelta(seconds=t)) for i, a, s, t in rows], schema)
        df.coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
        found = K.classify_stream(stream_of(spark, tmp_path / "in", schema), "id", "agg", "seq", "ts", "10 seconds", keep_ms=1000)
        K.run_once(found, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = [(r.ts, r.id, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == sum(map(len, landings))
    status = {(int((t - DAY).total_seconds()), i): s for t, i, s in got if i != "e4"}
    assert status == {
        (0, "e1"): "processed", (1, "e1"): "duplicate", (2, "e2"): "stale", (0, "f1"): "processed", (10, "e2"): "duplicate", (11, "e3"): "stale",
        (100_000, "z"): "processed", (100_001, "z"): "duplicate", (100_002, "e1"): "stale", (100_003, "f2"): "processed",
    }
    assert sorted(s for _, i, s in got if i == "e4") == ["duplicate", "processed"]


class FakeState:
    """State of one aggregate and its timers, counting the calls."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, set(), 0

    def _called(self, found=None):
        self.calls += 1
        return found

    def getValueState(self, *_):
        return type("Value", (), {"get": lambda _: self._called(self.value), "update": lambda _, v: self._called(setattr(self, "value", v))})()

    def getMapState(self, *_):
        methods = {
            "containsKey": lambda _, k: self._called(k in self.map),
            "updateValue": lambda _, k, v: self._called(self.map.__setitem__(k, v)),
            "clear": lambda _: self._called(self.map.clear()),
        }
        return type("Map", (), methods)()

    def registerTimer(self, at):
        self._called(self.timers.add(at))


@pytest.mark.parametrize("few", [3, 1000])
def test_keyed_state_in_few_calls(few):
    """Whether ids stay in the value or move to the map, rows are judged alike; an aggregate of few ids costs three calls a micro-batch."""
    draw, state = random.Random(few), FakeState()
    order = K.EventOrder(["id", "seq", "at", "status"], "id", "seq", "at", keep_ms=1000)
    order.FEW, order.SHARE = few, 0
    order.init(state)
    ids, last, forget, moved, made = set(), None, None, False, Row("id", "seq", "at")
    for n in range(60):
        start = n * 300_000 + (n // 20) * 5_000_000  # microseconds; two long gaps
        rows = [made(draw.choice("abcdefghijkl"), draw.randrange(200), start + draw.randrange(200_000)) for _ in range(draw.randint(1, 4))]
        before, expected = state.calls, []
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            status = "duplicate" if r.id in ids else "stale" if last is not None and r.seq <= last else "processed"
            ids.add(r.id)
            last = r.seq if status == "processed" else last
            expected.append((*r, status))
        forget = max(r.at for r in rows) // 1000 + 1000
        assert [tuple(r) for r in order.handleInputRows(("x",), iter(rows), None)] == expected
        assert few == 3 or state.calls - before <= 3
        moved |= bool(state.map)
        watermark = start // 1000 + (5_500 if n % 20 == 19 else 0)
        clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda _: watermark})()
        while due := {t for t in state.timers if t <= watermark}:
            state.timers -= due
            assert list(order.handleExpiredTimer(("x",), clock, None)) == []
        if forget <= watermark:
            ids = set()
            assert not state.timers and not state.map
        else:
            assert len(state.timers) == 1
    assert moved == (few == 3)


def test_events_of_no_aggregate_are_one_of_their_own(spark, tmp_path):
    rows = [(f"e{n}", None if n % 3 == 0 else f"a{n % 5}", n % 7, DAY + timedelta(seconds=n)) for n in range(60)]
    spark.createDataFrame(rows, "id string, agg string, seq long, ts timestamp").write.parquet(f"{tmp_path}/in/n=0")
    stream = stream_of(spark, tmp_path / "in", "id string, agg string, seq long, ts timestamp")
    K.run_once(K.classify_stream(stream, "id", "agg", "seq", "ts"), f"{tmp_path}/out", f"{tmp_path}/cp")
    last, expected = {}, {}
    for i, agg, seq, _ in rows:
        expected[i] = "stale" if seq <= last.get(agg, -1) else "processed"
        last[agg] = max(seq, last.get(agg, -1))
    assert {r.id: r.status for r in spark.read.parquet(f"{tmp_path}/out").collect()} == expected
