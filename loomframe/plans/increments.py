"""Queries for incremental loads, deltas and streams."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from loomframe.plans.registry import query, table
from loomframe.session import new_path
from loomframe.sources import incremental as I
from loomframe.streaming import streams as Z

_DAY = "TIMESTAMP '1999-06-15'"
_AT = datetime.datetime(1999, 6, 15)


@query("watermark_inclusive", f"SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate >= {_DAY}")
def watermark_inclusive(spark, d):
    return I.watermark_filter(table(spark, d, "orders"), "o_orderdate", F.lit(_AT).cast("timestamp_ntz")).select("o_orderkey", "o_orderpriority")


@query(
    "watermark_seen_rows",
    f"SELECT o_orderkey FROM orders WHERE o_orderdate > {_DAY} OR (o_orderdate = {_DAY} AND o_orderpriority >= '3')",
)
def watermark_seen_rows(spark, d):
    orders = table(spark, d, "orders")
    at = F.lit(_AT).cast("timestamp_ntz")
    loaded = orders.filter((F.col("o_orderdate") <= at) & (F.col("o_orderpriority") < "3"))
    state = I.watermark_state(loaded.filter(F.col("o_orderdate") == at), "o_orderdate")
    return I.watermark_filter(orders, "o_orderdate", at, state).select("o_orderkey")


@query(
    "watermark_state",
    """
    SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS watermark, (SELECT count(*) FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)) AS keys
    FROM orders
    """,
)
def watermark_state(spark, d):
    orders = table(spark, d, "orders")
    early = I.watermark_state(orders.filter("o_orderpriority < '3'"), "o_orderdate")
    state = I.watermark_state(orders.filter("o_orderpriority >= '3'"), "o_orderdate", early)
    return state.groupBy(F.date_format("watermark", "yyyy-MM-dd").alias("watermark")).agg(F.count(F.lit(1)).alias("keys"))


@query(
    "watermark_delta",
    "SELECT event_id FROM events WHERE event_type <> 'error' AND ts > TIMESTAMP '2024-01-10 00:00:00'",
)
def watermark_delta(spark, d):
    events = table(spark, d, "events").select("event_id", F.expr("CASE WHEN event_type <> 'error' THEN ts END").alias("ts"))
    return I.watermark_delta(events, "ts", F.lit(datetime.datetime(2024, 1, 10)).cast("timestamp_ntz")).select("event_id")


_OLD = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'"
_NEW = (
    "SELECT c_custkey, c_name, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer "
    "WHERE c_mktsegment <> 'MACHINERY'"
)


def _snapshots(spark, d):
    customer = table(spark, d, "customer")
    old = customer.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name", "c_acctbal")
    new = customer.filter("c_mktsegment <> 'MACHINERY'").selectExpr(
        "c_custkey", "c_name", "CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal END AS c_acctbal"
    )
    return old, new


_DELTA = f"""
    WITH o AS ({_OLD}), n AS ({_NEW}), delta AS (
    SELECT n.*, 'added' AS change_type FROM n ANTI JOIN o USING (c_custkey)
    UNION ALL SELECT n.*, 'modified' FROM n JOIN o USING (c_custkey) WHERE n.c_acctbal IS DISTINCT FROM o.c_acctbal
    UNION ALL SELECT o.*, 'deleted' FROM o ANTI JOIN n USING (c_custkey))
"""


@query("snapshot_delta", f"{_DELTA} SELECT * FROM delta")
def snapshot_delta(spark, d):
    return I.snapshot_delta(*_snapshots(spark, d), ["c_custkey"])


@query(
    "run_changelog",
    f"{_DELTA} SELECT count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'modified') AS modified, "
    "count(*) FILTER (change_type = 'deleted') AS deleted, count(*) AS total FROM delta",
)
def run_changelog(spark, d):
    return I.run_changelog(I.snapshot_delta(*_snapshots(spark, d), ["c_custkey"]))


# What a run that starts from day 10 finds of each type's share of the events.
_RUN = (
    "CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type, ts "
    "FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'"
)


@query(
    "run_changelog_watermarks",
    "SELECT count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'modified') AS modified, "
    "count(*) FILTER (change_type = 'deleted') AS deleted, count(*) AS total, '2024-01-10 00:00:00' AS watermark_before, "
    f"strftime(greatest(max(ts), TIMESTAMP '2024-01-10 00:00:00'), '%Y-%m-%d %H:%M:%S') AS watermark_after FROM (SELECT {_RUN})",
)
def run_changelog_watermarks(spark, d):
    start = datetime.datetime(2024, 1, 10)
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END")
    delta = I.watermark_delta(table(spark, d, "events"), "ts", F.lit(start).cast("timestamp_ntz")).withColumn("change_type", kind)
    run = I.run_changelog(delta, watermark="ts", before=start)
    marks = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("watermark_before", "watermark_after")}
    return run.withColumns(marks)


@query("apply_changes", _NEW)
def apply_changes(spark, d):
    old, new = _snapshots(spark, d)
    return I.apply_changes(old, I.snapshot_delta(old, new, ["c_custkey"]), ["c_custkey"])


@query("stale_rows", f"SELECT c_custkey FROM ({_OLD}) ANTI JOIN ({_NEW}) USING (c_custkey)")
def stale_rows(spark, d):
    old, new = _snapshots(spark, d)
    return I.stale_rows(old, new, ["c_custkey"]).select("c_custkey")


@query(
    "file_delta",
    """
    SELECT o_orderkey, o_totalprice, 'upserted' AS change_type FROM orders WHERE o_orderstatus IN ('O', 'P')
    UNION ALL SELECT o_orderkey, o_totalprice, 'deleted' FROM orders WHERE o_orderstatus = 'F'
    """,
)
def file_delta(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    added = orders.filter("o_orderstatus IN ('O', 'P')").drop("o_orderstatus")
    removed = orders.filter("o_orderstatus IN ('F', 'P')").drop("o_orderstatus")
    return I.file_delta(added, removed, ["o_orderkey"])


# Deliveries: every event arrives once by its id; errors arrive a second time much later.
_ARRIVALS = """
    SELECT event_id, user_id, (event_id * 7919) % 10007 AS seq, event_id * 2 AS arrival FROM events
    UNION ALL SELECT event_id, user_id, (event_id * 7919) % 10007, event_id * 2 + 1001 FROM events WHERE event_type = 'error'
"""


def _arrivals(spark, d):
    events = table(spark, d, "events")
    columns = ["event_id", "user_id", "(event_id * 7919) % 10007 AS seq"]
    once = events.selectExpr(*columns, "event_id * 2 AS arrival")
    return once.unionByName(events.filter("event_type = 'error'").selectExpr(*columns, "event_id * 2 + 1001 AS arrival"))


@query(
    "classify_events",
    f"""
    WITH a AS ({_ARRIVALS}), m AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) AS nth FROM a),
    p AS (SELECT *, max(seq) OVER (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m WHERE nth = 1)
    SELECT event_id, user_id, seq, arrival, CASE WHEN seq <= seen THEN 'stale' ELSE 'processed' END AS status FROM p
    UNION ALL SELECT event_id, user_id, seq, arrival, 'duplicate' FROM m WHERE nth > 1
    """,
)
def classify_events(spark, d):
    return Z.classify_events(_arrivals(spark, d), "event_id", "user_id", "seq", "arrival")


@query(
    "versioned_upsert",
    """
    WITH b AS (SELECT user_id, event_id, value, 0 AS side FROM events WHERE event_type IN ('view', 'click')
      UNION ALL SELECT user_id, event_id, value, 1 FROM events WHERE event_type IN ('click', 'purchase'))
    SELECT user_id, event_id, value FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, side DESC) = 1
    """,
)
def versioned_upsert(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    stored = events.filter("event_type IN ('view', 'click')").drop("event_type")
    incoming = events.filter("event_type IN ('click', 'purchase')").drop("event_type")
    return Z.versioned_upsert(stored, incoming, ["user_id"], "event_id")


@query(
    "stream_lag",
    """
    WITH o AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS cur, count(*) AS fin FROM events GROUP BY user_id)
    SELECT user_id, cur, fin, greatest(fin - cur, 0) AS lag, round(CASE WHEN fin > 0 THEN cur / fin * 100 ELSE 100 END, 6) AS progress FROM o
    """,
)
def stream_lag(spark, d):
    offsets = table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") != "error").alias("cur"), F.count(F.lit(1)).alias("fin")
    )
    return Z.stream_lag(offsets, "cur", "fin").withColumn("progress", F.round("progress", 6))


@query(
    "stream_lag_summary",
    """
    WITH o AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS lag FROM events GROUP BY user_id)
    SELECT CAST(sum(lag) AS BIGINT) AS total_lag, max(lag) AS max_lag, min(lag) AS min_lag, round(avg(lag), 6) AS mean_lag,
      avg(lag) < 1000 AND max(lag) < 5000 AS healthy FROM o
    """,
)
def stream_lag_summary(spark, d):
    offsets = table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") != "error").alias("cur"), F.count(F.lit(1)).alias("fin")
    )
    return Z.lag_summary(offsets, "cur", "fin").withColumn("mean_lag", F.round("mean_lag", 6))


def _event_stream(spark, d):
    """The events table as a file stream, with an event-time column that takes a watermark."""
    schema = table(spark, d, "events").schema
    stream = Z.read_stream(spark, "parquet", schema, {"pathGlobFilter": "events.parquet"}, d)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_landing", "SELECT event_id, user_id, event_type FROM events")
def stream_landing(spark, d):
    path, checkpoint = new_path(spark, "landed"), new_path(spark, "landed-checkpoint")
    # Two runs: the second finds nothing new, so every event lands once.
    for _ in range(2):
        Z.finish(Z.land(_event_stream(spark, d).select("event_id", "user_id", "event_type"), path, checkpoint), 600)
    return spark.read.parquet(path)


@query("stream_drop_repeats", "SELECT event_id, user_id FROM events")
def stream_drop_repeats(spark, d):
    stream = _event_stream(spark, d)
    twice = stream.withColumn("event_id", F.explode(F.array("event_id", "event_id")))
    path = new_path(spark, "distinct")
    unique = Z.drop_repeats(twice, "event_id", "ts").select("event_id", "user_id")
    Z.finish(Z.land(unique, path, new_path(spark, "distinct-checkpoint")), 600)
    return spark.read.parquet(path)


@query(
    "stream_upsert",
    "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
)
def stream_upsert(spark, d):
    root = new_path(spark, "upserts")
    stream = _event_stream(spark, d).select("user_id", "event_id", "event_type")
    Z.finish(Z.upsert_log(stream, root, ["user_id"], "event_id", new_path(spark, "upserts-checkpoint")), 600)
    return Z.current_state(spark, root, stream.schema, ["user_id"], "event_id")


@query(
    "stream_stream_join",
    """
    SELECT c.event_id, v.event_id AS right_event_id FROM events c JOIN events v ON c.user_id = v.user_id
      AND v.ts BETWEEN c.ts - INTERVAL 2 HOUR AND c.ts WHERE c.event_type = 'click' AND v.event_type = 'view'
    """,
)
def stream_stream_join(spark, d):
    stream = _event_stream(spark, d).select("user_id", "event_id", "ts", "event_type")
    clicks = stream.filter("event_type = 'click'").drop("event_type")
    views = stream.filter("event_type = 'view'").drop("event_type")
    joined = Z.stream_join(clicks, views, ["user_id"], "ts", "ts", "2 hours", delay="2 hours")
    path = new_path(spark, "joined")
    Z.finish(Z.land(joined.select("event_id", "right_event_id"), path, new_path(spark, "joined-checkpoint")), 600)
    return spark.read.parquet(path)
