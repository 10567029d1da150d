"""Queries over event time: resampled series, sessions, windows, and streams with state."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from loomframe.operators import timeseries as TS
from loomframe.plans.increments import _ARRIVALS, _arrivals, _event_stream
from loomframe.plans.registry import query, table
from loomframe.session import new_path
from loomframe.streaming import stateful as K

_STEP = 6 * 3600 * 1_000_000


@query(
    "series_resample",
    f"""
    WITH p AS (SELECT user_id, epoch_us(ts) AS t0, value, lead(epoch_us(ts)) OVER w AS until, lead(value) OVER w AS then_value
      FROM events WHERE ts IS NOT NULL AND value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    t AS (SELECT *, unnest(range(t0 + (({_STEP} - t0 % {_STEP}) % {_STEP}), coalesce(until, t0 + 1), {_STEP})) AS tick FROM p)
    SELECT user_id, make_timestamp(tick) AS tick, value AS previous, CASE WHEN tick = t0 THEN value ELSE then_value END AS next,
      round(CASE WHEN tick = t0 THEN value ELSE value + (then_value - value) * ((tick - t0) / (until - t0)) END, 6) AS linear FROM t
    """,
)
def series_resample(spark, d):
    points = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return TS.resample(points, ["user_id"], "ts", "event_id", "value", timedelta(hours=6)).withColumn("linear", F.round("linear", 6))


_SESSIONS = """
    g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g),
    t AS (SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY ALL)
"""


def _numbered(spark, d):
    return TS.sessions(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", ["event_id"], timedelta(hours=6))


@query("session_numbers", f"WITH {_SESSIONS} SELECT user_id, event_id, session FROM s")
def session_numbers(spark, d):
    return _numbered(spark, d).select("user_id", "event_id", "session")


@query("session_windows", f"WITH {_SESSIONS} SELECT * FROM t")
def session_windows(spark, d):
    return TS.session_summary(_numbered(spark, d), ["user_id"], "ts")


@query(
    "tumbling_windows",
    "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS starts, starts + INTERVAL 6 HOUR AS ends, count(*) AS events, "
    "round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def tumbling_windows(spark, d):
    events = table(spark, d, "events").select("event_type", "ts", "value")
    return TS.window_counts(events, ["event_type"], "ts", "6 hours", value="value").withColumn("total", F.round("total", 4))


@query(
    "sliding_windows",
    """
    WITH w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS starts FROM events, range(4) r(k))
    SELECT event_type, starts, starts + INTERVAL 24 HOUR AS ends, count(*) AS events FROM w GROUP BY ALL
    """,
)
def sliding_windows(spark, d):
    return TS.window_counts(table(spark, d, "events").select("event_type", "ts"), ["event_type"], "ts", "24 hours", "6 hours")


@query(
    "stream_sessions",
    f"""
    WITH {_SESSIONS} SELECT user_id, started, ended, events FROM t
    WHERE ended + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)
    """,
)
def stream_sessions(spark, d):
    """The sessions that are over for sure; the others wait in the state."""
    stream = _event_stream(spark, d).select("user_id", "ts").withWatermark("ts", "1 hour")
    path = new_path(spark, "sessions")
    K.run_once(K.session_counts(stream, ["user_id"], "ts", "6 hours"), path, new_path(spark, "sessions-checkpoint"))
    found = spark.read.parquet(path)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query(
    "stream_classify",
    f"""
    WITH a AS ({_ARRIVALS}), m AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) AS nth FROM a),
    p AS (SELECT *, max(seq) OVER (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m WHERE nth = 1)
    SELECT event_id, user_id, seq, arrival, CASE WHEN seq <= seen THEN 'stale' ELSE 'processed' END AS status FROM p
    UNION ALL SELECT event_id, user_id, seq, arrival, 'duplicate' FROM m WHERE nth > 1
    """,
)
def stream_classify(spark, d):
    """All deliveries in three landings by time of arrival; the stream stops after each and goes on from its checkpoint."""
    arrivals = _arrivals(spark, d).withColumn("at", F.timestamp_seconds(F.col("arrival") + 86_400))  # behind the first watermark, 1970
    last = arrivals.agg(F.max("arrival")).first()[0] or 0
    landing, path, checkpoint = new_path(spark, "arrivals"), new_path(spark, "classified"), new_path(spark, "classified-checkpoint")
    part = F.least(F.floor(F.col("arrival") * 3 / (last + 1)), F.lit(2))
    for k in range(3):
        arrivals.filter(part == k).write.parquet(f"{landing}/landed={k}")
        stream = spark.readStream.schema(arrivals.schema).parquet(f"{landing}/*")
        K.run_once(K.classify_stream(stream, "event_id", "user_id", "seq", "at"), path, checkpoint)
    return spark.read.parquet(path).drop("at")
