"""Time-series reads over a long table (keys…, time, value)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.where import DURATIONS
from loomframe.operators.skew import running_before
from loomframe.operators.windows import neighbours

UNITS = {"MILLISECONDS": timedelta(milliseconds=1), **DURATIONS}


def first_point(points: DataFrame, keys: Sequence[str], time: str, position: str, value: str) -> DataFrame:
    """Earliest point per series; equal times go to the lower position."""
    known = points.filter(F.col(time).isNotNull())
    pick = F.min_by(F.struct(time, value), F.struct(time, position)).alias("_p")
    return known.groupBy(*keys).agg(pick).select(*keys, "_p.*")


def last_point(points: DataFrame, keys: Sequence[str], time: str, position: str, value: str) -> DataFrame:
    """Latest point per series; equal times go to the higher position."""
    known = points.filter(F.col(time).isNotNull())
    pick = F.max_by(F.struct(time, value), F.struct(time, position)).alias("_p")
    return known.groupBy(*keys).agg(pick).select(*keys, "_p.*")


def between(points: DataFrame, time: str, start: Any = None, end: Any = None) -> DataFrame:
    """Points from ``start`` to ``end``, both included and each optional."""
    if start is not None:
        points = points.filter(F.col(time) >= F.lit(start))
    if end is not None:
        points = points.filter(F.col(time) <= F.lit(end))
    return points


def relative(
    points: DataFrame, time: str, now: datetime, start: tuple[int, str], end: tuple[int, str] = (0, "DAYS"), when: str = "BEFORE"
) -> DataFrame:
    """Points in a window before or after ``now``; a month is 30 days, a year 365."""
    near, far = end[0] * UNITS[end[1]], start[0] * UNITS[start[1]]
    low, high = (now - far, now - near) if when == "BEFORE" else (now + near, now + far)
    return between(points, time, F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def resample(points: DataFrame, keys: Sequence[str], time: str, position: str, value: str, step: timedelta) -> DataFrame:
    """(keys, tick, previous, next, linear): every series at each multiple of ``step`` between its first and last point.

    ``previous`` is the last value known at the tick, ``next`` the next one, ``linear`` lies on the line
    between them; a tick that meets a point takes its value. Of points at one time the one of the highest ``position`` counts.
    Each point makes the ticks up to its successor, found by a scan that cuts busy series, so there is
    no spine to join with. Points without time or value are left out.
    """
    known = points.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).select(*keys, time, position, value)
    timed = known.withColumn("_at", _micros(F.col(time)))
    paired = neighbours(timed, keys, [time, position], {"_until": "lead(_at)", "_then": f"lead({value})"}, before=0, after=1)
    width = int(step / timedelta(microseconds=1))
    first, at = F.expr(f"_at + pmod(-_at, {width}L)"), F.col("_at")
    last = F.coalesce(F.col("_until") - 1, at)
    ticks = F.when(first <= last, F.sequence(first, last, F.lit(width).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    spread = paired.select("*", F.explode(ticks).alias("_tick"))
    now, here, then = F.col("_tick"), F.col(value), F.col("_then")
    met = now == at
    line = here + (then - here) * ((now - at) / (F.col("_until") - at))
    return spread.select(
        *keys,
        F.timestamp_micros(now).cast("timestamp_ntz").alias("tick"),
        here.alias("previous"),
        F.when(met, here).otherwise(then).alias("next"),
        F.when(met, here).otherwise(line).alias("linear"),
    )


def sessions(events: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], gap: timedelta, name: str = "session") -> DataFrame:
    """The events with the number (from 1) of their session: a new one starts more than ``gap`` after the event before.

    The open session is carried over the cuts of a busy key: first its latest time, then the number of
    sessions started so far. Events without a time belong to none.
    """
    order, late = [time, *tie], F.col(time) > F.col("_seen") + F.make_dt_interval(secs=F.lit(gap.total_seconds()).cast("decimal(18,6)"))
    seen = running_before(events.filter(F.col(time).isNotNull()), keys, order, F.col(time), "max", "_seen", measure=events)
    started = seen.withColumn("_new", F.when(late | F.col("_seen").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")).drop("_seen")
    return running_before(started, keys, order, F.col("_new"), "sum", name, include_current=True, measure=events).drop("_new")


def session_summary(numbered: DataFrame, keys: Sequence[str], time: str, name: str = "session") -> DataFrame:
    """First and last time and number of events per session."""
    return numbered.groupBy(*keys, name).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count(F.lit(1)).alias("events"))


def window_counts(events: DataFrame, keys: Sequence[str], time: str, width: str, slide: str | None = None, value: str | None = None) -> DataFrame:
    """Events, and total of ``value``, per key and window (``starts``, ``ends``)."""
    made = [F.count(F.lit(1)).alias("events"), *([F.sum(value).alias("total")] if value else [])]
    window = F.window(time, width, slide) if slide else F.window(time, width)
    found = events.groupBy(*keys, window.alias("window")).agg(*made)
    return found.select(*keys, F.col("window.start").alias("starts"), F.col("window.end").alias("ends"), *[m for m in found.columns if m in ("events", "total")])
