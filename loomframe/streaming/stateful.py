"""Idempotent handling of an event stream with keyed state, and windows that drop late data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARK = "_mark"  # the column that takes the watermark


class EventOrder(StatefulProcessor):
    """Per aggregate: the greatest sequence so far, and the ids seen, forgotten ``keep_ms`` after the aggregate's last event.

    Rows of one micro-batch are handled by arrival, then sequence. Every call on the state is a message to Spark's side, so
    what most aggregates need is one value, read and written once a micro-batch: the sequence, when to forget, and the ids.
    An aggregate with more ids than FEW, and than SHARE times its rows of the micro-batch, or than MOST in any case, moves
    them to a map, where each id of a row is looked up alone. The timer is not moved with each event: when it fires too early, it is set again.
    """

    FEW, SHARE, MOST = 1000, 32, 100_000

    def __init__(self, columns: Sequence[str], event_id: str, sequence: str, arrival: str, keep_ms: int):
        """``columns`` of the rows that come out, the status last; ``arrival`` holds microseconds."""
        self.made = Row(*columns)
        self.event_id, self.sequence, self.arrival, self.keep_ms = event_id, sequence, arrival, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.order = handle.getValueState("order", "last bigint, forget bigint, moved boolean, ids array<string>")
        self.seen = handle.getMapState("seen", "event_id string", "arrival bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = sorted(rows, key=lambda r: (r[self.arrival], r[self.sequence]))
        last, forget, moved, ids = self.order.get() or (None, None, False, [])
        known = dict.fromkeys(ids)
        fresh: dict[str, int] = {}
        for row in batch:
            name, number = str(row[self.event_id]), row[self.sequence]
            if name in known or name in fresh or moved and self.seen.containsKey((name,)):
                state = "duplicate"
                known[name] = None
            else:
                fresh[name] = row[self.arrival] // 1000
                state = "stale" if last is not None and number <= last else "processed"
                last = number if state == "processed" else last
            yield self.made(*row[: len(self.made) - 1], state)
        timed, forget = forget is not None, batch[-1][self.arrival] // 1000 + self.keep_ms
        if not timed:
            self.handle.registerTimer(forget)
        ids = [*ids, *fresh]
        if len(ids) > min(self.MOST, max(self.FEW, self.SHARE * len(batch))):
            for name in ids:
                self.seen.updateValue((name,), (fresh.get(name, forget - self.keep_ms),))
            moved, ids = True, []
        self.order.update((last, forget, moved, ids))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The ids go; the sequence stays, so an old event is still known to be stale."""
        last, forget, moved, _ = self.order.get()
        if forget > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(forget)
            return iter(())
        if moved:
            self.seen.clear()
        self.order.update((last, None, False, []))
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for queries started inside."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def classify_stream(
    stream: DataFrame, event_id: str, aggregate: str, sequence: str, arrival: str, delay: str = "1 hour", keep_ms: int = 7 * 86_400_000, name: str = "status"
) -> DataFrame:
    """The stream with ``processed``, ``duplicate`` or ``stale`` per event, as :func:`streams.classify_events` gives for a batch.

    An event id belongs to one aggregate. ``arrival`` is a timestamp and takes the watermark: rows more than
    ``delay`` behind it are dropped and counted by :func:`late_rows`, ids are forgotten ``keep_ms`` after the last event of
    their aggregate. Rows without id, sequence or arrival must be filtered before. Checkpoints made before the state
    became one value per aggregate cannot be gone on with.
    """
    # Times go through the workers as numbers, so no time zone matters; the watermark's own column goes beside them.
    times = {f.name for f in stream.schema if isinstance(f.dataType, T.TimestampType)}
    taken = [(F.unix_micros(c) if c in times else F.col(c)).alias(c) for c in stream.columns]
    marked = stream.withColumn(MARK, F.col(arrival)).withWatermark(MARK, delay).select(*taken, MARK)
    schema = marked.drop(MARK).schema.add(name, T.StringType())
    found = marked.groupBy(aggregate).transformWithState(EventOrder(schema.names, event_id, sequence, arrival, keep_ms), schema, "Append", "EventTime")
    return found.select(*[(F.timestamp_micros(c) if c in times else F.col(c)).alias(c) for c in stream.columns], name)


def run_once(found: DataFrame, path: str, checkpoint: str, timeout: int = 600) -> StreamingQuery:
    """Handle all that has come since the last run with this checkpoint, append it to ``path`` and stop."""
    with keyed_state(found.sparkSession):
        query = found.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if not query.awaitTermination(timeout):
            query.stop()
            raise TimeoutError(f"the stream did not finish within {timeout} s")
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows that a finished query dropped because they came behind the watermark."""
    return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])


def session_counts(events: DataFrame, keys: Sequence[str], time: str, gap: str) -> DataFrame:
    """(keys, started, ended, events) per session, a new one starting ``gap`` or more after the event before; ``ended`` is its last event.

    On a stream with a watermark each session comes out once, when nothing can join it any more; rows
    behind the watermark are dropped and counted. On a batch, sessions of any busy key need :func:`timeseries.sessions`.
    """
    found = events.groupBy(*keys, F.session_window(time, gap).alias("window"))
    counts = found.agg(F.max(time).alias("ended"), F.count(F.lit(1)).alias("events"))
    return counts.select(*keys, F.col("window.start").alias("started"), "ended", "events")
