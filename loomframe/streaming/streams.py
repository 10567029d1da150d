"""Structured Streaming: landing, idempotent handling, upserts, joins and lag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from loomframe.operators.joins import _right_names
from loomframe.operators.skew import earliest, latest, row_numbers, running_before

# Lag limits of a healthy stream, in messages.
HEALTHY_MEAN_LAG, HEALTHY_MAX_LAG = 1000, 5000


def read_stream(
    spark: SparkSession, fmt: str, schema: StructType | str | None = None, options: Mapping[str, str] | None = None, path: str | None = None
) -> DataFrame:
    """A streaming source: files by default, Kafka where its connector is on the classpath."""
    reader = spark.readStream.format(fmt).options(**dict(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def land(stream: DataFrame, path: str, checkpoint: str, once: bool = False, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append everything available now to Parquet; the checkpoint makes a rerun add only news."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(once=True) if once else writer.trigger(availableNow=True)
    return (writer.partitionBy(*partition_by) if partition_by else writer).start()


def finish(query: StreamingQuery, timeout: int | None = None) -> None:
    """Wait for an available-now query; stop and fail when the time is up."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not finish within {timeout} s")


def classify_events(
    df: DataFrame, event_id: str, aggregate: str, sequence: str, arrival: str, name: str = "status"
) -> DataFrame:
    """``processed``, ``duplicate`` or ``stale`` per arriving event, for a batch.

    An event id counts once: its first arrival, of several at one time the one with the least
    sequence. An event is stale when its sequence does not exceed every earlier one of the
    aggregate. Busy ids and aggregates are cut along the arrival axis.
    """
    numbered = row_numbers(df, [event_id], [arrival, sequence], "_nth")
    once = numbered.filter("_nth = 1").drop("_nth")
    seen = running_before(once, [aggregate], [arrival, event_id], F.col(sequence), "max", "_seen", measure=df)
    stale = F.coalesce(F.col(sequence) <= F.col("_seen"), F.lit(False))
    handled = seen.withColumn(name, F.when(stale, F.lit("stale")).otherwise(F.lit("processed"))).drop("_seen")
    repeats = numbered.filter("_nth > 1").drop("_nth").withColumn(name, F.lit("duplicate"))
    return handled.unionByName(repeats)


def drop_repeats(stream: DataFrame, event_id: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([event_id])


def upsert_log(stream: DataFrame, root: str, keys: Sequence[str], sequence: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch, reduced to the newest row per key, to its own folder.

    A retried batch overwrites its folder, so every batch counts once. Readers merge with
    :func:`current_state`; :func:`compact` bounds the number of folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest(batch, keys, [sequence])
        newest.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_state(spark: SparkSession, root: str, schema: StructType, keys: Sequence[str], sequence: str) -> DataFrame:
    """Newest row per key: an incoming row wins when its sequence is not below the stored one."""
    log = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(root)
    return latest(log, keys, [sequence, "batch"]).drop("batch")


def compact(spark: SparkSession, root: str, target: str, schema: StructType, keys: Sequence[str], sequence: str) -> None:
    """Write the merged state as one folder of a new log root."""
    current_state(spark, root, schema, keys, sequence).write.mode("overwrite").parquet(f"{target}/batch=0")


def versioned_upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Batch form: incoming rows replace stored ones of the same or a lower sequence."""
    both = stored.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    return latest(both, keys, [sequence, "_side"]).drop("_side")


def stream_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    before: str,
    after: str = "0 seconds",
    delay: str = "1 hour",
    how: str = "inner",
) -> DataFrame:
    """Event-time join: right rows from ``before`` earlier to ``after`` later than the left row.

    Works on streams and on batches. Outer rows of a stream appear once the watermark passes.
    """
    names = {**_right_names(left, right, set()), **{k: f"right_{k}" for k in keys}}
    r = right.withWatermark(right_time, delay).withColumnsRenamed(names)
    l = left.withWatermark(left_time, delay)
    rt, lt = F.col(names.get(right_time, right_time)), F.col(left_time)
    test: Column = (rt >= lt - F.expr(f"INTERVAL {before}")) & (rt <= lt + F.expr(f"INTERVAL {after}"))
    for k in keys:
        test = test & (F.col(k) == F.col(names[k]))
    return l.join(r, test, how)


def stream_lag(offsets: DataFrame, current: str, end: str) -> DataFrame:
    """Per partition lag and progress: the latest offset against the processed one."""
    lag = F.greatest(F.col(end) - F.col(current), F.lit(0))
    progress = F.when(F.col(end) > 0, F.col(current) / F.col(end) * 100).otherwise(F.lit(100.0))
    return offsets.withColumns({"lag": lag, "progress": progress})


def lag_summary(offsets: DataFrame, current: str, end: str) -> DataFrame:
    """Total, greatest, least and mean lag, and whether the stream is healthy."""
    totals = stream_lag(offsets, current, end).agg(
        F.sum("lag").alias("total_lag"), F.max("lag").alias("max_lag"), F.min("lag").alias("min_lag"), F.avg("lag").alias("mean_lag")
    )
    healthy = (F.col("mean_lag") < HEALTHY_MEAN_LAG) & (F.col("max_lag") < HEALTHY_MAX_LAG)
    return totals.withColumn("healthy", healthy)


def first_deliveries(df: DataFrame, event_id: str, arrival: str) -> DataFrame:
    return earliest(df, [event_id], [arrival])
