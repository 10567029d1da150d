"""Event and command logs: replay, point in time, projections, schema migration, audit chains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.skew import running_before

# Command types of the log.
CREATES = ("CREATE_INSTANCE", "BULK_CREATE_INSTANCES")
UPDATE, DELETE = "UPDATE_INSTANCE", "DELETE_INSTANCE"


def point_in_time(
    events: DataFrame, sequence: str, time: str, up_to_sequence: int | None = None, up_to_time: Any = None
) -> DataFrame:
    """Events up to a sequence number and/or a time, both inclusive."""
    if up_to_sequence is not None:
        events = events.filter(F.coalesce(F.col(sequence), F.lit(0)) <= up_to_sequence)
    if up_to_time is not None:
        events = events.filter(F.col(time) <= F.lit(up_to_time))
    return events


def history(events: DataFrame, aggregate: str, sequence: str, time: str) -> DataFrame:
    """All events in replay order."""
    return events.sort(aggregate, sequence, time)


def _since_origin(events: DataFrame, aggregate: str, origin: Column) -> DataFrame:
    """Attach the origin position of each aggregate; AQE splits busy aggregates of the join."""
    origins = events.groupBy(aggregate).agg(origin.alias("_origin"))
    return events.join(origins, aggregate)


def replay(
    events: DataFrame,
    aggregate: str,
    kind: str,
    sequence: str,
    time: str,
    event_id: str,
    payload: str,
    fields: Sequence[str],
) -> DataFrame:
    """State of every aggregate after its events, without folding row by row.

    A create resets the data and sets version 1; updates merge the payload map; updates and
    deletes raise the version. Each field is the last value written since the last create.
    """
    place = F.struct(F.col(sequence), F.col(time), F.col(event_id))
    is_create, is_delete = F.col(kind).isin(*CREATES), F.col(kind) == DELETE
    is_update = F.col(kind) == UPDATE
    marked = _since_origin(events.withColumn("_place", place), aggregate, F.max(F.when(is_create, place)))
    live = F.col("_origin").isNull() | (F.col("_place") >= F.col("_origin"))
    born = F.col("_origin").isNotNull()
    writes = live & (is_create | is_update)
    states = marked.groupBy(aggregate).agg(
        F.sum(F.when(live & (is_create | is_update | is_delete), 1).otherwise(0)).cast("bigint").alias("version"),
        F.max(F.when(live & is_create, F.col(time))).alias("created_at"),
        F.max_by(F.when(writes, F.col(time)), F.when(writes, F.col("_place"))).alias("updated_at"),
        F.coalesce(F.max_by(is_delete, F.when(live & (is_create | is_delete), F.col("_place"))), F.lit(False)).alias("deleted"),
        F.max_by(event_id, "_place").alias("last_event_id"),
        F.max_by(sequence, "_place").alias("last_sequence"),
        F.count(F.lit(1)).alias("event_count"),
        *[
            F.max_by(
                F.try_element_at(F.col(payload), F.lit(f)),
                F.when(writes & F.map_contains_key(payload, f), F.col("_place")),
            ).alias(f)
            for f in fields
        ],
    )
    return states


def replay_fields(events: DataFrame, aggregate: str, kind: str, sequence: str, time: str, event_id: str, payload: str) -> DataFrame:
    """(aggregate, field, value) for every field that any payload names, as ``replay`` settles it."""
    place = F.struct(F.col(sequence), F.col(time), F.col(event_id))
    is_create = F.col(kind).isin(*CREATES)
    marked = _since_origin(events.withColumn("_place", place), aggregate, F.max(F.when(is_create, place)))
    live = F.col("_origin").isNull() | (F.col("_place") >= F.col("_origin"))
    written = marked.filter(live & (is_create | (F.col(kind) == UPDATE)))
    long = written.select(aggregate, "_place", F.explode(payload).alias("field", "value"))
    return long.groupBy(aggregate, "field").agg(F.max_by("value", "_place").alias("value"))


def replay_deletes(events: DataFrame, aggregate: str, kind: str, sequence: str, time: str, event_id: str, author: str) -> DataFrame:
    """(aggregate, deleted_at, deleted_by) of every aggregate that is deleted after its events."""
    place = F.struct(F.col(sequence), F.col(time), F.col(event_id))
    ends = events.filter(F.col(kind).isin(*CREATES, DELETE)).groupBy(aggregate)
    last = ends.agg(F.max_by(F.struct(F.col(kind).alias("kind"), F.col(time).alias("at"), F.col(author).alias("by")), place).alias("_last"))
    return last.filter(F.col("_last.kind") == DELETE).select(
        aggregate, F.col("_last.at").alias("deleted_at"), F.col("_last.by").alias("deleted_by")
    )


def state_hash(states: DataFrame, aggregate: str) -> DataFrame:
    """(aggregate, state_hash): equal states give equal hashes."""
    ordered = sorted(c for c in states.columns if c != aggregate)
    return states.select(aggregate, F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256).alias("state_hash"))


def nondeterministic(runs: Sequence[DataFrame], aggregate: str) -> DataFrame:
    """Aggregates whose replays gave different state hashes."""
    hashes = reduce(DataFrame.unionByName, [state_hash(r, aggregate) for r in runs])
    spread = hashes.groupBy(aggregate).agg(F.min("state_hash").alias("a"), F.max("state_hash").alias("b"), F.count(F.lit(1)).alias("n"))
    return spread.filter((F.col("a") != F.col("b")) | (F.col("n") != len(runs))).select(aggregate)


def command_replay(
    commands: DataFrame,
    aggregate: str,
    kind: str,
    order: Sequence[str],
    time: str,
    author: str,
    payload: str,
    fields: Sequence[str],
) -> DataFrame:
    """State with metadata: who created, updated and deleted it and when, and the command count.

    Updates before any create are ignored. A delete without a create leaves an orphan record,
    on which later updates build. Aggregates with neither are left out.
    """
    place = F.struct(*order)
    created = F.col(kind).isin(*CREATES)
    origin = F.coalesce(F.max(F.when(created, place)), F.min(F.when(F.col(kind) == DELETE, place)))
    marked = _since_origin(commands.withColumn("_place", place), aggregate, origin)
    at, live = F.col("_place") == F.col("_origin"), F.col("_place") >= F.col("_origin")
    update, delete = live & (F.col(kind) == UPDATE), live & (F.col(kind) == DELETE)
    writes = live & (created | (F.col(kind) == UPDATE))

    def last(value: str, test: Column) -> Column:
        return F.max_by(F.col(value), F.when(test, F.col("_place")))

    states = marked.filter(F.col("_origin").isNotNull()).groupBy(aggregate).agg(
        last(time, at & created).alias("created_at"),
        last(author, at & created).alias("created_by"),
        last(time, update).alias("updated_at"),
        last(author, update).alias("updated_by"),
        (F.count_if(delete) > 0).alias("deleted"),
        last(time, delete).alias("deleted_at"),
        last(author, delete).alias("deleted_by"),
        (F.count_if(at & (F.col(kind) == DELETE)) > 0).alias("orphan_deletion"),
        (F.count_if(update) + 1).alias("version"),
        F.count(F.lit(1)).alias("total_commands"),
        *[
            F.max_by(F.try_element_at(F.col(payload), F.lit(f)), F.when(writes & F.map_contains_key(payload, f), F.col("_place"))).alias(f)
            for f in fields
        ],
    )
    return states


def expected_projection(
    events: DataFrame, keys: Sequence[str], kind: str, sequence: str, time: str, event_id: str, deleted: str = "INSTANCE_DELETED"
) -> DataFrame:
    """Last event per instance by (sequence, time, id) and whether a document should exist."""
    place = F.struct(F.coalesce(F.col(sequence).cast("bigint"), F.lit(-1)), F.col(time), F.col(event_id).cast("string"))
    last = F.max_by(F.struct(F.col(event_id).alias("latest_event_id"), F.col(kind).alias("latest_event_type")), place)
    return events.groupBy(*keys).agg(last.alias("_l")).select(
        *keys, "_l.*", (F.col("_l.latest_event_type") != deleted).alias("should_exist")
    )


def projection_mismatches(
    expected: DataFrame, documents: DataFrame, key: str, document_key: str, checks: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """(key, reason) for every expectation that its document contradicts.

    ``checks`` lists reason → (expected column, document column) in order of precedence; an
    empty document value is not compared.
    """
    docs = documents.select(F.col(document_key).alias(key), F.struct(*documents.columns).alias("_doc"))
    both = expected.join(docs, key, "left")
    there = F.col("_doc").isNotNull()
    reason = F.when(F.col("should_exist") & ~there, F.lit("missing_document"))
    for name, (a, b) in checks.items():
        value = F.trim(F.col(f"_doc.{b}").cast("string"))
        reason = reason.when(F.col("should_exist") & (value != "") & (value != F.col(a).cast("string")), F.lit(name))
    reason = reason.when(~F.col("should_exist") & there, F.lit("deleted_document_present"))
    return both.select(key, reason.alias("reason")).filter(F.col("reason").isNotNull())


def migrate(df: DataFrame, version: str, steps: Sequence[tuple[int, int, Mapping[str, str]]]) -> DataFrame:
    """Bring rows of mixed schema versions to the last version in one pass.

    Steps are ``(from, to, {column: expression})`` in order. A step touches a row when the row
    has reached its ``from`` version; expressions see the columns as the earlier steps left them.
    """
    for before, after, changes in steps:
        due = F.col(version) == before
        kinds = set(df.columns)
        updates = {c: F.when(due, F.expr(e)).otherwise(F.col(c)) if c in kinds else F.when(due, F.expr(e)) for c, e in changes.items()}
        df = df.withColumns({**updates, version: F.when(due, F.lit(after)).otherwise(F.col(version))})
    return df


def entry_hash(previous: Column, body: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), F.lit("\n"), body), 256)


def broken_chain(log: DataFrame, partition: str, sequence: str, body: str, previous: str, digest: str) -> DataFrame:
    """Entries (partition, sequence, reason) whose own hash or link to the entry before is wrong."""
    linked = running_before(log, [partition], [sequence], F.struct(F.col(digest).alias("h")), "last", "_before")
    expected = F.col("_before.h")
    reason = F.when(entry_hash(F.col(previous), F.col(body)) != F.col(digest), F.lit("hash")).when(
        ~F.col(previous).eqNullSafe(expected), F.lit("link")
    )
    return linked.select(partition, sequence, reason.alias("reason")).filter(F.col("reason").isNotNull())
