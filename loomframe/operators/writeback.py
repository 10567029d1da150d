"""Patches on entities: apply, merge in order, detect and resolve conflicts, snapshot.

An entity row has ``data`` (map of text) and ``links`` (map of text lists). A patch is a
struct ``set`` (map), ``unset`` (list), ``link_add`` and ``link_remove`` (lists of struct
field, value) and ``delete`` (boolean).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATCH = (
    "struct<set:map<string,string>,unset:array<string>,link_add:array<struct<field:string,value:string>>,"
    "link_remove:array<struct<field:string,value:string>>,delete:boolean>"
)
DATA, LINKS = "map<string,string>", "map<string,array<string>>"


def _or_empty(c: Column, kind: str) -> Column:
    empty = F.create_map() if kind.startswith("map") else F.array()
    return F.coalesce(c, empty.cast(kind))


def patched_data(data: Column, patch: Column) -> Column:
    """Fields after ``set`` and then ``unset``."""
    changes, gone = _or_empty(patch["set"], DATA), _or_empty(patch["unset"], "array<string>")
    kept = F.map_filter(_or_empty(data, DATA), lambda k, v: ~F.map_contains_key(changes, k) & ~F.array_contains(gone, k))
    return F.map_concat(kept, F.map_filter(changes, lambda k, v: ~F.array_contains(gone, k)))


def patched_links(links: Column, patch: Column) -> Column:
    """Link lists after adding (once) and then removing."""
    ops = "array<struct<field:string,value:string>>"
    add, remove = _or_empty(patch["link_add"], ops), _or_empty(patch["link_remove"], ops)
    base = _or_empty(links, LINKS)

    def touched(o: Column) -> Column:
        return F.transform(o, lambda x: x["field"])

    def values(o: Column, field: Column) -> Column:
        return F.transform(F.filter(o, lambda x: x["field"] == field), lambda x: x["value"])

    def entry(field: Column) -> Column:
        now = F.coalesce(F.try_element_at(base, field), F.array().cast("array<string>"))
        return F.struct(field.alias("key"), F.array_except(F.array_union(now, values(add, field)), values(remove, field)).alias("value"))

    fields = F.array_union(F.map_keys(base), F.array_union(touched(add), touched(remove)))
    return F.map_from_entries(F.transform(fields, entry))


def apply_patch(df: DataFrame, patch: str, data: str = "data", links: str = "links") -> DataFrame:
    """Rows after their patch, with ``tombstone``; a deleting patch changes nothing else."""
    p, gone = F.col(patch), F.coalesce(F.col(f"{patch}.delete"), F.lit(False))
    return df.withColumns(
        {
            data: F.when(gone, F.col(data)).otherwise(patched_data(F.col(data), p)),
            links: F.when(gone, F.col(links)).otherwise(patched_links(F.col(links), p)),
            "tombstone": gone,
        }
    )


def last_writes(patches: DataFrame, key: str, sequence: str, patch: str) -> DataFrame:
    """Final write per (key, field): value, or NULL where the last write was an unset.

    Within one patch an unset follows a set. Combines map-side, whatever the number of patches.
    """
    sets = patches.select(
        key, sequence, F.lit(0).alias("_step"), F.explode(F.col(f"{patch}.set")).alias("field", "value")
    )
    unsets = patches.select(
        key, sequence, F.lit(1).alias("_step"), F.explode(F.col(f"{patch}.unset")).alias("field"), F.lit(None).cast("string").alias("value")
    )
    place = F.struct(sequence, "_step")
    return sets.unionByName(unsets).groupBy(key, "field").agg(F.max_by("value", place).alias("value"))


def last_link_edits(patches: DataFrame, key: str, sequence: str, patch: str) -> DataFrame:
    """Final state per (key, field, target): present or not."""
    parts = [
        patches.select(key, sequence, F.lit(step).alias("_step"), F.inline(F.col(f"{patch}.{name}"))).select(
            key, sequence, "_step", F.col("field"), F.col("value").alias("target")
        )
        for step, name in enumerate(("link_add", "link_remove"))
    ]
    place = F.struct(sequence, "_step")
    return parts[0].unionByName(parts[1]).groupBy(key, "field", "target").agg(
        (F.max_by("_step", place) == 0).alias("present")
    )


def merge(
    base: DataFrame,
    patches: DataFrame,
    key: str,
    sequence: str,
    patch: str,
    fields: Sequence[str],
    above: int | None = None,
) -> DataFrame:
    """Base rows (key and one column per field) after all queued patches.

    ``above`` skips patches that a snapshot already holds. A delete ends an entity: it becomes
    a tombstone without field values. ``last_sequence`` is that of the last patch applied.
    """
    queue = patches if above is None else patches.filter(F.col(sequence) > above)
    deletes = F.coalesce(F.col(f"{patch}.delete"), F.lit(False))
    heads = queue.groupBy(key).agg(F.max(sequence).alias("_last"), F.min(F.when(deletes, F.col(sequence))).alias("_deleted"))
    writes = last_writes(queue, key, sequence, patch).groupBy(key).agg(
        *[F.max(F.when(F.col("field") == f, F.struct(F.col("value").alias("v")))).alias(f"_w_{f}") for f in fields]
    )
    # Both sides hold one row per key, so busy entities cost nothing in these joins.
    merged = base.join(heads, key, "left").join(writes, key, "left")
    gone = F.col("_deleted").isNotNull()

    def value(f: str) -> Column:
        written = F.col(f"_w_{f}")
        return F.when(gone, F.lit(None)).when(written.isNotNull(), written.getField("v")).otherwise(F.col(f)).alias(f)

    return merged.select(
        key, *[value(f) for f in fields], gone.alias("tombstone"), F.coalesce("_deleted", "_last").alias("last_sequence")
    )


def merge_links(
    base: DataFrame, patches: DataFrame, key: str, sequence: str, patch: str, above: int | None = None
) -> DataFrame:
    """Links (key, field, target) after all queued patches; an entity that a patch deletes has none."""
    queue = patches if above is None else patches.filter(F.col(sequence) > above)
    edits = last_link_edits(queue, key, sequence, patch)
    place = [key, "field", "target"]
    kept = base.select(*place).distinct().join(edits, place, "left_anti")
    gone = queue.filter(F.coalesce(F.col(f"{patch}.delete"), F.lit(False))).select(key).distinct()
    return kept.unionByName(edits.filter("present").select(*place)).join(gone, key, "left_anti")


def conflicting_fields(observed: Column, current: Column) -> Column:
    """Fields of the observed map whose current value differs."""
    return F.sort_array(
        F.filter(F.map_keys(observed), lambda k: ~F.try_element_at(observed, k).eqNullSafe(F.try_element_at(current, k)))
    )


def conflicting_links(observed: Column, current: Column, patch: Column) -> Column:
    """Added links that the base removed meanwhile, and removed links that it added."""

    def has(links: Column, op: Column) -> Column:
        return F.coalesce(F.array_contains(F.try_element_at(links, op["field"]), op["value"]), F.lit(False))

    def found(ops: Column, test, direction: str) -> Column:
        hits = F.filter(F.coalesce(ops, F.array().cast("array<struct<field:string,value:string>>")), test)
        return F.transform(
            hits, lambda o: F.struct(o["field"].alias("field"), o["value"].alias("value"), F.lit(direction).alias("direction"))
        )

    return F.concat(
        found(patch["link_add"], lambda o: has(observed, o) & ~has(current, o), "BASE_REMOVED_PATCH_ADDS"),
        found(patch["link_remove"], lambda o: ~has(observed, o) & has(current, o), "BASE_ADDED_PATCH_REMOVES"),
    )


def resolution(policy: Column, has_conflict: Column) -> Column:
    """APPLIED, SKIPPED (the base wins) or REJECTED (fail or manual review)."""
    return (
        F.when(~has_conflict | (policy == "WRITEBACK_WINS"), F.lit("APPLIED"))
        .when(policy == "BASE_WINS", F.lit("SKIPPED"))
        .otherwise(F.lit("REJECTED"))
    )


def high_watermark(base: DataFrame, patches: DataFrame, key: str, sequence: str) -> DataFrame:
    """Sequence up to which a snapshot is complete: below the lowest patch without a base row."""
    ends = patches.groupBy(key).agg(F.min(sequence).alias("lo"), F.max(sequence).alias("hi"))
    known = ends.join(base.select(key, F.lit(True).alias("_ok")), key, "left")
    ok = F.col("_ok").isNotNull()
    totals = known.agg(
        F.max("hi").alias("top"), F.min(F.when(~ok, F.col("lo"))).alias("failed"), F.max(F.when(ok, F.col("hi"))).alias("done")
    )
    held = F.when(F.col("failed").isNotNull(), F.greatest(F.lit(0), F.least("top", F.col("failed") - 1))).otherwise(F.col("top"))
    mark = F.when(F.col("done").isNotNull(), F.least(held, "done")).when(F.col("failed").isNotNull(), F.lit(0)).otherwise(held)
    return totals.select(mark.cast("bigint").alias("high_watermark"))


def snapshot(
    base: DataFrame, patches: DataFrame, key: str, sequence: str, patch: str, fields: Sequence[str], path: str
) -> DataFrame:
    """Write the merged state of every queued entity once and return the snapshot's rows."""
    queued = base.join(patches.select(key).distinct(), key, "left_semi")
    merge(queued, patches, key, sequence, patch, fields).write.mode("overwrite").parquet(path)
    return base.sparkSession.read.parquet(path)
