"""Incremental loads: watermarks, snapshot deltas and change application."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.operators.transforms import align, row_hash


def watermark_filter(df: DataFrame, column: str, after: Any = None, seen: DataFrame | None = None) -> DataFrame:
    """Rows not loaded yet. Rows without a watermark value are dropped once a watermark is set.

    Without ``seen`` the boundary is inclusive. With ``seen`` (a table of ``row_key`` hashes of
    rows already loaded at the boundary) only unseen rows of the boundary pass. The two range
    tests stay plain so that both reach the file statistics.
    """
    if after is None:
        return df
    if seen is None:
        return df.filter(F.col(column) >= F.lit(after))
    boundary = df.filter(F.col(column) == F.lit(after)).withColumn("row_key", row_hash(df.columns))
    fresh = boundary.join(seen.select("row_key"), "row_key", "left_anti").select(*df.columns)
    return df.filter(F.col(column) > F.lit(after)).unionByName(fresh)


def watermark_state(df: DataFrame, column: str, previous: DataFrame | None = None) -> DataFrame:
    """State table (watermark, row_key): the greatest value with the hashes of its rows.

    When the greatest value did not move, earlier hashes are kept. The state is a table, so a
    boundary shared by many rows never passes through the driver.
    """
    top = df.agg(F.max(column)).scalar()
    rows = df.filter(F.col(column) == top).select(F.col(column).alias("watermark"), row_hash(df.columns).alias("row_key"))
    if previous is None:
        return rows.distinct()
    whole = rows.unionByName(previous.select("watermark", "row_key"))
    newest = whole.agg(F.max("watermark")).scalar()
    return whole.filter(F.col("watermark") == newest).distinct()


def watermark_delta(df: DataFrame, column: str, previous: Any = None) -> DataFrame:
    """Rows strictly above the previous watermark; missing values are skipped."""
    known = df.filter(F.col(column).isNotNull())
    return known if previous is None else known.filter(F.col(column) > F.lit(previous))


def snapshot_delta(old: DataFrame, new: DataFrame, keys: Sequence[str], unchanged: bool = False) -> DataFrame:
    """Row changes between two snapshots: ``change_type`` added, modified or deleted.

    Values are the new ones, for deleted rows the old ones. Keys are unique on each side. A column
    that one side lacks counts as missing there.
    """
    schema = dict(new.dtypes) | {c: t for c, t in old.dtypes if c not in new.columns}
    values = [c for c in schema if c not in keys]
    before = align(old, schema).select(*keys, F.struct(F.lit(True).alias("_there"), *values).alias("_old"))
    after = align(new, schema).select(*keys, F.struct(F.lit(True).alias("_there"), *values).alias("_new"))
    kind = (
        F.when(F.col("_old").isNull(), F.lit("added"))
        .when(F.col("_new").isNull(), F.lit("deleted"))
        .when(F.col("_old") != F.col("_new"), F.lit("modified"))
    )
    both = before.join(after, list(keys), "full").withColumn("change_type", kind)
    if unchanged:
        both = both.na.fill("unchanged", ["change_type"])
    current = [F.coalesce(F.col("_new"), F.col("_old")).getField(c).alias(c) for c in values]
    return both.filter(F.col("change_type").isNotNull()).select(*keys, *current, "change_type")


def file_delta(added: DataFrame, removed: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Row delta from added and removed files: upserts, and deletes whose key does not reappear."""
    upserts = added.withColumn("change_type", F.lit("upserted"))
    if removed is None:
        return upserts
    gone = removed.join(added.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    return upserts.unionByName(align(gone, dict(added.dtypes)).withColumn("change_type", F.lit("deleted")))


def apply_changes(target: DataFrame, delta: DataFrame, keys: Sequence[str], kind: str = "change_type") -> DataFrame:
    """Target after the delta: touched keys leave, added and changed rows come in."""
    fresh = delta.filter(F.col(kind) != "deleted").select(*target.columns)
    return target.join(delta.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def stale_rows(existing: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows whose key the full run did not produce."""
    return existing.join(current.select(*keys).distinct(), list(keys), "left_anti")


def run_changelog(delta: DataFrame, kind: str = "change_type", watermark: str | None = None, before: Any = None) -> DataFrame:
    """(added, modified, deleted, total) of one run, one row also for an empty delta.

    With ``watermark``, a column of the delta, also ``watermark_before`` (the one the run started
    from, None for a first run) and ``watermark_after``: the greatest value seen, never below the one before.
    """
    names = ("added", "modified", "deleted")
    counts = [F.count_if(F.col(kind) == n).alias(n) for n in names]
    counts.append(F.count_if(F.col(kind).isin(*names)).alias("total"))
    if watermark is None:
        return delta.agg(*counts)
    start = F.lit(before).cast(delta.schema[watermark].dataType)
    return delta.agg(*counts, start.alias("watermark_before"), F.greatest(F.max(watermark), start).alias("watermark_after"))
