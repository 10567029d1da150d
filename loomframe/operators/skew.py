"""Ordered work over groups of any size.

A plain window puts a whole group into one task, which is right for small groups. The few
groups that are too large are found first and dealt into ranges of their real order columns;
each (group, range) is worked on by itself and only one summary row per range is carried on, so
a group holding a third of the table still spreads over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from loomframe.session import materialize

TASK_ROWS = 2_000_000  # rows of one group that one task takes; busier groups are cut


def _group(keys: Sequence[str]) -> Column:
    # Struct equality treats missing fields as equal, as grouping does, and keeps the hash
    # partitioning usable by both the join and the window.
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def _order(order: Sequence[str]) -> list[Column]:
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def _plain(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(_group(keys)).orderBy(*_order(order))


def busy_groups(df: DataFrame, keys: Sequence[str], task_rows: int) -> DataFrame | None:
    """Groups too large for one task with their rows, as a written table (_group, _n); None if there are none.

    Keys are counted in one pass, whose outcome is written and read from then on.
    """
    counts = df.groupBy(_group(keys).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    busy = materialize(counts.filter(F.col("_n") > task_rows), "busy-groups")
    return None if busy.isEmpty() else busy


def slices_for(busy: DataFrame, task_rows: int) -> int:
    """Number of ranges for all busy groups: as many as their rows need, at half of what a task should take."""
    return math.ceil(2 * busy.agg(F.sum("_n")).first()[0] / task_rows)


def _apart(df: DataFrame, keys: Sequence[str], busy: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("_group", _group(keys))
    return marked.join(busy, "_group", "left_anti").select(*df.columns), marked.join(busy, "_group", "left_semi").select(*df.columns)


def ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """The rows with ``_group`` and ``_slice``: consecutive ranges of group and order, each a part of one shuffle.

    A hash of the row parts those that tie; only rows equal in every column stay together. The
    ranges are written once, so that all later steps see the same ones. ``slices`` is their number
    (None: as many as a shuffle has partitions).
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    ranged = df.withColumn("_group", _group(keys)).repartitionByRange(slices, F.col("_group").asc(), *_order(order), ties.asc())
    return materialize(ranged.withColumn("_slice", F.spark_partition_id()), "ranges")


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    task_rows: int = TASK_ROWS,
    measure: DataFrame | None = None,
) -> DataFrame:
    """``row_number`` for every row; groups above ``task_rows`` rows are spread over slices.

    "-col" sorts descending. ``measure`` is a cheaper table with the key columns and at least as
    many rows per group.
    """
    measure = df if measure is None else measure
    busy = busy_groups(measure, keys, task_rows)
    if busy is None:
        return df.withColumn(name, F.row_number().over(_plain(keys, order)).cast("bigint"))
    calm, large = _apart(df, keys, busy)
    cut = ranges(large, keys, order, slices_for(busy, task_rows))
    sizes = cut.groupBy("_group", "_slice").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_group", "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    local = Window.partitionBy("_group", "_slice").orderBy(*_order(order))
    spread = cut.join(starts, ["_group", "_slice"]).withColumn(name, (F.row_number().over(local) + F.col("_start")).cast("bigint"))
    whole = calm.withColumn(name, F.row_number().over(_plain(keys, order)).cast("bigint"))
    return whole.unionByName(spread.select(*df.columns, name))


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    how: str,
    name: str,
    task_rows: int = TASK_ROWS,
    include_current: bool = False,
    measure: DataFrame | None = None,
) -> DataFrame:
    """Running ``max``/``min``/``sum``/``last`` of ``value`` over the earlier rows of the group.

    ``last`` skips missing values. The order must be total within a group, and its columns
    all ascend or all descend. Groups above ``task_rows`` rows are spread over slices; their
    sums of doubles are added slice by slice.
    """
    last = how == "last"
    fold = {"max": F.max, "min": F.min, "sum": F.sum}.get(how)

    def running(column: str, window: WindowSpec) -> Column:
        return F.last(column, ignorenulls=True).over(window) if last else fold(column).over(window)

    end = 0 if include_current else -1
    measure = df if measure is None else measure
    busy = busy_groups(measure, keys, task_rows)
    calm, large = (df, None) if busy is None else _apart(df, keys, busy)
    whole_window = _plain(keys, order).rowsBetween(Window.unboundedPreceding, end)
    whole = calm.withColumn("_value", value).withColumn(name, running("_value", whole_window)).drop("_value")
    if large is None:
        return whole
    cut = ranges(large, keys, order, slices_for(busy, task_rows)).withColumn("_value", value)
    if last:
        place = F.struct(*[F.col(o.lstrip("-")) for o in order])
        pick = F.min_by if order[0].startswith("-") else F.max_by
        summary = pick("_value", F.when(F.col("_value").isNotNull(), place))
    else:
        summary = fold("_value")
    summaries = cut.groupBy("_group", "_slice").agg(summary.alias("_summary"))
    earlier = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carries = summaries.select("_group", "_slice", running("_summary", earlier).alias("_carry"))
    local = Window.partitionBy("_group", "_slice").orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, end)
    here, before = F.col("_here"), F.col("_carry")
    if last:
        merged = F.coalesce(here, before)
    elif how == "sum":
        merged = F.coalesce(here + before, here, before)
    else:
        merged = (F.greatest if how == "max" else F.least)(here, before)
    spread = cut.join(carries, ["_group", "_slice"]).withColumn("_here", running("_value", local)).withColumn(name, merged)
    return whole.unionByName(spread.select(*df.columns, name))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order`` (missing lowest). Combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order``. Combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def chunked_lists(df: DataFrame, keys: Sequence[str], item: str, name: str, chunk: int = 10_000) -> DataFrame:
    """Sorted distinct items per key, in lists of about ``chunk`` items at most.

    Small keys get one list (chunk 0); a large key gets as many lists as it needs, each built
    by its own task, so no list grows with the table.
    """
    pairs = df.select(*keys, item).where(F.col(item).isNotNull()).distinct()
    sizes = pairs.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("_parts"))
    spread = F.pmod(F.xxhash64(item), F.col("_parts")).cast("int")
    return (
        pairs.join(sizes, list(keys))
        .groupBy(*keys, spread.alias("chunk"))
        .agg(F.sort_array(F.collect_list(item)).alias(name))
    )
