"""Window columns and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.operators.skew import _group, earliest, latest, row_numbers, running_before


def row_number(
    df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], output: str = "row_number"
) -> DataFrame:
    """Number rows inside each group. Groups of any size: the order axis is sliced.

    The order must be total.
    """
    return row_numbers(df, partition_by, order_by, output)


def ranks(df: DataFrame, partition_by: Sequence[str], order: str, tie: Sequence[str], tiles: int | None = None) -> DataFrame:
    """``row_number``, ``rank``, ``dense_rank`` and ``ntile`` columns for groups of any size.

    Ranks compare ``order`` alone ("-col" descends); row numbers and tiles settle ties by ``tie``.
    Ranks are worked out on one row per distinct value and joined back, so neither a busy
    group nor a busy value gathers in one task.
    """
    columns, value = df.columns, order.lstrip("-")
    keys = F.struct(F.struct(*partition_by).alias("g"), F.col(value).alias("v"))
    counts = df.groupBy(*partition_by, value).agg(F.count(F.lit(1)).alias("_n"))
    summed = running_before(counts, partition_by, [order], F.col("_n"), "sum", "_before", measure=df)
    ranked = row_numbers(summed, partition_by, [order], "_dense", measure=df)
    totals = df.groupBy(F.struct(*partition_by).alias("_g")).agg(F.count(F.lit(1)).alias("_total"))
    lookup = ranked.select(
        keys.alias("_key"), (F.coalesce("_before", F.lit(0)) + 1).cast("bigint").alias("rank"), F.col("_dense").alias("dense_rank")
    )
    numbered = row_numbers(df, partition_by, [order, *tie], "row_number").withColumn("_key", keys)
    joined = numbered.join(lookup, "_key")
    names = ["row_number", "rank", "dense_rank"]
    if tiles:
        # The first (total mod tiles) tiles hold one row more than the rest.
        joined = joined.withColumn("_g", F.struct(*partition_by)).join(totals, "_g")
        small, large = F.floor(F.col("_total") / tiles), F.col("_total") % tiles
        at = F.col("row_number") - 1
        head = large * (small + 1)
        tile = F.when(at < head, F.floor(at / (small + 1))).otherwise(large + F.floor((at - head) / F.greatest(small, F.lit(1))))
        joined, names = joined.withColumn("ntile", (tile + 1).cast("bigint")), [*names, "ntile"]
    return joined.select(*columns, *names)


def neighbours(
    df: DataFrame,
    partition_by: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str],
    before: int = 1,
    after: int = 1,
    chunk: int = 100_000,
) -> DataFrame:
    """Window functions that look at most ``before`` rows back and ``after`` rows ahead.

    ``columns`` holds window calls without their OVER clause, and optionally a ROWS frame after
    a ``|``: ``lag(x)``, ``avg(x) | ROWS BETWEEN 2 PRECEDING AND CURRENT ROW``. Groups are cut
    into runs of ``chunk`` rows (``before`` or ``after`` if those are more), each with copies of
    its few neighbouring rows, so that no run grows with its group.
    """
    chunk = max(chunk, before, after, 1)
    numbered = row_numbers(df, partition_by, order, "_rn").withColumn("_group", _group(partition_by))
    place = F.col("_rn") - 1
    home, offset = F.floor(place / chunk), place % chunk
    others = F.array_compact(
        F.array(
            F.struct(home.alias("run"), F.lit(True).alias("own")),
            F.when(offset >= chunk - before, F.struct((home + 1).alias("run"), F.lit(False).alias("own"))),
            F.when((offset < after) & (home > 0), F.struct((home - 1).alias("run"), F.lit(False).alias("own"))),
        )
    )
    spread = numbered.select("*", F.inline(others))
    over = "OVER (PARTITION BY _group, run ORDER BY _rn"
    made = []
    for name, call in columns.items():
        function, _, frame = call.partition("|")
        made.append(F.expr(f"{function.strip()} {over} {frame.strip()})").alias(name))
    return spread.select("*", *made).filter("own").select(*df.columns, *columns)


def window_expressions(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Any SQL window expressions, passed to Catalyst together so equal windows share one sort.

    Each group is one task's work; for groups without a size bound use :func:`row_number`,
    :func:`ranks`, :func:`neighbours` and the per-key aggregates.
    """
    return df.select("*", *[F.expr(e).alias(a) for a, e in columns.items()])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return latest(df, keys, order)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return earliest(df, keys, order)


def union(left: DataFrame, right: DataFrame, mode: str = "strict") -> DataFrame:
    """By name, keeping duplicates. ``strict``: same columns; ``common_only``; ``pad`` with NULLs."""
    if mode == "strict":
        if set(left.columns) != set(right.columns):
            raise ValueError("strict union needs the same columns on both sides")
        return left.unionByName(right)
    if mode == "common_only":
        common = [c for c in left.columns if c in right.columns]
        if not common:
            raise ValueError("the sides share no column")
        return left.select(*common).unionByName(right.select(*common))
    if mode in ("pad", "pad_missing_nulls"):
        return left.unionByName(right, allowMissingColumns=True)
    raise ValueError(f"unknown union mode: {mode}")


def table_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows whose number differs, with both counts. One pass over both sides, no row copies."""
    columns = expected.columns
    tagged = expected.withColumn("_e", F.lit(1)).unionByName(actual.select(*columns).withColumn("_e", F.lit(0)))
    counted = tagged.groupBy(*columns).agg(
        F.sum("_e").alias("expected_count"), F.sum(1 - F.col("_e")).alias("actual_count")
    )
    return counted.filter(F.col("expected_count") != F.col("actual_count"))


def identity_union(frames: Sequence[DataFrame], identity: Sequence[str]) -> DataFrame:
    """All result sets together, the first occurrence of each identity kept."""
    parts = [f.withColumn("_set", F.lit(i)) for i, f in enumerate(frames)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return earliest(whole, identity, ["_set"]).drop("_set")
