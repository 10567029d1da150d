"""Exact percentiles of groups of any size, grouping sets over a lattice, and sketches kept as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.skew import running_before
from loomframe.session import materialize

ACCURACY = 1_000  # a quantile sketch of this accuracy is off by at most 1 / ACCURACY of a group's rows
MARGIN = 3  # the searched interval reaches this many times that error to both sides
HLL_BITS = 12  # 2^12 registers: a relative standard error of 1.6 %
KLL_SIZE = 200  # a normalized rank error of about 1.65 %

#: Partial states by metric, and how each is added up and read.
_STATES = {"count": ("count",), "sum": ("sum",), "min": ("min",), "max": ("max",), "avg": ("sum", "count")}
_FOLD = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def percentile_exact(df: DataFrame, keys: Sequence[str], value: str, fraction: float, name: str) -> DataFrame:
    """(keys, name): the percentile of the known values of each group, on the line between its two neighbouring ranks.

    A sketch per group bounds an interval that must hold both ranks, since its error is at most a third of
    the margin taken (all values of a group of less than 2 ACCURACY rows). One pass then counts what lies below and, per distinct value, inside. Running counts
    over the distinct values find the ranks; a busy group is cut there. No task holds a group's values.
    """
    named = [F.col(k) for k in keys] or [F.lit(0).alias("_all")]
    known = df.filter(F.col(value).isNotNull()).select(F.struct(*named).alias("_key"), F.col(value).alias("_v"))
    low, high = max(fraction - MARGIN / ACCURACY, 0.0), min(fraction + MARGIN / ACCURACY, 1.0)
    bounds = F.percentile_approx("_v", [low, high], ACCURACY)
    rank = (F.col("_n") - 1) * F.lit(float(fraction))
    groups = known.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), bounds.alias("_b"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    small = F.col("_n") < 2 * ACCURACY  # so few rows that the next rank may lie beyond the margin
    groups = groups.withColumns({"_from": F.when(small, F.col("_least")).otherwise(F.col("_b")[0]), "_to": F.when(small, F.col("_most")).otherwise(F.col("_b")[1])})
    groups = materialize(
        groups.select("_key", F.floor(rank).alias("_low"), F.ceil(rank).alias("_high"), (rank - F.floor(rank)).alias("_part"), "_from", "_to"),
        "percentile-bounds",
    )
    narrowed = known.join(groups.select("_key", "_from", "_to"), "_key").filter(F.col("_v") <= F.col("_to"))
    inside = F.when(F.col("_v") >= F.col("_from"), F.col("_v"))  # missing: below the interval
    counts = materialize(narrowed.groupBy("_key", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c")), "percentile-counts")
    summed = running_before(counts, ["_key"], ["_v"], F.col("_c"), "sum", "_upto", include_current=True)
    ranked = summed.filter(F.col("_v").isNotNull()).join(groups.select("_key", "_low", "_high", "_part"), "_key")
    found = ranked.groupBy("_key").agg(
        F.min(F.when(F.col("_upto") > F.col("_low"), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.col("_high"), F.col("_v"))).alias("_z"),
        F.first("_part").alias("_part"),
    )
    between = F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_part")
    checked = F.when(F.col("_z").isNull(), F.raise_error(F.lit("a rank lies outside its interval"))).otherwise(between)
    return found.select(*[F.col(f"_key.{k}").alias(k) for k in keys], checked.cast("double").alias(name))


def cube(keys: Sequence[str]) -> list[tuple[str, ...]]:
    return [c for n in range(len(keys), -1, -1) for c in combinations(keys, n)]


def rollup(keys: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(keys[:n]) for n in range(len(keys), -1, -1)]


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], metrics: Mapping[str, tuple[str, str | None]], level: str = "grouping_id") -> DataFrame:
    """Metrics ``alias: (count | sum | min | max | avg, column)`` for each set of keys, other keys missing.

    Rows are read once, for the finest grouping. Every other set adds up partial states of the smallest set above it
    that is worked out already, so the input is not multiplied. ``level`` has a bit per key, the first
    highest, set where the key is not part of the set, as SQL's GROUPING_ID. The empty set gives one row, also for no input.
    """
    wanted = list(dict.fromkeys(tuple(s) for s in sets))
    keys = list(dict.fromkeys(k for s in wanted for k in s))
    states, read = {}, {}
    for alias, (kind, column) in metrics.items():
        for part in _STATES[kind]:
            states.setdefault((part, column), f"_s{len(states)}")
        own = [F.col(states[part, column]) for part in _STATES[kind]]
        read[alias] = F.try_divide(own[0], own[1]) if kind == "avg" else own[0]
    first = [_FOLD[part](F.lit(1) if column is None else F.col(column)).alias(name) for (part, column), name in states.items()]
    again = [(F.sum if part == "count" else _FOLD[part])(name).alias(name) for (part, _), name in states.items()]
    zero = {name: 0 for (part, _), name in states.items() if part == "count"}
    done = {tuple(keys): materialize(df.groupBy(*keys).agg(*first), "lattice")}
    for s in sorted({tuple(k for k in keys if k in w) for w in wanted}, key=len, reverse=True):
        if s not in done:
            above = min((d for d in done if set(s) < set(d)), key=len)
            done[s] = materialize(done[above].groupBy(*s).agg(*again).na.fill(zero), "lattice")
    found = None
    for w in wanted:
        s = tuple(k for k in keys if k in w)
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        columns = [F.col(k) if k in s else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]
        part = done[s].select(*columns, F.lit(bits).cast("bigint").alias(level), *[c.alias(a) for a, c in read.items()])
        found = part if found is None else found.unionByName(part)
    return found


def sketch(df: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """Per group one row of sketches: ``distinct_col`` (HyperLogLog) and ``quantiles_col`` (KLL) as binary, of bounded size each.

    The rows can be stored; :func:`merge_sketches` adds them up for coarser groups without reading the data again.
    """
    made = [F.hll_sketch_agg(c, HLL_BITS).alias(f"distinct_{c}") for c in distinct]
    made += [F.kll_sketch_agg_double(F.col(c).cast("double"), KLL_SIZE).alias(f"quantiles_{c}") for c in quantiles]
    return df.groupBy(*keys).agg(*made)


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    made = [F.hll_union_agg(c).alias(c) for c in sketches.columns if c.startswith("distinct_")]
    made += [F.kll_merge_agg_double(c).alias(c) for c in sketches.columns if c.startswith("quantiles_")]
    return sketches.groupBy(*keys).agg(*made)


def distinct_estimate(sketched: str) -> Column:
    return F.hll_sketch_estimate(sketched)


def quantile_estimate(sketched: str, fraction: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketched), F.lit(float(fraction)))
