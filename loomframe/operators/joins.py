"""Joins with collision-safe names, lookups, key checks and link traversal."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.skew import chunked_lists, latest
from loomframe.operators.transforms import free_name

NO_RIGHT_SIDE = {"semi", "leftsemi", "left_semi", "anti", "leftanti", "left_anti"}


def _right_names(left: DataFrame, right: DataFrame, keep: set[str]) -> dict[str, str]:
    taken = set(left.columns) | set(right.columns)
    names: dict[str, str] = {}
    for c in right.columns:
        if c in left.columns and c not in keep:
            names[c] = free_name(f"right_{c}", taken)
            taken.add(names[c])
    return names


FULL = ("full", "outer", "fullouter", "full_outer")


def _full(left: DataFrame, right: DataFrame, matched: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """``matched`` and the right rows whose key the left side lacks."""
    known = left.select(*[F.col(a).alias(f"_k{i}") for i, a in enumerate(left_keys)]).distinct()
    tests = [F.col(b) == F.col(f"_k{i}") for i, b in enumerate(right_keys)]
    alone = right.join(known, reduce(Column.__and__, tests), "left_anti")
    empty = [F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in alone.columns]
    return matched.unionByName(alone.select("*", *empty))


def join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
    how: str = "inner",
    *,
    left_hint: str | None = None,
    right_hint: str | None = None,
) -> DataFrame:
    """Equi join. Right columns that collide get a ``right_`` prefix; same-named keys merge.

    No side is broadcast by default: Catalyst and AQE choose from measured sizes, and AQE
    splits skewed partitions. Hints pass through for callers who know their sizes. A full join is
    a left join and the right rows without a partner, since a busy key can be split in both of
    these but not in a full outer join; each side is read twice.
    """
    right_keys = list(right_keys or left_keys)
    if not left_keys or len(left_keys) != len(right_keys):
        raise ValueError("a join needs the same number of left and right keys, at least one")
    left = left.hint(left_hint) if left_hint else left
    right = right.hint(right_hint) if right_hint else right
    if list(left_keys) == right_keys:
        names = _right_names(left, right, set(right_keys))
        renamed = right.withColumnsRenamed(names)
        if how in FULL:
            return _full(left, renamed, left.join(renamed, list(left_keys), "left"), left_keys, right_keys)
        return left.join(renamed, list(left_keys), how)
    names = _right_names(left, right, set())
    renamed = right.withColumnsRenamed(names)
    if how in FULL:
        theirs = [names.get(b, b) for b in right_keys]
        return _full(left, renamed, join(left, right, left_keys, right_keys, "left"), left_keys, theirs)
    tests = [left[a] == renamed[names.get(b, b)] for a, b in zip(left_keys, right_keys)]
    return left.join(renamed, reduce(Column.__and__, tests), how)


def changed(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left rows whose values differ from the right row of the same key (missing equals missing)."""
    other = right.select(*keys, F.struct(*columns).alias("_other"))
    differs = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"_other.{c}")) for c in columns])
    return left.join(other, list(keys)).filter(differs).drop("_other")


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    right_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Left join to the latest right row per key; ``order`` ends in a unique column."""
    right_keys = list(right_keys or keys)
    return join(left, latest(right, right_keys, order), keys, right_keys, "left")


def orphans(
    child: DataFrame, parent: DataFrame, keys: Sequence[str], parent_keys: Sequence[str] | None = None,
    allow_nulls: bool = True,
) -> DataFrame:
    """Child rows without a parent. Rows with a missing key are fine when ``allow_nulls``."""
    parent_keys = list(parent_keys or keys)
    known = parent.select(*[F.col(p).alias(k) for k, p in zip(keys, parent_keys)]).distinct()
    if allow_nulls:
        child = child.dropna(subset=list(keys))
    return child.join(known, list(keys), "left_anti")


def join_quality(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str] | None = None
) -> DataFrame:
    """Coverage, explosion and missing ratios, one row per join type, from key counts only.

    The join itself is never produced: both sides shrink to one row per key first. A side's
    null ratio is the share of output rows in which its columns are empty.
    """
    right_keys = list(right_keys or left_keys)
    names = [f"_k{i}" for i in range(len(left_keys))]

    def counts(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        keyed = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
        return keyed.groupBy(*names).agg(F.count(F.lit(1)).alias(name))

    # A key with a missing part matches nothing, as in a join.
    both = counts(left, left_keys, "l").join(counts(right, right_keys, "r"), names, "full")
    l, r = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    hit = (l > 0) & (r > 0)
    totals = both.agg(
        F.sum(l).alias("left_rows"),
        F.sum(r).alias("right_rows"),
        F.sum(F.when(hit, l).otherwise(0)).alias("left_matched"),
        F.sum(F.when(hit, r).otherwise(0)).alias("right_matched"),
        # Products of row counts outgrow a bigint long before the tables do.
        F.coalesce(F.sum(l.cast("decimal(19,0)") * r.cast("decimal(19,0)")), F.lit(0)).cast("decimal(38,0)").alias("inner_rows"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    left_only = F.col("left_rows") - F.col("left_matched")
    right_only = F.col("right_rows") - F.col("right_matched")
    extra = {"inner": (0, 0), "left": (left_only, 0), "right": (0, right_only), "full": (left_only, right_only)}

    def outcome(how: str) -> Column:
        alone_left, alone_right = (F.lit(0) if isinstance(e, int) else e for e in extra[how])
        output = F.col("inner_rows") + alone_left + alone_right
        return F.struct(
            F.lit(how).alias("join_type"),
            output.cast("decimal(38,0)").alias("output_rows"),
            ratio(output.cast("double"), F.greatest("left_rows", "right_rows", F.lit(1))).alias("explosion"),
            ratio(alone_right.cast("double"), output.cast("double")).alias("left_null_ratio"),
            ratio(alone_left.cast("double"), output.cast("double")).alias("right_null_ratio"),
        )

    return totals.select(
        "left_rows",
        "right_rows",
        ratio(F.col("left_matched"), F.col("left_rows")).alias("left_coverage"),
        ratio(F.col("right_matched"), F.col("right_rows")).alias("right_coverage"),
        ratio(left_only, F.col("left_rows")).alias("left_missing"),
        ratio(right_only, F.col("right_rows")).alias("right_missing"),
        F.inline(F.array(*[outcome(how) for how in extra])),
    )


def search_around(
    sources: DataFrame, links: DataFrame, targets: DataFrame, source_key: str, target_key: str,
    link_source: str, link_target: str,
) -> DataFrame:
    """Distinct target rows linked from the source set; two semi joins, no fan-out."""
    followed = links.join(sources.select(F.col(source_key).alias(link_source)), link_source, "left_semi")
    return targets.join(followed.select(F.col(link_target).alias(target_key)), target_key, "left_semi")


def link_rows(
    sources: DataFrame, links: DataFrame, source_key: str, link_source: str, link_target: str, link: str, target_type: str
) -> DataFrame:
    """The links of the source rows, one row each: (source key, ``link``, ``target_type``, ``target``), distinct.

    Rows, not lists: a source with any number of links stays plain to join with. Links without a
    target are none; sources without links have no row.
    """
    pairs = links.select(F.col(link_source).alias(source_key), F.col(link_target).alias("target")).dropna()
    followed = pairs.join(sources.select(source_key), source_key, "left_semi").distinct()
    return followed.select(source_key, F.lit(link).alias("link"), F.lit(target_type).alias("target_type"), "target")


def load_links(
    sources: DataFrame, links: DataFrame, source_key: str, link_source: str, link_target: str, chunk: int = 10_000
) -> DataFrame:
    """Per source row its distinct link targets, in sorted lists of bounded size."""
    followed = links.join(sources.select(F.col(source_key).alias(link_source)), link_source, "left_semi")
    return chunked_lists(followed, [link_source], link_target, "targets", chunk)


def range_join(
    points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``points`` with ``low <= point < high`` of ``spans``, by numeric cells of ``width``.

    Each span is listed once per cell it touches, so the join is an equi join on the cell.
    """
    cell = F.floor(F.col(point) / F.lit(width)).cast("bigint")
    first = F.floor(F.col(low) / F.lit(width)).cast("bigint")
    last = F.floor(F.col(high) / F.lit(width)).cast("bigint")
    spread = spans.filter(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(first, last)))
    matched = points.withColumn("_cell", cell).join(spread, [*keys, "_cell"])
    return matched.filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_cell")
