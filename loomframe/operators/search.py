"""Object search: collapse, filter, order, page, aggregate; and access policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.skew import latest
from loomframe.operators.transforms import page


def collapse(
    df: DataFrame, identity: Sequence[str], updated: str, overlay: str, sequence: str, tombstone: str
) -> DataFrame:
    """Newest copy of every object by (update time, overlay, sequence), without deleted ones.

    Rows without an identity pass through.
    """
    unkeyed = reduce(Column.__or__, [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in identity[-1:]])
    ranked = df.withColumns({"_t": F.coalesce(F.col(updated).cast("string"), F.lit("")), "_q": F.coalesce(F.col(sequence).cast("bigint"), F.lit(-1))})
    newest = latest(ranked.filter(~unkeyed), identity, ["_t", overlay, "_q"])
    alive = newest.filter(~F.coalesce(F.col(tombstone), F.lit(False)))
    return alive.unionByName(ranked.filter(unkeyed)).drop("_t", "_q")


def search_objects(
    df: DataFrame, where: Column | None, order_by: Sequence[str], key: str, select: Sequence[str], size: int, offset: int = 0
) -> DataFrame:
    """Filter, total order with the key as tie-break, one page, chosen columns."""
    found = df if where is None else df.filter(where)
    return page(found, order_by, key, size, offset).select(key, *[c for c in select if c != key])


def aggregate_objects(
    df: DataFrame, where: Column | None, group_by: Sequence[str], metrics: Mapping[str, Column]
) -> DataFrame:
    found = df if where is None else df.filter(where)
    return found.groupBy(*group_by).agg(*[m.alias(a) for a, m in metrics.items()])


def object_set(frames: Mapping[str, DataFrame], order_by: Sequence[str], size: int) -> DataFrame:
    """Objects of several types together, labelled by type, in order."""
    parts = [f.withColumn("object_type", F.lit(kind)) for kind, f in frames.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.sort(*order_by).limit(size)


def saved_query(df: DataFrame, options: Mapping[str, Any], parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """A stored object query with bound parameters: where, order, columns, size."""
    from loomframe.operators.transforms import bind, sort

    if options.get("where"):
        df = df.filter(bind(options["where"], parameters))
    if options.get("order_by"):
        df = sort(df, options["order_by"])
    if options.get("size"):
        df = df.limit(int(options["size"]))
    return df.select(*options["select"]) if options.get("select") else df


def _rule(df: DataFrame, field: str, op: str, value: Any) -> Column:
    if field not in df.columns:
        # An absent field behaves as missing.
        c = F.lit(None).cast("string")
        array = False
    else:
        c = F.col(field)
        array = dict(df.dtypes)[field].startswith("array")
    values = list(value) if isinstance(value, (list, tuple, set)) else [value]
    given = [v for v in values if v is not None]
    within = F.coalesce(c.isin(*given), F.lit(False)) if given else F.lit(False)
    if None in values:
        within = within | c.isNull()
    rules = {
        "is_null": lambda: c.isNull(),
        "not_null": lambda: c.isNotNull(),
        "eq": lambda: c.eqNullSafe(F.lit(value)),
        "ne": lambda: ~c.eqNullSafe(F.lit(value)),
        "gt": lambda: c > F.lit(value),
        "gte": lambda: c >= F.lit(value),
        "lt": lambda: c < F.lit(value),
        "lte": lambda: c <= F.lit(value),
        "in": lambda: within,
        "not_in": lambda: ~within,
        "contains": lambda: F.array_contains(c, F.lit(value)) if array else F.contains(c.cast("string"), F.lit(str(value))),
    }
    made = rules.get(op.lower())
    return F.coalesce(made(), F.lit(False)) if made else F.lit(False)


def policy_condition(
    df: DataFrame, rules: Sequence[tuple[str, str, Any]], operator: str = "and", mode: str = "allow"
) -> Column:
    """Rules ``(field, op, value)``. Missing values compare as values; unknown ops never match."""
    made = [_rule(df, *r) for r in rules]
    if not made:
        matches = F.lit(True)
    else:
        matches = reduce(Column.__or__ if operator == "or" else Column.__and__, made)
    return ~matches if mode == "deny" else matches


def apply_policy(
    df: DataFrame,
    rules: Sequence[tuple[str, str, Any]] = (),
    operator: str = "and",
    mode: str = "allow",
    mask: Sequence[str] = (),
    mask_value: Any = None,
) -> DataFrame:
    """Allowed rows with the listed columns replaced by the mask value, in the type of the column.

    A mask value that the type cannot hold fails the query.
    """
    kinds = dict(df.dtypes)
    hidden = {c: F.lit(mask_value).cast(kinds[c]) for c in mask if c in kinds}
    kept = df.filter(policy_condition(df, rules, operator, mode))
    return kept.withColumns(hidden) if hidden else kept


def policy_report(
    df: DataFrame,
    rules: Sequence[tuple[str, str, Any]] = (),
    operator: str = "and",
    mode: str = "allow",
    mask: Sequence[str] = (),
) -> DataFrame:
    """Rows kept back and cells masked, in one pass."""
    allowed = policy_condition(df, rules, operator, mode)
    cells = len([c for c in mask if c in df.columns])
    return df.agg(
        F.count_if(~allowed).alias("filtered"), (F.count_if(allowed) * F.lit(cells)).alias("masked_fields")
    )
