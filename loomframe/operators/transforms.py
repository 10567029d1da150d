"""Projections, filters and row shaping."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions import casts

BOM = "﻿"
FAR_FUTURE = "9999-12-31 00:00:00"


def free_name(wanted: str, taken: set[str]) -> str:
    """``wanted``, or ``wanted__1``, ``wanted__2`` … when it is taken."""
    if wanted not in taken:
        return wanted
    n = 1
    while f"{wanted}__{n}" in taken:
        n += 1
    return f"{wanted}__{n}"


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def select_expr(df: DataFrame, expressions: Sequence[str]) -> DataFrame:
    return df.selectExpr(*expressions)


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; unknown sources are skipped and a taken name gets a ``__n`` suffix."""
    current = list(df.columns)
    plain = {c.lstrip(BOM): c for c in current}
    for source, target in names.items():
        source = source if source in current else plain.get(source.lstrip(BOM), source)
        target = target.lstrip(BOM)
        if source not in current or source == target:
            continue
        at = current.index(source)
        current[at] = free_name(target, set(current))
    return df.toDF(*current)


_PLACEHOLDER = re.compile(r"\{\{\s*(\w+)\s*\}\}|\$(\w+)")


def bind(expression: str, parameters: Mapping[str, Any] | None = None) -> Column:
    """SQL expression with ``$name`` / ``{{name}}`` replaced by literals, safely quoted."""
    values = dict(parameters or {})

    def literal(match: re.Match[str]) -> str:
        name = match.group(1) or match.group(2)
        if name not in values:
            return match.group(0)
        value = values[name]
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, (int, float)):
            return repr(value)
        quoted = str(value).replace("\\", "\\\\").replace("'", "\\'")
        return f"'{quoted}'"

    return F.expr(_PLACEHOLDER.sub(literal, expression))


def where(df: DataFrame, expression: str, parameters: Mapping[str, Any] | None = None) -> DataFrame:
    return df.filter(bind(expression, parameters))


def split(df: DataFrame, expression: str, name: str = "branch") -> DataFrame:
    """Label each row ``true``, ``false`` or ``null`` by the predicate, in one pass."""
    p = F.expr(expression)
    return df.withColumn(name, F.when(p, "true").when(~p, "false").otherwise("null"))


def split_branches(df: DataFrame, expression: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(true, false, undecided) branches; the third holds rows whose predicate is NULL."""
    p = F.expr(expression)
    return df.filter(p), df.filter(~p), df.filter(p.isNull())


_ASSIGNMENT = re.compile(r"^\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.+)$", re.S)


def compute(df: DataFrame, formula: str, parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """``target = expression``, or a bare expression that fills the column ``computed``."""
    match = _ASSIGNMENT.match(formula)
    target, expression = match.groups() if match else ("computed", formula)
    return df.withColumn(target, bind(expression, parameters))


def compute_many(df: DataFrame, assignments: Sequence[tuple[str, str]]) -> DataFrame:
    """Assignments in order; a later one may use an earlier one. Catalyst folds the projections."""
    for target, expression in assignments:
        df = df.withColumn(target, F.expr(expression))
    return df


def cast(df: DataFrame, types: Mapping[str, str], policy: str = "SAFE_NULL") -> DataFrame:
    """Cast columns; SAFE_NULL turns bad values into NULL, STRICT fails on them."""
    how = casts.strict_cast if policy.upper() == "STRICT" else casts.safe_cast
    return df.withColumns({c: how(F.col(c), kind) for c, kind in types.items()})


def cast_statistics(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """(column, attempted, failed, failure_rate) for all casts in one pass."""
    sums: list[Column] = []
    for c, kind in types.items():
        given = ~casts.is_blank(F.col(c))
        sums.append(F.count_if(given).alias(f"{c}__given"))
        sums.append(F.count_if(given & casts.safe_cast(F.col(c), kind).isNull()).alias(f"{c}__failed"))
    one = df.agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.col(f"{c}__given").alias("attempted"), F.col(f"{c}__failed").alias("failed")
            )
            for c in types
        ]
    )
    return one.select(F.explode(rows).alias("r")).select(
        "r.*", F.coalesce(F.try_divide("r.failed", "r.attempted"), F.lit(0.0)).alias("failure_rate")
    )


def normalize(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    trim: bool = True,
    case: str | None = None,
    empty_to_null: bool = True,
    whitespace_to_null: bool = True,
) -> DataFrame:
    """Tidy string columns in one projection; other types stay as they are."""
    kinds = dict(df.dtypes)
    chosen = [c for c in (columns or df.columns) if kinds.get(c) == "string"]

    def tidy(c: str) -> Column:
        value = F.trim(F.col(c)) if trim else F.col(c)
        value = {"lower": F.lower, "upper": F.upper}.get(case or "", lambda v: v)(value)
        if whitespace_to_null:
            value = F.when(~value.rlike(r"^\s+$"), value)
        if empty_to_null:
            value = F.nullif(value, F.lit(""))
        return value

    return df.withColumns({c: tidy(c) for c in chosen}) if chosen else df


def regex_replace(df: DataFrame, rules: Sequence[Mapping[str, str]]) -> DataFrame:
    """Rules ``{column, pattern, replacement, flags}`` applied in order; flags from ``ims``."""
    for rule in rules:
        flags = "".join(f for f in rule.get("flags", "") if f in "ims")
        pattern = (f"(?{flags})" if flags else "") + rule["pattern"]
        column = rule["column"]
        df = df.withColumn(column, F.regexp_replace(column, pattern, rule.get("replacement", "")))
    return df


def explode(df: DataFrame, column: str, *, outer: bool = False, position: str | None = None) -> DataFrame:
    """One row per array element, in place. Empty and missing arrays vanish unless ``outer``."""
    if position is None:
        maker = F.explode_outer if outer else F.explode
        return df.withColumn(column, maker(column))
    maker = F.posexplode_outer if outer else F.posexplode
    others = [c for c in df.columns if c != column]
    return df.select(*others, maker(column).alias(position, column)).select(*df.columns, position)


def dedupe(df: DataFrame, keys: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per key; with ``order_by`` the smallest row survives, else any."""
    if not keys:
        return df.distinct()
    if not order_by:
        return df.dropDuplicates(list(keys))
    from loomframe.operators.skew import earliest

    return earliest(df, keys, order_by)


def _sort_key(spec: str | Mapping[str, str]) -> Column:
    if isinstance(spec, str):
        return F.col(spec[1:]).desc() if spec.startswith("-") else F.col(spec).asc()
    descending = spec.get("direction", "asc").lower() == "desc"
    return F.col(spec["column"]).desc() if descending else F.col(spec["column"]).asc()


def sort(df: DataFrame, by: Sequence[str | Mapping[str, str]]) -> DataFrame:
    """Sort; missing values first ascending and last descending."""
    return df.sort(*[_sort_key(s) for s in by])


def page(df: DataFrame, by: Sequence[str], key: str, size: int, offset: int = 0) -> DataFrame:
    """A page of a total order: the sort columns, then the row key."""
    ordered = sort(df, [*by, key])
    return (ordered.offset(offset) if offset else ordered).limit(size)


def after(df: DataFrame, by: Sequence[str], last: Sequence[Any], size: int) -> DataFrame:
    """Keyset page: the next ``size`` rows strictly after ``last`` in ascending order of ``by``."""
    return df.filter(beyond(by, last)).sort(*by).limit(size)


def beyond(columns: Sequence[str], last: Sequence[Any]) -> Column:
    """Lexicographic ``(c1, c2, …) > (v1, v2, …)`` with the leading bound kept pushable."""
    condition = F.col(columns[-1]) > F.lit(last[-1])
    for name, value in reversed(list(zip(columns[:-1], last[:-1]))):
        condition = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & condition)
    if len(columns) > 1:
        condition = (F.col(columns[0]) >= F.lit(last[0])) & condition
    return condition


def project(df: DataFrame, wanted: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """The wanted columns, always with the identity columns in front."""
    return df.select(*identity, *[c for c in wanted if c not in identity and c in df.columns])


def align(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Exactly these columns in this order; missing ones become typed NULLs."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items()])


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of ``name=value`` pairs in name order; independent of column order."""
    pairs = [
        F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__NULL__"))) for c in sorted(columns)
    ]
    return F.sha2(F.concat_ws("||", *pairs), 256)


def system_columns(df: DataFrame, source: str, ingested_at: Column) -> DataFrame:
    """Source, load time, validity interval, delete flag and record hash."""
    return df.withColumns(
        {
            "_sys_source": F.lit(source),
            "_sys_ingested_at": ingested_at,
            "_sys_is_deleted": F.lit(False),
            "_sys_valid_from": ingested_at,
            "_sys_valid_to": F.lit(FAR_FUTURE).cast("timestamp"),
            "_sys_record_hash": F.sha2(F.to_json(F.struct(*df.columns)), 256),
        }
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; each map task keeps at most ``k`` per group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*[_sort_key(o) for o in order])
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
