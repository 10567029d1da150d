"""Claims about a table or a transform, checked on all rows; every function lists witnesses.

An empty result means that the claim holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import casts

NORMALIZATIONS = (
    "trim",
    "lowercase",
    "uppercase",
    "collapse_whitespace",
    "strip_leading_zeros",
    "strip_trailing_zeros",
    "normalize_integer",
    "normalize_decimal",
    "normalize_datetime",
    "normalize_date",
)


def primary_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that are missing or occur more than once: (keys…, reason, rows)."""
    gap = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return groups.filter(gap | (F.col("rows") > 1)).select(
        *keys, F.when(gap, F.lit("null")).otherwise(F.lit("duplicate")).alias("reason"), "rows"
    )


def functional_right(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right-side join keys that would match more than one row; missing keys never match."""
    groups = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return groups.filter(F.col("rows") > 1)


def filter_removes_only_nulls(
    before: DataFrame, after: DataFrame, column: str, empty_is_null: bool = False, blank_is_null: bool = False
) -> DataFrame:
    """Values of ``column`` that lost rows though they are not missing, with both counts."""
    tagged = before.select(F.col(column).alias("value"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        after.select(F.col(column).alias("value"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    counts = tagged.groupBy("value").agg(F.sum("i").alias("input_count"), F.sum("o").alias("output_count"))
    missing = F.col("value").isNull()
    if empty_is_null:
        missing = missing | (F.col("value").cast("string") == "")
    if blank_is_null:
        missing = missing | F.col("value").cast("string").rlike(r"^\s+$")
    return counts.filter((F.col("output_count") < F.col("input_count")) & ~missing)


def retain_rate(before: DataFrame, after: DataFrame, minimum: float) -> DataFrame:
    """One row when fewer than ``minimum`` of the rows remain."""
    rows = before.agg(F.count(F.lit(1)).alias("input_rows")).withColumn(
        "output_rows", after.agg(F.count(F.lit(1))).scalar()
    )
    rate = F.coalesce(F.try_divide("output_rows", "input_rows"), F.lit(1.0))
    return rows.withColumn("retain_rate", F.round(rate, 6)).filter(rate + 1e-12 < minimum)


def union_lossless(inputs: Sequence[DataFrame], output: DataFrame) -> DataFrame:
    """Input rows that occur less often in the output than in the inputs together."""
    columns = output.columns
    parts = [i.select(*columns).withColumns({"_i": F.lit(1), "_o": F.lit(0)}) for i in inputs]
    parts.append(output.withColumns({"_i": F.lit(0), "_o": F.lit(1)}))
    counts = reduce(DataFrame.unionByName, parts).groupBy(*columns).agg(
        F.sum("_i").alias("input_count"), F.sum("_o").alias("output_count")
    )
    return counts.filter(F.col("output_count") < F.col("input_count"))


def cast_success(df: DataFrame, keys: Sequence[str], types: Mapping[str, str]) -> DataFrame:
    """Cells that are given but do not parse: (keys…, column, value)."""
    failed = [
        F.when(
            ~casts.is_blank(F.col(c)) & casts.safe_cast(F.col(c), kind).isNull(),
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")),
        )
        for c, kind in types.items()
    ]
    return df.select(*keys, F.explode(F.array_compact(F.array(*failed))).alias("_f")).select(*keys, "_f.*")


def plain_decimal(c: Column) -> Column:
    """Number as plain text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def normalized(c: Column, rules: Sequence[str]) -> Column:
    """Text after the allowed normalizations, in order."""
    unknown = [r for r in rules if r not in NORMALIZATIONS]
    if unknown:
        raise ValueError(f"unknown normalizations: {unknown}")
    for rule in rules:
        if rule == "trim":
            c = casts.strip(c)
        elif rule == "lowercase":
            c = F.lower(c)
        elif rule == "uppercase":
            c = F.upper(c)
        elif rule == "collapse_whitespace":
            c = casts.strip(F.regexp_replace(c, r"\s+", " "))
        elif rule == "strip_leading_zeros":
            c = F.regexp_replace(c, r"^([+-]?)0+(\d+)$", "$1$2")
        elif rule == "strip_trailing_zeros":
            c = F.regexp_replace(F.regexp_replace(c, r"^([+-]?\d+\.\d*?)0+$", "$1"), r"^([+-]?\d+)\.$", "$1")
        elif rule == "normalize_integer":
            c = F.coalesce(casts.parse_integer(c).cast("string"), c)
        elif rule == "normalize_decimal":
            c = F.coalesce(plain_decimal(casts.parse_decimal(c)), c)
        elif rule == "normalize_datetime":
            c = F.coalesce(F.date_format(casts.parse_datetime(c)["value"], "yyyy-MM-dd'T'HH:mm:ss"), c)
        elif rule == "normalize_date":
            c = F.coalesce(F.date_format(casts.parse_datetime(c)["value"], "yyyy-MM-dd"), c)
    return c


def _written(c: Column, kind: str) -> Column:
    """A cast value written back as text."""
    if kind == "decimal":
        made = plain_decimal(c)
    elif kind == "timestamp":
        made = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        made = c.cast("string")
    return F.coalesce(made, F.lit(""))


def cast_lossless(df: DataFrame, keys: Sequence[str], types: Mapping[str, str], rules: Sequence[str]) -> DataFrame:
    """Cells whose cast fails or whose round trip differs: (keys…, column, original, roundtrip)."""
    if not rules:
        raise ValueError("say which normalizations are allowed")
    found = []
    for c, kind in types.items():
        value = casts.safe_cast(F.col(c), kind)
        original, back = F.col(c).cast("string"), _written(value, kind)
        failed = ~casts.is_blank(F.col(c)) & value.isNull()
        differs = normalized(original, rules) != normalized(back, rules)
        row = F.struct(F.lit(c).alias("column"), original.alias("original"), back.alias("roundtrip"))
        found.append(F.when(F.col(c).isNotNull() & (failed | differs), row))
    return df.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("_f")).select(*keys, "_f.*")
