"""Profiles, type inference, cleansing advice and relationships between columns. Full data."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import casts
from loomframe.functions.text import value_pattern
from loomframe.operators.aggregates import stacked

# Thresholds and name hints of the cleansing advice.
CAST_AT, WHITESPACE_AT, EMPTY_AT = 0.9, 0.05, 0.1
DUPLICATE_ROWS_AT, CASE_AT, NOISE_AT = 0.1, 0.15, 0.2
KEEP_WHITESPACE = (
    "code", "script", "json", "xml", "html", "yaml", "yml", "query", "sql", "expression", "formula", "template",
    "content", "body", "text", "description", "comment", "note", "address", "snippet", "source", "raw",
)
LOG_TABLES = (
    "log", "event", "audit", "history", "trace", "metric", "transaction", "activity", "record", "journal", "change",
)
DOMAINS = (
    ("email", ("email", "e_mail"), r"\s"),
    ("phone", ("phone", "mobile", "tel", "cell"), r"[^0-9+]"),
    ("postal", ("zip", "postal", "postcode"), r"[\s-]"),
)
# Name hints that a column refers to another table, with their confidence, and
# names that never do.
REFERENCE_NAMES = (
    (r"_id$", 0.75),
    (r"_fk$", 0.95),
    (r"_key$", 0.70),
    (r"^fk_", 0.95),
    (r"_ref$", 0.85),
    (r"_code$", 0.60),
    (r"id$", 0.70),
    (r"fk$", 0.90),
)
NEVER_REFERENCES = (
    r"created_at|updated_at|deleted_at|^is_|^has_|^can_|_at$|_date$|_time$|^count_|_count$|^total_|_total$"
)
LIKELY = 0.95


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, missing, empty, blank, distinct and numeric min, max, mean.

    Counts come from one wide aggregate; distinct values from one grouping of the long form,
    which shrinks map-side.
    """
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)
    sums: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        v, is_text = F.col(c), kinds[c] == "string"
        number = v.try_cast("double") if is_text else v.cast("double") if _numeric(kinds[c]) else F.lit(None).cast("double")
        sums += [
            F.count_if(v.isNull()).alias(f"_null{i}"),
            (F.count_if(v == "") if is_text else F.lit(0).cast("bigint")).alias(f"_empty{i}"),
            (F.count_if((v != "") & v.rlike(r"^\s+$")) if is_text else F.lit(0).cast("bigint")).alias(f"_blank{i}"),
            F.min(number).alias(f"_min{i}"),
            F.max(number).alias(f"_max{i}"),
            F.avg(number).alias(f"_mean{i}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("_rows").alias("rows"),
            F.col(f"_null{i}").alias("null_count"),
            F.col(f"_empty{i}").alias("empty_count"),
            F.col(f"_blank{i}").alias("whitespace_count"),
            F.col(f"_min{i}").alias("min"),
            F.col(f"_max{i}").alias("max"),
            F.col(f"_mean{i}").alias("mean"),
        )
        for i, c in enumerate(columns)
    ]
    wide = df.agg(*sums).select(F.inline(F.array(*rows)))
    values = stacked(df, columns).filter(F.col("value") != "").distinct()
    distinct = values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    return wide.join(distinct, "column", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))


def _numeric(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def infer_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, suggested_type, confidence, values, bool/int/decimal/datetime ratios) in one pass.

    The first of boolean, integer, decimal, dateTime that at least 95 % of the values parse
    as wins; otherwise string.
    """
    kinds = {"bool": "boolean", "int": "integer", "decimal": "decimal", "datetime": "dateTime"}
    # The long form keeps the expressions few; counts combine map-side to one row per column.
    values = stacked(df, columns).filter(~casts.is_blank(F.col("value")))
    read = values.withColumn("_n", casts.number_kinds(F.col("value")))
    counted = read.groupBy("column").agg(
        F.count(F.lit(1)).alias("values"),
        F.count_if(casts.is_bool_like(F.col("value"))).alias("bool"),
        F.count_if("_n.integer").alias("int"),
        F.count_if("_n.decimal").alias("decimal"),
        F.count_if(casts.is_datetime_like(F.col("value"))).alias("datetime"),
    )
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    ratios = named.join(counted, "column", "left").select(
        "column",
        F.coalesce("values", F.lit(0)).alias("values"),
        *[F.coalesce(F.try_divide(n, "values"), F.lit(0.0)).alias(n) for n in kinds],
    )
    kind, confidence = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0.0))
    for n, name in kinds.items():
        kind, confidence = kind.when(F.col(n) >= LIKELY, F.lit(name)), confidence.when(F.col(n) >= LIKELY, F.col(n))
    return ratios.select(
        "column",
        kind.otherwise("string").alias("suggested_type"),
        F.round(confidence.otherwise(F.greatest(*kinds)), 3).alias("confidence"),
        "values",
        *[F.round(n, 3).alias(f"{n}_ratio") for n in kinds],
    )


def cleansing_metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column the ratios behind the cleansing advice."""
    inferred = infer_types(df, columns).select(
        "column",
        "values",
        *[F.col(f"{a}_ratio").alias(b) for a, b in (("bool", "boolean"), ("int", "integer"), ("decimal", "decimal"), ("datetime", "dateTime"))],
    )
    sums = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        v = F.col(c).cast("string")
        noise = next((p for _, hints, p in DOMAINS if any(h in c.lower() for h in hints)), None)
        sums += [
            F.count_if(v == "").alias(f"_empty{i}"),
            F.count_if((v != "") & v.rlike(r"^\s+$")).alias(f"_blank{i}"),
            (F.count_if(v.rlike(noise)) if noise else F.lit(0).cast("bigint")).alias(f"_noise{i}"),
            F.count(F.nullif(v, F.lit(""))).alias(f"_given{i}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.try_divide(F.col(f"_empty{i}"), F.col("_rows")).alias("empty_ratio"),
            F.try_divide(F.col(f"_blank{i}"), F.col("_rows")).alias("whitespace_ratio"),
            F.coalesce(F.try_divide(F.col(f"_noise{i}"), F.col(f"_given{i}")), F.lit(0.0)).alias("noise_ratio"),
        )
        for i, c in enumerate(columns)
    ]
    ratios = df.agg(*sums).select(F.inline(F.array(*rows)))
    spellings = stacked(df, columns).filter(F.trim("value") != "").distinct()
    lowered = spellings.groupBy("column", F.lower("value").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cases = lowered.groupBy("column").agg((1 - F.count(F.lit(1)) / F.sum("n")).alias("case_variation"))
    return inferred.join(ratios, "column").join(cases, "column", "left").withColumn(
        "case_variation", F.coalesce(F.round("case_variation", 4), F.lit(0.0))
    )


def cleansing_advice(df: DataFrame, columns: Sequence[str], table_name: str = "") -> DataFrame:
    """Rows (column, operation, detail): what to tidy, from the metrics of the whole table."""
    metrics = cleansing_metrics(df, columns)
    keep = [c for c in columns if any(h in c.lower() for h in KEEP_WHITESPACE)]
    domain = {c: d for c in columns for d, hints, _ in reversed(DOMAINS) if any(h in c.lower() for h in hints)}
    dirty = (F.col("whitespace_ratio") >= WHITESPACE_AT) | (F.col("empty_ratio") >= EMPTY_AT)
    kinds = ("boolean", "integer", "decimal", "dateTime")
    score = F.greatest(*kinds)
    best = F.when(F.lit(False), F.lit(""))
    for k in kinds:
        best = best.when(F.col(k) == score, F.lit(k))
    cleaners = {"email": r"\s+", "phone": r"[^0-9+]+", "postal": r"[\s-]+"}
    cleaner = F.when(F.lit(False), F.lit(""))
    for c, d in domain.items():
        cleaner = cleaner.when(F.col("column") == c, F.lit(cleaners[d]))

    def advice(test: Column, operation: str, detail: Column) -> Column:
        return F.when(test, F.struct(F.lit(operation).alias("operation"), detail.alias("detail")))

    protected = F.col("column").isin(*keep) if keep else F.lit(False)
    options = F.array_compact(
        F.array(
            advice(dirty & ~protected, "normalize", F.lit("trim, empty and blank to missing")),
            advice(dirty & protected, "keep_whitespace", F.lit("blank runs may carry meaning")),
            advice(score >= CAST_AT, "cast", best),
            advice(F.col("case_variation") >= CASE_AT, "lowercase", F.col("case_variation").cast("string")),
            advice((F.col("noise_ratio") >= NOISE_AT) & cleaner.isNotNull(), "regex_replace", cleaner),
        )
    )
    per_column = metrics.select("column", F.explode(options).alias("_a")).select("column", "_a.*")
    repeated = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.try_divide(F.sum(F.col("_n") - 1), F.sum("_n")).alias("ratio")
    )
    operation = "keep_duplicates" if any(h in table_name.lower() for h in LOG_TABLES) else "dedupe"
    rows = repeated.filter(F.col("ratio") >= DUPLICATE_ROWS_AT).select(
        F.lit("").alias("column"), F.lit(operation).alias("operation"), F.round("ratio", 4).cast("string").alias("detail")
    )
    return per_column.unionByName(rows)


def pattern_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, pattern, count, ratio, dominant): classes of the non-missing values."""
    counted = (
        stacked(df, columns)
        .filter(F.col("value").isNotNull())
        .groupBy("column", value_pattern(F.col("value")).alias("pattern"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counted.groupBy("column").agg(
        F.sum("count").alias("_total"), F.min_by("pattern", F.struct(-F.col("count"), F.col("pattern"))).alias("_top")
    )
    return counted.join(totals, "column").select(
        "column",
        "pattern",
        "count",
        F.round(F.col("count") / F.col("_total"), 4).alias("ratio"),
        (F.col("pattern") == F.col("_top")).alias("dominant"),
    )


def name_hints(columns: Sequence[str]) -> dict[str, list[str]]:
    """What the column names suggest."""
    rules = (
        ("possible_foreign_key", r"^id$|_id$|id$"),
        ("likely_temporal", r"created_at|updated_at|timestamp|time|date|_at"),
        ("possibly_sensitive", r"email|phone|ssn|social|address"),
        ("likely_boolean", r"^is_|^has_|^flag|_flag$"),
        ("likely_categorical", r"status|state|type|category|tier|level"),
    )
    return {c: [hint for hint, pattern in rules if re.search(pattern, c.lower())] for c in columns}


def semantic_hints(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, hint) from names, plus ``likely_identifier`` where the values agree."""
    named = name_hints(columns)
    pairs = [F.struct(F.lit(c).alias("column"), F.lit(h).alias("hint")) for c in columns for h in named[c]]
    dominant = pattern_distribution(df, columns).filter("dominant").select("column", "pattern")
    references = [c for c in columns if "possible_foreign_key" in named[c]]
    from_values = dominant.filter(
        F.col("column").isin(*references, "") & F.col("pattern").isin("uuid", "sequential_id")
    ).select("column", F.lit("likely_identifier").alias("hint"))
    if not pairs:
        return from_values
    from_names = df.sparkSession.range(1).select(F.inline(F.array(*pairs)))
    return from_names.unionByName(from_values)


def _folded(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.nullif(F.lower(F.trim(F.col(column).cast("string"))), F.lit("")).alias("v"))


def column_relationship(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """Null and unique ratios, shared values and containment both ways, from value counts."""

    def counts(df: DataFrame, column: str, name: str) -> DataFrame:
        # A missing value gets its own group with v = NULL.
        return _folded(df, column).groupBy("v").agg(F.count(F.lit(1)).alias(name))

    both = counts(left, left_column, "l").join(counts(right, right_column, "r"), "v", "full")
    l, r = F.col("l"), F.col("r")
    known = F.col("v").isNotNull()
    t = both.agg(
        F.sum(l).alias("l_rows"),
        F.sum(r).alias("r_rows"),
        F.sum(F.when(~known, l)).alias("l_null"),
        F.sum(F.when(~known, r)).alias("r_null"),
        F.count_if(known & l.isNotNull()).alias("l_distinct"),
        F.count_if(known & r.isNotNull()).alias("r_distinct"),
        F.count_if(known & l.isNotNull() & r.isNotNull()).alias("shared"),
    ).na.fill(0)

    def ratio(a: Column, b: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)

    c = {n: F.col(n) for n in t.columns}
    return t.select(
        ratio(c["l_null"], c["l_rows"]).alias("left_null_ratio"),
        ratio(c["r_null"], c["r_rows"]).alias("right_null_ratio"),
        ratio(c["l_distinct"], c["l_rows"] - c["l_null"]).alias("left_unique_ratio"),
        ratio(c["r_distinct"], c["r_rows"] - c["r_null"]).alias("right_unique_ratio"),
        c["shared"].alias("intersection_count"),
        ratio(c["shared"], c["l_distinct"]).alias("left_containment"),
        ratio(c["shared"], c["r_distinct"]).alias("right_containment"),
    )


def unmatched_values(left: DataFrame, left_column: str, right: DataFrame, right_column: str, k: int) -> DataFrame:
    """The first ``k`` values that only one side has: (side, value)."""
    a, b = (_folded(df, c).dropna().distinct() for df, c in ((left, left_column), (right, right_column)))
    only = [x.join(y, "v", "left_anti").sort("v").limit(k).select(F.lit(s).alias("side"), F.col("v").alias("value"))
            for s, x, y in (("left", a, b), ("right", b, a))]
    return only[0].unionByName(only[1])


def reference_candidates(
    sources: Mapping[str, tuple[DataFrame, Sequence[str]]],
    targets: Mapping[str, tuple[DataFrame, str]],
    threshold: float = 0.7,
) -> DataFrame:
    """Columns whose values look like keys of a target table, with confidence above ``threshold``.

    Confidence is 0.7 * share of source values found + 0.3 * cardinality factor. All columns are
    stacked into one (column, value) set; one shuffle by value finds every overlap, and each
    value carries at most as many columns as the schemas have.
    """
    named = [
        stacked(df, columns).select(F.concat(F.lit(f"{name}."), "column").alias("column"), "value", F.lit(False).alias("is_key"))
        for name, (df, columns) in sources.items()
    ] + [
        df.select(F.lit(f"{name}.{key}").alias("column"), F.col(key).cast("string").alias("value"), F.lit(True).alias("is_key"))
        for name, (df, key) in targets.items()
    ]
    pairs = reduce(DataFrame.unionByName, named).dropna(subset=["value"]).distinct()
    sizes = pairs.groupBy("column", "is_key").agg(F.count(F.lit(1)).alias("size"))
    per_value = pairs.groupBy("value").agg(
        F.collect_list(F.when(~F.col("is_key"), F.col("column"))).alias("s"),
        F.collect_list(F.when(F.col("is_key"), F.col("column"))).alias("t"),
    )
    overlaps = (
        per_value.filter((F.size("s") > 0) & (F.size("t") > 0))
        .select(F.explode("s").alias("source"), "t")
        .select("source", F.explode("t").alias("target"))
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    source_sizes = sizes.filter(~F.col("is_key")).select(F.col("column").alias("source"), F.col("size").alias("ns"))
    target_sizes = sizes.filter(F.col("is_key")).select(F.col("column").alias("target"), F.col("size").alias("nt"))
    ratio = F.col("nt") / F.col("ns")
    factor = F.when(ratio <= 1.0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.5), 1 - (ratio - 1) * 0.1))
    scored = overlaps.join(source_sizes, "source").join(target_sizes, "target").withColumn(
        "confidence", F.least(F.lit(1.0), 0.7 * F.col("shared") / F.col("ns") + 0.3 * factor)
    )
    return scored.filter((F.col("confidence") > threshold) & (F.col("source") != F.col("target"))).select(
        "source", "target", "shared", F.round("confidence", 6).alias("confidence")
    )


def references_by_name(columns: Sequence[str], tables: Sequence[str]) -> list[tuple[str, str | None, float]]:
    """(column, table, confidence) from names alone; a table that fits raises the confidence."""
    found = []
    for column in columns:
        if re.search(NEVER_REFERENCES, column, re.I):
            continue
        options = []
        for pattern, confidence in REFERENCE_NAMES:
            if re.search(pattern, column, re.I):
                stem = re.sub(pattern, "", column, flags=re.I).lower().replace("_", "")
                fits = [t for t in tables if stem and (stem in t.lower().replace("_", "") or t.lower().replace("_", "") in stem)]
                options.append((min(1.0, confidence * (1.2 if fits else 0.8)), fits[0] if fits else None))
        if options:
            confidence, table = max(options, key=lambda o: o[0])
            found.append((column, table, round(confidence, 4)))
    return found
