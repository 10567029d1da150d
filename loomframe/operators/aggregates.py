"""Grouping, buckets, pivots, histograms and distribution similarity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.transforms import top_per_group

FOLDS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def aggregate(df: DataFrame, keys: Sequence[str], metrics: Sequence[Mapping[str, str]]) -> DataFrame:
    """Metrics ``{column, op, alias}``; the alias defaults to ``op_column``. No keys: one row."""
    made = []
    for m in metrics:
        column = m.get("column", "*")
        target = F.lit(1) if column == "*" else F.col(column)
        made.append(FOLDS[m["op"]](target).alias(m.get("alias") or f"{m['op']}_{column}"))
    return df.groupBy(*keys).agg(*made)


def aggregate_expressions(df: DataFrame, keys: Sequence[str], expressions: Mapping[str, str]) -> DataFrame:
    """Any Spark SQL aggregate per alias."""
    return df.groupBy(*keys).agg(*[F.expr(e).alias(a) for a, e in expressions.items()])


def metric(kind: str, column: str | None = None, fraction: float | None = None) -> Column:
    """One aggregate by name; fractions are clamped to 0..1."""
    if kind == "count":
        return F.count(F.lit(1) if column is None else F.col(column))
    if kind == "exactDistinct":
        return F.count_distinct(F.col(column))
    if kind == "approximateDistinct":
        return F.approx_count_distinct(column)
    if kind == "approximatePercentile":
        return F.percentile_approx(column, min(max(fraction or 0.0, 0.0), 1.0))
    return FOLDS[kind](F.col(column))


def group_exact(
    df: DataFrame, column: str, metrics: Mapping[str, Column] | None = None, *, max_groups: int
) -> DataFrame:
    """The most frequent values with their count and metrics."""
    made = [m.alias(a) for a, m in (metrics or {}).items()]
    grouped = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"), *made)
    return grouped.sort(F.desc("count"), F.col(column)).limit(max_groups)


def group_fixed_width(
    df: DataFrame, column: str, width: float, metrics: Mapping[str, Column] | None = None
) -> DataFrame:
    """Counts per bucket ``[k*width, (k+1)*width)``, empty buckets between the ends included.

    The two ends reach the driver; the buckets between them are made by all tasks.
    """
    made = {a: m for a, m in (metrics or {}).items()}
    step = F.floor(F.col(column) / F.lit(width)).cast("bigint")
    filled = (
        df.filter(F.col(column).isNotNull())
        .withColumn("_step", step)
        .groupBy("_step")
        .agg(F.count(F.lit(1)).alias("count"), *[m.alias(a) for a, m in made.items()])
    )
    ends = df.agg(F.min(step).alias("low"), F.max(step).alias("high")).first()
    known = ends.low is not None
    spine = df.sparkSession.range(ends.low if known else 0, ends.high + 1 if known else 0).withColumnRenamed("id", "_step")
    return spine.join(filled, "_step", "left").select(
        (F.col("_step") * F.lit(width)).alias("bucket"), F.coalesce("count", F.lit(0)).alias("count"), *made
    )


def range_label(low: Any, high: Any) -> str:
    def text(v: Any) -> str:
        return "*" if v is None else str(v)

    return f"{text(low)}-{text(high)}"


def group_ranges(
    df: DataFrame, column: str, ranges: Sequence[tuple[Any, Any]], metrics: Mapping[str, Column] | None = None
) -> DataFrame:
    """Counts per range, from inclusive to exclusive. Ranges may overlap: a row counts in each.

    One conditional aggregate per range, so rows are neither copied nor joined.
    """
    value = F.col(column)
    made = metrics or {}
    tests = []
    for low, high in ranges:
        test = value.isNotNull()
        if low is not None:
            test &= value >= F.lit(low)
        if high is not None:
            test &= value < F.lit(high)
        tests.append((range_label(low, high), test))
    if not made:
        one = df.agg(*[F.count_if(test).alias(f"r{i}") for i, (_, test) in enumerate(tests)])
        rows = [F.struct(F.lit(label).alias("range"), F.col(f"r{i}").alias("count")) for i, (label, _) in enumerate(tests)]
        return one.select(F.inline(F.array(*rows)))
    labels = F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in tests]))
    listed = df.withColumn("range", F.explode(labels))
    return listed.groupBy("range").agg(F.count(F.lit(1)).alias("count"), *[m.alias(a) for a, m in made.items()])


def group_nested(df: DataFrame, columns: Sequence[str], max_groups: int) -> DataFrame:
    """Up to three nested dimensions, each level keeping its most frequent values."""
    if not 1 <= len(columns) <= 3:
        raise ValueError("one to three grouping columns")
    counted = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))
    kept = counted
    for level in range(1, len(columns) + 1):
        head, parents = list(columns[:level]), list(columns[: level - 1])
        totals = kept.groupBy(*head).agg(F.sum("count").alias("_total"))
        if parents:
            best = top_per_group(totals, parents, ["-_total", head[-1]], max_groups, "_rank")
        else:
            best = totals.sort(F.desc("_total"), head[-1]).limit(max_groups)
        kept = kept.join(best.select(*head), head, "left_semi")
    return kept


def pivot(
    df: DataFrame, index: Sequence[str], columns: str, values: str, how: str = "sum", known: Sequence[Any] | None = None
) -> DataFrame:
    """Values of ``columns`` become columns; pass ``known`` values to save the discovery job."""
    grouped = df.groupBy(*index).pivot(columns, list(known)) if known else df.groupBy(*index).pivot(columns)
    return grouped.agg(F.count(F.lit(1)) if how == "count" else FOLDS[how](F.col(values)))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width counts; at most as many bins as values, one bin for a constant, last bin closed."""
    shape = df.agg(
        F.struct(
            F.min(column).cast("double").alias("low"),
            F.max(column).cast("double").alias("high"),
            F.least(F.count(column), F.lit(bins)).cast("int").alias("bins"),
        ).alias("shape")
    )
    constant = F.col("shape.low") == F.col("shape.high")
    spine = (
        shape.filter(F.col("shape.bins") > 0)
        .select("shape", F.when(constant, F.lit(1)).otherwise(F.col("shape.bins")).alias("n"))
        .select("shape", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))
    )
    width = (F.col("shape.high") - F.col("shape.low")) / F.col("n")
    spine = spine.select(
        "bin",
        (F.col("shape.low") + width * F.col("bin")).alias("start"),
        (F.col("shape.low") + width * (F.col("bin") + 1)).alias("end"),
    )
    known = df.select(F.col(column).cast("double").alias("_x"), shape.scalar().alias("shape")).filter("_x IS NOT NULL")
    step = (F.col("shape.high") - F.col("shape.low")) / F.col("shape.bins")
    at = F.when(constant, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("_x") - F.col("shape.low"), step)).cast("int"), F.col("shape.bins") - 1)
    )
    counts = known.select(at.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return spine.join(counts, "bin", "left").select("bin", "start", "end", F.coalesce("count", F.lit(0)).alias("count"))


def stacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form (column, value) with values as text."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def top_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The ``k`` most frequent non-empty values of each column; ties by value."""
    counted = stacked(df, columns).filter(F.col("value") != "").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    return top_per_group(counted, ["column"], ["-count", "value"], k)


def _tidy(column: Column) -> Column:
    return F.lower(F.trim(column.cast("string")))


def numeric_similarity(source: DataFrame, source_column: str, target: DataFrame, target_column: str, points: int = 20) -> DataFrame:
    """0.5 * (1 - largest CDF gap) + 0.3 * mean + 0.2 * spread, on min-max scaled values."""

    def shape(df: DataFrame, column: str) -> DataFrame:
        x = F.col(column).cast("double")
        ends = df.agg(F.struct(F.min(x).alias("low"), F.max(x).alias("high")).alias("e")).scalar()
        scaled = df.select(x.alias("_x"), ends.alias("_e")).select(
            F.try_divide(F.col("_x") - F.col("_e.low"), F.col("_e.high") - F.col("_e.low")).alias("s")
        )
        cdf = [F.avg(F.when(F.col("s").isNotNull(), (F.col("s") <= i / points).cast("double"))) for i in range(points)]
        return scaled.agg(
            F.struct(
                F.array(*cdf).alias("cdf"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("std"), F.count("s").alias("n")
            ).alias("shape")
        )

    one = shape(source, source_column).select(
        F.col("shape").alias("a"), shape(target, target_column).scalar().alias("b")
    )
    gap = F.array_max(F.zip_with("a.cdf", "b.cdf", lambda p, q: F.abs(p - q)))
    score = (
        0.5 * (1 - gap)
        + 0.3 * (1 - F.abs(F.col("a.mean") - F.col("b.mean")))
        + 0.2 * (1 - F.abs(F.col("a.std") - F.col("b.std")))
    )
    enough = (F.col("a.n") >= 5) & (F.col("b.n") >= 5)
    return one.select(F.coalesce(F.when(enough, score), F.lit(0.0)).alias("similarity"))


def categorical_similarity(source: DataFrame, source_column: str, target: DataFrame, target_column: str, k: int) -> DataFrame:
    """0.6 * Jaccard + 0.4 * overlap of the ``k`` most frequent values."""

    def most(df: DataFrame, column: str, name: str) -> DataFrame:
        values = df.select(_tidy(F.col(column)).alias("v")).dropna()
        return values.groupBy("v").agg(F.count(F.lit(1)).alias("n")).sort(F.desc("n"), "v").limit(k).select("v", F.lit(1).alias(name))

    both = most(source, source_column, "a").join(most(target, target_column, "b"), "v", "full")
    counts = both.agg(F.count("a").alias("a"), F.count("b").alias("b"), F.count(F.col("a") + F.col("b")).alias("both"))
    union = F.col("a") + F.col("b") - F.col("both")
    score = 0.6 * F.try_divide("both", union) + 0.4 * F.try_divide(F.col("both"), F.least("a", "b"))
    return counts.select(F.coalesce(score, F.lit(0.0)).alias("similarity"))


def string_similarity(source: DataFrame, source_column: str, target: DataFrame, target_column: str) -> DataFrame:
    """0.7 * cosine of character trigram counts + 0.3 * likeness of mean lengths, on all rows."""

    def trigrams(df: DataFrame, column: str, name: str) -> DataFrame:
        text = df.select(_tidy(F.col(column)).alias("t")).filter(F.length("t") >= 3)
        # Equal texts are cut up once and weighted by their count.
        text = text.groupBy("t").agg(F.count(F.lit(1)).alias("w"))
        starts = F.sequence(F.lit(1), F.length("t") - 2)
        grams = text.select("w", F.explode(F.transform(starts, lambda i: F.substr("t", i, F.lit(3)))).alias("g"))
        return grams.groupBy("g").agg(F.sum("w").cast("double").alias(name))

    def mean_length(df: DataFrame, column: str) -> Column:
        return df.agg(F.avg(F.length(_tidy(F.col(column)))).alias("m")).scalar()

    both = trigrams(source, source_column, "a").join(trigrams(target, target_column, "b"), "g", "full")
    sums = both.agg(
        F.sum(F.col("a") * F.col("b")).alias("dot"),
        F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"),
        F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"),
    ).withColumns({"la": mean_length(source, source_column), "lb": mean_length(target, target_column)})
    cosine = F.try_divide(F.col("dot"), F.col("na") * F.col("nb"))
    lengths = 1 - F.abs(F.col("la") - F.col("lb")) / F.greatest("la", "lb")
    return sums.select(F.when(F.col("dot").isNull(), F.lit(0.0)).otherwise(0.7 * cosine + 0.3 * lengths).alias("similarity"))

