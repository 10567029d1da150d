"""Mixing sources to target weights by capped water-filling.

``water_fill`` shares a total among sources by weight, clamps every source at its maximum number of
epochs and shares the excess again until nothing is above its clamp. ``take`` then repeats whole
epochs and samples the fractional one: a seeded hash orders the documents of a source, and the
beginning of that order whose size comes nearest to the fraction is taken once more. The place
where it ends is found by histograms of the hash, a few bits finer each time, so no source is ever
sorted or windowed, however many rows it has.

Missing texts have size 0; a missing source is a source of its own, the last in order. Rows with the
same id and text share a hash; where the cut falls among them, as many of them are taken as come
nearest to the target, dealt as counted copies, not ordered in one task. Ties of hashes go by size. Texts of
any length are counted whole. Empty tables give empty results. Extra columns are kept; those named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.operators.skew import running_before
from loomframe.session import materialize

BLANKS = " \t\n\x0b\f\r"
BITS, LEVEL = 48, 12  # of the hash, and of one histogram
COPIES = 1 << 14  # equal rows that one part of a run writes out


def word_count(text: Column | str) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for a missing text."""
    bare = F.btrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("bigint")


def water_fill(sources: DataFrame, total: float, epochs: float) -> DataFrame:
    """Add ``target`` to (source, size, weight): shares of ``total`` by weight, none above ``epochs`` sizes.

    Each round is one small aggregate; only its three numbers reach the driver.
    """
    cap = F.col("size").cast("double") * F.lit(float(epochs))
    weight = F.col("weight").cast("double")
    rate, clamped = 0.0, -1
    while True:
        over = F.lit(False) if clamped < 0 else weight * F.lit(rate) > cap
        row = sources.agg(
            F.sum(F.when(over, cap)).alias("fixed"), F.sum(F.when(~over, weight)).alias("free"), F.count_if(over).alias("n")
        ).first()
        if row.n == clamped or not row.free:
            break
        rate, clamped = (float(total) - (row.fixed or 0.0)) / row.free, row.n
    full = F.lit(not row.free)
    return sources.withColumn("target", F.when(full, cap).otherwise(F.least(cap, weight * F.lit(rate))))


def hashed(seed: int, *columns: str) -> Column:
    """A seeded number of BITS bits from the text of the columns; missing counts as empty."""
    parts = [F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, BITS // 4), 16, 10).cast("bigint")


def cut_points(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of ``plan`` (source, extra) the hash ``cut`` where the once more taken rows end, and its ``shares``.

    ``sized`` has source, size, u. A histogram of 2**LEVEL places per source finds the place where
    the running size passes ``extra``; the next one looks only into that place. Rows below ``cut`` are
    taken. ``shares`` lists, for each size of the rows at ``cut``, how many of their ``n`` are (``k``).
    """
    state = plan.select("source", "extra", F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("below"))
    for left in range(BITS - LEVEL, -1, -LEVEL):
        width = F.lit(1 << left).cast("bigint")
        near = sized.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        near = near.filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("low") + width * (1 << LEVEL)))
        place = F.floor((F.col("u") - F.col("low")) / width).cast("bigint")
        counts = near.groupBy(F.col("s.source").alias("source"), "extra", "low", "below", place.alias("place"))
        counts = counts.agg(F.sum("size").alias("size"))
        upto = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        run = counts.withColumn("upto", F.col("below") + F.sum("size").over(upto))
        # The first place that passes the target; if none does, the last one.
        passed = F.when(F.col("upto") >= F.col("extra"), F.struct("place", "upto", "size", "low"))
        picked = run.groupBy("source", "extra").agg(
            F.coalesce(F.min(passed), F.max(F.struct("place", "upto", "size", "low"))).alias("p")
        )
        state = materialize(
            picked.select(
                "source",
                "extra",
                (F.col("p.low") + F.col("p.place") * width).alias("low"),
                (F.col("p.upto") - F.col("p.size")).cast("bigint").alias("below"),
            ),
            "mix-cut",
        )
    there = sized.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("u") == F.col("low")))
    sizes = there.groupBy(F.col("s.source").alias("source"), "extra", "low", "below", "d.size").agg(F.count(F.lit(1)).alias("n"))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("below") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(smaller), F.lit(0))
    gap = F.col("extra") - F.col("before")
    full = F.floor(gap / F.nullif("size", F.lit(0)))  # rows that fit; one more if that comes nearer
    k = full + ((full + 1) * F.col("size") - gap <= gap - full * F.col("size")).cast("bigint")
    k = F.when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.greatest(k, F.lit(0)), F.col("n")))
    shares = sizes.withColumn("before", before).withColumn("k", F.when(F.col("extra") > 0, k).otherwise(0).cast("bigint"))
    cuts = shares.groupBy("source", "extra", "low").agg(F.array_sort(F.collect_list(F.struct("size", "k", "n"))).alias("shares"))
    return cuts.select("source", F.when(F.col("extra") > 0, F.col("low")).otherwise(-1).alias("cut"), "shares")


def _divided(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of which ``_k`` of a ``_group`` are taken once more (``_more``): counted as equal ones, spread again in parts.

    Which of several rows that differ in other columns is settled by a hash of the whole row.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_order", F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))
    counted = materialize(counted, "mix-equal")
    placed = running_before(counted, keys, ["_order"], F.col("_n"), "sum", "_before")
    more = F.least(F.greatest(F.col("_k") - F.coalesce("_before", F.lit(0)), F.lit(0)), F.col("_n"))
    runs = F.array(F.struct(F.lit(1).alias("more"), more.alias("n")), F.struct(F.lit(0).alias("more"), (F.col("_n") - more).alias("n")))
    runs = placed.select(*columns, F.explode(runs).alias("_run")).filter("_run.n > 0")
    parts = runs.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_run.n") - 1) / COPIES))))
    parts = parts.repartition(*keys, "_part", "_run")
    copies = F.least(F.lit(COPIES).cast("bigint"), F.col("_run.n") - F.col("_part") * COPIES)
    out = parts.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    return out.select(*columns, F.col("_run.more").cast("bigint").alias("_more"))


def take(docs: DataFrame, weights: DataFrame, share: float, epochs: float, seed: int, text: str = "text") -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``epochs`` (times the mix repeats the row) and ``taken``.

    ``docs`` has doc_id, source and the text; ``weights`` has one row per source and its weight. The
    mix takes ``share`` of all sizes. Sizes and hashes are worked out once and written narrow.
    """
    size, u = word_count(text), hashed(seed, "doc_id", text)
    sized = materialize(docs.select("source", size.alias("size"), u.alias("u")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"))
    of = totals.alias("t").join(weights.alias("w"), F.col("t.source").eqNullSafe(F.col("w.source")), "left")
    sources = materialize(of.select("t.source", "t.size", F.coalesce("w.weight", F.lit(0.0)).cast("double").alias("weight")), "mix-sources")
    total = sources.agg(F.sum("size")).first()[0] or 0
    filled = water_fill(sources, share * total, epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("bigint")
    filled = filled.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("size"))
    cuts = cut_points(sized, filled)
    plan = filled.alias("f").join(cuts.alias("c"), F.col("f.source").eqNullSafe(F.col("c.source")), "left").select(
        F.col("f.source").alias("_source"),
        F.col("f.size").alias("source_size"),
        "target",
        F.col("whole").alias("_whole"),
        F.coalesce("cut", F.lit(-1)).alias("_cut"),
        "shares",
    )
    plan = materialize(plan.withColumnRenamed("shares", "_shares"), "mix-plan")
    made = ("size", "source_size", "target", "epochs", "taken")
    rows = docs.select(*[c for c in docs.columns if c not in made], size.alias("size"), u.alias("_u"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    share = F.filter("_shares", lambda s: s["size"] == F.col("size"))[0]
    at_cut = F.col("_u") == F.col("_cut")
    # Of equal rows at the cut all, none or some are taken; some is rare, so those are dealt apart only where there are any.
    parted = F.exists("_shares", lambda s: (s["k"] > 0) & (s["k"] < s["n"]))
    if plan.filter(parted).isEmpty():
        rows = rows.withColumn("_more", ((F.col("_u") < F.col("_cut")) | (at_cut & (share["k"] > 0))).cast("bigint"))
    else:
        split = F.coalesce(at_cut & (share["k"] > 0) & (share["k"] < share["n"]), F.lit(False))
        rest = rows.filter(~split).withColumn("_more", ((F.col("_u") < F.col("_cut")) | (at_cut & (share["k"] > 0))).cast("bigint"))
        some = rows.filter(split).withColumn("_k", share["k"])
        rows = rest.unionByName(_divided(some, ["_source", "size"]).drop("_k"))
    rows = rows.withColumn("epochs", F.col("_whole") + F.coalesce("_more", F.lit(0)))
    return rows.withColumn("taken", F.col("size") * F.col("epochs")).drop("_source", "_whole", "_cut", "_shares", "_u", "_more")


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """Weights ``cycle`` repeated over the sources by code point, a missing source last.

    Ranks the list of distinct sources, not documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source").distinct().withColumn("_rank", rank).select(
        "source", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), F.col("_rank") % len(cycle) + 1).alias("weight")
    )
