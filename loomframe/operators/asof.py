"""As-of join: for every left row the best right row of the same key near its event time.

The seconds of both sides are merged into one time-ordered scan per key that carries the last
(or next) right row, so no pairs are produced and a busy key is spread over time slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.joins import _right_names
from loomframe.operators.skew import TASK_ROWS, running_before

DIRECTIONS = ("backward", "forward", "symmetric")


def _seconds(df: DataFrame, name: str) -> Column:
    """Whole epoch seconds, floored."""
    return F.floor(F.unix_micros(df[name].cast("timestamp")) / 1_000_000).cast("bigint")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    *,
    lateness: float,
    left_cache: float,
    right_cache: float,
    direction: str = "backward",
    how: str = "full",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Best right row per left row, then the unmatched rows that ``how`` asks for.

    A right row qualifies within ``lateness`` and both cache times of the left row, on the
    side that ``direction`` names; deltas count whole seconds. The nearest wins, then the
    smallest right id. Rows with a missing time match only when no timed match exists. A
    right row that is nobody's best match counts as unmatched.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    if lateness < 0 or left_cache <= 0 or right_cache <= 0:
        raise ValueError("lateness must be >= 0 and cache times > 0")
    reach = min(lateness, left_cache, right_cache)
    names = _right_names(left, right, set(keys))
    output = [*left.columns, *[names.get(c, c) for c in right.columns if c not in keys]]
    seconds = _seconds(left, left_time)
    lefts = left.select(*keys, seconds.alias("_sec"), F.struct(*left.columns).alias("_l"))
    rights = right.select(*keys, _seconds(right, right_time).alias("_sec"), F.struct(*right.columns).alias("_r"))
    # One row per key and second: whether the left side has it, and the right row with the
    # smallest id, the only one of that second that can win. Left rows stay out of the scan.
    none = F.lit(None).cast(rights.schema["_r"].dataType)
    instants = (
        lefts.select(*keys, "_sec", F.lit(True).alias("_asked"), none.alias("_r"))
        .unionByName(rights.select(*keys, "_sec", F.lit(False).alias("_asked"), "_r"))
        .filter(F.col("_sec").isNotNull())
        .groupBy(*keys, "_sec")
        .agg(F.max("_asked").alias("_asked"), F.min_by("_r", f"_r.{right_id}").alias("_r"))
    )
    asked = lefts.select(*keys, "_sec").unionByName(rights.select(*keys, "_sec")).filter(F.col("_sec").isNotNull())
    found: list[Column] = []
    for name, order in (("_back", ["_sec"]), ("_next", ["-_sec"])):
        if direction in ("symmetric", "backward" if name == "_back" else "forward"):
            entry = F.when(F.col("_r").isNotNull(), F.struct("_sec", "_r"))
            instants = running_before(instants, keys, order, entry, "last", name, task_rows, True, asked)
            near = F.abs(F.col("_sec") - F.col(f"{name}._sec"))
            ranked = F.struct(near.alias("d"), F.col(f"{name}._r.{right_id}").alias("id"), F.col(f"{name}._r").alias("r"))
            found.append(F.when(near <= F.lit(reach), ranked))
    # Nearest first, then the smaller right id: exactly the struct's field order.
    best = found[0] if len(found) == 1 else F.least(*found)
    answers = instants.filter("_asked").select(*keys, "_sec", best.getField("r").alias("_r"))
    matched = lefts.filter(F.col("_sec").isNotNull()).join(answers, [*keys, "_sec"], "left").select(*keys, "_sec", "_l", "_r")
    matched = matched.unionByName(
        lefts.filter(F.col("_sec").isNull()).withColumn("_r", F.lit(None).cast(rights.schema["_r"].dataType))
    )
    matched = _fill_without_time(matched, rights, keys, right_id, direction)

    left_part = [F.col(f"_l.{c}").alias(c) for c in left.columns]
    right_part = [F.col(f"_r.{c}").alias(names.get(c, c)) for c in right.columns if c not in keys]
    result = matched if how in ("left", "full") else matched.filter(F.col("_r").isNotNull())
    result = result.select(*left_part, *right_part)
    if how in ("right", "full"):
        used = matched.filter(F.col("_r").isNotNull()).select(F.col(f"_r.{right_id}").alias(right_id)).distinct()
        alone = right.join(used, right_id, "left_anti")
        kinds = dict(left.dtypes)
        empty_left = [F.col(c) if c in keys else F.lit(None).cast(kinds[c]).alias(c) for c in left.columns]
        renamed = [F.col(c).alias(names.get(c, c)) for c in right.columns if c not in keys]
        result = result.unionByName(alone.select(*empty_left, *renamed))
    return result.select(*output)


def _fill_without_time(
    matched: DataFrame, rights: DataFrame, keys: Sequence[str], right_id: str, direction: str
) -> DataFrame:
    """Fallback where either time is missing: one candidate row per key for each case."""
    rid = F.col(f"_r.{right_id}")
    untimed = F.col("_sec").isNull()
    if direction == "backward":  # latest time first, missing last
        order = F.struct(untimed, F.negate(F.col("_sec")), rid)
    elif direction == "forward":
        order = F.struct(untimed, F.col("_sec"), rid)
    else:
        order = F.struct(rid)
    options = rights.groupBy(*keys).agg(
        F.min_by("_r", order).alias("_any"),
        F.min_by("_r", F.when(untimed, rid)).alias("_untimed"),
    )
    spare = F.when(F.col("_sec").isNull(), F.col("_any")).otherwise(F.col("_untimed"))
    return matched.join(options, list(keys), "left").select(
        *keys, "_sec", "_l", F.coalesce("_r", spare).alias("_r")
    )
