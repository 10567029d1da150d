"""Schema drift between two versions of a table, and what it does to the rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions import casts
from loomframe.operators.quality import contract_type

# Types that can hold every value of the key type.
WIDER = {
    "integer": {"integer", "decimal", "string"},
    "decimal": {"decimal", "string"},
    "string": {"string"},
    "boolean": {"boolean", "string"},
    "date": {"date", "dateTime", "string"},
    "dateTime": {"dateTime", "string"},
}
SEVERITY = {"data_loss": "breaking", "mapping_invalid": "breaking", "type_mismatch": "warning", "warning": "warning"}
CAST_KINDS = {"integer": "integer", "decimal": "decimal", "boolean": "boolean", "date": "date", "dateTime": "timestamp"}


def type_impact(old: str, new: str) -> str:
    if new in WIDER.get(old, set()):
        return "none"
    return "type_mismatch" if old in WIDER.get(new, set()) else "data_loss"


def schema_changes(
    old: Mapping[str, str], new: Mapping[str, str], critical: Sequence[str] = (), similar: float = 0.8
) -> list[dict[str, str]]:
    """Added, removed, renamed and retyped columns with their impact and severity."""

    def is_critical(name: str) -> bool:
        return any(re.search(p, name.lower()) for p in critical)

    removed = [c for c in old if c not in new]
    added = [c for c in new if c not in old]
    renamed: dict[str, str] = {}
    for c in removed:
        options = [(SequenceMatcher(None, c.lower(), a.lower()).ratio(), a) for a in added if new[a] == old[c]]
        ratio, best = max(options, default=(0.0, ""))
        if ratio >= similar:
            renamed[c] = best
    changes = []

    def note(kind: str, column: str, was: str, now: str, impact: str) -> None:
        changes.append(
            {"change": kind, "column": column, "old": was, "new": now, "impact": impact, "severity": SEVERITY.get(impact, "info")}
        )

    for c, a in renamed.items():
        note("column_renamed", c, c, a, "mapping_invalid" if is_critical(c) else "warning")
    for c in removed:
        if c not in renamed:
            note("column_removed", c, old[c], "", "data_loss" if is_critical(c) else "mapping_invalid")
    for c in added:
        if c not in renamed.values():
            note("column_added", c, "", new[c], "none")
    for c in old:
        if c in new and old[c] != new[c]:
            note("type_changed", c, old[c], new[c], type_impact(old[c], new[c]))
    return changes


def drift(old: DataFrame, new: DataFrame, critical: Sequence[str] = ()) -> DataFrame:
    """Schema changes plus, for changed types, how many old values the new type would lose.

    The value counts of all changed columns come from one pass over the old version.
    """
    kinds = [{c: contract_type(t) for c, t in df.dtypes} for df in (old, new)]
    changes = schema_changes(kinds[0], kinds[1], critical)
    sums = [F.count(F.lit(1)).alias("_rows")]
    for i, change in enumerate(changes):
        lost = F.lit(False)
        if change["change"] == "type_changed" and change["new"] in CAST_KINDS:
            c = F.col(change["column"])
            lost = ~casts.is_blank(c) & casts.safe_cast(c, CAST_KINDS[change["new"]]).isNull()
        elif change["change"] == "column_removed":
            lost = F.col(change["column"]).isNotNull()
        sums.append(F.count_if(lost).alias(f"_lost{i}"))
    rows = [
        F.struct(
            *[F.lit(change[k]).alias(k) for k in ("change", "column", "old", "new", "impact", "severity")],
            F.col(f"_lost{i}").alias("values_lost"),
        )
        for i, change in enumerate(changes)
    ]
    if not rows:
        empty = "change string, column string, old string, new string, impact string, severity string, values_lost bigint"
        return old.sparkSession.createDataFrame([], empty)
    return old.agg(*sums).select(F.inline(F.array(*rows)))


def overall_severity(changes: DataFrame) -> DataFrame:
    """(drift, severity): mixed or the only kind, and the worst severity."""
    kinds = F.collect_set("change")
    return changes.agg(
        F.when(F.size(kinds) > 1, F.lit("mixed")).otherwise(F.element_at(kinds, 1)).alias("drift"),
        F.when(F.count_if(F.col("severity") == "breaking") > 0, F.lit("breaking"))
        .when(F.count_if(F.col("severity") == "warning") > 0, F.lit("warning"))
        .otherwise(F.lit("info"))
        .alias("severity"),
    )
