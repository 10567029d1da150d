"""Rows to typed entities: mapping, coercion, keys, ids, references and links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import casts
from loomframe.functions.casts import is_blank, let, strip
from loomframe.operators.skew import chunked_lists

# Currency signs and words around amounts, and the namespace of derived ids.
CURRENCY_SIGNS = "$€£₩₹₽₺฿₫₱₪¥￥"
CURRENCY_WORDS = ("人民币", "人民幣", "원화", "원", "元", "円")
ID_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"

ERRORS = "array<struct<field:string,code:string>>"
NUMERIC = ("integer", "long", "decimal", "float", "double")


def _amount(c: Column) -> Column:
    """Plain number text with an optional minus, or NULL."""
    words = "|".join(CURRENCY_WORDS)

    def bare(raw: Column) -> Column:
        body = F.regexp_replace(raw, r"^\(\s*|\s*\)$", "")
        negative = raw.rlike(r"^\(.*\)$") | body.startswith("-")
        body = strip(F.regexp_replace(strip(F.regexp_replace(body, r"^[+-]", "")), "%$", ""))
        body = strip(F.regexp_replace(body, rf"^[{CURRENCY_SIGNS}]|[{CURRENCY_SIGNS}]$", ""))
        body = strip(F.regexp_replace(body, rf"^({words})|({words})$", ""))
        body = F.regexp_replace(body, r"^[A-Za-z]{3}\s+|\s+[A-Za-z]{3}$", "")
        return F.struct(F.regexp_replace(body, r"[ _]", "").alias("b"), negative.alias("n"))

    def plain(t: Column) -> Column:
        b = t["b"]
        comma, dot = b.contains(","), b.contains(".")
        none = F.lit("")
        number = (
            F.when(comma & dot & b.rlike(r"\.[^.]*,[^.]*$"), F.replace(F.replace(b, F.lit("."), none), F.lit(","), F.lit(".")))
            .when(comma & dot, F.replace(b, F.lit(","), none))
            .when(comma & b.rlike(r"^[^,]*(,[^,]{3})+$"), F.replace(b, F.lit(","), none))
            .when(comma, F.replace(b, F.lit(","), F.lit(".")))
            .when(b.rlike(r"\..*\."), F.replace(b, F.lit("."), none))
            .otherwise(b)
        )
        return let(number, lambda n: F.when(n.rlike(r"^\d+(\.\d+)?$"), F.when(t["n"], F.concat(F.lit("-"), n)).otherwise(n)))

    return let(let(strip(c.cast("string")), bare), plain)


def coerce(c: Column, kind: str) -> Column:
    """Cell to its target type; NULL when it is blank or does not fit."""
    raw = c.cast("string")
    if kind in ("string", "anyURI"):
        return F.when(~is_blank(c), raw)
    if kind == "boolean":
        return casts.safe_cast(c, "boolean")
    if kind == "date":
        day = F.regexp_replace(F.regexp_extract(strip(raw), r"^([^T ]*)", 1), "[/.]", "-")
        day = F.regexp_replace(day, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
        return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date"))
    if kind == "dateTime":
        iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?)?$"
        return F.when(strip(raw).rlike(iso), strip(raw).try_cast("timestamp"))
    if kind in ("integer", "long"):
        return let(_amount(c), lambda n: F.when(n.rlike(r"^-?\d+(\.0*)?$"), F.regexp_replace(n, r"\..*$", "").try_cast("bigint")))
    if kind in NUMERIC:
        return _amount(c).try_cast("double")
    if kind == "json":
        return F.when(F.try_parse_json(raw).isNotNull(), raw)
    raise ValueError(f"unsupported target type: {kind}")


def _error(test: Column, field: str, code: str) -> Column:
    return F.when(test, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))


def map_rows(
    df: DataFrame,
    mappings: Sequence[tuple[str, str, str]],
    required: Sequence[str] = (),
    keys: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Typed entity columns plus ``errors``; rows without any value are left out.

    Mappings are ``(source, target, type)``. When two map to one target, the later one that
    has a value wins. Cells that do not fit and missing required or key fields are errors of
    a row that has any value at all; nothing is dropped because of them.
    """
    values: dict[str, list[Column]] = {}
    problems: list[Column] = []
    for source, target, kind in mappings:
        if source not in df.columns:
            problems.append(_error(F.lit(True), target, "SOURCE_FIELD_UNKNOWN"))
            continue
        made = coerce(F.col(source), kind)
        values.setdefault(target, []).insert(0, made)
        problems.append(_error(~is_blank(F.col(source)) & made.isNull(), target, "TYPE_COERCION_FAILED"))
    typed = {t: F.coalesce(*made) if len(made) > 1 else made[0] for t, made in values.items()}
    missing = [(f, "PRIMARY_KEY_MISSING" if f in keys else "REQUIRED_FIELD_MISSING") for f in [*keys, *[r for r in required if r not in keys]]]
    staged = df.select(*keep, *[v.alias(t) for t, v in typed.items()], F.array_compact(F.array(*problems)).cast(ERRORS).alias("errors"))
    any_value = reduce(Column.__or__, [F.col(t).isNotNull() for t in typed])
    gaps = [_error(F.col(f).isNull() if f in typed else F.lit(True), f, code) for f, code in missing]
    whole = F.concat("errors", F.array_compact(F.array(*gaps)).cast(ERRORS)) if gaps else F.col("errors")
    return staged.filter(any_value | (F.size("errors") > 0)).select(
        *keep, *typed, F.when(any_value, whole).otherwise(F.col("errors")).alias("errors")
    )


def valid_rows(mapped: DataFrame) -> DataFrame:
    return mapped.filter(F.size("errors") == 0).drop("errors")


def error_rows(mapped: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per error."""
    return mapped.select(*keep, F.inline("errors"))


def row_key(fields: Sequence[str], origin: str = "target") -> Column:
    """``target:v1|v2`` text, NULL when any part is blank. For display; joins use the columns."""
    blank = reduce(Column.__or__, [is_blank(F.col(f)) for f in fields])
    return F.when(~blank, F.concat(F.lit(f"{origin}:"), F.concat_ws("|", *[F.col(f).cast("string") for f in fields])))


def instance_ids(
    df: DataFrame, class_id: str, key: Column, seed: str, version: int = 1, id_field: str | None = None
) -> DataFrame:
    """``instance_id``: the declared id, else any ``*_id`` column, else one derived from the key.

    The derived id is the class name with the first 12 hex digits of a name-based UUID, which
    are those of SHA-1 over namespace and name.
    """
    declared = id_field or f"{class_id.lower()}_id"
    options = [c for c in [declared, *[c for c in df.columns if c.endswith("_id") and c != declared]] if c in df.columns]
    name = F.concat(F.lit(f"objectify:{seed}:{version}:"), key)
    digest = F.sha1(F.concat(F.unhex(F.lit(ID_NAMESPACE.replace("-", ""))), F.encode(name, "UTF-8")))
    made = F.concat(F.lit(f"{class_id.lower()}_"), F.substring(digest, 1, 12))
    given = [F.when(~is_blank(F.col(c)), F.col(c).cast("string")) for c in options]
    return df.withColumn("instance_id", F.coalesce(*given, made))


def duplicate_rows(df: DataFrame, keys: Sequence[str], order: str, name: str = "is_duplicate") -> DataFrame:
    """Mark every row after the first of its key; ``order`` is unique. Rows without key are first."""
    firsts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.min(order).alias("_first"))
    marked = df.join(firsts, list(keys), "left")
    return marked.withColumn(name, F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).select(*df.columns, name)


def reference(c: Column, target_class: str) -> Column:
    """struct(ref, error): ``Class/id`` text from an id or a reference."""
    raw = strip(c.cast("string"))
    named = raw.contains("/")
    cls, rest = F.substring_index(raw, "/", 1), F.regexp_extract(raw, r"^[^/]*/(.*)$", 1)
    error = (
        F.when(c.isNull() | (raw == ""), F.lit("EMPTY"))
        .when(named & (cls != target_class), F.lit("TARGET_MISMATCH"))
        .when(named & (strip(rest) == ""), F.lit("EMPTY_ID"))
    )
    text = F.concat(F.lit(f"{target_class}/"), F.when(named, rest).otherwise(raw))
    return F.struct(F.when(error.isNull(), text).alias("ref"), error.alias("error"))


def build_links(
    df: DataFrame, source: str, target: str, predicate: str, targets: DataFrame, target_key: str, dangling: str = "SKIP"
) -> DataFrame:
    """Distinct edges (src, dst, predicate, dangling).

    SKIP leaves edges without a target out, WARN keeps them flagged, FAIL raises when any exists.
    """
    edges = df.select(F.col(source).alias("src"), F.col(target).alias("dst")).dropna().distinct()
    known = targets.select(F.col(target_key).alias("dst")).distinct()
    if dangling == "SKIP":
        return edges.join(known, "dst", "left_semi").select("src", "dst", F.lit(predicate).alias("predicate"), F.lit(False).alias("dangling"))
    lost = edges.join(known, "dst", "left_anti")
    if dangling == "FAIL" and not lost.isEmpty():
        raise ValueError(f"links of {predicate} point to missing targets")
    flagged = edges.join(known.withColumn("_known", F.lit(True)), "dst", "left")
    return flagged.select("src", "dst", F.lit(predicate).alias("predicate"), F.col("_known").isNull().alias("dangling"))


def link_statistics(df: DataFrame, source: str, target: str, targets: DataFrame, target_key: str) -> DataFrame:
    """(rows, links, repeated, dangling, sources): counts of a link build."""
    given = df.select(F.col(source).alias("src"), F.col(target).alias("dst")).dropna()
    # Pairs first: each distinct pair meets the target list once.
    pairs = given.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    known = targets.select(F.col(target_key).alias("dst")).distinct().withColumn("_known", F.lit(True))
    flagged = pairs.join(known, "dst", "left")
    return flagged.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("links"),
        F.sum(F.col("n") - 1).alias("repeated"),
        F.count_if(F.col("_known").isNull()).alias("dangling"),
        F.count_distinct("src").alias("sources"),
    )


def overlay_links(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Edges (src, dst, predicate) after user edits with ``edit`` ADD or REMOVE and ``active``."""
    columns = ["src", "dst", "predicate"]
    active = edits.filter("active")
    removed = active.filter(F.upper("edit") == "REMOVE").select(*columns)
    added = active.filter(F.upper("edit") == "ADD").select(*columns)
    return edges.select(*columns).unionByName(added).distinct().join(removed, columns, "left_anti")


def reverse_link_rows(
    parents: DataFrame, key: str, children: DataFrame, child_key: str, foreign_key: str, child_class: str
) -> DataFrame:
    """The references of the children of the parents, one row each: (parent key, ``ref``), distinct."""
    refs = children.select(
        F.col(foreign_key).alias(key), F.concat(F.lit(f"{child_class}/"), F.col(child_key).cast("string")).alias("ref")
    ).dropna()
    return refs.join(parents.select(key), key, "left_semi").distinct()


def reverse_links(
    parents: DataFrame, key: str, children: DataFrame, child_key: str, foreign_key: str, child_class: str, chunk: int = 10_000
) -> DataFrame:
    """Per parent the sorted references of its children, in lists of bounded size."""
    known = reverse_link_rows(parents, key, children, child_key, foreign_key, child_class)
    return chunked_lists(known, [key], "ref", "refs", chunk)


def run_mode(has_watermark: bool, has_file_diff: bool, requested: str = "full") -> str:
    """full, incremental (needs a watermark) or delta (needs a file diff); falls back to full."""
    if requested == "incremental" and has_watermark:
        return "incremental"
    if requested == "delta" and has_file_diff:
        return "delta"
    return "full"

