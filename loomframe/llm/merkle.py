"""Merkle manifest of a dataset: a leaf a row, a tree a group, one root over all groups.

Leaves of a group (``lang``) ascend by id, ties by leaf; while several nodes remain, every FAN
consecutive ones become their hash. The subroots, ordered by group, likewise give the root.

Built levels are stored as node rows that name their parent and their place in it. A recursive query
then climbs from the leaves to the root: each step joins the node above, appends the siblings found
there to the proof and folds the hash carried upwards. Leaves of one lowest run have all siblings
above in common, so a row climbs with the run's leaves, each with a folded hash of its own, and holds
their common proof once. Order comes from range partitions whose counts are added up, so a group of
any size is spread.

Missing values count as ``-``, empty texts as ``0:``; a missing id sorts first and is never tampered
with, a missing group is a group of its own and the first. Texts of any length are hashed whole inside
their row. Equal rows are leaves of their own: they have equal leaves and differ by place only. Other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.session import materialize

FAN = 8
TOP = -1  # number of the tree over all subroots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: dict[str, Column]) -> Column:
    """Hash of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[_field(columns[name]) for name in FIELDS]), 256))


def joined_hash(digests: Column) -> Column:
    """Hash of digests that stand one after the other, read as hex text; 32 bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def tampered(doc_id: Column) -> Column:
    """Rows whose text is changed after the manifest was built."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, now): each row's hash as built, and as it is after tampering."""
    columns = {name: docs[name] for name in FIELDS}
    leaf = leaf_hash(columns)
    changed = leaf_hash(columns | {"text": F.translate(docs["text"], UPPER, LOWER)})
    return docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered(docs["doc_id"]), changed).alias("now"))


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with ``place`` (from 0) in their group and ``n``, the group's size, whatever that is.

    Ranges of (group, order) are sorted and written; what comes before a range is added up from one
    count per range and group.
    """
    keys = [F.col(c).asc_nulls_first() for c in group + order]
    tie = F.monotonically_increasing_id()  # equal rows may stand in any order: let them fill several ranges
    ranged = rows.withColumn("_tie", tie).repartitionByRange(*keys, F.col("_tie").asc()).sortWithinPartitions(*keys, F.col("_tie").asc())
    stored = materialize(ranged.drop("_tie").select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "placed")
    counts = stored.groupBy("_range", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_count"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_count").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = [F.col("_range").alias("_in"), *[F.col(c).alias(f"_of_{c}") for c in group]]
    offsets = counts.select(*named, (before - F.col("_first")).alias("_shift"), F.sum("_count").over(whole).alias("n"))
    same = F.col("_range") == F.col("_in")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    joined = stored.join(offsets, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"), "n")
    return materialize(joined, "places")


def _levels(spark: SparkSession, nodes: DataFrame, most: int, extra: list[str]) -> Iterator[DataFrame]:
    """From nodes (tree, place, n, hash) each level above, written: children joined, their hash, place and n there.

    ``extra`` columns of the lowest level are kept as lists of a run.
    """
    while most > 1:
        members = F.sort_array(F.collect_list(F.struct("place", "hash", *extra)))
        runs = nodes.filter("n > 1").groupBy("tree", "n", F.expr(f"place div {FAN}").alias("run")).agg(members.alias("m"))
        children = F.aggregate(F.col("m.hash"), F.lit(b""), lambda a, b: F.concat(a, b))
        kept = [F.col(f"m.{c}").alias(c) for c in extra]
        made = runs.select("tree", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("run").alias("place"), children.alias("children"), *kept)
        nodes = materialize(made.withColumn("hash", joined_hash(F.col("children"))), "level")
        yield nodes
        most, extra = -(-most // FAN), []


@dataclass
class Manifest:
    """``nodes`` (node, parent, place, children) of all levels above the lowest runs; ``runs``: the lowest runs
    and lone leaves with their rows; ``trees`` (tree, lang, subroot, place of the subroot); ``root``, hex."""

    nodes: DataFrame
    runs: DataFrame
    trees: DataFrame
    root: str | None


def _node(tree: Column, level: int, run: Column) -> Column:
    return F.struct(tree.cast("bigint").alias("tree"), F.lit(level).alias("level"), run.cast("bigint").alias("run"))


def _linked(level: DataFrame, number: int, groups: int) -> DataFrame:
    """Rows of one level with the node above and their place in it; none above the root."""
    at, within, top = F.col("place"), F.col("n") > 1, F.col("tree") == TOP
    above = F.when(within, _node(F.col("tree"), number + 1, F.expr(f"place div {FAN}")))
    if groups > 1:
        above = above.when(~top, _node(F.lit(TOP), 1, F.expr(f"tree div {FAN}")))
    place = F.when(within | top, at).otherwise(F.col("tree")) % FAN
    return level.withColumns({"node": _node(F.col("tree"), number, at), "parent": above, "step": place.cast("int")})


def build(rows: DataFrame) -> Manifest:
    """Manifest of ``leaves``: every level is written once."""
    spark = rows.sparkSession
    stored = materialize(rows, "leaves")
    order = placed(stored, ["lang"], ["doc_id", "leaf"])
    groups = placed(order.filter("place = 0").select("lang", F.col("n").alias("size")), [], ["lang"])
    most = groups.agg(F.max("size").alias("size"), F.max("n").alias("n")).first()
    trees = groups.select(F.col("place").alias("tree"), "lang")
    low = order.join(trees.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    low = low.select("tree", "place", "n", F.col("leaf").alias("hash"), "doc_id", F.coalesce("now", "leaf").alias("now"))
    low = materialize(low, "lowest")
    levels = list(_levels(spark, low, most["size"] or 0, ["doc_id", "now"]))
    none = low.filter("n = 1").select("tree", "n", "place", F.lit(b"").alias("children"), F.array("doc_id").alias("doc_id"), F.array("now").alias("now"), "hash")
    lone = _linked(none, 0, most["n"] or 0)
    roots = [level.filter("n = 1").select("tree", "hash") for level in [low, *levels]]
    subroots = roots[0]
    for other in roots[1:]:
        subroots = subroots.unionByName(other)
    subroots = materialize(subroots, "subroots")
    heads = subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.lit(most["n"] or 0).alias("n"), "hash")
    tops = list(_levels(spark, heads, most["n"] or 0, []))
    linked = [_linked(level, k + 1, most["n"] or 0) for k, level in enumerate(levels)]
    runs = lone if not linked else lone.unionByName(linked[0])
    upper = [level.select("node", "parent", "step", "children") for level in [*linked[1:], *(_linked(t, k + 1, most["n"]) for k, t in enumerate(tops))]]
    nodes = upper[0] if upper else lone.select("node", "parent", "step", "children").limit(0)
    for other in upper[1:]:
        nodes = nodes.unionByName(other)
    last = (tops[-1] if tops else subroots).select(F.lower(F.hex("hash")).alias("root")).first()
    return Manifest(materialize(nodes, "nodes"), materialize(runs.drop("place", "n"), "runs"), subroots.withColumnRenamed("hash", "subroot"), last and last["root"])


def _without(children: str, step: str) -> str:
    return f"concat(substr({children}, 1, 32 * {step}), substr({children}, 32 * {step} + 33))"


def _folded(children: str, step: str, own: str) -> str:
    whole = f"concat(substr({children}, 1, 32 * {step}), {own}, substr({children}, 32 * {step} + 33))"
    return f"unhex(sha2(lower(hex({whole})), 256))"


# The anchor folds each leaf into its own run; a step folds what arrived into the node above.
_CLIMB = f"""
WITH RECURSIVE climb(run, parent, step, folded, proof) AS (
  SELECT node, parent, step,
    CASE WHEN length(children) = 0 THEN now ELSE transform(now, (h, i) -> {_folded('children', 'i', 'h')}) END,
    CAST('' AS BINARY)
  FROM {{runs}}
  UNION ALL
  SELECT c.run, n.parent, n.step, transform(c.folded, h -> {_folded('n.children', 'c.step', 'h')}),
    concat(c.proof, {_without('n.children', 'c.step')})
  FROM climb c JOIN {{nodes}} n ON n.node = c.parent)
SELECT run, folded, proof FROM climb WHERE parent IS NULL
"""


@contextmanager
def _unlimited_rows(spark: SparkSession) -> Iterator[None]:
    """A recursion of any number of rows; its depth stays bounded by the levels of the manifest."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests as hex."""
    spark = manifest.runs.sparkSession
    with _unlimited_rows(spark):
        climbed = materialize(spark.sql(_CLIMB, runs=manifest.runs, nodes=manifest.nodes), "climb")
    joined = manifest.runs.join(climbed, manifest.runs["node"] == climbed["run"])
    joined = joined.withColumn("tree", F.col("node.tree")).join(manifest.trees, "tree")
    each = joined.select(F.posexplode(F.arrays_zip("doc_id", "folded")).alias("i", "own"), "children", "hash", "subroot", "proof")
    lone = F.length("children") == 0
    leaf = F.when(lone, F.col("hash")).otherwise(F.expr("substr(children, 32 * i + 1, 32)"))
    beside = F.when(lone, F.lit(b"")).otherwise(F.expr(_without("children", "i")))
    folded, root = F.lower(F.hex("own.folded")), F.lit(manifest.root)
    return each.select(
        F.col("own.doc_id").alias("doc_id"),
        F.lower(F.hex(leaf)).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        root.alias("root"),
        F.sha2(F.lower(F.hex(F.concat(beside, F.col("proof")))), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == root).alias("verified"),
    )


def manifest(docs: DataFrame) -> DataFrame:
    """Build the manifest of ``docs``, tamper, and check every row's proof."""
    return proofs(build(leaves(docs)))
