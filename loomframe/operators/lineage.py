"""Lineage analytics over edges (src, dst, edge_type, projection, occurred_at, run_id, code)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.graph import reachable
from loomframe.operators.rollups import percentile_exact
from loomframe.session import cut_lineage

ARTIFACT = "artifact:"


def as_of(edges: DataFrame, time: Any = None) -> DataFrame:
    return edges if time is None else edges.filter(F.col("occurred_at") <= F.lit(time))


def _turned(edges: DataFrame, direction: str) -> DataFrame:
    if direction == "downstream":
        return edges
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _root(edges: DataFrame, root: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(root,)], "node string")


def walk(edges: DataFrame, root: str, direction: str, max_depth: int, time: Any = None) -> DataFrame:
    """(node, hops) upstream, downstream or both from a root."""
    known = as_of(edges, time)
    sides = ["downstream", "upstream"] if direction == "both" else [direction]
    found = None
    for side in sides:
        part = reachable(_turned(known, side), _root(edges, root), max_depth)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("node").agg(F.min("hops").alias("hops"))


def walk_edges(edges: DataFrame, walked: DataFrame, max_depth: int, direction: str) -> DataFrame:
    """Edges met by a one-way walk: those that leave a node before the last level."""
    start = "src" if direction == "downstream" else "dst"
    left = walked.filter(F.col("hops") < max_depth).select(F.col("node").alias(start))
    return edges.join(left, start, "left_semi").select("src", "dst", "edge_type", "projection").distinct()


def shortest_path(edges: DataFrame, root: str, target: str, direction: str, max_depth: int) -> DataFrame:
    """(path, hops) with the fewest hops, the smallest such path; one path per node is kept."""
    links = _turned(edges, direction).select("src", "dst")
    frontier = _root(edges, root).select("node", F.array("node").alias("path"))
    visited = frontier.select("node")
    for depth in range(1, max_depth + 1):
        step = links.join(frontier.withColumnRenamed("node", "src"), "src").select(
            F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")
        )
        fresh = step.join(visited, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        frontier = cut_lineage(fresh)
        hit = frontier.filter(F.col("node") == target)
        if not hit.isEmpty() or depth == max_depth:
            break
        visited = visited.unionByName(frontier.select("node"))
    return hit.select("path", (F.size("path") - 1).alias("hops"))


def impact(edges: DataFrame, root: str, max_depth: int, time: Any = None, prefix: str = ARTIFACT) -> DataFrame:
    """Downstream artifacts (node, kind, hops, latest_at): what a change of the root touches."""
    known = as_of(edges, time)
    hit = walk(known, root, "downstream", max_depth).filter(F.col("node").startswith(prefix))
    touched = known.join(hit.select(F.col("node").alias("dst")), "dst", "left_semi")
    latest = touched.groupBy(F.col("dst").alias("node")).agg(F.max("occurred_at").alias("latest_at"))
    kind = F.split_part(F.regexp_extract("node", r":(.*)$", 1), F.lit("/"), F.lit(1))
    return hit.join(latest, "node", "left").select("node", kind.alias("kind"), "hops", "latest_at")


def impact_by_kind(impacted: DataFrame) -> DataFrame:
    return impacted.groupBy("kind").agg(F.count(F.lit(1)).alias("artifacts"), F.max("latest_at").alias("latest_at"))


def walk_difference(edges: DataFrame, root: str, before: Any, after: Any, direction: str, max_depth: int) -> DataFrame:
    """(node, change): nodes that the walk gained or lost between two times."""
    old, new = (walk(edges, root, direction, max_depth, t).select("node") for t in (before, after))
    both = old.withColumn("_o", F.lit(1)).join(new.withColumn("_n", F.lit(1)), "node", "full")
    change = F.when(F.col("_o").isNull(), F.lit("added")).when(F.col("_n").isNull(), F.lit("removed"))
    return both.select("node", change.alias("change")).filter(F.col("change").isNotNull())


def edge_difference(edges: DataFrame, root: str, before: Any, after: Any, direction: str, max_depth: int) -> DataFrame:
    """(src, dst, edge_type, change): edges among the nodes of the walk that it gained or lost between two times."""

    def known(time: Any, mark: str) -> DataFrame:
        nodes = walk(edges, root, direction, max_depth, time).select("node")
        there = as_of(edges, time).select("src", "dst", "edge_type").distinct()
        there = there.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
        return there.select("src", "dst", "edge_type", F.lit(1).alias(mark))

    both = known(before, "_o").join(known(after, "_n"), ["src", "dst", "edge_type"], "full")
    change = F.when(F.col("_o").isNull(), F.lit("added")).when(F.col("_n").isNull(), F.lit("removed"))
    return both.select("src", "dst", "edge_type", change.alias("change")).filter(F.col("change").isNotNull())


def run_summaries(edges: DataFrame, since: Any = None, until: Any = None) -> DataFrame:
    """Per run: first and last time, edges, distinct artifacts and projections."""
    if since is not None:
        edges = edges.filter(F.col("occurred_at") >= F.lit(since))
    if until is not None:
        edges = edges.filter(F.col("occurred_at") <= F.lit(until))
    return edges.filter(F.col("run_id") != "").groupBy("run_id").agg(
        F.min("occurred_at").alias("first_occurred_at"),
        F.max("occurred_at").alias("last_occurred_at"),
        F.count(F.lit(1)).alias("edge_count"),
        F.count_distinct(F.when(F.col("dst").startswith(ARTIFACT), F.col("dst"))).alias("impacted_artifact_count"),
        F.count_distinct(F.when(F.col("projection") != "", F.col("projection"))).alias("impacted_projection_count"),
    )


def freshness(df: DataFrame, last: str, now: Column, slo_minutes: float) -> DataFrame:
    """``status`` by age against the target: healthy, up to three times warning, then critical."""
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(last).cast("timestamp"))) / 1e6
    age = F.greatest(F.lit(0.0), seconds / 60)
    status = (
        F.when(F.col(last).isNull(), F.lit("no_data"))
        .when(F.col("age_minutes") <= slo_minutes, F.lit("healthy"))
        .when(F.col("age_minutes") <= slo_minutes * 3, F.lit("warning"))
        .otherwise(F.lit("critical"))
    )
    return df.withColumn("age_minutes", F.when(F.col(last).isNotNull(), age)).withColumn("status", status)


def status_rank(status: Column) -> Column:
    """Order of attention: critical, warning, no_data, healthy."""
    return F.array_position(F.array(*[F.lit(s) for s in ("critical", "warning", "no_data", "healthy")]), status).cast("int") - 1


def latest_writes(items: DataFrame, edges: DataFrame, key: str, edge_key: str) -> DataFrame:
    """Items with the time and number of their writes; never-written items stay with NULL and 0."""
    writes = edges.groupBy(F.col(edge_key).alias(key)).agg(
        F.max("occurred_at").alias("last_occurred_at"), F.count(F.lit(1)).alias("write_count")
    )
    return items.join(writes, key, "left").withColumn("write_count", F.coalesce("write_count", F.lit(0)))


def latest_edges(edges: DataFrame, end: str, tie: Sequence[str]) -> DataFrame:
    """Newest edge to (``dst``) or from (``src``) each node; ``tie`` settles equal times."""
    from loomframe.operators.skew import latest

    return latest(edges, [end], ["occurred_at", *tie])


def out_of_date(
    items: DataFrame, writes: DataFrame, emitted: DataFrame, now: Column, slo_minutes: float, tie: Sequence[str]
) -> DataFrame:
    """Per artifact: status, scope (parent, ancestor, none), reason, update type and gap.

    ``writes`` are edges from an event to an artifact (dst), with ``projection`` and ``code``;
    ``emitted`` are edges from an aggregate (src) to an event (dst). The parent of an artifact
    is the aggregate behind its last writer; any newer event elsewhere makes an ancestor scope.
    """
    from loomframe.operators.skew import latest

    writer = latest(writes.select("src", "dst", "projection", "code", "occurred_at"), ["dst"], ["occurred_at", *tie])
    last = items.join(
        writer.select(
            F.col("dst").alias("node"),
            F.col("src").alias("event"),
            "projection",
            "code",
            F.col("occurred_at").alias("last_occurred_at"),
        ),
        "node",
        "left",
    )
    parents = emitted.groupBy(F.col("dst").alias("event")).agg(F.max_by("src", F.struct("occurred_at", "src")).alias("parent"))
    parent_last = emitted.groupBy(F.col("src").alias("parent")).agg(F.max("occurred_at").alias("parent_at"))
    newest = latest(
        writes.filter(F.col("projection") != "").select("projection", "code", "occurred_at", "src"), ["projection"], ["occurred_at", "src"]
    ).select("projection", F.col("code").alias("newest_code"), F.col("occurred_at").alias("newest_at"))
    upstream = emitted.agg(F.max("occurred_at")).scalar()
    whole = (
        freshness(last, "last_occurred_at", now, slo_minutes)
        .join(parents, "event", "left")
        .join(parent_last, "parent", "left")
        .join(newest, "projection", "left")
        .withColumn("upstream_at", upstream)
    )
    at, stale = F.col("last_occurred_at"), ~F.col("status").isin("healthy", "no_data")
    scope = (
        F.when(stale & (F.col("parent_at") > at), F.lit("parent"))
        .when(stale & (F.col("upstream_at") > at), F.lit("ancestor"))
        .otherwise(F.lit("none"))
    )
    reason = (
        F.when(F.col("status") == "healthy", F.lit("healthy"))
        .when(F.col("status") == "no_data", F.lit("no_lineage_data"))
        .when(F.col("scope") == "parent", F.lit("parent_has_newer_events"))
        .when(F.col("scope") == "ancestor", F.lit("ancestor_has_newer_events"))
        .otherwise(F.lit("freshness_slo_breached"))
    )
    logic = stale & (F.col("newest_at") > at) & (F.col("code") != F.col("newest_code")) & (F.col("code") != "") & (F.col("newest_code") != "")
    update = F.when(logic, F.lit("logic")).when(F.col("scope") != "none", F.lit("data")).otherwise(F.lit("none"))
    gap = (F.unix_micros(F.col("upstream_at").cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 6e7
    return whole.withColumn("scope", scope).select(
        "node",
        "status",
        "scope",
        reason.alias("reason"),
        update.alias("update_type"),
        F.greatest(gap, F.lit(0.0)).alias("upstream_gap_minutes"),
    )


def coverage(event_ids: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Share of events without a lineage edge, from the ids themselves."""
    recorded = edges.select(F.col("dst").alias(key)).distinct().withColumn("_r", F.lit(1))
    counted = event_ids.join(recorded, key, "left").agg(
        F.count(F.lit(1)).alias("events"), F.count("_r").alias("recorded")
    )
    missing = F.col("events") - F.col("recorded")
    return counted.select(
        "events", "recorded", missing.alias("missing"), F.coalesce(F.try_divide(missing, "events"), F.lit(0.0)).alias("missing_ratio")
    )


def missing_events(event_ids: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    return event_ids.join(edges.select(F.col("dst").alias(key)).distinct(), key, "left_anti")


def timeline(edges: DataFrame, minutes: int) -> DataFrame:
    """(bucket_start, edge_type, edges) per time bucket."""
    seconds = F.floor(F.unix_micros(F.col("occurred_at").cast("timestamp")) / 1_000_000)
    start = F.floor(seconds / (minutes * 60)) * (minutes * 60)
    known = edges.filter(F.col("occurred_at").isNotNull())
    return known.groupBy(start.cast("bigint").alias("bucket_start"), "edge_type").agg(F.count(F.lit(1)).alias("edges"))


def spikes(edges: DataFrame, minutes: int) -> DataFrame:
    """Buckets with at least max(5, 3 * median of the non-empty buckets) edges."""
    buckets = timeline(edges, minutes).groupBy("bucket_start").agg(F.sum("edges").alias("edges"))
    baseline = percentile_exact(buckets, [], "edges", 0.5, "baseline").select("baseline").agg(F.max("baseline")).scalar()
    judged = buckets.withColumn("baseline", baseline)
    limit = F.greatest(F.lit(5.0), F.col("baseline") * 3)
    return judged.withColumn("threshold", limit).filter(F.col("edges") >= F.col("threshold"))


def column_lineage(pairs: DataFrame) -> DataFrame:
    """(source_column, target_column, dataset, class) with uses and the latest time."""
    return pairs.groupBy("source_column", "target_column", "dataset", "class").agg(
        F.count(F.lit(1)).alias("uses"), F.max("occurred_at").alias("latest_at")
    )
