"""Graph walks over edge tables (src, dst, predicate); nodes are text ids ``Class/id``.

Every step works on distinct nodes or one best path per node, so results stay within the size
of the node set however many routes exist. Step results are checkpointed to the shared folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.session import cut_lineage

MAX_HOPS = 10


def class_of(node: Column | str) -> Column:
    return F.substring_index(node, "/", 1)


def start_set(objects: DataFrame, key: str, filters: Mapping[str, object], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Objects equal to all filters, in key order, optionally one page."""
    for column, value in filters.items():
        objects = objects.filter(F.col(column) == F.lit(value))
    if limit is None:
        return objects
    ordered = objects.sort(key)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def follow(frontier: DataFrame, edges: DataFrame, predicate: str | None = None, target: str | None = None, reverse: bool = False) -> DataFrame:
    """Edges one hop from ``frontier`` (column node), in their stored direction."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    if predicate is not None:
        edges = edges.filter(F.col("predicate") == predicate)
    if target is not None:
        edges = edges.filter(class_of(there) == target)
    nodes = frontier.select(F.col("node").alias(here)).distinct()
    return edges.join(nodes, here, "left_semi").select("src", "dst", "predicate").distinct()


Hop = tuple[str, str, bool]  # predicate, target class, reverse


def multi_hop(start: DataFrame, edges: DataFrame, hops: Sequence[Hop], no_cycles: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes with the hop of their first visit, edges with their hop) along a chain of hops."""
    if len(hops) > MAX_HOPS:
        raise ValueError(f"at most {MAX_HOPS} hops")
    frontier = start.select("node").distinct()
    levels, taken = [frontier.withColumn("hop", F.lit(0))], []
    for number, (predicate, target, reverse) in enumerate(hops, 1):
        found = follow(frontier, edges, predicate, target, reverse)
        there = "src" if reverse else "dst"
        if no_cycles:
            seen = reduce(DataFrame.unionByName, levels).select(F.col("node").alias(there)).distinct()
            found = found.join(seen, there, "left_anti").select("src", "dst", "predicate")
        found = cut_lineage(found)
        frontier = found.select(F.col(there).alias("node")).distinct()
        levels.append(frontier.withColumn("hop", F.lit(number)))
        taken.append(found.withColumn("hop", F.lit(number)))
    nodes = reduce(DataFrame.unionByName, levels).groupBy("node").agg(F.min("hop").alias("hop"))
    return nodes, reduce(DataFrame.unionByName, taken)


def hop_paths(start: DataFrame, edges: DataFrame, hops: Sequence[Hop]) -> DataFrame:
    """(node, path): one path, the smallest, to each node of the last hop; reverse hops keep theirs."""
    paths = start.select("node", F.array("node").alias("path")).distinct()
    for predicate, target, reverse in hops:
        here, there = ("dst", "src") if reverse else ("src", "dst")
        step = edges.filter((F.col("predicate") == predicate) & (class_of(there) == target)).select(here, there)
        reached = paths.withColumnRenamed("node", here).join(step, here)
        # The smallest path per node wins map-side already.
        paths = cut_lineage(reached.groupBy(F.col(there).alias("node")).agg(F.min(F.array_append("path", F.col(there))).alias("path")))
    return paths


def class_adjacency(edges: DataFrame) -> DataFrame:
    """(src, predicate, dst, links) between classes, from all edges."""
    return edges.groupBy(class_of("src").alias("src"), "predicate", class_of("dst").alias("dst")).agg(
        F.count(F.lit(1)).alias("links")
    )


def class_paths(edges: DataFrame, start: str, end: str, max_depth: int) -> DataFrame:
    """(path, predicates) between two classes over the schema graph, each class at most once."""
    return simple_paths(class_adjacency(edges), start, end, max_depth)


def simple_paths(edges: DataFrame, start: str, end: str, max_depth: int) -> DataFrame:
    """All simple paths (path, predicates, length, weight) of at most ``max_depth`` hops.

    Meant for small graphs such as a schema. Only edges that lie on some route to ``end`` are
    walked. ``weight`` sums the edges' ``weight`` column when there is one.
    """
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    links = cut_lineage(edges.select("src", "dst", "predicate", weight.alias("w")))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "predicate")
    useful = reachable(back, edges.sparkSession.createDataFrame([(end,)], "node string"), max_depth)
    links = cut_lineage(links.join(useful.select(F.col("node").alias("dst")), "dst", "left_semi"))
    paths = links.filter(F.col("src") == start).select(
        F.array("src", "dst").alias("path"), F.array("predicate").alias("predicates"), F.col("w").alias("weight"), F.col("dst").alias("tip")
    )
    paths = paths.filter(F.col("tip") != start)
    done = [paths.filter(F.col("tip") == end)]
    for _ in range(1, max_depth):
        longer = paths.filter(F.col("tip") != end).join(links, F.col("tip") == F.col("src"))
        paths = cut_lineage(
            longer.filter(~F.array_contains("path", F.col("dst"))).select(
                F.array_append("path", F.col("dst")).alias("path"),
                F.array_append("predicates", F.col("predicate")).alias("predicates"),
                (F.col("weight") + F.col("w")).alias("weight"),
                F.col("dst").alias("tip"),
            )
        )
        done.append(paths.filter(F.col("tip") == end))
    return reduce(DataFrame.unionByName, done).select("path", "predicates", F.size("predicates").alias("length"), "weight")


def self_references(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("node"), "predicate").distinct()


def direct_cycles(edges: DataFrame) -> DataFrame:
    """(a, b, there, back) with a < b: edges in both directions, one row per predicate pair."""
    links = edges.filter(F.col("src") != F.col("dst")).select("src", "dst", "predicate").distinct()
    forth = links.filter(F.col("src") < F.col("dst")).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("predicate").alias("there"))
    back = links.filter(F.col("src") > F.col("dst")).select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("predicate").alias("back"))
    return forth.join(back, ["a", "b"])


def indirect_cycles(edges: DataFrame, max_depth: int) -> DataFrame:
    """(path, length): simple cycles of three or more nodes, one per node set.

    For small graphs such as a schema. Paths begin at their smallest node, so each cycle is
    found from one start only.
    """
    links = cut_lineage(edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    paths = links.filter(F.col("src") < F.col("dst")).select(F.array("src", "dst").alias("path"), F.col("dst").alias("tip"))
    found = []
    for length in range(3, max_depth + 1):
        longer = paths.join(links, F.col("tip") == F.col("src")).filter(
            (F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))
        )
        paths = cut_lineage(longer.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("tip")))
        closed = paths.join(links, (F.col("tip") == F.col("src")) & (F.col("path")[0] == F.col("dst"))).select("path")
        found.append(closed.groupBy(F.sort_array("path").alias("_set")).agg(F.min("path").alias("path")).select("path", F.lit(length).alias("length")))
    return reduce(DataFrame.unionByName, found)


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Propagate the greatest label along edges until nothing changes: (node, label).

    Only nodes whose label rose push again, and each round is one job.
    """
    state = labels.withColumn("rose", F.lit(True))
    while True:
        rising = state.filter("rose").select(F.col("node").alias("src"), "label")
        pushed = edges.join(rising, "src").groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("_new"))
        higher = F.coalesce(F.col("_new") > F.col("label"), F.lit(False))
        state = cut_lineage(
            state.join(pushed, "node", "left").select(
                "node", F.when(higher, F.col("_new")).otherwise(F.col("label")).alias("label"), higher.alias("rose")
            )
        )
        if state.filter("rose").isEmpty():
            return state.drop("rose")


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components: (node, component), named by their smallest node.

    Rounds of two propagations: every node learns the greatest node that reaches it (its
    colour), then each colour's own node collects, backwards inside the colour, its component.
    """
    links = cut_lineage(edges.select("src", "dst").distinct())
    nodes = cut_lineage(links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct())
    done: list[DataFrame] = []
    while not nodes.isEmpty():
        colours = _spread(nodes.select("node", F.col("node").alias("label")), links)
        tagged = links.join(colours.select(F.col("node").alias("src"), F.col("label").alias("_a")), "src").join(
            colours.select(F.col("node").alias("dst"), F.col("label").alias("_b")), "dst"
        )
        inside = cut_lineage(tagged.filter(F.col("_a") == F.col("_b")).select("src", "dst"))
        roots = colours.filter(F.col("node") == F.col("label"))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        gathered, fresh = roots, roots
        while not fresh.isEmpty():
            step = back.join(fresh.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label").distinct()
            fresh = cut_lineage(step.join(gathered.select("node"), "node", "left_anti"))
            gathered = gathered.unionByName(fresh)
        gathered = cut_lineage(gathered)
        names = gathered.groupBy("label").agg(F.min("node").alias("component"))
        done.append(gathered.join(names, "label").select("node", "component"))
        nodes = cut_lineage(nodes.join(gathered.select("node"), "node", "left_anti"))
        # Finished nodes leave the graph.
        links = inside.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(
            nodes.select(F.col("node").alias("dst")), "dst", "left_semi"
        )
        links = cut_lineage(links.select("src", "dst"))
    return reduce(DataFrame.unionByName, done) if done else nodes.select("node", F.col("node").alias("component"))


def reachable(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(node, hops): every node within ``max_depth`` of the start nodes, start included at 0."""
    links = edges.select("src", "dst")
    frontier = start.select("node").distinct().withColumn("hops", F.lit(0))
    visited = frontier
    for depth in range(1, max_depth + 1):
        step = links.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(step.join(visited.select("node"), "node", "left_anti").withColumn("hops", F.lit(depth)))
        visited = visited.unionByName(frontier)
        if frontier.isEmpty():
            break
    return visited


def connecting(edges: DataFrame, one: DataFrame, other: DataFrame, max_depth: int) -> DataFrame:
    """Nodes that both ends reach within half the depth, the ends themselves left out."""
    half = max_depth // 2
    a, b = (reachable(edges, s, half).filter(F.col("hops") > 0).select("node") for s in (one, other))
    return a.join(b, "node", "left_semi")


def _improvements(edges: DataFrame, start: DataFrame, max_depth: int) -> list[DataFrame]:
    """Per hop count the pairs (start, node, weight, parent) that this many hops reach lighter than fewer do.

    A path that is not lighter than one of fewer hops cannot lead to anything lighter, so only improved
    pairs go on; weights must not be negative. Rounds carry no paths, only the node before.
    """
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    # Parallel edges: only the lightest can be on a lightest path.
    links = cut_lineage(edges.groupBy("src", "dst").agg(F.min(weight).alias("w")))
    best = start.select(F.col("node").alias("start"), "node", F.lit(0.0).alias("weight")).distinct()
    rounds = [best.withColumn("parent", F.lit(None).cast("string"))]
    for _ in range(max_depth):
        step = rounds[-1].select("start", F.col("node").alias("src"), "weight").join(links, "src")
        lightest = F.min(F.struct((F.col("weight") + F.col("w")).alias("weight"), F.col("src").alias("parent"))).alias("_b")
        step = step.groupBy("start", F.col("dst").alias("node")).agg(lightest).select("start", "node", "_b.weight", "_b.parent")
        known = best.withColumnRenamed("weight", "_known")
        improved = step.join(known, ["start", "node"], "left").filter(F.col("_known").isNull() | (F.col("weight") < F.col("_known")))
        improved = cut_lineage(improved.drop("_known"))
        if improved.isEmpty():
            break
        rounds.append(improved)
        both = best.unionByName(improved.drop("parent"))
        best = cut_lineage(both.groupBy("start", "node").agg(F.min("weight").alias("weight")))
    return rounds


def _numbered(rounds: list[DataFrame]) -> DataFrame:
    """Every improvement with its number of hops."""
    return reduce(DataFrame.unionByName, [r.withColumn("hops", F.lit(k)) for k, r in enumerate(rounds)])


def shortest_distances(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(start, node, weight): the least weight of a path of at most ``max_depth`` hops per pair."""
    found = _numbered(_improvements(edges, start, max_depth)).groupBy("start", "node").agg(F.min("weight").alias("weight"))
    return found.filter(F.col("start") != F.col("node"))


def shortest_paths(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(start, node, path, weight): the lightest path of at most ``max_depth`` hops per pair.

    Paths are put together backwards at the end, from the node before each improvement. Ties go to the
    fewer hops, then to the smaller node before.
    """
    rounds = _improvements(edges, start, max_depth)
    last = F.min_by(F.struct("weight", "parent", "hops"), F.struct("weight", "hops")).alias("_b")
    paths = _numbered(rounds).groupBy("start", "node").agg(last).select("start", "node", "_b.*").filter(F.col("start") != F.col("node"))
    paths = paths.withColumn("path", F.array("node")).withColumnRenamed("parent", "tip")
    for hops in range(len(rounds) - 1, 0, -1):
        # All paths that still have ``hops`` hops to go grow by the node before.
        here = F.col("hops") == hops
        before = rounds[hops - 1].select("start", F.col("node").alias("tip"), F.col("parent").alias("_next"), F.lit(hops).alias("hops"))
        grown = paths.filter(here).join(before, ["start", "tip", "hops"]).select(
            "start", "node", "weight", F.col("_next").alias("tip"), F.lit(hops - 1).alias("hops"), F.concat(F.array("tip"), "path").alias("path")
        )
        paths = paths.filter(~here).unionByName(grown)
    return paths.select("start", "node", "path", "weight")


def weigh(edges: DataFrame, weights: Mapping[str, float], boosts: Mapping[str, float] | None = None, default: float = 1.0) -> DataFrame:
    """Edge weights by predicate, times a boost by predicate."""

    def pick(table: Mapping[str, float], otherwise: float) -> Column:
        made = F.when(F.lit(False), F.lit(0.0))
        for name, value in table.items():
            made = made.when(F.col("predicate") == name, F.lit(float(value)))
        return made.otherwise(F.lit(float(otherwise)))

    return edges.withColumn("weight", pick(weights, default) * pick(boosts or {}, 1.0))


def path_statistics(paths: DataFrame) -> DataFrame:
    """Counts, lengths and weights of paths (length, weight)."""
    return paths.agg(
        F.count(F.lit(1)).alias("total_paths"),
        F.avg("length").alias("average_length"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.avg("weight").alias("average_weight"),
        F.min("weight").alias("min_weight"),
        F.max("weight").alias("max_weight"),
    )


def common_predicates(paths: DataFrame, share: float = 0.5) -> DataFrame:
    """Predicates on at least ``share`` of the paths."""
    total = paths.agg(F.count(F.lit(1))).scalar()
    counted = paths.select(F.explode(F.array_distinct("predicates")).alias("predicate")).groupBy("predicate").agg(F.count(F.lit(1)).alias("paths"))
    return counted.filter(F.col("paths") >= total * share)


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges, sources, targets and greatest fan-out per predicate."""
    fan = edges.groupBy("predicate", "src").agg(F.count(F.lit(1)).alias("n"))
    sides = edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("dst").alias("targets"))
    return sides.join(
        fan.groupBy("predicate").agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("max_fan_out")), "predicate"
    )


def allowed_graph(nodes: DataFrame, edges: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that a policy allows, and the edges between them."""
    kept = nodes.join(allowed.select("node").distinct(), "node", "left_semi")
    for end in ("src", "dst"):
        edges = edges.join(kept.select(F.col("node").alias(end)), end, "left_semi")
    return kept, edges
