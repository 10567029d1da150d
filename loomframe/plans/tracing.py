"""Queries for graphs, lineage, time series and user functions."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.operators import graph as G
from loomframe.operators import lineage as L
from loomframe.operators import search as S
from loomframe.operators import timeseries as TS
from loomframe.operators import udf as U
from loomframe.plans.registry import query, table

_EDGE_LIST = [
    ("nation", "concat('nation/', n_nationkey)", "concat('region/', n_regionkey)", "in_region"),
    ("customer", "concat('customer/', c_custkey)", "concat('nation/', c_nationkey)", "in_nation"),
    ("supplier", "concat('supplier/', s_suppkey)", "concat('nation/', s_nationkey)", "in_nation"),
    ("orders", "concat('order/', o_orderkey)", "concat('customer/', o_custkey)", "placed_by"),
    ("lineitem", "concat('order/', l_orderkey)", "concat('part/', l_partkey)", "contains"),
    ("lineitem", "concat('part/', l_partkey)", "concat('supplier/', l_suppkey)", "supplied_by"),
    ("lineitem", "concat('supplier/', l_suppkey)", "concat('order/', l_orderkey)", "delivers"),
]


def _links(spark, d):
    parts = [
        table(spark, d, t).select(F.expr(s).alias("src"), F.expr(o).alias("dst"), F.lit(p).alias("predicate"))
        for t, s, o, p in _EDGE_LIST
    ]
    return reduce(DataFrame.unionByName, parts)


def _edges(spark, d):
    return _links(spark, d).distinct()


_DUCK_LINKS = "links AS (" + " UNION ALL ".join(f"SELECT {s} AS src, {o} AS dst, '{p}' AS predicate FROM {t}" for t, s, o, p in _EDGE_LIST) + ")"
_DUCK_EDGES = "edges AS (" + " UNION ".join(f"SELECT {s} AS src, {o} AS dst, '{p}' AS predicate FROM {t}" for t, s, o, p in _EDGE_LIST) + ")"


def _start(spark, d):
    big = table(spark, d, "customer").filter("c_acctbal > 9900")
    return big.select(F.concat(F.lit("customer/"), "c_custkey").alias("node"))


_DUCK_START = "start AS (SELECT 'customer/' || c_custkey AS node FROM customer WHERE c_acctbal > 9900)"


@query("graph_start", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7 ORDER BY s_suppkey LIMIT 3 OFFSET 1")
def graph_start(spark, d):
    return G.start_set(table(spark, d, "supplier"), "s_suppkey", {"s_nationkey": 7}, 3, 1).select("s_suppkey", "s_name")


@query(
    "graph_hop_forward",
    f"WITH {_DUCK_EDGES}, {_DUCK_START} SELECT DISTINCT src, dst, predicate FROM edges WHERE predicate = 'in_nation' AND src IN (SELECT node FROM start)",
)
def graph_hop_forward(spark, d):
    return G.follow(_start(spark, d), _edges(spark, d), "in_nation", "nation")


@query(
    "graph_hop_reverse",
    f"WITH {_DUCK_EDGES}, {_DUCK_START} SELECT DISTINCT src, dst, predicate FROM edges WHERE predicate = 'placed_by' AND dst IN (SELECT node FROM start)",
)
def graph_hop_reverse(spark, d):
    return G.follow(_start(spark, d), _edges(spark, d), "placed_by", "order", True)


_HOPS = [("placed_by", "order", True), ("contains", "part", False), ("contains", "order", True), ("placed_by", "customer", False)]
_DUCK_HOPS = f"""
    WITH {_DUCK_EDGES}, {_DUCK_START},
    e1 AS (SELECT DISTINCT e.* FROM edges e WHERE predicate = 'placed_by' AND dst IN (SELECT node FROM start)),
    e2 AS (SELECT DISTINCT e.* FROM edges e WHERE predicate = 'contains' AND src IN (SELECT src FROM e1)),
"""


@query(
    "graph_multi_hop",
    f"""{_DUCK_HOPS}
    e3 AS (SELECT DISTINCT e.* FROM edges e WHERE predicate = 'contains' AND dst IN (SELECT dst FROM e2)),
    e4 AS (SELECT DISTINCT e.* FROM edges e WHERE predicate = 'placed_by' AND src IN (SELECT src FROM e3)),
    n AS (SELECT node, 0 AS hop FROM start UNION SELECT src, 1 FROM e1 UNION SELECT dst, 2 FROM e2 UNION SELECT src, 3 FROM e3 UNION SELECT dst, 4 FROM e4)
    SELECT node, min(hop) AS hop FROM n GROUP BY node""",
)
def graph_multi_hop(spark, d):
    return G.multi_hop(_start(spark, d), _edges(spark, d), _HOPS)[0]


@query(
    "graph_multi_hop_no_cycles",
    f"""{_DUCK_HOPS}
    e3 AS (SELECT DISTINCT e.* FROM edges e WHERE predicate = 'contains' AND dst IN (SELECT dst FROM e2) AND src NOT IN (SELECT src FROM e1)),
    e4 AS (SELECT DISTINCT e.* FROM edges e WHERE predicate = 'placed_by' AND src IN (SELECT src FROM e3) AND dst NOT IN (SELECT node FROM start))
    SELECT *, 1 AS hop FROM e1 UNION ALL SELECT *, 2 FROM e2 UNION ALL SELECT *, 3 FROM e3 UNION ALL SELECT *, 4 FROM e4""",
)
def graph_multi_hop_no_cycles(spark, d):
    return G.multi_hop(_start(spark, d), _edges(spark, d), _HOPS, no_cycles=True)[1]


@query(
    "graph_paths",
    f"""{_DUCK_HOPS}
    p AS (SELECT e2.dst AS node, min([e1.dst, e1.src, e2.dst]) AS path FROM e1 JOIN e2 ON e2.src = e1.src GROUP BY e2.dst)
    SELECT node, array_to_string(path, '>') AS path FROM p""",
)
def graph_paths(spark, d):
    return G.hop_paths(_start(spark, d), _edges(spark, d), _HOPS[:2]).select("node", F.concat_ws(">", "path").alias("path"))


@query(
    "graph_class_adjacency",
    f"WITH {_DUCK_LINKS} SELECT split_part(src, '/', 1) AS src, predicate, split_part(dst, '/', 1) AS dst, count(*) AS links FROM links GROUP BY 1, 2, 3",
)
def graph_class_adjacency(spark, d):
    return G.class_adjacency(_links(spark, d))


_DUCK_CLASSES = f"""
    {_DUCK_EDGES}, ca AS (SELECT DISTINCT split_part(src, '/', 1) AS src, predicate, split_part(dst, '/', 1) AS dst FROM edges),
    w AS (SELECT *, CASE predicate WHEN 'contains' THEN 2.0 WHEN 'in_nation' THEN 1.5 ELSE 1.0 END::DOUBLE AS weight FROM ca)
"""
_DUCK_PATHS = """
    paths AS (SELECT [src, dst] AS path, [predicate] AS predicates, weight, dst AS tip FROM w WHERE src = '{start}'
      UNION ALL SELECT list_append(path, w.dst), list_append(predicates, w.predicate), paths.weight + w.weight, w.dst FROM paths JOIN w ON tip = w.src
      WHERE NOT list_contains(path, w.dst) AND len(predicates) < {depth})
"""


@query(
    "graph_class_paths",
    f"WITH RECURSIVE {_DUCK_CLASSES}, {_DUCK_PATHS.format(start='order', depth=3)} SELECT array_to_string(path, '>') AS path, array_to_string(predicates, '>') AS predicates FROM paths WHERE tip = 'nation'",
)
def graph_class_paths(spark, d):
    paths = G.class_paths(_links(spark, d), "order", "nation", 3)
    return paths.select(F.concat_ws(">", "path").alias("path"), F.concat_ws(">", "predicates").alias("predicates"))


def _weighted(spark, d):
    return G.weigh(G.class_adjacency(_links(spark, d)), {"contains": 2.0, "in_nation": 1.0}, {"in_nation": 1.5})


@query(
    "graph_all_paths",
    f"WITH RECURSIVE {_DUCK_CLASSES}, {_DUCK_PATHS.format(start='part', depth=5)} SELECT array_to_string(path, '>') AS path, CAST(len(predicates) AS INTEGER) AS length, weight FROM paths WHERE tip = 'region'",
)
def graph_all_paths(spark, d):
    paths = G.simple_paths(_weighted(spark, d), "part", "region", 5)
    return paths.select(F.concat_ws(">", "path").alias("path"), "length", "weight")


@query(
    "graph_path_statistics",
    f"WITH RECURSIVE {_DUCK_CLASSES}, {_DUCK_PATHS.format(start='part', depth=5)}, r AS (SELECT CAST(len(predicates) AS INTEGER) AS length, weight FROM paths WHERE tip = 'region') "
    "SELECT count(*) AS total_paths, avg(length) AS average_length, min(length) AS min_length, max(length) AS max_length, avg(weight) AS average_weight, "
    "min(weight) AS min_weight, max(weight) AS max_weight FROM r",
)
def graph_path_statistics(spark, d):
    return G.path_statistics(G.simple_paths(_weighted(spark, d), "part", "region", 5))


@query(
    "graph_common_predicates",
    f"WITH RECURSIVE {_DUCK_CLASSES}, {_DUCK_PATHS.format(start='part', depth=5)}, r AS (SELECT predicates FROM paths WHERE tip = 'region'), "
    "u AS (SELECT unnest(list_distinct(predicates)) AS predicate FROM r) SELECT predicate, count(*) AS paths FROM u GROUP BY predicate HAVING count(*) >= 0.5 * (SELECT count(*) FROM r)",
)
def graph_common_predicates(spark, d):
    return G.common_predicates(G.simple_paths(_weighted(spark, d), "part", "region", 5))


# A directed graph between users from all events: the number k of an event names the user it points to.
_HITS = "SELECT DISTINCT 'user/' || user_id AS src, 'user/' || json_extract_string(props, '$.k') AS dst, event_type AS predicate FROM events"


def _hits(spark, d):
    to = F.concat(F.lit("user/"), F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select(F.concat(F.lit("user/"), "user_id").alias("src"), to.alias("dst"), F.col("event_type").alias("predicate")).distinct()


@query("graph_self_references", f"SELECT DISTINCT src AS node, predicate FROM ({_HITS}) WHERE src = dst")
def graph_self_references(spark, d):
    return G.self_references(_hits(spark, d))


@query(
    "graph_direct_cycles",
    f"WITH h AS ({_HITS}) SELECT x.src AS a, x.dst AS b, x.predicate AS there, y.predicate AS back FROM h x JOIN h y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst",
)
def graph_direct_cycles(spark, d):
    return G.direct_cycles(_hits(spark, d))


@query(
    "graph_indirect_cycles",
    f"""
    WITH RECURSIVE {_DUCK_EDGES}, ca AS (SELECT DISTINCT split_part(src, '/', 1) AS src, split_part(dst, '/', 1) AS dst FROM edges),
    p AS (SELECT [src, dst] AS path, dst AS tip FROM ca WHERE src < dst
      UNION ALL SELECT list_append(path, ca.dst), ca.dst FROM p JOIN ca ON tip = ca.src WHERE ca.dst > path[1] AND NOT list_contains(path, ca.dst) AND len(path) < 6),
    c AS (SELECT path FROM p JOIN ca ON tip = ca.src AND path[1] = ca.dst WHERE len(path) >= 3)
    SELECT array_to_string(min(path), '>') AS path, CAST(len(list_sort(path)) AS INTEGER) AS length FROM c GROUP BY list_sort(path)
    """,
)
def graph_indirect_cycles(spark, d):
    cycles = G.indirect_cycles(G.class_adjacency(_links(spark, d)), 6)
    return cycles.select(F.concat_ws(">", "path").alias("path"), "length")


@query(
    "graph_components",
    f"""
    WITH RECURSIVE h AS (SELECT DISTINCT src, dst FROM ({_HITS})), n AS (SELECT src AS node FROM h UNION SELECT dst FROM h),
    r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, h.dst FROM r JOIN h ON r.b = h.src)
    SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a
    """,
)
def graph_components(spark, d):
    return G.components(_hits(spark, d))


_REACH = f"""
    WITH RECURSIVE h AS (SELECT DISTINCT src, dst FROM ({_HITS})),
    r AS (SELECT '{{}}' AS node, 0 AS hops UNION SELECT h.dst, r.hops + 1 FROM r JOIN h ON r.node = h.src WHERE r.hops < {{}}),
    m AS (SELECT node, min(hops) AS hops FROM r GROUP BY node)
"""


def _user(spark, number):
    return spark.createDataFrame([(f"user/{number}",)], "node string")


@query("graph_reachable", _REACH.format("user/5", 3) + " SELECT * FROM m")
def graph_reachable(spark, d):
    return G.reachable(_hits(spark, d), _user(spark, 5), 3)


@query(
    "graph_connecting",
    _REACH.format("user/5", 2).replace("m AS", "m1 AS")
    + ", r2 AS (SELECT 'user/9' AS node, 0 AS hops UNION SELECT h.dst, r2.hops + 1 FROM r2 JOIN h ON r2.node = h.src WHERE r2.hops < 2), "
    "m2 AS (SELECT node, min(hops) AS hops FROM r2 GROUP BY node) SELECT m1.node FROM m1 SEMI JOIN (SELECT node FROM m2 WHERE hops > 0) USING (node) WHERE m1.hops > 0",
)
def graph_connecting(spark, d):
    return G.connecting(_hits(spark, d), _user(spark, 5), _user(spark, 9), 4)


@query(
    "graph_shortest_paths",
    f"""
    WITH RECURSIVE h AS (SELECT src, dst, min(CASE WHEN predicate = 'error' THEN 2.5 ELSE 1.0 END)::DOUBLE AS w FROM ({_HITS}) GROUP BY ALL),
    r AS (SELECT 'user/5' AS node, 0 AS hops, 0.0::DOUBLE AS weight UNION SELECT h.dst, r.hops + 1, r.weight + w FROM r JOIN h ON r.node = h.src WHERE r.hops < 3)
    SELECT node, min(weight) AS weight FROM r WHERE node <> 'user/5' GROUP BY node
    """,
)
def graph_shortest_paths(spark, d):
    weighted = G.weigh(_hits(spark, d), {"error": 2.5})
    return G.shortest_paths(weighted, _user(spark, 5), 3).select("node", "weight")


@query(
    "graph_edge_counts",
    f"""
    WITH {_DUCK_EDGES}, f AS (SELECT predicate, src, count(*) AS n FROM edges GROUP BY ALL)
    SELECT e.predicate, e.edges, e.targets, count(*) AS sources, max(n) AS max_fan_out
    FROM (SELECT predicate, count(*) AS edges, count(DISTINCT dst) AS targets FROM edges GROUP BY predicate) e JOIN f USING (predicate) GROUP BY ALL
    """,
)
def graph_edge_counts(spark, d):
    return G.edge_counts(_edges(spark, d))


@query(
    "graph_policy",
    f"""
    WITH {_DUCK_EDGES}, a AS (SELECT 'customer/' || c_custkey AS node FROM customer WHERE c_mktsegment <> 'BUILDING'
      UNION ALL SELECT 'order/' || o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    SELECT src, dst, predicate FROM edges WHERE predicate = 'placed_by' AND src IN (SELECT node FROM a) AND dst IN (SELECT node FROM a)
    """,
)
def graph_policy(spark, d):
    edges = _edges(spark, d).filter("predicate = 'placed_by'")
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    customers = S.apply_policy(table(spark, d, "customer"), [("c_mktsegment", "ne", "BUILDING")])
    orders = S.apply_policy(table(spark, d, "orders"), [("o_orderstatus", "eq", "P")], mode="deny")
    allowed = customers.select(F.concat(F.lit("customer/"), "c_custkey").alias("node")).unionByName(
        orders.select(F.concat(F.lit("order/"), "o_orderkey").alias("node"))
    )
    return G.allowed_graph(nodes, edges, allowed)[1].select("src", "dst", "predicate")


# Lineage: suppliers feed parts, parts feed orders, orders feed the artifact of a customer.
_LINEAGE = [
    ("lineitem", "concat('supplier/', l_suppkey)", "concat('part/', l_partkey)", "supplies", "''", "l_shipdate", "l_returnflag"),
    ("lineitem", "concat('part/', l_partkey)", "concat('order/', l_orderkey)", "ordered", "l_linestatus", "l_shipdate", "l_returnflag"),
    ("orders", "concat('order/', o_orderkey)", "concat('artifact:', lower(substr(o_orderpriority, 3)), '/', o_custkey)", "placed", "o_orderpriority", "o_orderdate", "o_orderstatus"),
]


def _lineage(spark, d):
    parts = [
        table(spark, d, t).select(
            F.expr(s).alias("src"),
            F.expr(o).alias("dst"),
            F.lit(k).alias("edge_type"),
            F.expr(p).alias("projection"),
            F.col(at).alias("occurred_at"),
            F.date_format(at, "yyyy-MM").alias("run_id"),
            F.col(code).alias("code"),
        )
        for t, s, o, k, p, at, code in _LINEAGE
    ]
    return reduce(DataFrame.unionByName, parts)


_DUCK_LINEAGE = "lin AS (" + " UNION ALL ".join(
    f"SELECT {s} AS src, {o} AS dst, '{k}' AS edge_type, {p} AS projection, {at} AS occurred_at, strftime({at}, '%Y-%m') AS run_id, {code} AS code FROM {t}"
    for t, s, o, k, p, at, code in _LINEAGE
) + ")"


def _duck_walk(name: str, root: str, depth: int, down: bool = True, until: str | None = None) -> str:
    here, there = ("src", "dst") if down else ("dst", "src")
    when = f" AND occurred_at <= TIMESTAMP '{until}'" if until else ""
    levels = [f"{name}0 AS (SELECT '{root}' AS node)"]
    for i in range(1, depth + 1):
        levels.append(f"{name}{i} AS (SELECT DISTINCT {there} AS node FROM lin WHERE {here} IN (SELECT node FROM {name}{i - 1}){when})")
    union = " UNION ALL ".join(f"SELECT node, {i} AS hops FROM {name}{i}" for i in range(depth + 1))
    return ", ".join(levels) + f", {name} AS (SELECT node, min(hops) AS hops FROM ({union}) GROUP BY node)"


@query("lineage_downstream", f"WITH {_DUCK_LINEAGE}, {_duck_walk('w', 'supplier/3', 3)} SELECT * FROM w")
def lineage_downstream(spark, d):
    return L.walk(_lineage(spark, d), "supplier/3", "downstream", 3)


@query(
    "lineage_upstream",
    f"WITH {_DUCK_LINEAGE}, {_duck_walk('w', 'artifact:urgent/7', 3, False, '1999-01-01')} SELECT * FROM w",
)
def lineage_upstream(spark, d):
    return L.walk(_lineage(spark, d), "artifact:urgent/7", "upstream", 3, F.lit("1999-01-01").cast("timestamp_ntz"))


@query(
    "lineage_both",
    f"WITH {_DUCK_LINEAGE}, {_duck_walk('w', 'part/11', 2)}, {_duck_walk('v', 'part/11', 2, False)} "
    "SELECT node, min(hops) AS hops FROM (SELECT * FROM w UNION ALL SELECT * FROM v) GROUP BY node",
)
def lineage_both(spark, d):
    return L.walk(_lineage(spark, d), "part/11", "both", 2)


@query(
    "lineage_walk_edges",
    f"WITH {_DUCK_LINEAGE}, {_duck_walk('w', 'supplier/3', 2)} SELECT DISTINCT src, dst, edge_type, projection FROM lin WHERE src IN (SELECT node FROM w WHERE hops < 2)",
)
def lineage_walk_edges(spark, d):
    edges = _lineage(spark, d)
    return L.walk_edges(edges, L.walk(edges, "supplier/3", "downstream", 2), 2, "downstream")


@query(
    "lineage_shortest_path",
    f"""
    WITH {_DUCK_LINEAGE}, t AS (SELECT DISTINCT src, dst FROM lin)
    SELECT array_to_string(min([a.src, a.dst, b.dst, c.dst]), '>') AS path, 3 AS hops FROM t a JOIN t b ON a.dst = b.src JOIN t c ON b.dst = c.src
    WHERE a.src = 'supplier/3' AND c.dst = (SELECT min(dst) FROM lin WHERE edge_type = 'placed')
    """,
)
def lineage_shortest_path(spark, d):
    edges = _lineage(spark, d)
    # The alphabetically first artifact; one value from one aggregate.
    target = edges.filter("edge_type = 'placed'").agg(F.min("dst")).first()[0]
    return L.shortest_path(edges, "supplier/3", target, "downstream", 5).select(F.concat_ws(">", "path").alias("path"), "hops")


_DUCK_IMPACT = f"""
    WITH {_DUCK_LINEAGE}, {_duck_walk('w', 'part/11', 2)}, i AS (SELECT w.node, split_part(split_part(w.node, ':', 2), '/', 1) AS kind, hops, max(occurred_at) AS latest_at
      FROM w JOIN lin ON dst = w.node WHERE starts_with(w.node, 'artifact:') GROUP BY ALL)
"""


@query("lineage_impact", f"{_DUCK_IMPACT} SELECT node, kind, hops, strftime(latest_at, '%Y-%m-%d') AS latest_at FROM i")
def lineage_impact(spark, d):
    return L.impact(_lineage(spark, d), "part/11", 2).withColumn("latest_at", F.date_format("latest_at", "yyyy-MM-dd"))


@query(
    "lineage_impact_by_kind",
    f"{_DUCK_IMPACT} SELECT kind, count(*) AS artifacts, strftime(max(latest_at), '%Y-%m-%d') AS latest_at FROM i GROUP BY kind",
)
def lineage_impact_by_kind(spark, d):
    kinds = L.impact_by_kind(L.impact(_lineage(spark, d), "part/11", 2))
    return kinds.withColumn("latest_at", F.date_format("latest_at", "yyyy-MM-dd"))


@query(
    "lineage_edge_difference",
    f"WITH {_DUCK_LINEAGE}, {_duck_walk('w', 'supplier/3', 3, True, '1996-01-01')}, {_duck_walk('v', 'supplier/3', 3, True, '1997-01-01')}, "
    "a AS (SELECT DISTINCT src, dst, edge_type FROM lin WHERE occurred_at <= TIMESTAMP '1997-01-01' AND src IN (SELECT node FROM v) AND dst IN (SELECT node FROM v)), "
    "b AS (SELECT DISTINCT src, dst, edge_type FROM lin WHERE occurred_at <= TIMESTAMP '1996-01-01' AND src IN (SELECT node FROM w) AND dst IN (SELECT node FROM w)) "
    "SELECT *, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
)
def lineage_edge_difference(spark, d):
    before, after = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (1996, 1997))
    return L.edge_difference(_lineage(spark, d), "supplier/3", before, after, "downstream", 3)


@query(
    "lineage_difference",
    f"WITH {_DUCK_LINEAGE}, {_duck_walk('w', 'supplier/3', 3, True, '1996-01-01')}, {_duck_walk('v', 'supplier/3', 3, True, '1997-01-01')} "
    "SELECT node, 'added' AS change FROM v ANTI JOIN w USING (node)",
)
def lineage_difference(spark, d):
    before, after = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (1996, 1997))
    return L.walk_difference(_lineage(spark, d), "supplier/3", before, after, "downstream", 3)


_DUCK_RUNS = f"""
    WITH {_DUCK_LINEAGE}, r AS (SELECT run_id, min(occurred_at) AS f, max(occurred_at) AS l, count(*) AS edge_count,
      count(DISTINCT dst) FILTER (starts_with(dst, 'artifact:')) AS impacted_artifact_count, count(DISTINCT projection) FILTER (projection <> '') AS impacted_projection_count
      FROM lin WHERE occurred_at >= TIMESTAMP '1996-03-10' GROUP BY run_id)
"""


@query(
    "lineage_runs",
    f"{_DUCK_RUNS} SELECT run_id, strftime(f, '%Y-%m-%d') AS first_occurred_at, strftime(l, '%Y-%m-%d') AS last_occurred_at, edge_count, impacted_artifact_count, impacted_projection_count FROM r",
)
def lineage_runs(spark, d):
    runs = L.run_summaries(_lineage(spark, d), since=F.lit("1996-03-10").cast("timestamp_ntz"))
    return runs.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_occurred_at", "last_occurred_at")})


@query(
    "lineage_run_freshness",
    f"""{_DUCK_RUNS}, a AS (SELECT run_id, date_diff('second', l, TIMESTAMP '2001-12-01') / 60 AS age FROM r)
    SELECT run_id, round(greatest(0, age), 4) AS age_minutes, CASE WHEN age <= 1000000 THEN 'healthy' WHEN age <= 3000000 THEN 'warning' ELSE 'critical' END AS status,
      CASE WHEN age <= 1000000 THEN 3 WHEN age <= 3000000 THEN 1 ELSE 0 END AS rank FROM a""",
)
def lineage_run_freshness(spark, d):
    runs = L.run_summaries(_lineage(spark, d), since=F.lit("1996-03-10").cast("timestamp_ntz"))
    judged = L.freshness(runs, "last_occurred_at", F.lit("2001-12-01").cast("timestamp"), 1_000_000)
    return judged.select("run_id", F.round("age_minutes", 4).alias("age_minutes"), "status", L.status_rank(F.col("status")).alias("rank"))


@query(
    "lineage_latest_writes",
    f"""
    WITH {_DUCK_LINEAGE}, k AS (SELECT DISTINCT 'artifact:urgent/' || c_custkey AS node FROM customer)
    SELECT node, strftime(max(occurred_at), '%Y-%m-%d') AS last_occurred_at, count(dst) AS write_count FROM k LEFT JOIN lin ON dst = node GROUP BY node
    """,
)
def lineage_latest_writes(spark, d):
    items = table(spark, d, "customer").select(F.concat(F.lit("artifact:urgent/"), "c_custkey").alias("node"))
    written = L.latest_writes(items, _lineage(spark, d), "node", "dst")
    return written.withColumn("last_occurred_at", F.date_format("last_occurred_at", "yyyy-MM-dd"))


@query(
    "lineage_latest_projection_writes",
    f"WITH {_DUCK_LINEAGE} SELECT projection, strftime(max(occurred_at), '%Y-%m-%d') AS last_occurred_at, count(*) AS write_count FROM lin WHERE projection <> '' GROUP BY projection",
)
def lineage_latest_projection_writes(spark, d):
    edges = _lineage(spark, d).filter("projection <> ''")
    written = L.latest_writes(edges.select("projection").distinct(), edges, "projection", "projection")
    return written.withColumn("last_occurred_at", F.date_format("last_occurred_at", "yyyy-MM-dd"))


@query(
    "lineage_latest_edge_to",
    f"WITH {_DUCK_LINEAGE} SELECT dst, src, edge_type, strftime(occurred_at, '%Y-%m-%d') AS occurred_at FROM lin QUALIFY row_number() OVER (PARTITION BY dst ORDER BY lin.occurred_at DESC, src DESC, edge_type DESC) = 1",
)
def lineage_latest_edge_to(spark, d):
    edges = _lineage(spark, d).select("dst", "src", "edge_type", "occurred_at")
    return L.latest_edges(edges, "dst", ["src", "edge_type"]).withColumn("occurred_at", F.date_format("occurred_at", "yyyy-MM-dd"))


@query(
    "lineage_latest_edge_from",
    f"WITH {_DUCK_LINEAGE} SELECT src, dst, edge_type, strftime(occurred_at, '%Y-%m-%d') AS occurred_at FROM lin QUALIFY row_number() OVER (PARTITION BY src ORDER BY lin.occurred_at DESC, dst DESC, edge_type DESC) = 1",
)
def lineage_latest_edge_from(spark, d):
    edges = _lineage(spark, d).select("dst", "src", "edge_type", "occurred_at")
    return L.latest_edges(edges, "src", ["dst", "edge_type"]).withColumn("occurred_at", F.date_format("occurred_at", "yyyy-MM-dd"))


@query(
    "lineage_out_of_date",
    f"""
    WITH {_DUCK_LINEAGE}, items AS (SELECT 'artifact:urgent/' || c_custkey AS node FROM customer), wr AS (SELECT * FROM lin WHERE edge_type = 'placed'), em AS (SELECT * FROM lin WHERE edge_type = 'ordered'),
    lw AS (SELECT * FROM wr QUALIFY row_number() OVER (PARTITION BY dst ORDER BY occurred_at DESC, src DESC) = 1),
    pa AS (SELECT dst AS event, src AS parent FROM em QUALIFY row_number() OVER (PARTITION BY dst ORDER BY occurred_at DESC, src DESC) = 1),
    pl AS (SELECT src AS parent, max(occurred_at) AS parent_at FROM em GROUP BY src),
    nw AS (SELECT projection, code AS newest_code, occurred_at AS newest_at FROM wr QUALIFY row_number() OVER (PARTITION BY projection ORDER BY occurred_at DESC, src DESC) = 1),
    x AS (SELECT node, lw.occurred_at AS att, code, newest_code, newest_at, parent_at, date_diff('second', lw.occurred_at, TIMESTAMP '2001-12-01') / 60 AS age, (SELECT max(occurred_at) FROM em) AS up
      FROM items LEFT JOIN lw ON lw.dst = node LEFT JOIN pa ON pa.event = lw.src LEFT JOIN pl USING (parent) LEFT JOIN nw USING (projection)),
    s AS (SELECT *, CASE WHEN att IS NULL THEN 'no_data' WHEN age <= 500000 THEN 'healthy' WHEN age <= 1500000 THEN 'warning' ELSE 'critical' END AS status FROM x),
    c AS (SELECT *, CASE WHEN status IN ('healthy', 'no_data') THEN 'none' WHEN parent_at > att THEN 'parent' WHEN up > att THEN 'ancestor' ELSE 'none' END AS scope FROM s)
    SELECT node, status, scope, CASE status WHEN 'healthy' THEN 'healthy' WHEN 'no_data' THEN 'no_lineage_data' ELSE
        CASE scope WHEN 'parent' THEN 'parent_has_newer_events' WHEN 'ancestor' THEN 'ancestor_has_newer_events' ELSE 'freshness_slo_breached' END END AS reason,
      CASE WHEN status NOT IN ('healthy', 'no_data') AND newest_at > att AND code <> newest_code THEN 'logic' WHEN scope <> 'none' THEN 'data' ELSE 'none' END AS update_type,
      CASE WHEN att IS NULL THEN 0.0 ELSE greatest(round(date_diff('second', att, up) / 60, 4), 0) END::DOUBLE AS upstream_gap_minutes FROM c
    """,
)
def lineage_out_of_date(spark, d):
    edges = _lineage(spark, d)
    items = table(spark, d, "customer").select(F.concat(F.lit("artifact:urgent/"), "c_custkey").alias("node"))
    writes, emitted = edges.filter("edge_type = 'placed'"), edges.filter("edge_type = 'ordered'")
    judged = L.out_of_date(items, writes, emitted, F.lit("2001-12-01").cast("timestamp"), 500_000, ["src"])
    return judged.withColumn("upstream_gap_minutes", F.round("upstream_gap_minutes", 4))


@query(
    "lineage_coverage",
    "SELECT count(*) AS events, count(*) FILTER (known) AS recorded, count(*) FILTER (NOT known) AS missing, round(count(*) FILTER (NOT known) / count(*), 6) AS missing_ratio "
    "FROM (SELECT event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS known FROM events)",
)
def lineage_coverage(spark, d):
    edges = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("dst"))
    report = L.coverage(table(spark, d, "events").select("event_id"), edges, "event_id")
    return report.withColumn("missing_ratio", F.round("missing_ratio", 6))


@query("lineage_missing_events", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def lineage_missing_events(spark, d):
    edges = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("dst"))
    return L.missing_events(table(spark, d, "events").select("event_id"), edges, "event_id")


_TIMELINE = "SELECT CAST(floor(epoch(ts) / 5400) * 5400 AS BIGINT) AS bucket_start, event_type AS edge_type, count(*) AS edges FROM events GROUP BY ALL"


def _timed(spark, d):
    return table(spark, d, "events").selectExpr("event_type AS edge_type", "ts AS occurred_at")


@query("lineage_timeline", _TIMELINE)
def lineage_timeline(spark, d):
    return L.timeline(_timed(spark, d), 90)


@query(
    "lineage_spikes",
    """
    WITH b AS (SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS bucket_start, count(*) AS edges FROM events GROUP BY 1), m AS (SELECT median(edges) AS baseline FROM b)
    SELECT bucket_start, edges, baseline, greatest(5.0, baseline * 3) AS threshold FROM b, m WHERE edges >= greatest(5.0, baseline * 3)
    """,
)
def lineage_spikes(spark, d):
    return L.spikes(_timed(spark, d), 5)


@query(
    "lineage_columns",
    """
    WITH p AS (SELECT unnest(['l_quantity', 'l_extendedprice']) AS source_column, CASE l_linestatus WHEN 'O' THEN 'open_' ELSE 'final_' END AS prefix, l_returnflag, l_shipdate FROM lineitem)
    SELECT source_column, prefix || source_column AS target_column, l_returnflag AS dataset, 'Sale' AS class, count(*) AS uses, strftime(max(l_shipdate), '%Y-%m-%d') AS latest_at FROM p GROUP BY ALL
    """,
)
def lineage_columns(spark, d):
    pairs = table(spark, d, "lineitem").select(
        F.explode(F.array(F.lit("l_quantity"), F.lit("l_extendedprice"))).alias("source_column"),
        F.expr("CASE l_linestatus WHEN 'O' THEN 'open_' ELSE 'final_' END").alias("prefix"),
        F.col("l_returnflag").alias("dataset"),
        F.lit("Sale").alias("class"),
        F.col("l_shipdate").alias("occurred_at"),
    )
    pairs = pairs.withColumn("target_column", F.concat("prefix", "source_column"))
    return L.column_lineage(pairs).withColumn("latest_at", F.date_format("latest_at", "yyyy-MM-dd"))


def _points(spark, d):
    return table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")


_POINT = "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY events.ts {0}, event_id {0}) = 1"


@query("series_first_point", _POINT.format("ASC"))
def series_first_point(spark, d):
    points = TS.first_point(_points(spark, d), ["user_id", "event_type"], "ts", "event_id", "value")
    return points.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("series_last_point", _POINT.format("DESC"))
def series_last_point(spark, d):
    points = TS.last_point(_points(spark, d), ["user_id", "event_type"], "ts", "event_id", "value")
    return points.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "series_range",
    "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:30:00'",
)
def series_range(spark, d):
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05 06:00:00", "2024-01-09 18:30:00"))
    return TS.between(_points(spark, d), "ts", start, end).select("event_id", "value")


@query(
    "series_relative_before",
    "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-06 00:00:00' AND TIMESTAMP '2024-01-19 12:00:00'",
)
def series_relative_before(spark, d):
    now = datetime.datetime(2024, 1, 20)
    return TS.relative(_points(spark, d), "ts", now, (2, "WEEKS"), (12, "HOURS")).select("event_id", "value")


@query(
    "series_relative_after",
    "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-02-09 00:00:00'",
)
def series_relative_after(spark, d):
    now = datetime.datetime(2024, 1, 10)
    return TS.relative(_points(spark, d), "ts", now, (1, "MONTHS"), when="AFTER").select("event_id", "value")


@query(
    "udf_rows",
    "SELECT p_partkey, upper(p_type) || '-' || p_size AS code, p_retailprice * 2 AS price FROM part",
)
def udf_rows(spark, d):
    def make(row):
        return {"p_partkey": row["p_partkey"], "code": f"{row['p_type'].upper()}-{row['p_size']}", "price": row["p_retailprice"] * 2}

    return U.map_rows(table(spark, d, "part"), make, "p_partkey bigint, code string, price double")


@query(
    "udf_flat_map",
    "SELECT conv_id, turn, word FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations WHERE role <> 'system') WHERE length(word) > 6",
)
def udf_flat_map(spark, d):
    def words(row):
        if row["role"] == "system":
            return None
        return [{"conv_id": row["conv_id"], "turn": row["turn"], "word": w} for w in row["text"].split(" ") if len(w) > 6]

    return U.map_rows(table(spark, d, "conversations"), words, "conv_id bigint, turn bigint, word string")


@query("udf_batches", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def udf_batches(spark, d):
    def net(batch):
        batch["net"] = (batch["l_extendedprice"] * (1 - batch["l_discount"])).round(4)
        return batch[["l_orderkey", "l_linenumber", "net"]]

    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return U.map_batches(items, net, "l_orderkey bigint, l_linenumber int, net double")
