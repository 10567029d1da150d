"""Queries for joins, lookups, as-of matching, key checks and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import joins as J
from loomframe.operators.asof import asof_join
from loomframe.plans.registry import query, table


@query(
    "join_inner",
    """
    SELECT l_orderkey, l_linenumber, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
def join_inner(spark, d):
    joined = J.join(table(spark, d, "lineitem"), table(spark, d, "orders"), ["l_orderkey"], ["o_orderkey"])
    return joined.select("l_orderkey", "l_linenumber", "o_custkey", "o_orderstatus")


_COLLIDING = """
    {} (SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer) l
    {} JOIN (SELECT s_suppkey AS key, s_name AS name, s_acctbal AS right_name FROM supplier) r ON l.key = r.key
"""


def _colliding(spark, d):
    left = table(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_nationkey AS nation")
    right = table(spark, d, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS right_name")
    return left, right


@query(
    "join_left_collision",
    _COLLIDING.format('SELECT l.key, l.name, l.nation, r.name AS "right_name__1", r.right_name FROM', "LEFT"),
)
def join_left_collision(spark, d):
    return J.join(*_colliding(spark, d), ["key"], how="left")


@query(
    "join_right",
    "SELECT n_nationkey AS s_nationkey, n_name, s_suppkey, s_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey",
)
def join_right(spark, d):
    nation = table(spark, d, "nation").selectExpr("n_nationkey AS s_nationkey", "n_name")
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return J.join(nation, suppliers, ["s_nationkey"], how="right")


_HALVES = """
    (SELECT l_partkey, l_suppkey, sum(l_quantity) AS {name} FROM lineitem
     WHERE l_returnflag {test} GROUP BY l_partkey, l_suppkey)
"""


@query(
    "join_full_composite",
    f"SELECT l_partkey, l_suppkey, returned, kept FROM {_HALVES.format(name='returned', test=chr(61) + chr(39) + 'R' + chr(39))} a "
    f"FULL JOIN {_HALVES.format(name='kept', test='<> ' + chr(39) + 'R' + chr(39))} b USING (l_partkey, l_suppkey)",
)
def join_full_composite(spark, d):
    items = table(spark, d, "lineitem")
    returned = items.filter("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("returned"))
    kept = items.filter("l_returnflag <> 'R'").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("kept"))
    return J.join(returned, kept, ["l_partkey", "l_suppkey"], how="full")


@query("join_semi", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def join_semi(spark, d):
    large = table(spark, d, "orders").filter("o_totalprice > 400000")
    return J.join(table(spark, d, "customer"), large, ["c_custkey"], ["o_custkey"], "left_semi").select("c_custkey", "c_name")


@query("join_anti", "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def join_anti(spark, d):
    large = table(spark, d, "orders").filter("o_totalprice > 400000")
    return J.join(table(spark, d, "customer"), large, ["c_custkey"], ["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query(
    "join_hint",
    "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
)
def join_hint(spark, d):
    joined = J.join(
        table(spark, d, "lineitem"), table(spark, d, "part"), ["l_partkey"], ["p_partkey"], right_hint="shuffle_hash"
    )
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rows_changed",
    """
    SELECT o_orderkey, o_totalprice, status FROM (SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS status FROM orders)
    WHERE status IS NULL OR o_totalprice > 300000
    """,
)
def rows_changed(spark, d):
    orders = table(spark, d, "orders")
    now = orders.selectExpr("o_orderkey", "o_totalprice", "nullif(o_orderstatus, 'P') AS status")
    before = orders.selectExpr("o_orderkey", "least(o_totalprice, 300000D) AS o_totalprice", "o_orderstatus AS status")
    return J.changed(now, before, ["o_orderkey"], ["o_totalprice", "status"])


@query(
    "stream_join_static",
    "SELECT event_id, e.user_id, c_name FROM events e LEFT JOIN customer ON e.user_id = c_custkey",
)
def stream_join_static(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id")
    return J.join(events, table(spark, d, "customer"), ["user_id"], ["c_custkey"], "left").select("event_id", "user_id", "c_name")


@query(
    "stream_join_lookup",
    """
    SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN
      (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
      ON c_custkey = o_custkey
    """,
)
def stream_join_lookup(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    joined = J.lookup(table(spark, d, "customer"), orders, ["c_custkey"], ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return joined.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


_REACH = 20_000
_ASOF = {
    "backward": ("r.sec <= l.sec", "l.sec - r.sec", "r.sec DESC NULLS LAST"),
    "forward": ("r.sec >= l.sec", "r.sec - l.sec", "r.sec ASC NULLS LAST"),
    "symmetric": ("true", "abs(l.sec - r.sec)", "1"),
}


def _asof_sql(direction: str, how: str) -> str:
    side, delta, order = _ASOF[direction]
    parts = ["SELECT user_id, event_id, right_event_id FROM best"]
    if how in ("left", "full"):
        parts.append("SELECT user_id, event_id, NULL FROM l ANTI JOIN best USING (event_id)")
    if how in ("right", "full"):
        parts.append("SELECT user_id, NULL, r.event_id FROM r WHERE r.event_id NOT IN (SELECT right_event_id FROM best)")
    return f"""
    WITH l AS (SELECT *, CASE WHEN value <= 55 THEN CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) END AS sec
               FROM events WHERE event_type = 'click'),
    r AS (SELECT *, CASE WHEN value <= 60 THEN CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) END AS sec
          FROM events WHERE event_type = 'view'),
    best AS (
      SELECT l.user_id, l.event_id, r.event_id AS right_event_id FROM l JOIN r ON l.user_id = r.user_id
      WHERE l.sec IS NULL OR r.sec IS NULL OR ({side} AND {delta} <= {_REACH})
      QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY
        CASE WHEN l.sec IS NULL OR r.sec IS NULL THEN 1 ELSE 0 END,
        CASE WHEN l.sec IS NULL OR r.sec IS NULL THEN 9e18 ELSE {delta} END, {order}, r.event_id) = 1)
    {" UNION ALL ".join(parts)}
    """


def _asof(spark, d, direction, how):
    events = table(spark, d, "events")

    def side(kind, limit):
        timed = F.when(F.col("value") <= limit, F.col("ts"))
        return events.filter(F.col("event_type") == kind).select("user_id", "event_id", timed.alias("ts"))

    joined = asof_join(
        side("click", 55),
        side("view", 60),
        ["user_id"],
        "ts",
        "ts",
        "event_id",
        "event_id",
        lateness=_REACH,
        left_cache=90_000,
        right_cache=80_000,
        direction=direction,
        how=how,
    )
    return joined.select("user_id", "event_id", "right_event_id")


@query("asof_backward", _asof_sql("backward", "full"))
def asof_backward(spark, d):
    return _asof(spark, d, "backward", "full")


@query("asof_forward", _asof_sql("forward", "left"))
def asof_forward(spark, d):
    return _asof(spark, d, "forward", "left")


@query("asof_symmetric", _asof_sql("symmetric", "full"))
def asof_symmetric(spark, d):
    return _asof(spark, d, "symmetric", "full")


@query(
    "range_join",
    """
    SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem
    JOIN (SELECT p_partkey, p_retailprice * 30 AS low, p_retailprice * 30 + p_size AS high FROM part)
      ON l_partkey = p_partkey AND l_extendedprice >= low AND l_extendedprice < high
    """,
)
def range_join(spark, d):
    spans = table(spark, d, "part").selectExpr(
        "p_partkey AS l_partkey", "p_retailprice * 30 AS low", "p_retailprice * 30 + p_size AS high"
    )
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    matched = J.range_join(items, spans, "l_extendedprice", "low", "high", 25.0, ["l_partkey"])
    return matched.selectExpr("l_orderkey", "l_linenumber", "l_partkey AS p_partkey")


@query(
    "orphan_keys",
    "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')",
)
def orphan_keys(spark, d):
    parents = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'")
    return J.orphans(table(spark, d, "events"), parents, ["user_id"], ["c_custkey"]).select("event_id", "user_id")


@query(
    "orphan_keys_nulls",
    """
    SELECT count(*) AS orphans FROM (SELECT nullif(l_partkey, 10) AS p, nullif(l_suppkey, 3) AS s FROM lineitem) c
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A') x
                      WHERE x.p = c.p AND x.s = c.s)
    """,
)
def orphan_keys_nulls(spark, d):
    items = table(spark, d, "lineitem")
    child = items.selectExpr("nullif(l_partkey, 10) AS p", "nullif(l_suppkey, 3) AS s")
    parent = items.filter("l_returnflag = 'A'").selectExpr("l_partkey AS p", "l_suppkey AS s")
    return J.orphans(child, parent, ["p", "s"], allow_nulls=False).agg(F.count(F.lit(1)).alias("orphans"))


_QUALITY_SQL = """
    WITH l AS (SELECT nullif(l_suppkey, 5) AS k FROM lineitem), r AS (SELECT c_nationkey * 2 AS k FROM customer),
    t AS (SELECT (SELECT count(*) FROM l) AS ln, (SELECT count(*) FROM r) AS rn,
      (SELECT count(*) FROM l SEMI JOIN r USING (k)) AS lm, (SELECT count(*) FROM r SEMI JOIN l USING (k)) AS rm,
      (SELECT CAST(sum(a.n * b.n) AS BIGINT) FROM (SELECT k, count(*) AS n FROM l GROUP BY k) a
         JOIN (SELECT k, count(*) AS n FROM r GROUP BY k) b USING (k)) AS m),
    o AS (SELECT *, j AS join_type, m + CASE WHEN j IN ('left', 'full') THEN ln - lm ELSE 0 END
            + CASE WHEN j IN ('right', 'full') THEN rn - rm ELSE 0 END AS output_rows
          FROM t, (SELECT unnest(['inner', 'left', 'right', 'full']) AS j))
    SELECT ln AS left_rows, rn AS right_rows, round(lm / ln, 6) AS left_coverage, round(rm / rn, 6) AS right_coverage,
      round((ln - lm) / ln, 6) AS left_missing, round((rn - rm) / rn, 6) AS right_missing, join_type, output_rows,
      round(output_rows / greatest(ln, rn), 6) AS explosion,
      round(CASE WHEN j IN ('right', 'full') THEN (rn - rm) / output_rows ELSE 0 END, 6) AS left_null_ratio,
      round(CASE WHEN j IN ('left', 'full') THEN (ln - lm) / output_rows ELSE 0 END, 6) AS right_null_ratio
    FROM o
"""


@query("join_quality", _QUALITY_SQL)
def join_quality(spark, d):
    left = table(spark, d, "lineitem").selectExpr("nullif(l_suppkey, 5) AS k")
    right = table(spark, d, "customer").selectExpr("c_nationkey * 2 AS k")
    report = J.join_quality(left, right, ["k"]).withColumn("output_rows", F.col("output_rows").cast("bigint"))
    return report.withColumns({c: F.round(c, 6) for c, t in report.dtypes if t == "double"})


@query(
    "search_around",
    """
    SELECT p_partkey, p_name FROM part WHERE p_partkey IN (
      SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 450000))
    """,
)
def search_around(spark, d):
    found = J.search_around(
        table(spark, d, "orders").filter("o_totalprice > 450000"),
        table(spark, d, "lineitem"),
        table(spark, d, "part"),
        "o_orderkey",
        "p_partkey",
        "l_orderkey",
        "l_partkey",
    )
    return found.select("p_partkey", "p_name")


@query(
    "link_rows",
    """
    SELECT DISTINCT l_orderkey AS o_orderkey, 'contains' AS link, 'Part' AS target_type, l_partkey AS target
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND l_partkey IS NOT NULL
    """,
)
def link_rows(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return J.link_rows(urgent, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", "l_partkey", "contains", "Part")


@query(
    "load_links",
    """
    SELECT l_orderkey, 0 AS chunk, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS targets
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY l_orderkey
    """,
)
def load_links(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    links = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("l_partkey"))
    lists = J.load_links(urgent, links, "o_orderkey", "l_orderkey", "l_partkey")
    return lists.withColumn("targets", F.concat_ws(",", "targets"))
