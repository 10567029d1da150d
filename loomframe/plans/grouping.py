"""Queries for aggregation, buckets, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import aggregates as A
from loomframe.operators import rollups as RU
from loomframe.operators import windows as W
from loomframe.plans.registry import query, table


@query(
    "aggregate_metrics",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS "count_*", round(sum(l_quantity), 2) AS sum_l_quantity,
      round(avg(l_extendedprice), 6) AS mean_price, min(l_discount) AS min_l_discount, max(l_tax) AS max_l_tax
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def aggregate_metrics(spark, d):
    df = A.aggregate(
        table(spark, d, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        [
            {"op": "count"},
            {"op": "sum", "column": "l_quantity"},
            {"op": "avg", "column": "l_extendedprice", "alias": "mean_price"},
            {"op": "min", "column": "l_discount"},
            {"op": "max", "column": "l_tax"},
        ],
    )
    return df.withColumns({"sum_l_quantity": F.round("sum_l_quantity", 2), "mean_price": F.round("mean_price", 6)})


@query(
    "aggregate_global",
    "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean FROM orders",
)
def aggregate_global(spark, d):
    df = A.aggregate(
        table(spark, d, "orders"),
        [],
        [
            {"op": "count", "alias": "n"},
            {"op": "sum", "column": "o_totalprice", "alias": "total"},
            {"op": "avg", "column": "o_totalprice", "alias": "mean"},
        ],
    )
    return df.select("n", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"))


@query(
    "aggregate_expressions",
    """
    SELECT o_orderpriority, round(stddev_samp(o_totalprice), 4) AS spread, round(var_samp(o_totalprice / 1000), 4) AS variance,
      count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderstatus = 'F') AS finished
    FROM orders GROUP BY o_orderpriority
    """,
)
def aggregate_expressions(spark, d):
    return A.aggregate_expressions(
        table(spark, d, "orders"),
        ["o_orderpriority"],
        {
            "spread": "round(stddev(o_totalprice), 4)",
            "variance": "round(variance(o_totalprice / 1000), 4)",
            "customers": "count(DISTINCT o_custkey)",
            "finished": "count_if(o_orderstatus = 'F')",
        },
    )


@query(
    "aggregate_collect",
    """
    SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS flags, count(*) AS items
    FROM lineitem GROUP BY l_orderkey
    """,
)
def aggregate_collect(spark, d):
    df = A.aggregate_expressions(
        table(spark, d, "lineitem"),
        ["l_orderkey"],
        {"flags": "sort_array(collect_set(l_returnflag))", "items": "count(1)"},
    )
    return df.withColumn("flags", F.concat_ws("", "flags"))


@query(
    "distinct_exact",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
)
def distinct_exact(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        A.metric("exactDistinct", "l_partkey").alias("parts"), A.metric("exactDistinct", "l_suppkey").alias("suppliers")
    )


@query("distinct_approximate")
def distinct_approximate(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(A.metric("approximateDistinct", "l_partkey").alias("parts"))


@query("percentile_approximate")
def percentile_approximate(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        A.metric("approximatePercentile", "o_totalprice", 0.95).alias("p95")
    )


@query(
    "percentile_exact",
    "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY o_orderpriority",
)
def percentile_exact(spark, d):
    found = RU.percentile_exact(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 0.95, "p95")
    return found.withColumn("p95", F.round("p95", 4))


_LATTICE = (
    "SELECT l_returnflag, l_linestatus, l_linenumber, CAST(GROUPING_ID(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS grouping_id, "
    "count(*) AS items, CAST(sum(l_partkey) AS BIGINT) AS parts, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean "
    "FROM lineitem GROUP BY {}"
)
_DIMENSIONS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def _lattice(spark, d, sets):
    metrics = {"items": ("count", None), "parts": ("sum", "l_partkey"), "least": ("min", "l_quantity"), "most": ("max", "l_quantity"), "mean": ("avg", "l_quantity")}
    return RU.grouping_sets(table(spark, d, "lineitem"), sets, metrics).withColumn("mean", F.round("mean", 6))


@query("group_cube", _LATTICE.format("CUBE (l_returnflag, l_linestatus, l_linenumber)"))
def group_cube(spark, d):
    return _lattice(spark, d, RU.cube(_DIMENSIONS))


@query("group_rollup", _LATTICE.format("ROLLUP (l_returnflag, l_linestatus, l_linenumber)"))
def group_rollup(spark, d):
    return _lattice(spark, d, RU.rollup(_DIMENSIONS))


@query("grouping_sets", _LATTICE.format("GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus, l_linenumber), (l_linenumber), ())"))
def grouping_sets(spark, d):
    return _lattice(spark, d, [("l_returnflag", "l_linestatus"), ("l_linestatus", "l_linenumber"), ("l_linenumber",), ()])


def _price_sketches(spark, d):
    """Sketches per supplier and flag, merged per flag: the rows themselves are read once only."""
    return RU.merge_sketches(RU.sketch(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_partkey"], ["l_extendedprice"]), ["l_returnflag"])


@query("sketch_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS within FROM lineitem GROUP BY l_returnflag")
def sketch_distinct(spark, d):
    """Estimates from merged sketches, beside the exact number: within 5 %, three times the standard error."""
    estimated = _price_sketches(spark, d).select("l_returnflag", RU.distinct_estimate("distinct_l_partkey").alias("estimate"))
    exact = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))
    within = F.abs(F.col("estimate") - F.col("parts")) <= F.col("parts") * 0.05
    return exact.join(estimated, "l_returnflag").select("l_returnflag", "parts", within.alias("within"))


@query("sketch_quantiles", "SELECT l_returnflag, count(*) AS items, true AS within FROM lineitem GROUP BY l_returnflag")
def sketch_quantiles(spark, d):
    """The estimated median has between 46 and 54 % of a flag's items at or below it: the rank error of a merged sketch stays below that."""
    estimated = _price_sketches(spark, d).select("l_returnflag", RU.quantile_estimate("quantiles_l_extendedprice", 0.5).alias("median"))
    items = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice").join(estimated, "l_returnflag")
    shares = items.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("l_extendedprice") <= F.col("median")).alias("below"))
    return shares.select("l_returnflag", "items", (F.col("below") / F.col("items")).between(0.46, 0.54).alias("within"))


@query(
    "metrics_empty",
    "SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_totalprice) AS top FROM orders WHERE o_totalprice < 0",
)
def metrics_empty(spark, d):
    return table(spark, d, "orders").filter("o_totalprice < 0").agg(
        A.metric("count").alias("n"), A.metric("sum", "o_totalprice").alias("total"), A.metric("max", "o_totalprice").alias("top")
    )


@query(
    "group_exact",
    "SELECT l_partkey, count(*) AS count, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_partkey ORDER BY count DESC, l_partkey LIMIT 100",
)
def group_exact(spark, d):
    return A.group_exact(table(spark, d, "lineitem"), "l_partkey", {"quantity": F.round(F.sum("l_quantity"), 2)}, max_groups=100)


@query(
    "group_fixed_width",
    """
    WITH b AS (SELECT CAST(floor(o_totalprice / 250) AS BIGINT) AS step FROM orders)
    SELECT s * 250.0::DOUBLE AS bucket, count(b.step) AS count
    FROM (SELECT unnest(generate_series((SELECT min(step) FROM b), (SELECT max(step) FROM b))) AS s) LEFT JOIN b ON s = step
    GROUP BY s
    """,
)
def group_fixed_width(spark, d):
    return A.group_fixed_width(table(spark, d, "orders"), "o_totalprice", 250.0)


@query(
    "group_ranges",
    """
    SELECT '*-1000' AS range, count(*) AS count FROM customer WHERE c_acctbal < 1000
    UNION ALL SELECT '0-5000', count(*) FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 5000
    UNION ALL SELECT '2500-*', count(*) FROM customer WHERE c_acctbal >= 2500
    """,
)
def group_ranges(spark, d):
    return A.group_ranges(table(spark, d, "customer"), "c_acctbal", [(None, 1000), (0, 5000), (2500, None)])


@query(
    "group_ranges_metrics",
    """
    SELECT '0-20' AS range, count(*) AS count, round(avg(l_extendedprice), 6) AS price FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 20
    UNION ALL SELECT '10-40', count(*), round(avg(l_extendedprice), 6) FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40
    """,
)
def group_ranges_metrics(spark, d):
    metrics = {"price": F.round(F.avg("l_extendedprice"), 6)}
    return A.group_ranges(table(spark, d, "lineitem"), "l_quantity", [(0, 20), (10, 40)], metrics)


@query(
    "group_nested",
    """
    WITH c AS (SELECT l_suppkey, l_returnflag, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL),
    k1 AS (SELECT l_suppkey FROM c GROUP BY 1 ORDER BY sum(count) DESC, 1 LIMIT 2),
    k2 AS (SELECT l_suppkey, l_returnflag FROM c SEMI JOIN k1 USING (l_suppkey) GROUP BY l_suppkey, l_returnflag
           QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(count) DESC, l_returnflag) <= 2),
    k3 AS (SELECT l_suppkey, l_returnflag, l_linenumber FROM c SEMI JOIN k2 USING (l_suppkey, l_returnflag) GROUP BY l_suppkey, l_returnflag, l_linenumber
           QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY sum(count) DESC, l_linenumber) <= 2)
    SELECT c.* FROM c SEMI JOIN k3 USING (l_suppkey, l_returnflag, l_linenumber)
    """,
)
def group_nested(spark, d):
    return A.group_nested(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag", "l_linenumber"], 2)


@query(
    "pivot_sum",
    """
    SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS A,
      sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS N, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS R
    FROM lineitem GROUP BY l_suppkey
    """,
)
def pivot_sum(spark, d):
    return A.pivot(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "l_quantity", "sum", ["A", "N", "R"])


@query(
    "pivot_count",
    """
    SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F,
      nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P
    FROM orders GROUP BY o_orderpriority
    """,
)
def pivot_count(spark, d):
    return A.pivot(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "o_orderkey", "count")


@query("count_objects", "SELECT count(*) AS count FROM documents WHERE lang = 'de' AND n_chars > 500")
def count_objects(spark, d):
    return table(spark, d, "documents").filter("lang = 'de' AND n_chars > 500").agg(A.metric("count").alias("count"))


@query(
    "histogram",
    """
    WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
    b AS (SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin FROM customer, e)
    SELECT CAST(s AS INTEGER) AS bin, round(lo + (hi - lo) / 10 * s, 6) AS start, round(lo + (hi - lo) / 10 * (s + 1), 6) AS "end",
      (SELECT count(*) FROM b WHERE bin = s) AS count FROM e, generate_series(0, 9) t(s)
    """,
)
def histogram(spark, d):
    h = A.histogram(table(spark, d, "customer"), "c_acctbal")
    return h.select("bin", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "count")


@query(
    "top_values",
    """
    WITH s AS (SELECT 'p_name' AS "column", p_name AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part
      UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT 'p_type', p_type FROM part),
    c AS (SELECT "column", value, count(*) AS count FROM s WHERE value <> '' GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank FROM c QUALIFY rank <= 10
    """,
)
def top_values(spark, d):
    return A.top_values(table(spark, d, "part"), ["p_name", "p_brand", "p_size", "p_type"], 10)


@query(
    "similarity_numeric",
    """
    WITH a AS (SELECT (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS s FROM customer),
    b AS (SELECT (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) AS s FROM supplier),
    g AS (SELECT max(abs((SELECT avg(CASE WHEN s <= i / 20 THEN 1.0 ELSE 0 END) FROM a)
                       - (SELECT avg(CASE WHEN s <= i / 20 THEN 1.0 ELSE 0 END) FROM b))) AS gap FROM generate_series(0, 19) t(i))
    SELECT round(0.5 * (1 - gap) + 0.3 * (1 - abs((SELECT avg(s) FROM a) - (SELECT avg(s) FROM b)))
      + 0.2 * (1 - abs((SELECT stddev_samp(s) FROM a) - (SELECT stddev_samp(s) FROM b))), 6) AS similarity FROM g
    """,
)
def similarity_numeric(spark, d):
    score = A.numeric_similarity(table(spark, d, "customer"), "c_acctbal", table(spark, d, "supplier"), "s_acctbal")
    return score.select(F.round("similarity", 6).alias("similarity"))


@query(
    "similarity_categorical",
    """
    WITH a AS (SELECT lower(p_name) AS v FROM part WHERE p_size <= 25 GROUP BY v ORDER BY count(*) DESC, v LIMIT 20),
    b AS (SELECT lower(p_name) AS v FROM part WHERE p_size > 25 GROUP BY v ORDER BY count(*) DESC, v LIMIT 20),
    n AS (SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM a SEMI JOIN b USING (v)) AS m)
    SELECT round(0.6 * m / (a + b - m) + 0.4 * m / least(a, b), 6) AS similarity FROM n
    """,
)
def similarity_categorical(spark, d):
    part = table(spark, d, "part")
    score = A.categorical_similarity(part.filter("p_size <= 25"), "p_name", part.filter("p_size > 25"), "p_name", 20)
    return score.select(F.round("similarity", 6).alias("similarity"))


@query(
    "similarity_text",
    """
    WITH a AS (SELECT lower(trim(c_name)) AS t FROM customer), b AS (SELECT lower(trim(s_name)) AS t FROM supplier),
    ga AS (SELECT substr(t, i, 3) AS g, CAST(count(*) AS DOUBLE) AS n FROM (SELECT t, unnest(generate_series(1, length(t) - 2)) AS i FROM a) GROUP BY g),
    gb AS (SELECT substr(t, i, 3) AS g, CAST(count(*) AS DOUBLE) AS n FROM (SELECT t, unnest(generate_series(1, length(t) - 2)) AS i FROM b) GROUP BY g)
    SELECT round(0.7 * (SELECT sum(ga.n * gb.n) FROM ga JOIN gb USING (g)) / sqrt((SELECT sum(n * n) FROM ga)) / sqrt((SELECT sum(n * n) FROM gb))
      + 0.3 * (1 - abs((SELECT avg(length(t)) FROM a) - (SELECT avg(length(t)) FROM b))
                 / greatest((SELECT avg(length(t)) FROM a), (SELECT avg(length(t)) FROM b))), 6) AS similarity
    """,
)
def similarity_text(spark, d):
    score = A.string_similarity(table(spark, d, "customer"), "c_name", table(spark, d, "supplier"), "s_name")
    return score.select(F.round("similarity", 6).alias("similarity"))


@query(
    "window_row_number",
    """
    SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_returnflag
      ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS rn FROM lineitem
    """,
)
def window_row_number(spark, d):
    order = ["-l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
    numbered = W.row_number(table(spark, d, "lineitem"), ["l_returnflag"], order, "rn")
    return numbered.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rn")


@query(
    "window_ranks",
    """
    SELECT o_orderkey, o_custkey, row_number() OVER w AS row_number, rank() OVER v AS rank, dense_rank() OVER v AS dense_rank, ntile(3) OVER w AS ntile
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderdate)
    """,
)
def window_ranks(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return W.ranks(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"], 3).drop("o_orderdate")


@query(
    "window_ranks_large_groups",
    """
    SELECT l_returnflag, l_quantity, row_number, rank, dense_rank, ntile, count(*) AS n FROM (
      SELECT l_returnflag, l_quantity, row_number() OVER w % 2 AS row_number, rank() OVER v AS rank, dense_rank() OVER v AS dense_rank, ntile(7) OVER w AS ntile
      FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice),
        v AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC)) GROUP BY ALL
    """,
)
def window_ranks_large_groups(spark, d):
    items = table(spark, d, "lineitem")
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    ranked = W.ranks(items.select("l_returnflag", "l_quantity", *tie), ["l_returnflag"], "-l_quantity", tie, 7)
    ranked = ranked.withColumn("row_number", F.col("row_number") % 2)
    return ranked.groupBy("l_returnflag", "l_quantity", "row_number", "rank", "dense_rank", "ntile").agg(F.count(F.lit(1)).alias("n"))


@query(
    "window_neighbours",
    """
    SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey, 2) OVER w AS second_next,
      round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    """,
)
def window_neighbours(spark, d):
    df = W.neighbours(
        table(spark, d, "orders"),
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        {
            "previous": "lag(o_orderkey)",
            "second_next": "lead(o_orderkey, 2)",
            "moving": "sum(o_totalprice) | ROWS BETWEEN 2 PRECEDING AND CURRENT ROW",
        },
        before=2,
        after=2,
    )
    return df.select("o_orderkey", "o_custkey", "previous", "second_next", F.round("moving", 2).alias("moving"))


@query(
    "window_ends",
    """
    SELECT o_custkey, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER w AS last FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
)
def window_ends(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    order = ["o_orderdate", "o_orderkey"]
    first = W.first_per_key(orders, ["o_custkey"], order).select("o_custkey", F.col("o_orderkey").alias("first"))
    last = W.latest_per_key(orders, ["o_custkey"], order).select("o_custkey", F.col("o_orderkey").alias("last"))
    return orders.select("o_custkey").join(first, "o_custkey").join(last, "o_custkey")


@query(
    "window_expressions",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      CAST(rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice) AS INTEGER) AS nth,
      max(l_extendedprice) OVER (PARTITION BY l_orderkey, l_linenumber) AS top FROM lineitem
    """,
)
def window_expressions(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    line = "OVER (PARTITION BY l_orderkey, l_linenumber"
    return W.window_expressions(
        items, {"nth": f"rank() {line} ORDER BY l_extendedprice)", "top": f"max(l_extendedprice) {line})"}
    )


@query(
    "latest_per_key",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def latest_per_key(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return W.latest_per_key(events, ["user_id"], ["ts", "event_id"]).drop("ts")


def _people(spark, d):
    customers = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    suppliers = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    return customers, suppliers


@query("union_strict", "SELECT l_partkey AS key FROM lineitem UNION ALL SELECT p_partkey FROM part")
def union_strict(spark, d):
    return W.union(table(spark, d, "lineitem").selectExpr("l_partkey AS key"), table(spark, d, "part").selectExpr("p_partkey AS key"))


@query("union_common_only", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_common_only(spark, d):
    return W.union(*_people(spark, d), "common_only")


@query(
    "union_pad",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer "
    "UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier",
)
def union_pad(spark, d):
    return W.union(*_people(spark, d), "pad")


@query(
    "table_difference",
    """
    WITH e AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL),
    a AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 OR l_returnflag = 'R' GROUP BY ALL)
    SELECT l_suppkey, l_returnflag, coalesce(e.n, 0) AS expected_count, coalesce(a.n, 0) AS actual_count
    FROM e FULL JOIN a USING (l_suppkey, l_returnflag) WHERE coalesce(e.n, 0) <> coalesce(a.n, 0)
    """,
)
def table_difference(spark, d):
    items = table(spark, d, "lineitem")
    columns = ["l_suppkey", "l_returnflag"]
    expected = items.filter("l_linenumber <> 7").select(*columns)
    return W.table_difference(expected, items.filter("l_linenumber <> 7 OR l_returnflag = 'R'").select(*columns))


@query(
    "identity_union",
    """
    SELECT 'order' AS kind, o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN 'large' ELSE 'urgent' END AS why
    FROM orders WHERE o_totalprice > 300000 OR o_orderpriority = '1-URGENT'
    """,
)
def identity_union(spark, d):
    orders = table(spark, d, "orders")
    large = orders.filter("o_totalprice > 300000").selectExpr("'order' AS kind", "o_orderkey AS id", "'large' AS why")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").selectExpr("'order' AS kind", "o_orderkey AS id", "'urgent' AS why")
    return W.identity_union([large, urgent], ["kind", "id"])
