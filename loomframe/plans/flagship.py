"""Flagship: revenue by nation and market segment, ranked inside each region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators import transforms as T
from loomframe.operators.joins import join
from loomframe.plans.registry import query, table


@query(
    "nation_revenue",
    """
    WITH agg AS (
      SELECT r_name, n_name, lower(c_mktsegment) AS segment,
             round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
             count(*) AS items
      FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey
      WHERE l_returnflag <> 'R' AND o_orderdate >= TIMESTAMP '1996-01-01'
      GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY r_name ORDER BY revenue DESC, n_name, segment) AS INTEGER) AS rank
    FROM agg
    QUALIFY row_number() OVER (PARTITION BY r_name ORDER BY revenue DESC, n_name, segment) <= 5
    """,
)
def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = T.where(table(spark, sf_dir, "orders"), "o_orderdate >= timestamp_ntz'1996-01-01'")
    items = T.where(table(spark, sf_dir, "lineitem"), "l_returnflag <> $skip", {"skip": "R"})
    customers = T.normalize(table(spark, sf_dir, "customer"), ["c_mktsegment"], case="lower")
    items = T.compute(items, "revenue = l_extendedprice * (1 - l_discount)")
    placed = join(items, orders, ["l_orderkey"], ["o_orderkey"])
    # One row per customer before the dimensions join: the fact rows shuffle once.
    sold = placed.groupBy("o_custkey").agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("items"))
    sold = join(sold, customers, ["o_custkey"], ["c_custkey"])
    sold = join(sold, table(spark, sf_dir, "nation"), ["c_nationkey"], ["n_nationkey"])
    sold = join(sold, table(spark, sf_dir, "region"), ["n_regionkey"], ["r_regionkey"])
    totals = sold.groupBy("r_name", "n_name", F.col("c_mktsegment").alias("segment")).agg(
        F.round(F.sum("revenue"), 4).alias("revenue"), F.sum("items").alias("items")
    )
    return T.top_per_group(totals, ["r_name"], ["-revenue", "n_name", "segment"], 5)
