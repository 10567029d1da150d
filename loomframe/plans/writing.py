"""Queries for writers and write modes.

"Loaded" rows are the orders placed before the year 2000; "arriving" rows are those placed
since mid-1998, with a corrected price on pending ones, so both sides overlap.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.plans.registry import query, table
from loomframe.session import new_path
from loomframe.sources import sinks as S

KEYS = ["o_orderkey"]

_SIDES = """
    WITH loaded AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
                    WHERE o_orderdate < TIMESTAMP '2000-01-01'),
    arriving AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                   CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
                 FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01')
"""


def _loaded(spark, d):
    orders = table(spark, d, "orders").filter("o_orderdate < timestamp_ntz'2000-01-01'")
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _arriving(spark, d):
    orders = table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz'1998-07-01'")
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice"))


def _twice(df):
    return df.unionByName(df)


def _committed(spark, d, mode, arriving, **extra):
    root = new_path(spark, mode)
    S.commit(_loaded(spark, d), root)
    S.commit(arriving, root, mode, KEYS, **extra)
    return S.read_dataset(spark, root)


@query("write_parquet_partitioned", "SELECT event_id, user_id, event_type FROM events")
def write_parquet_partitioned(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    path = S.write_files(events, new_path(spark, "by-type"), partition_by=["event_type"])
    return spark.read.parquet(path)


@query("write_csv", "SELECT s_suppkey, s_acctbal FROM supplier")
def write_csv(spark, d):
    path = S.write_files(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), new_path(spark, "csv"), "csv")
    return spark.read.schema("s_suppkey bigint, s_acctbal double").option("header", True).csv(path)


@query("write_json", "SELECT s_suppkey, s_name FROM supplier")
def write_json(spark, d):
    path = S.write_files(table(spark, d, "supplier").select("s_suppkey", "s_name"), new_path(spark, "json"), "json")
    return spark.read.schema("s_suppkey bigint, s_name string").json(path)


@query("write_orc", "SELECT c_custkey, c_acctbal FROM customer")
def write_orc(spark, d):
    path = S.write_files(table(spark, d, "customer").select("c_custkey", "c_acctbal"), new_path(spark, "orc"), "orc")
    return spark.read.orc(path)


@query("write_overwrite", f"{_SIDES} SELECT * FROM arriving")
def write_overwrite(spark, d):
    return _committed(spark, d, S.default_mode(), _arriving(spark, d))


@query("write_always_append", f"{_SIDES} SELECT * FROM loaded UNION ALL SELECT * FROM arriving")
def write_always_append(spark, d):
    return _committed(spark, d, "always_append", _arriving(spark, d))


@query(
    "write_append_only_new_rows",
    f"{_SIDES} SELECT * FROM loaded UNION ALL SELECT * FROM arriving WHERE o_orderkey NOT IN (SELECT o_orderkey FROM loaded)",
)
def write_append_only_new_rows(spark, d):
    return _committed(spark, d, "append_only_new_rows", _twice(_arriving(spark, d)))


@query(
    "write_changelog",
    f"""{_SIDES} SELECT * FROM loaded UNION ALL
    (SELECT a.* FROM arriving a LEFT JOIN loaded l USING (o_orderkey)
     WHERE l.o_orderkey IS NULL OR a.o_totalprice IS DISTINCT FROM l.o_totalprice)""",
)
def write_changelog(spark, d):
    return _committed(spark, d, "changelog", _arriving(spark, d))


@query(
    "write_changelog_resent",
    f"""{_SIDES} SELECT * FROM loaded UNION ALL
    (SELECT a.* FROM arriving a LEFT JOIN loaded l USING (o_orderkey)
     WHERE l.o_orderkey IS NULL OR a.o_totalprice IS DISTINCT FROM l.o_totalprice)""",
)
def write_changelog_resent(spark, d):
    """The same arriving rows again add no version."""
    root = new_path(spark, "changelog-resent")
    S.commit(_loaded(spark, d), root)
    for _ in range(2):
        S.commit(_arriving(spark, d), root, "changelog", KEYS)
    return S.read_dataset(spark, root)


@query(
    "write_append_new_column",
    f"""{_SIDES} SELECT *, CAST(NULL AS VARCHAR) AS origin FROM loaded
    UNION ALL SELECT *, 'arriving' FROM arriving""",
)
def write_append_new_column(spark, d):
    return _committed(spark, d, "always_append", _arriving(spark, d).withColumn("origin", F.lit("arriving")))


@query(
    "write_replace_stored_column",
    f"""{_SIDES} SELECT l.* FROM loaded l ANTI JOIN arriving a USING (o_orderkey)
    UNION ALL SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR), o_totalprice FROM arriving""",
)
def write_replace_stored_column(spark, d):
    """A column that only the stored side has stays."""
    return _committed(spark, d, "snapshot_replace", _arriving(spark, d).drop("o_orderstatus"))


@query(
    "write_snapshot_difference",
    f"{_SIDES} SELECT a.* FROM arriving a ANTI JOIN loaded l USING (o_orderkey)",
)
def write_snapshot_difference(spark, d):
    return _committed(spark, d, "snapshot_difference", _arriving(spark, d))


@query(
    "write_snapshot_replace",
    f"{_SIDES} SELECT l.* FROM loaded l ANTI JOIN arriving a USING (o_orderkey) UNION ALL SELECT * FROM arriving",
)
def write_snapshot_replace(spark, d):
    return _committed(spark, d, "snapshot_replace", _twice(_arriving(spark, d)))


@query(
    "write_snapshot_replace_and_remove",
    f"""{_SIDES}, flagged AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'No' WHEN 'O' THEN 'yes' END AS keep FROM arriving)
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(NULL AS VARCHAR) AS keep FROM loaded
    ANTI JOIN (SELECT o_orderkey FROM flagged WHERE keep IS NOT NULL) t USING (o_orderkey)
    UNION ALL SELECT * FROM flagged WHERE keep = 'yes'""",
)
def write_snapshot_replace_and_remove(spark, d):
    flagged = _arriving(spark, d).withColumn("keep", F.expr("CASE o_orderstatus WHEN 'F' THEN 'No' WHEN 'O' THEN 'yes' END"))
    return _committed(spark, d, "snapshot_replace_and_remove", flagged, flag="keep")


@query(
    "write_geotemporal",
    "SELECT event_id, 'POINT(' || user_id || ' ' || event_id || ')' AS geometry, strftime(ts, '%Y-%m-%d') AS day FROM events",
)
def write_geotemporal(spark, d):
    point = F.format_string("POINT(%d %d)", "user_id", "event_id")
    events = table(spark, d, "events").select("event_id", "ts", point.alias("geometry"))
    path = S.write_geotemporal(events, new_path(spark, "geo"), "ts", "geometry")
    return spark.read.parquet(path).select("event_id", "geometry", F.col("day").cast("string").alias("day"))


@query("write_media", "SELECT url, 'document' AS media_type FROM pages")
def write_media(spark, d):
    return spark.read.parquet(S.write_media(table(spark, d, "pages").select("url"), new_path(spark, "media"), "url", "document"))


@query(
    "virtual_view",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey",
)
def virtual_view(spark, d):
    counted = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return S.virtual_view(counted, "orders_per_customer")


@query("write_entities", "SELECT c_custkey, c_name, 'Customer' AS class_id FROM customer")
def write_entities(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    return spark.read.parquet(S.write_entities(customers, new_path(spark, "entities"), "Customer", ["c_custkey"]))


@query("write_links", "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst, 'contains' AS predicate FROM lineitem")
def write_links(spark, d):
    path = S.write_links(table(spark, d, "lineitem"), new_path(spark, "links"), "contains", "l_orderkey", "l_partkey")
    return spark.read.parquet(path)


@query("key_difference", f"{_SIDES} SELECT a.o_orderkey FROM arriving a ANTI JOIN loaded l USING (o_orderkey)")
def key_difference(spark, d):
    return S.snapshot_difference(_loaded(spark, d), _arriving(spark, d), KEYS).select("o_orderkey")
