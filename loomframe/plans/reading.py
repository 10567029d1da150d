"""Queries for sources, extracts and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.plans.registry import query, table
from loomframe.session import new_path
from loomframe.sources import readers as R
from loomframe.sources import sinks as S


@query("read_parquet", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def read_parquet(spark, d):
    return R.read_parquet(spark, f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("read_csv", "SELECT * FROM customer")
def read_csv(spark, d):
    customers = table(spark, d, "customer")
    path = S.write_files(customers, new_path(spark, "csv"), "csv")
    ddl = ", ".join(f"{c} {t}" for c, t in customers.dtypes)
    return R.read_csv(spark, path, schema=ddl)


@query("read_json_lines", "SELECT event_id, event_type, value, props FROM events")
def read_json_lines(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value", "props")
    path = S.write_files(events, new_path(spark, "json"), "json")
    return R.read_json(spark, path, schema="event_id bigint, event_type string, value double, props string")


@query("read_json_rows", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def read_json_rows(spark, d):
    docs = table(spark, d, "supplier").select(F.array(F.struct("s_suppkey", "s_name", "s_acctbal")).alias("rows"))
    path = S.write_files(docs, new_path(spark, "json-rows"), "json")
    schema = "rows array<struct<s_suppkey:bigint,s_name:string,s_acctbal:double>>"
    return R.read_json(spark, path, schema=schema, rows="rows")


@query("read_orc", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def read_orc(spark, d):
    return R.read_orc(spark, S.write_files(table(spark, d, "part"), new_path(spark, "orc"), "orc"))


@query(
    "extract_incremental",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 900 OR (o_custkey = 900 AND o_orderkey > 4000)",
)
def extract_incremental(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return R.extract_after(orders, "o_custkey", 900, "o_orderkey", 4000)


@query(
    "extract_position",
    "SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderkey FROM orders "
    "ORDER BY orders.o_orderdate DESC, o_orderkey DESC LIMIT 1",
)
def extract_position(spark, d):
    state = R.position(table(spark, d, "orders"), "o_orderdate", "o_orderkey")
    return state.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "extract_changes",
    "SELECT event_id, user_id, event_type FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)",
)
def extract_changes(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    seen = R.change_token(events, "event_id").select(F.floor(F.col("token") / 2).alias("token")).scalar()
    return events.filter(F.col("event_id") > seen)


@query("peek_change_token", "SELECT max(event_id) AS token FROM events")
def peek_change_token(spark, d):
    return R.change_token(table(spark, d, "events"), "event_id")


@query("parse_json_value", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json_value(spark, d):
    parsed = R.parse_value(table(spark, d, "events"), "props", "json", "k bigint", "FAILFAST")
    return parsed.select("event_id", "value_parsed.k")


@query("parse_json_permissive", "SELECT doc_id, CAST(NULL AS BIGINT) AS k FROM documents")
def parse_json_permissive(spark, d):
    parsed = R.parse_value(table(spark, d, "documents"), "text", "json", "k bigint", "PERMISSIVE")
    return parsed.select("doc_id", "value_parsed.k")


@query("parse_raw_value", "SELECT event_id, props AS value_parsed FROM events")
def parse_raw_value(spark, d):
    return R.parse_value(table(spark, d, "events"), "props", "raw").select("event_id", "value_parsed")


@query("list_media")
def list_media(spark, d):
    return R.list_media(spark, d)


@query(
    "read_new_commits",
    "SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'error')",
)
def read_new_commits(spark, d):
    root = new_path(spark, "commits")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    first = S.commit(events.filter("event_type NOT IN ('view', 'error')").drop("event_type"), root)
    S.commit(events.filter("event_type = 'view'").drop("event_type"), root, "always_append")
    S.commit(events.filter("event_type = 'error'").drop("event_type"), root, "always_append")
    return S.read_dataset(spark, root, since=first)


@query(
    "read_commit_changes",
    """
    WITH v AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders),
    old AS (SELECT o_orderkey, o_totalprice FROM v WHERE o_orderstatus <> 'P'),
    new AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM v
      WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'))
    SELECT *, 'added' AS change FROM (FROM new EXCEPT ALL FROM old) UNION ALL SELECT *, 'removed' FROM (FROM old EXCEPT ALL FROM new)
    """,
)
def read_commit_changes(spark, d):
    """An append, then a snapshot that rewrites all rows, changes some and leaves some out."""
    root = new_path(spark, "commits")
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    first = S.commit(orders.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice"), root)
    S.commit(orders.filter("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice"), root, "always_append")
    price = F.expr("CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice + 1 ELSE o_totalprice END")
    kept = orders.filter("NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
    S.commit(kept.select("o_orderkey", price.alias("o_totalprice")), root)
    return S.read_changes(spark, root, first)


@query(
    "commit_manifest",
    "SELECT * FROM (VALUES ('added', 2, true), ('added', 3, true), ('removed', 1, true)) t(change, version, filled) WHERE (SELECT count(*) FROM events) > 0",
)
def commit_manifest(spark, d):
    """Files that came and went between an append, a snapshot and another append of the same events."""
    root = new_path(spark, "commits")
    events = table(spark, d, "events").select("event_id", "user_id")
    first = S.commit(events, root)
    S.commit(events.filter("event_id % 2 = 0"), root)
    S.commit(events.filter("event_id % 2 = 1"), root, "always_append")
    found = S.file_changes(spark, root, first).groupBy("change", F.col("version").cast("int").alias("version"))
    return found.agg((F.sum("bytes") > 0).alias("filled"))


@query("table_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 500")
def table_page(spark, d):
    return R.table_page(table(spark, d, "customer"), ["c_custkey", "c_name"], ["c_custkey"], 500)


@query("sample_random")
def sample_random(spark, d):
    return R.sample_random(table(spark, d, "lineitem"), 0.1, seed=7)


@query("sample_stratified")
def sample_stratified(spark, d):
    return R.sample_stratified(table(spark, d, "events"), "event_type", {"view": 0.5, "click": 0.1}, seed=7)


_DUCK_SHARE = "CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0"


@query("sample_by_key", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_DUCK_SHARE.format('o_orderkey')} < 0.2")
def sample_by_key(spark, d):
    return R.sample_by_key(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.2)


@query(
    "sample_stratified_by_key",
    f"SELECT event_id, event_type FROM events WHERE {_DUCK_SHARE.format('event_id')} < "
    "CASE event_type WHEN 'purchase' THEN 0.9 WHEN 'error' THEN 0.25 ELSE 0 END",
)
def sample_stratified_by_key(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    return R.sample_stratified_by_key(events, "event_id", "event_type", {"purchase": 0.9, "error": 0.25})


@query("sample_head")
def sample_head(spark, d):
    return R.head(table(spark, d, "lineitem"), 100)
