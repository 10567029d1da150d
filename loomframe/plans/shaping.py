"""Queries for projections, filters, casts and row shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import casts
from loomframe.operators import transforms as T
from loomframe.plans.registry import query, table


@query("select_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_columns(spark, d):
    return T.select(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@query(
    "select_expressions",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, "
    "upper(l_returnflag) || '/' || lower(l_linestatus) AS flags FROM lineitem",
)
def select_expressions(spark, d):
    return T.select_expr(
        table(spark, d, "lineitem"),
        [
            "l_orderkey",
            "l_linenumber",
            "round(l_extendedprice * (1 - l_discount), 4) AS net",
            "concat(upper(l_returnflag), '/', lower(l_linestatus)) AS flags",
        ],
    )


@query("drop_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def drop_columns(spark, d):
    return T.drop(table(spark, d, "customer"), ["c_acctbal", "c_mktsegment", "no_such_column"])


@query(
    "rename_columns",
    "SELECT s_suppkey AS id, s_name AS label, s_nationkey AS label__1, s_acctbal FROM supplier",
)
def rename_columns(spark, d):
    return T.rename(
        table(spark, d, "supplier"), {"s_suppkey": "id", "s_name": "label", "s_nationkey": "label", "absent": "x"}
    )


@query(
    "filter_parameters",
    "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders "
    "WHERE o_totalprice >= 250000 AND o_orderpriority <> '5-LOW'",
)
def filter_parameters(spark, d):
    df = T.where(
        table(spark, d, "orders"),
        "o_totalprice >= $floor AND o_orderpriority <> {{ skip }}",
        {"floor": 250000, "skip": "5-LOW"},
    )
    return T.select(df, ["o_orderkey", "o_totalprice", "o_orderpriority"])


@query(
    "split_branches",
    """
    SELECT branch, count(*) AS n, round(sum(value), 2) AS total FROM (
      SELECT value, CASE WHEN p THEN 'true' WHEN NOT p THEN 'false' ELSE 'null' END AS branch
      FROM (SELECT value, nullif(event_type, 'error') = 'purchase' AS p FROM events))
    GROUP BY branch
    """,
)
def split_branches(spark, d):
    events = table(spark, d, "events")
    yes, no, undecided = T.split_branches(events, "nullif(event_type, 'error') = 'purchase'")
    parts = [p.select("value", F.lit(b).alias("branch")) for p, b in ((yes, "true"), (no, "false"), (undecided, "null"))]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "split_labels",
    """
    SELECT event_id, CASE WHEN nullif(event_type, 'error') = 'view' THEN 'true'
      WHEN nullif(event_type, 'error') <> 'view' THEN 'false' ELSE 'null' END AS branch FROM events
    """,
)
def split_labels(spark, d):
    return T.split(table(spark, d, "events"), "nullif(event_type, 'error') = 'view'").select("event_id", "branch")


@query("compute_bare", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS computed FROM lineitem")
def compute_bare(spark, d):
    df = T.compute(table(spark, d, "lineitem"), "l_quantity * $factor", {"factor": 2})
    return df.select("l_orderkey", "l_linenumber", "computed")


@query(
    "compute_ordered",
    """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
      round(round(l_extendedprice * (1 - l_discount), 4) + l_quantity, 4) AS gross,
      round(round(l_extendedprice * (1 - l_discount), 4) + l_quantity, 4) > 50000 AS large
    FROM lineitem
    """,
)
def compute_ordered(spark, d):
    df = T.compute_many(
        table(spark, d, "lineitem"),
        [
            ("net", "round(l_extendedprice * (1 - l_discount), 4)"),
            ("gross", "round(net + l_quantity, 4)"),
            ("large", "gross > 50000"),
        ],
    )
    return df.select("l_orderkey", "l_linenumber", "net", "gross", "large")


# Numbers written as text in the ways the casts must read, one way per line number and status.
_NUMBER_TEXTS = """
    CASE l_linenumber WHEN 1 THEN {us} WHEN 2 THEN {eu} WHEN 3 THEN '(' || {us} || ')'
      WHEN 4 THEN ' $ ' || {us} || ' ' WHEN 5 THEN 'USD ' || {us}
      WHEN 6 THEN CAST(CAST(l_quantity AS INTEGER) AS {text}) || ',5' ELSE 'n/a ' || l_returnflag END
"""
_SPARK_TEXT = _NUMBER_TEXTS.format(
    us="format_number(l_extendedprice, 2)",
    eu="translate(format_number(l_extendedprice, 2), ',.', '.,')",
    text="STRING",
)
_DUCK_TEXT = _NUMBER_TEXTS.format(
    us="format('{:,.2f}', l_extendedprice)",
    eu="translate(format('{:,.2f}', l_extendedprice), ',.', '.,')",
    text="VARCHAR",
)
_DUCK_VALUE = """
    CASE l_linenumber WHEN 1 THEN l_extendedprice WHEN 2 THEN l_extendedprice WHEN 3 THEN -l_extendedprice
      WHEN 4 THEN l_extendedprice WHEN 5 THEN l_extendedprice WHEN 6 THEN l_quantity + 0.5 ELSE NULL END
"""


@query(
    "parse_locale_number",
    f"SELECT l_orderkey, l_linenumber, {_DUCK_TEXT} AS raw, CAST({_DUCK_VALUE} AS DOUBLE) AS value FROM lineitem",
)
def parse_locale_number(spark, d):
    df = table(spark, d, "lineitem").withColumn("raw", F.expr(_SPARK_TEXT))
    return df.select("l_orderkey", "l_linenumber", "raw", casts.parse_decimal(F.col("raw")).alias("value"))


@query(
    "parse_number_ambiguity",
    """
    SELECT p_partkey, raw, value, is_ambiguous,
           CASE WHEN is_ambiguous THEN CAST(replace(raw, '.', '') AS DOUBLE) END AS alternative
    FROM (SELECT p_partkey, raw, CAST(raw AS DOUBLE) AS value, regexp_full_match(raw, '\\d+\\.\\d{3}') AS is_ambiguous
          FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) || '.' ||
                       CASE WHEN p_type = 'ECONOMY' THEN lpad(CAST(p_size AS VARCHAR), 3, '0')
                            ELSE lpad(CAST(p_size AS VARCHAR), 2, '0') END AS raw FROM part))
    """,
)
def parse_number_ambiguity(spark, d):
    raw = F.expr(
        "concat(p_size, '.', CASE WHEN p_type = 'ECONOMY' THEN lpad(p_size, 3, '0') ELSE lpad(p_size, 2, '0') END)"
    )
    parts = table(spark, d, "part").select("p_partkey", raw.alias("raw"))
    return parts.withColumn("r", casts.parse_number(F.col("raw"))).select("p_partkey", "raw", "r.*")


_SPARK_DATE_TEXT = """
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN date_format(o_orderdate, 'yyyy-MM-dd')
      WHEN '2' THEN date_format(o_orderdate, 'yyyy/MM/dd HH:mm') WHEN '3' THEN date_format(o_orderdate, 'MM/dd/yyyy')
      WHEN '4' THEN date_format(o_orderdate, 'yyyyMMdd') ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T06:30:00+02:00') END
"""


@query(
    "parse_dates",
    """
    SELECT o_orderkey,
      strftime(CASE WHEN o_orderpriority LIKE '5%' THEN o_orderdate + INTERVAL 270 MINUTE ELSE o_orderdate END,
               '%Y-%m-%d %H:%M:%S') AS value,
      o_orderpriority LIKE '3%' AND day(o_orderdate) <= 12 AS is_ambiguous,
      CASE WHEN o_orderpriority LIKE '3%' AND day(o_orderdate) <= 12
           THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') END AS alternative
    FROM orders
    """,
)
def parse_dates(spark, d):
    orders = table(spark, d, "orders")
    parsed = orders.select("o_orderkey", casts.parse_datetime(F.expr(_SPARK_DATE_TEXT)).alias("r"))
    return parsed.select(
        "o_orderkey",
        F.date_format("r.value", "yyyy-MM-dd HH:mm:ss").alias("value"),
        "r.is_ambiguous",
        F.date_format("r.alternative", "yyyy-MM-dd").alias("alternative"),
    )


_CAST_INPUT = {
    "whole": "CASE WHEN l_linenumber = 7 THEN 'x' || l_returnflag ELSE ' 1,2' || CAST(CAST(l_quantity AS INTEGER) AS {t}) || '_0 ' END",
    "fraction": "CASE WHEN l_linenumber = 6 THEN '--' ELSE CAST(CAST(l_quantity AS INTEGER) AS {t}) || '.5%' END",
    "truth": "CASE l_linenumber WHEN 1 THEN 'Yes' WHEN 2 THEN ' n ' WHEN 3 THEN 'TRUE' WHEN 4 THEN '0' ELSE 'maybe' END",
    "day": "CASE WHEN l_linenumber = 5 THEN 'soon' ELSE substr(CAST(l_shipdate AS {t}), 1, 10) END",
    "note": "CASE WHEN l_returnflag = 'A' THEN '   ' ELSE '  ' || l_returnflag || ' ' END",
}
_CAST_TYPES = {"whole": "integer", "fraction": "decimal", "truth": "boolean", "day": "date", "note": "string"}


def _cast_input(spark, d):
    made = [F.expr(e.format(t="STRING")).alias(c) for c, e in _CAST_INPUT.items()]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *made)


_DUCK_CASTS = {
    "whole": "TRY_CAST(regexp_replace(trim(whole), '[,_ ]', '', 'g') AS BIGINT)",
    "fraction": "TRY_CAST(regexp_replace(trim(fraction), '%$', '') AS DOUBLE)",
    "truth": "CASE WHEN lower(trim(truth)) IN ('true','t','1','yes','y') THEN true "
    "WHEN lower(trim(truth)) IN ('false','f','0','no','n') THEN false END",
    "day": "TRY_CAST(day AS DATE)",
    "note": "nullif(trim(note), '')",
}
_DUCK_CAST_FROM = "(SELECT l_orderkey, l_linenumber, {} FROM lineitem)".format(
    ", ".join(f"{e.format(t='VARCHAR')} AS {c}" for c, e in _CAST_INPUT.items())
)


@query(
    "cast_safe",
    "SELECT l_orderkey, l_linenumber, {}, CAST({} AS VARCHAR) AS day FROM {}".format(
        ", ".join(f"{e} AS {c}" for c, e in _DUCK_CASTS.items() if c != "day"), _DUCK_CASTS["day"], _DUCK_CAST_FROM
    ),
)
def cast_safe(spark, d):
    return T.cast(_cast_input(spark, d), _CAST_TYPES).withColumn("day", F.col("day").cast("string"))


@query(
    "cast_strict",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def cast_strict(spark, d):
    events = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return T.cast(events, {"k": "integer"}, "STRICT")


@query(
    "cast_statistics",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (trim({c}) <> '') AS attempted, "
        f"count(*) FILTER (trim({c}) <> '' AND ({e}) IS NULL) AS failed, "
        f"round(count(*) FILTER (trim({c}) <> '' AND ({e}) IS NULL) / count(*) FILTER (trim({c}) <> ''), 6) AS failure_rate "
        f"FROM {_DUCK_CAST_FROM}"
        for c, e in _DUCK_CASTS.items()
    ),
)
def cast_statistics(spark, d):
    stats = T.cast_statistics(_cast_input(spark, d), _CAST_TYPES)
    return stats.withColumn("failure_rate", F.round("failure_rate", 6))


@query(
    "normalize_text",
    """
    SELECT doc_id, nullif(upper(trim(lang)), '') AS lang,
      CASE WHEN source = 'src3' THEN NULL ELSE upper(source) END AS source
    FROM documents
    """,
)
def normalize_text(spark, d):
    padded = table(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("  "), "lang", F.lit(" ")).alias("lang"),
        F.when(F.col("source") == "src3", F.lit("   ")).otherwise(F.col("source")).alias("source"),
    )
    return T.normalize(padded, case="upper")


@query(
    "regex_replace",
    r"""
    SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', '', 'i'), '\d+', '#', 'g') AS url,
      md5(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS text_digest
    FROM pages
    """,
)
def regex_replace(spark, d):
    df = T.regex_replace(
        table(spark, d, "pages"),
        [
            {"column": "url", "pattern": "^HTTPS?://", "replacement": "", "flags": "i"},
            {"column": "url", "pattern": r"\d+", "replacement": "#"},
            {"column": "html", "pattern": "<[^>]*>", "replacement": " "},
        ],
    )
    return df.select("page_id", "url", F.md5("html").alias("text_digest"))


@query(
    "explode_array",
    "SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS position, CAST(embedding[i] AS DOUBLE) AS embedding "
    "FROM (SELECT vec_id, label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)",
)
def explode_array(spark, d):
    df = T.explode(table(spark, d, "embeddings"), "embedding", position="position")
    return df.withColumn("embedding", F.col("embedding").cast("double"))


@query(
    "explode_tokens",
    "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) GROUP BY token",
)
def explode_tokens(spark, d):
    tokens = table(spark, d, "documents").select(F.split("text", " ", -1).alias("token"))
    return T.explode(tokens, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dedupe_all_columns",
    "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem",
)
def dedupe_all_columns(spark, d):
    return T.dedupe(table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus"))


@query(
    "dedupe_first",
    """
    SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1
    """,
)
def dedupe_first(spark, d):
    df = T.dedupe(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return df.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")


@query(
    "sort_null_order",
    """
    SELECT c_custkey, segment, c_acctbal FROM
      (SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS segment, c_acctbal FROM customer)
    ORDER BY segment ASC NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey
    """,
)
def sort_null_order(spark, d):
    df = table(spark, d, "customer").select(
        "c_custkey", F.expr("nullif(c_mktsegment, 'MACHINERY')").alias("segment"), "c_acctbal"
    )
    return T.sort(df, ["segment", {"column": "c_acctbal", "direction": "desc"}, "c_custkey"])


@query(
    "top_page",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50",
)
def top_page(spark, d):
    return T.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["-o_totalprice"], "o_orderkey", 25, 50)


@query(
    "keyset_page",
    """
    SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (700, 5000)
    ORDER BY o_custkey, o_orderkey LIMIT 100
    """,
)
def keyset_page(spark, d):
    return T.after(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], [700, 5000], 100)


@query("project_identity", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def project_identity(spark, d):
    return T.project(table(spark, d, "orders"), ["o_orderstatus", "missing", "o_custkey"], ["o_orderkey", "o_custkey"])


@query(
    "system_columns",
    """
    SELECT r_regionkey, r_name, 'erp' AS _sys_source, '2024-05-01 00:00:00' AS _sys_ingested_at,
      false AS _sys_is_deleted, '2024-05-01 00:00:00' AS _sys_valid_from, '9999-12-31 00:00:00' AS _sys_valid_to,
      sha256('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}') AS _sys_record_hash
    FROM region
    """,
)
def system_columns(spark, d):
    df = T.system_columns(table(spark, d, "region"), "erp", F.lit("2024-05-01 00:00:00").cast("timestamp"))
    stamps = ["_sys_ingested_at", "_sys_valid_from", "_sys_valid_to"]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in stamps})


@query(
    "row_hash",
    """
    SELECT o_orderkey, sha256('o_custkey=' || coalesce(CAST(nullif(o_custkey, 7) AS VARCHAR), '__NULL__') ||
      '||o_orderkey=' || o_orderkey || '||o_orderpriority=' || o_orderpriority) AS hash FROM orders
    """,
)
def row_hash(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.expr("nullif(o_custkey, 7)").alias("o_custkey"))
    return df.select("o_orderkey", T.row_hash(df.columns).alias("hash"))


@query(
    "align_schema",
    "SELECT n_nationkey, CAST(NULL AS BIGINT) AS population, n_name, CAST(NULL AS VARCHAR) AS note FROM nation",
)
def align_schema(spark, d):
    wanted = {"n_nationkey": "int", "population": "bigint", "n_name": "string", "note": "string"}
    return T.align(table(spark, d, "nation"), wanted)


@query(
    "top_per_group",
    """
    SELECT o_orderpriority, o_orderkey, o_totalprice,
      CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
    FROM orders QUALIFY rank <= 10
    """,
)
def top_per_group(spark, d):
    df = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return T.top_per_group(df, ["o_orderpriority"], ["-o_totalprice", "o_orderkey"], 10)
