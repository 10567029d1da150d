"""Queries for scalar functions, geo columns and text patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import geo
from loomframe.functions import text as X
from loomframe.operators import transforms as T
from loomframe.plans.registry import query, table

# Positions derived from keys; multiples of 1/8 degree are exact in binary.
_LAT = "((o_orderkey * 37) % 1441) / 8D - 90D"
_LON = "((o_orderkey * 101 + o_custkey) % 2881) / 8D - 180D"
DUCK_LAT = "((o_orderkey * 37) % 1441) / 8::DOUBLE - 90::DOUBLE"
DUCK_LON = "((o_orderkey * 101 + o_custkey) % 2881) / 8::DOUBLE - 180::DOUBLE"
DUCK_PLACES = f"(SELECT o_orderkey, o_custkey, o_totalprice, {DUCK_LAT} AS lat, {DUCK_LON} AS lon FROM orders)"


def places(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_totalprice", f"{_LAT} AS lat", f"{_LON} AS lon"
    )


@query(
    "functions_datetime",
    """
    SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_start, CAST(year(ts) AS INTEGER) AS year,
      CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour,
      CAST(minute(ts) AS INTEGER) AS minute, CAST(second(ts) AS INTEGER) AS second FROM events
    """,
)
def functions_datetime(spark, d):
    return table(spark, d, "events").selectExpr(
        "event_id",
        "date_format(date_trunc('HOUR', ts), 'yyyy-MM-dd HH:mm:ss') AS hour_start",
        "year(ts) AS year",
        "month(ts) AS month",
        "dayofmonth(ts) AS day",
        "hour(ts) AS hour",
        "minute(ts) AS minute",
        "second(ts) AS second",
    )


@query(
    "functions_string",
    r"""
    SELECT c_custkey, regexp_extract(c_name, '#0*(\d+)', 1) AS number, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS shape,
      upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, trim('  ' || c_mktsegment || ' ') AS trimmed,
      ltrim('  x') AS l, rtrim('x  ') AS r, split_part(c_name, '#', 2) AS tail, c_name || '-' || c_custkey AS joined,
      substr(c_name, 1, 4) AS head, length(c_name) AS size FROM customer
    """,
)
def functions_string(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey",
        r"regexp_extract(c_name, '#0*(\\d+)', 1) AS number",
        "regexp_replace(c_name, '[0-9]+', 'N') AS shape",
        "upper(c_mktsegment) AS up",
        "lower(c_mktsegment) AS low",
        "trim(concat('  ', c_mktsegment, ' ')) AS trimmed",
        "ltrim('  x') AS l",
        "rtrim('x  ') AS r",
        "split(c_name, '#')[1] AS tail",
        "concat(c_name, '-', c_custkey) AS joined",
        "substr(c_name, 1, 4) AS head",
        "CAST(length(c_name) AS BIGINT) AS size",
    )


@query(
    "functions_null",
    """
    SELECT event_id, coalesce(v, -1.0) AS filled, coalesce(v, 0.0) AS nvl, v IS NULL AS missing, false AS nan
    FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events)
    """,
)
def functions_null(spark, d):
    df = table(spark, d, "events").selectExpr("event_id", "CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v")
    return df.selectExpr("event_id", "coalesce(v, -1D) AS filled", "nvl(v, 0D) AS nvl", "isnull(v) AS missing", "isnan(v) AS nan")


@query(
    "functions_math",
    """
    SELECT c_custkey, abs(c_acctbal) AS size, round(c_acctbal / 7, 3) AS rounded, CAST(floor(c_acctbal) AS BIGINT) AS down,
      CAST(ceil(c_acctbal) AS BIGINT) AS up, greatest(c_acctbal, 100.5) AS at_least, least(c_acctbal, 100.5) AS at_most,
      CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'good' END AS state FROM customer
    """,
)
def functions_math(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey",
        "abs(c_acctbal) AS size",
        "round(c_acctbal / 7, 3) AS rounded",
        "floor(c_acctbal) AS down",
        "ceil(c_acctbal) AS up",
        "greatest(c_acctbal, 100.5D) AS at_least",
        "least(c_acctbal, 100.5D) AS at_most",
        "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'good' END AS state",
    )


@query(
    "functions_safe_arithmetic",
    """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS ratio,
      l_orderkey % nullif(l_linenumber - 1, 0) AS remainder, pow(l_linenumber, 2) AS square FROM lineitem
    """,
)
def functions_safe_arithmetic(spark, d):
    return T.select_expr(
        table(spark, d, "lineitem"),
        [
            "l_orderkey",
            "l_linenumber",
            "round(try_divide(l_extendedprice, l_discount), 4) AS ratio",
            "try_mod(l_orderkey, CAST(l_linenumber - 1 AS BIGINT)) AS remainder",
            "pow(l_linenumber, 2) AS square",
        ],
    )


@query(
    "functions_json",
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
      '{"id":' || event_id || ',"type":"' || event_type || '"}' AS made FROM events
    """,
)
def functions_json(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        F.from_json("props", "k bigint")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("made"),
    )


@query(
    "functions_array",
    """
    SELECT vec_id, len(embedding) AS size, list_contains(list_transform(embedding, lambda x: x > 0.2), true) AS large,
      round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings
    """,
)
def functions_array(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.size("embedding").cast("bigint").alias("size"),
        F.array_contains(F.transform("embedding", lambda x: x > 0.2), True).alias("large"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"),
    )


@query("functions_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def functions_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(
    "geo_point",
    f"SELECT o_orderkey, 'POINT(' || lon || ' ' || lat || ')' AS point FROM {DUCK_PLACES}",
)
def geo_point(spark, d):
    return places(spark, d).select("o_orderkey", geo.point_text(F.col("lat"), F.col("lon")).alias("point"))


def _geohash_sql(precision: int) -> str:
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2
    letters = []
    for i in range(precision):
        bits = []
        for b in range(5):
            at = 5 * i + b
            name, width = ("x", lon_bits) if at % 2 == 0 else ("y", lat_bits)
            bits.append(f"(({name} >> {width - 1 - at // 2}) & 1) * {1 << (4 - b)}")
        letters.append(f"substr('{geo.GEOHASH_ALPHABET}', CAST(1 + {' + '.join(bits)} AS INTEGER), 1)")
    return f"""
    SELECT o_orderkey, {" || ".join(letters)} AS cell FROM (SELECT o_orderkey,
      least(CAST(floor((lon + 180) / 360 * {1 << lon_bits}) AS BIGINT), {(1 << lon_bits) - 1}) AS x,
      least(CAST(floor((lat + 90) / 180 * {1 << lat_bits}) AS BIGINT), {(1 << lat_bits) - 1}) AS y FROM {DUCK_PLACES})
    """


@query("geo_hash", _geohash_sql(7))
def geo_hash(spark, d):
    return places(spark, d).select("o_orderkey", geo.geohash(F.col("lat"), F.col("lon")).alias("cell"))


@query("geo_hash_cells", f"SELECT cell, count(*) AS n FROM ({_geohash_sql(3)}) GROUP BY cell")
def geo_hash_cells(spark, d):
    cells = places(spark, d).select(geo.geohash(F.col("lat"), F.col("lon"), 3).alias("cell"))
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query(
    "geo_distance",
    f"""
    SELECT o_orderkey, round(6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM (SELECT o_orderkey,
      pow(sin(radians(37.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(37.5)) * pow(sin(radians(127.0 - lon) / 2), 2) AS a
      FROM {DUCK_PLACES})
    """,
)
def geo_distance(spark, d):
    km = geo.distance_km(F.col("lat"), F.col("lon"), F.lit(37.5), F.lit(127.0))
    return places(spark, d).select("o_orderkey", F.round(km, 6).alias("km"))


@query(
    "pattern_contains",
    r"SELECT page_id, regexp_matches(html, '<h[1-3][^>]*>') AS has_heading FROM pages",
)
def pattern_contains(spark, d):
    return table(spark, d, "pages").select("page_id", X.pattern_contains(F.col("html"), "<h[1-3][^>]*>").alias("has_heading"))


@query("pattern_extract", r"SELECT page_id, nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS page FROM pages")
def pattern_extract(spark, d):
    return table(spark, d, "pages").select("page_id", X.pattern_extract(F.col("url"), r"[?&]page=(\d+)").alias("page"))


@query("pattern_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\d+')) AS INTEGER) AS numbers FROM documents")
def pattern_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.pattern_count(F.col("text"), r"\d+").alias("numbers"))


_EMAIL_RE2 = X.EMAIL


@query(
    "mask_emails",
    rf"""
    SELECT doc_id, md5(CASE WHEN len(found) = 0 THEN text ELSE list_reduce(list_transform(range(1, len(between) + 1),
      lambda i: between[i] || coalesce('<email:' || substr(sha256(found[i]), 1, 10) || '>', '')), lambda x, y: x || y) END) AS masked
    FROM (SELECT doc_id, text, regexp_split_to_array(text, '{_EMAIL_RE2}') AS between,
                 regexp_extract_all(text, '{_EMAIL_RE2}') AS found FROM documents)
    """,
)
def mask_emails(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.mask_emails(F.col("text"))).alias("masked"))


@query("mask_personal_data")
def mask_personal_data(spark, d):
    return table(spark, d, "documents").select("doc_id", X.mask_personal_data(F.col("text")).alias("masked"))


@query(
    "personal_data_counts",
    rf"""
    SELECT lang, CAST(sum(len(regexp_extract_all(text, '{X.EMAIL}'))) AS BIGINT) AS emails,
      CAST(sum(len(regexp_extract_all(text, '{X.LONG_DIGITS}'))) AS BIGINT) AS digit_runs FROM documents GROUP BY lang
    """,
)
def personal_data_counts(spark, d):
    def found(pattern):
        return F.sum(F.regexp_count("text", F.lit(pattern))).cast("bigint")

    return table(spark, d, "documents").groupBy("lang").agg(
        found(X.EMAIL).alias("emails"), found(X.LONG_DIGITS).alias("digit_runs")
    )


_PATTERN_SOURCE = """
    SELECT 'c_name' AS "column", replace(c_name, '#', '') AS value FROM customer
    UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'code', substr(c_mktsegment, 1, 2) FROM customer
    UNION ALL SELECT 'balance', CAST(CAST(c_acctbal AS INTEGER) AS VARCHAR) FROM customer
    UNION ALL SELECT 'url', url FROM pages UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders
    UNION ALL SELECT 'eu_day', strftime(o_orderdate, '%d.%m.%Y') FROM orders
    UNION ALL SELECT 'flag', CASE WHEN o_orderstatus = 'F' THEN 'No' WHEN o_orderstatus = 'O' THEN ' true ' END FROM orders
"""


@query(
    "value_pattern_distribution",
    "SELECT \"column\", pattern, count(*) AS count FROM (SELECT \"column\", CASE WHEN value IS NULL THEN 'null' "
    + " ".join(f"WHEN regexp_matches(trim(value), '{p}') THEN '{n}'" for n, p in X.VALUE_PATTERNS)
    + f" ELSE 'free_text' END AS pattern FROM ({_PATTERN_SOURCE})) GROUP BY ALL",
)
def value_pattern_distribution(spark, d):
    customer, orders, pages = (table(spark, d, n) for n in ("customer", "orders", "pages"))
    from loomframe.operators.aggregates import stacked

    people = customer.selectExpr(
        "replace(c_name, '#', '') AS c_name",
        "c_mktsegment",
        "substr(c_mktsegment, 1, 2) AS code",
        "CAST(CAST(round(c_acctbal) AS INT) AS STRING) AS balance",
    )
    days = orders.selectExpr(
        "date_format(o_orderdate, 'yyyy-MM-dd') AS day",
        "date_format(o_orderdate, 'dd.MM.yyyy') AS eu_day",
        "CASE WHEN o_orderstatus = 'F' THEN 'No' WHEN o_orderstatus = 'O' THEN ' true ' END AS flag",
    )
    whole = stacked(people, people.columns).unionByName(stacked(pages, ["url"])).unionByName(stacked(days, days.columns))
    return whole.groupBy("column", X.value_pattern(F.col("value")).alias("pattern")).agg(F.count(F.lit(1)).alias("count"))
