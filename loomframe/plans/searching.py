"""Queries for search predicates, object search and access policies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loomframe.functions import where as P
from loomframe.operators import search as S
from loomframe.operators.aggregates import metric
from loomframe.plans.registry import query, table
from loomframe.plans.scalars import DUCK_PLACES, places


def _docs(spark, d, predicate):
    return table(spark, d, "documents").filter(predicate).select("doc_id", "lang")


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_LINE = f"' ' || array_to_string({_TOKENS}, ' ') || ' '"


@query("where_eq", "SELECT doc_id, lang FROM documents WHERE source = 'src7'")
def where_eq(spark, d):
    return _docs(spark, d, P.eq(F.col("source"), "src7"))


@query(
    "where_ranges",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 1500 AND o_totalprice <= 400000 AND o_custkey >= 10 AND o_orderpriority < '4'",
)
def where_ranges(spark, d):
    p = P.gt(F.col("o_totalprice"), 1500) & P.lte(F.col("o_totalprice"), 400000)
    p &= P.gte(F.col("o_custkey"), 10) & P.lt(F.col("o_orderpriority"), "4")
    return table(spark, d, "orders").filter(p).select("o_orderkey")


_HOLES = "SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '' WHEN 'error' THEN 'None' ELSE event_type END AS kind FROM events"


def _holes(spark, d):
    return table(spark, d, "events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '' WHEN 'error' THEN 'None' ELSE event_type END AS kind",
    )


@query(
    "where_is_null",
    f"SELECT event_id, kind IS NULL AS missing, kind IS NULL OR kind IN ('', 'None') AS blank FROM ({_HOLES})",
)
def where_is_null(spark, d):
    return _holes(spark, d).select(
        "event_id", P.is_null(F.col("kind")).alias("missing"), P.is_null(F.col("kind"), blank_counts=True).alias("blank")
    )


@query("where_not_null", f"SELECT event_id, kind FROM ({_HOLES}) WHERE kind NOT IN ('', 'None')")
def where_not_null(spark, d):
    df = _holes(spark, d)
    return df.filter(P.is_null(F.col("kind"), False, True))


@query("where_contains", f"SELECT doc_id, lang FROM documents WHERE list_contains({_TOKENS}, 'the')")
def where_contains(spark, d):
    from loomframe.functions.text import tokens

    return _docs(spark, d, P.contains(tokens(F.col("text")), "the"))


@query("where_in", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def where_in(spark, d):
    return _docs(spark, d, P.is_in(F.col("lang"), ["de", "fr"]))


@query("where_any_term", f"SELECT doc_id, lang FROM documents WHERE list_has_any({_TOKENS}, ['thing', 'under'])")
def where_any_term(spark, d):
    return _docs(spark, d, P.contains_any_term(F.col("text"), "Thing, under!"))


@query("where_all_terms", f"SELECT doc_id, lang FROM documents WHERE list_has_all({_TOKENS}, ['the', 'of', 'in'])")
def where_all_terms(spark, d):
    return _docs(spark, d, P.contains_all_terms(F.col("text"), "in the of"))


@query("where_phrase", f"SELECT doc_id, lang FROM documents WHERE contains({_LINE}, ' of the ')")
def where_phrase(spark, d):
    return _docs(spark, d, P.contains_all_terms_in_order(F.col("text"), "of the"))


@query("where_phrase_prefix", f"SELECT doc_id, lang FROM documents WHERE contains({_LINE}, ' of th')")
def where_phrase_prefix(spark, d):
    return _docs(spark, d, P.contains_all_terms_in_order_prefix_last_term(F.col("text"), "of th"))


@query("where_starts_with", "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://www.')")
def where_starts_with(spark, d):
    return table(spark, d, "pages").filter(P.starts_with(F.col("url"), "https://www.")).select("page_id", "url")


@query("where_wildcard", "SELECT page_id, url FROM pages WHERE url GLOB 'http*://m.*/e?/*'")
def where_wildcard(spark, d):
    return table(spark, d, "pages").filter(P.wildcard(F.col("url"), "http*://m.*/e?/*")).select("page_id", "url")


@query("where_regex", r"SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'https?://[a-z.]+/(en|de)/\d+')")
def where_regex(spark, d):
    return table(spark, d, "pages").filter(P.regex(F.col("url"), r"https?://[a-z.]+/(en|de)/\d+")).select("page_id", "url")


@query(
    "where_relative_dates",
    "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-16 12:00:00' AND TIMESTAMP '2024-01-29 00:00:00'",
)
def where_relative_dates(spark, d):
    p = P.relative_date_range(F.col("ts"), datetime(2024, 1, 30, 12), (2, "WEEKS"), (36, "HOURS"))
    return table(spark, d, "events").filter(p).select("event_id")


@query(
    "where_and_or_not",
    f"SELECT event_id, kind FROM ({_HOLES}) WHERE (kind IS DISTINCT FROM 'signup' AND kind IS DISTINCT FROM '') OR event_id < 50",
)
def where_and_or_not(spark, d):
    unwanted = P.is_in(F.col("kind"), ["signup", ""])
    return _holes(spark, d).filter(P.none_of(unwanted) | P.lt(F.col("event_id"), 50))


@query(
    "where_interval_ordered",
    f"""
    SELECT doc_id, lang FROM (SELECT doc_id, lang, {_TOKENS} AS t FROM documents)
    WHERE len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'the' AND list_contains(t[i + 1:i + 3], 'of'))) > 0
    """,
)
def where_interval_ordered(spark, d):
    return _docs(spark, d, P.interval(P.match(F.col("text"), "the of", 2, True)))


@query(
    "where_interval_unordered",
    f"""
    SELECT doc_id, lang FROM (SELECT doc_id, lang, {_TOKENS} AS t FROM documents)
    WHERE len(list_filter(range(1, len(t) + 1), lambda i: (t[i] = 'the' AND list_contains(t[i + 1:i + 2], 'of'))
                                               OR (t[i] = 'of' AND list_contains(t[i + 1:i + 2], 'the')))) > 0
    """,
)
def where_interval_unordered(spark, d):
    return _docs(spark, d, P.interval(P.match(F.col("text"), "the of", 1)))


@query(
    "where_interval_nested",
    f"""
    SELECT doc_id, lang FROM (SELECT doc_id, lang, {_LINE} AS t FROM documents)
    WHERE regexp_matches(t, ' of the (\\S+ ){{0,4}}(and|in) ')
    """.replace("\\\\", "\\"),
)
def where_interval_nested(spark, d):
    c = F.col("text")
    phrase = P.match(c, "of the", 0, True)
    found = P.all_of([phrase, P.any_of([P.match(c, "and"), P.match(c, "in")])], 4, True)
    return _docs(spark, d, P.interval(found))


_KM = f"""6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)) FROM (SELECT *, pow(sin(radians(40.0 - lat) / 2), 2)
  + cos(radians(lat)) * cos(radians(40.0)) * pow(sin(radians(-75.0 - lon) / 2), 2) AS a FROM {DUCK_PLACES})"""


@query("where_within_distance", f"SELECT o_orderkey FROM (SELECT o_orderkey, {_KM.replace(' FROM', ' AS km FROM', 1)}) WHERE km <= 1609.344")
def where_within_distance(spark, d):
    p = P.within_distance_of(F.col("lat"), F.col("lon"), (-75.0, 40.0), 1000, "MILES")
    return places(spark, d).filter(p).select("o_orderkey")


@query("where_within_box", f"SELECT o_orderkey FROM {DUCK_PLACES} WHERE lat BETWEEN 10 AND 50.5 AND lon BETWEEN -20 AND 30")
def where_within_box(spark, d):
    p = P.within_bounding_box(F.col("lat"), F.col("lon"), (-20.0, 50.5), (30.0, 10.0))
    return places(spark, d).filter(p).select("o_orderkey")


# A concave ring with corners off the 1/8 degree grid, so that no point lies on an edge.
_RING = [(-60.03, -30.07), (60.05, -30.02), (60.01, 40.06), (0.04, 5.03), (-60.08, 40.01)]


def _inside_sql(lat: str, lon: str) -> str:
    ends = list(zip(_RING, _RING[1:] + _RING[:1]))
    hits = [
        f"CASE WHEN ({y1} > {lat}) <> ({y2} > {lat}) AND {lon} < ({x2} - {x1}) * ({lat} - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END"
        for (x1, y1), (x2, y2) in [(tuple(f"({v}::DOUBLE)" for v in a), tuple(f"({v}::DOUBLE)" for v in b)) for a, b in ends]
    ]
    return f"(({' + '.join(hits)}) % 2 = 1)"


@query("where_within_polygon", f"SELECT o_orderkey FROM {DUCK_PLACES} WHERE {_inside_sql('lat', 'lon')}")
def where_within_polygon(spark, d):
    return places(spark, d).filter(P.within_polygon(F.col("lat"), F.col("lon"), _RING)).select("o_orderkey")


_BOX = ("lon", "lat", "lon + o_custkey % 9", "lat + o_custkey % 5")


@query(
    "where_intersects_box",
    f"""
    SELECT o_orderkey, lon <= 30 AND lon + o_custkey % 9 >= -20 AND lat <= 50.5 AND lat + o_custkey % 5 >= 10 AS touches,
      NOT (lon <= 30 AND lon + o_custkey % 9 >= -20 AND lat <= 50.5 AND lat + o_custkey % 5 >= 10) AS apart FROM {DUCK_PLACES}
    """,
)
def where_intersects_box(spark, d):
    args = (*[F.expr(e) for e in _BOX], (-20.0, 50.5), (30.0, 10.0))
    return places(spark, d).select(
        "o_orderkey",
        P.intersects_bounding_box(*args).alias("touches"),
        P.does_not_intersect_bounding_box(*args).alias("apart"),
    )


@query("where_intersects_polygon")
def where_intersects_polygon(spark, d):
    corners = [("0", "0"), ("o_custkey % 9", "0"), ("0", "o_custkey % 5"), ("0", "0")]
    ring = F.array(*[F.struct(F.expr(f"lon + {x}").alias("lon"), F.expr(f"lat + {y}").alias("lat")) for x, y in corners])
    return places(spark, d).select("o_orderkey", ring.alias("ring")).select(
        "o_orderkey",
        P.intersects_polygon(F.col("ring"), _RING).alias("touches"),
        P.does_not_intersect_polygon(F.col("ring"), _RING).alias("apart"),
    )


@query(
    "search_objects",
    """
    SELECT o_orderkey, o_totalprice, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 200000
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50
    """,
)
def search_objects(spark, d):
    p = P.is_in(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]) & P.gt(F.col("o_totalprice"), 200000)
    return S.search_objects(table(spark, d, "orders"), p, ["-o_totalprice"], "o_orderkey", ["o_totalprice", "o_custkey"], 50, 50)


@query(
    "collapse_duplicates",
    """
    WITH o AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS updated, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS overlay,
                 event_id, event_type = 'error' AS tombstone FROM events)
    SELECT user_id, event_id, updated FROM (SELECT * FROM o
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, overlay DESC, event_id DESC) = 1) WHERE NOT tombstone
    """,
)
def collapse_duplicates(spark, d):
    copies = table(spark, d, "events").selectExpr(
        "'User' AS class_id",
        "user_id",
        "date_format(ts, 'yyyy-MM-dd') AS updated",
        "CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS overlay",
        "event_id",
        "event_type = 'error' AS tombstone",
    )
    objects = S.collapse(copies, ["class_id", "user_id"], "updated", "overlay", "event_id", "tombstone")
    return objects.select("user_id", "event_id", "updated")


@query(
    "aggregate_objects",
    """
    SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, max(l_extendedprice) AS top
    FROM lineitem WHERE l_quantity >= 25 GROUP BY l_returnflag
    """,
)
def aggregate_objects(spark, d):
    metrics = {"n": metric("count"), "suppliers": metric("exactDistinct", "l_suppkey"), "top": metric("max", "l_extendedprice")}
    return S.aggregate_objects(table(spark, d, "lineitem"), P.gte(F.col("l_quantity"), 25), ["l_returnflag"], metrics)


@query(
    "saved_query",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 100 ORDER BY c_acctbal DESC, c_custkey LIMIT 20",
)
def saved_query(spark, d):
    options = {
        "where": "c_mktsegment = $segment AND c_acctbal > $floor",
        "order_by": ["-c_acctbal", "c_custkey"],
        "select": ["c_custkey", "c_acctbal"],
        "size": 20,
    }
    return S.saved_query(table(spark, d, "customer"), options, {"segment": "MACHINERY", "floor": 100})


@query(
    "object_set",
    """
    SELECT * FROM (SELECT c_name AS name, c_acctbal AS balance, 'Customer' AS object_type FROM customer
      UNION ALL SELECT s_name, s_acctbal, 'Supplier' FROM supplier) ORDER BY balance, name LIMIT 40
    """,
)
def object_set(spark, d):
    frames = {
        "Customer": table(spark, d, "customer").selectExpr("c_name AS name", "c_acctbal AS balance"),
        "Supplier": table(spark, d, "supplier").selectExpr("s_name AS name", "s_acctbal AS balance"),
    }
    return S.object_set(frames, ["balance", "name"], 40)


@query(
    "policy_allow",
    f"SELECT event_id, CAST(NULL AS VARCHAR) AS kind FROM ({_HOLES}) WHERE kind IS DISTINCT FROM 'signup' AND (kind IS NULL OR kind NOT IN ('None')) AND event_id >= 100",
)
def policy_allow(spark, d):
    rules = [("kind", "ne", "signup"), ("kind", "not_in", ["None"]), ("event_id", "gte", 100)]
    return S.apply_policy(_holes(spark, d), rules, mask=["kind", "absent"])


@query(
    "policy_deny",
    f"SELECT event_id, kind FROM ({_HOLES}) WHERE NOT coalesce(kind IS NULL OR contains(kind, 'ign') OR event_id < 30, false)",
)
def policy_deny(spark, d):
    rules = [("kind", "is_null", None), ("kind", "contains", "ign"), ("event_id", "lt", 30), ("kind", "sounds_like", "x")]
    return S.apply_policy(_holes(spark, d), rules, "or", "deny")


@query(
    "policy_report",
    f"SELECT count(*) FILTER (kind IS DISTINCT FROM 'purchase') AS filtered, count(*) FILTER (kind = 'purchase') * 2 AS masked_fields FROM ({_HOLES})",
)
def policy_report(spark, d):
    return S.policy_report(_holes(spark, d), [("kind", "eq", "purchase")], mask=["event_id", "kind"])
