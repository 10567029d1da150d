"""Queries for data quality, profiling, claims and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import claims as C
from loomframe.operators import drift as D
from loomframe.operators import profiling as P
from loomframe.operators import quality as Q
from loomframe.plans.registry import query, table


@query(
    "expectations",
    """
    WITH o AS (SELECT *, nullif(o_custkey, 9) AS buyer, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END AS status FROM orders),
    r AS (SELECT 'row_count_min' AS rule, '' AS "column", greatest(100000000 - count(*), 0) AS violations FROM o
      UNION ALL SELECT 'row_count_max', '', greatest(count(*) - 100, 0) FROM o
      UNION ALL SELECT 'not_null', 'o_orderkey', count(*) FILTER (o_orderkey IS NULL) FROM o
      UNION ALL SELECT 'not_null', 'buyer', count(*) FILTER (buyer IS NULL) FROM o
      UNION ALL SELECT 'non_empty', 'status', count(*) FILTER (trim(status) = '') FROM o
      UNION ALL SELECT 'min', 'o_totalprice', count(*) FILTER (o_totalprice < 2000) FROM o
      UNION ALL SELECT 'max', 'o_totalprice', count(*) FILTER (o_totalprice > 600000) FROM o
      UNION ALL SELECT 'regex', 'o_orderpriority', count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-4]-')) FROM o
      UNION ALL SELECT 'in_set', 'o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM o
      UNION ALL SELECT 'unique', 'o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM o
      UNION ALL SELECT 'unique', 'buyer,status', (SELECT count(*) FROM o) - count(*) FROM (SELECT DISTINCT buyer, status FROM o))
    SELECT rule, "column", violations, violations > 0 AS failed FROM r
    """,
)
def expectations(spark, d):
    orders = table(spark, d, "orders").selectExpr(
        "*", "nullif(o_custkey, 9) AS buyer", "CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END AS status"
    )
    return Q.expectations(
        orders,
        [
            ("row_count_min", [], 100_000_000),
            ("row_count_max", [], 100),
            ("not_null", ["o_orderkey", "buyer"], None),
            ("non_empty", ["status"], None),
            ("min", ["o_totalprice"], 2000),
            ("max", ["o_totalprice"], 600000),
            ("regex", ["o_orderpriority"], "^[1-4]-"),
            ("in_set", ["o_orderstatus"], ["F", "O"]),
            ("unique", ["o_orderkey"], None),
            ("unique", ["buyer", "status"], None),
        ],
    )


@query(
    "key_expectations",
    """
    SELECT 'not_null' AS rule, c AS "column", 0::BIGINT AS violations, false AS failed FROM (VALUES ('l_orderkey'), ('l_linenumber'), ('l_linestatus')) t(c)
    UNION ALL SELECT 'unique', 'l_orderkey,l_linenumber', (SELECT count(*) FROM lineitem) - count(*), (SELECT count(*) FROM lineitem) > count(*)
      FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
    """,
)
def key_expectations(spark, d):
    return Q.expectations(table(spark, d, "lineitem"), Q.key_rules(["l_orderkey", "l_linenumber"], True, "l_linestatus"))


@query(
    "schema_checks",
    """
    SELECT * FROM (VALUES ('required', 'c_phone', 1::BIGINT, true), ('type', 'c_custkey', 0, false), ('type', 'c_name', 1, true))
      t(rule, "column", violations, failed)
    UNION ALL SELECT 'not_null', 'c_name', 0, false
    UNION ALL SELECT 'min', 'c_acctbal', count(*) FILTER (c_acctbal < 0), count(*) FILTER (c_acctbal < 0) > 0 FROM customer
    UNION ALL SELECT 'regex', 'c_name', count(*) FILTER (NOT regexp_matches(c_name, '00$')), true FROM customer
    """,
)
def schema_checks(spark, d):
    checks = [
        ("required", "c_phone", None),
        ("type", "c_custkey", "integer"),
        ("type", "c_name", "decimal"),
        ("not_null", "c_name", None),
        ("min", "c_acctbal", 0),
        ("regex", "c_name", "00$"),
    ]
    return Q.schema_checks(table(spark, d, "customer"), checks)


@query(
    "schema_contract",
    """SELECT * FROM (VALUES ('s_phone', 'missing'), ('s_acctbal', 'type decimal is not integer')) t("column", problem)""",
)
def schema_contract(spark, d):
    contract = [("s_suppkey", "integer", True), ("s_phone", "string", True), ("s_fax", "string", False), ("s_acctbal", "integer", True)]
    return Q.schema_contract(table(spark, d, "supplier"), contract)


_CONSTRAINTS = {
    "c_mktsegment": {"enum": ["BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD"]},
    "c_name": {"minLength": 3, "maxLength": 18, "allowedChars": "Customer#01234567", "pattern": "^C"},
    "c_acctbal": {"minimum": 0, "exclusiveMaximum": 9000, "precision": 1},
    "c_nationkey": {"multipleOf": 3},
    "lower_name": {"lowercase": True, "format": "email"},
    "c_custkey": [{"minimum": 10}, {"maximum": 1000}],
}


@query(
    "constraint_violations",
    """
    WITH c AS (SELECT *, CASE WHEN c_nationkey = 1 THEN NULL WHEN c_nationkey = 2 THEN c_name ELSE lower(replace(c_name, '#', '@')) || '.org' END AS lower_name
               FROM customer),
    v AS (SELECT c_custkey AS id, 'c_mktsegment' AS "column", CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'enum' END AS rule FROM c
      UNION ALL SELECT c_custkey, 'c_name', CASE WHEN regexp_matches(c_name, '[89]') THEN 'allowedChars' END FROM c
      UNION ALL SELECT c_custkey, 'c_acctbal', CASE WHEN c_acctbal < 0 THEN 'minimum' WHEN c_acctbal >= 9000 THEN 'exclusiveMaximum'
        WHEN regexp_matches(CAST(c_acctbal AS VARCHAR), '\\.\\d\\d') THEN 'precision' END FROM c
      UNION ALL SELECT c_custkey, 'c_nationkey', CASE WHEN c_nationkey % 3 <> 0 THEN 'multipleOf' END FROM c
      UNION ALL SELECT c_custkey, 'lower_name', CASE WHEN lower_name IS NULL THEN NULL WHEN lower_name <> lower(lower_name) THEN 'lowercase'
        WHEN NOT regexp_matches(lower_name, '^[\\w._%+-]+@[\\w.-]+\\.[A-Za-z]{2,}$') THEN 'format' END FROM c
      UNION ALL SELECT c_custkey, 'c_custkey', CASE WHEN c_custkey < 10 THEN 'minimum' WHEN c_custkey > 1000 THEN 'maximum' END FROM c)
    SELECT * FROM v WHERE rule IS NOT NULL
    """,
)
def constraint_violations(spark, d):
    customers = table(spark, d, "customer").selectExpr(
        "*",
        "c_custkey AS id",
        "CASE WHEN c_nationkey = 1 THEN NULL WHEN c_nationkey = 2 THEN c_name "
        "ELSE concat(lower(replace(c_name, '#', '@')), '.org') END AS lower_name",
    )
    return Q.constraint_violations(customers, ["id"], _CONSTRAINTS)


@query(
    "constraint_list_counts",
    """
    SELECT 'tokens' AS "column", rule, count(*) AS violations FROM (
      SELECT CASE WHEN len(t) < 20 THEN 'minItems' WHEN len(t) > 400 THEN 'maxItems'
        WHEN len(list_distinct(t)) < len(t) THEN 'uniqueItems' WHEN NOT list_contains(t, 'the') THEN 'contains' END AS rule
      FROM (SELECT string_split(text, ' ') AS t FROM documents)) WHERE rule IS NOT NULL GROUP BY rule
    """,
)
def constraint_list_counts(spark, d):
    words = table(spark, d, "documents").select(F.split("text", " ", -1).alias("tokens"))
    return Q.constraint_counts(words, {"tokens": {"minItems": 20, "maxItems": 400, "uniqueItems": True, "contains": "the"}})


@query(
    "key_scan",
    """
    WITH e AS (SELECT nullif(user_id, 3) AS user_id, event_type, event_id FROM events)
    SELECT 'user_id,event_type' AS key, 'primary' AS kind, count(*) AS rows, count(*) FILTER (user_id IS NULL) AS missing,
      count(*) FILTER (user_id IS NOT NULL) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM e WHERE user_id IS NOT NULL)) AS duplicates FROM e
    UNION ALL SELECT 'event_id', 'unique', count(*), 0, count(*) - count(DISTINCT event_id) FROM e
    """,
)
def key_scan(spark, d):
    events = table(spark, d, "events").selectExpr("nullif(user_id, 3) AS user_id", "event_type", "event_id")
    return Q.key_scan(events, ["user_id", "event_type"], [["event_id"]])


_PROFILE = """
    SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS null_count,
      count(*) FILTER (CAST({c} AS VARCHAR) = '') AS empty_count, count(*) FILTER (regexp_matches(CAST({c} AS VARCHAR), '^\\s+$')) AS whitespace_count,
      min({n}) AS min, max({n}) AS max, round(avg({n}), 6) AS mean, count(DISTINCT nullif(CAST({c} AS VARCHAR), '')) AS distinct_count FROM p
"""


@query(
    "column_profile",
    "WITH p AS (SELECT p_partkey, p_size, p_retailprice, CASE p_type WHEN 'ECONOMY' THEN '' WHEN 'PROMO' THEN '  ' WHEN 'LARGE' THEN NULL ELSE p_type END AS kind FROM part) "
    + " UNION ALL ".join(
        _PROFILE.format(c=c, n="CAST(NULL AS DOUBLE)" if c == "kind" else f"CAST({c} AS DOUBLE)")
        for c in ("p_partkey", "p_size", "p_retailprice", "kind")
    ),
)
def column_profile(spark, d):
    parts = table(spark, d, "part").selectExpr(
        "p_partkey",
        "p_size",
        "p_retailprice",
        "CASE p_type WHEN 'ECONOMY' THEN '' WHEN 'PROMO' THEN '  ' WHEN 'LARGE' THEN NULL ELSE p_type END AS kind",
    )
    return P.column_profile(parts).withColumn("mean", F.round("mean", 6))


_TYPED = {
    "flag": ("CASE WHEN o_orderstatus = 'F' THEN ' True' ELSE 'false' END", 1, 0, 0, 0),
    "whole": ("CAST(o_orderkey AS {t})", 0, 1, 1, 0),
    "money": ("CAST(CAST(o_custkey AS BIGINT) AS {t}) || '.25'", 0, 0, 1, 0),
    "day": ("substr(CAST(o_orderdate AS {t}), 1, 10)", 0, 0, 0, 1),
    "words": ("CASE WHEN o_orderpriority = '1-URGENT' THEN '12' ELSE o_orderpriority END", 0, None, None, 0),
}


@query(
    "infer_types",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS suggested_type, {conf} AS confidence, count(*) AS values, "
        + ", ".join(f"CAST({r} AS DOUBLE) AS {n}_ratio" for n, r in zip(("bool", "int", "decimal", "datetime"), rs))
        + " FROM orders"
        for c, k, conf, rs in [
            ("flag", "boolean", "1.0::DOUBLE", (1, 0, 0, 0)),
            ("money", "decimal", "1.0::DOUBLE", (0, 0, 1, 0)),
            ("day", "dateTime", "1.0::DOUBLE", (0, 0, 0, 1)),
            (
                "words",
                "string",
                "round(count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 3)",
                (0, "round(count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 3)", "round(count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 3)", 0),
            ),
        ]
    ),
)
def infer_types(spark, d):
    columns = ["flag", "money", "day", "words"]
    made = [F.expr(_TYPED[c][0].format(t="STRING")).alias(c) for c in columns]
    return P.infer_types(table(spark, d, "orders").select(*made), columns)


@query(
    "cleansing_advice",
    """
    SELECT * FROM (VALUES ('label', 'normalize', 'trim, empty and blank to missing'), ('comment', 'keep_whitespace', 'blank runs may carry meaning'),
      ('amount', 'cast', 'decimal'), ('phone', 'regex_replace', '[^0-9+]+'), ('label', 'lowercase', '0.5')) t("column", operation, detail)
    WHERE (SELECT count(*) FILTER (c_nationkey % 4 = 0) / count(*) FROM customer) >= 0.1
    UNION ALL SELECT '', 'dedupe', CAST(round(1 - (2 * count(*) - count(*) FILTER (c_nationkey % 4 = 0)) / (4 * count(*)), 4) AS VARCHAR) FROM customer
    """,
)
def cleansing_advice(spark, d):
    base = table(spark, d, "customer").selectExpr(
        "CASE WHEN c_nationkey % 4 = 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN concat('a', c_custkey div 2) ELSE concat('A', c_custkey div 2) END AS label",
        "CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE c_name END AS comment",
        "concat(c_custkey, '.75') AS amount",
        "concat('010-', lpad(c_custkey, 4, '0')) AS phone",
        "c_custkey",
    )
    spelled = base.selectExpr("stack(2, upper(label), lower(label)) AS label", "comment", "amount", "phone", "c_custkey")
    doubled = spelled.unionByName(spelled)
    return P.cleansing_advice(doubled, ["label", "comment", "amount", "phone"], "accounts")


@query(
    "pattern_distribution",
    """
    WITH c AS (SELECT 'day' AS "column", 'iso_date' AS pattern, count(*) AS count FROM orders
      UNION ALL SELECT 'status', CASE WHEN o_orderstatus = 'F' THEN 'code_short' ELSE 'sequential_id' END, count(*) FROM orders WHERE o_orderstatus <> 'P' GROUP BY 2)
    SELECT "column", pattern, count, round(count / sum(count) OVER (PARTITION BY "column"), 4) AS ratio,
      row_number() OVER (PARTITION BY "column" ORDER BY count DESC, pattern) = 1 AS dominant FROM c
    """,
)
def pattern_distribution(spark, d):
    orders = table(spark, d, "orders").selectExpr(
        "date_format(o_orderdate, 'yyyy-MM-dd') AS day",
        "CASE o_orderstatus WHEN 'F' THEN 'FX' WHEN 'O' THEN concat('ORD-', lpad(o_orderkey, 6, '0')) END AS status",
    )
    return P.pattern_distribution(orders, ["day", "status"])


@query(
    "semantic_hints",
    """
    SELECT * FROM (VALUES ('event_id', 'possible_foreign_key'), ('user_id', 'possible_foreign_key'), ('event_type', 'likely_categorical'),
      ('event_id', 'likely_identifier')) t("column", hint)
    """,
)
def semantic_hints(spark, d):
    events = table(spark, d, "events").selectExpr("concat('EV', lpad(event_id, 9, '0')) AS event_id", "concat('u ', user_id) AS user_id", "event_type")
    return P.semantic_hints(events, ["event_id", "user_id", "event_type"])


@query(
    "column_relationship",
    """
    WITH l AS (SELECT nullif(user_id, 2) AS v FROM events), r AS (SELECT c_custkey * 2 AS v FROM customer),
    n AS (SELECT (SELECT count(DISTINCT v) FROM l) AS ld, (SELECT count(DISTINCT v) FROM r) AS rd,
      (SELECT count(*) FROM (SELECT DISTINCT v FROM l) SEMI JOIN r USING (v)) AS s)
    SELECT (SELECT round(count(*) FILTER (v IS NULL) / count(*), 4) FROM l) AS left_null_ratio, 0.0::DOUBLE AS right_null_ratio,
      round(ld / (SELECT count(v) FROM l), 4) AS left_unique_ratio, round(rd / (SELECT count(v) FROM r), 4) AS right_unique_ratio,
      s AS intersection_count, round(s / ld, 4) AS left_containment, round(s / rd, 4) AS right_containment FROM n
    """,
)
def column_relationship(spark, d):
    left = table(spark, d, "events").selectExpr("nullif(user_id, 2) AS v")
    return P.column_relationship(left, "v", table(spark, d, "customer").selectExpr("c_custkey * 2 AS v"), "v")


@query(
    "unmatched_values",
    """
    (SELECT 'left' AS side, v AS value FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS v FROM customer) ANTI JOIN
      (SELECT DISTINCT CAST(user_id AS VARCHAR) AS v FROM events) USING (v) ORDER BY v LIMIT 5)
    UNION ALL (SELECT 'right', v FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS v FROM events) ANTI JOIN
      (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS v FROM customer) USING (v) ORDER BY v LIMIT 5)
    """,
)
def unmatched_values(spark, d):
    return P.unmatched_values(table(spark, d, "customer"), "c_custkey", table(spark, d, "events"), "user_id", 5)


_SOURCES = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "orders": ["o_custkey"], "events": ["user_id"], "customer": ["c_nationkey"]}
_TARGETS = {"orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "customer": "c_custkey", "nation": "n_nationkey"}


def _stack_sql(pairs: list[tuple[str, str]]) -> str:
    return " UNION ".join(f"SELECT '{t}.{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {t}" for t, c in pairs)


@query(
    "reference_candidates",
    f"""
    WITH s AS ({_stack_sql([(t, c) for t, cs in _SOURCES.items() for c in cs])}), t AS ({_stack_sql(list(_TARGETS.items()))}),
    ns AS (SELECT col, count(*) AS n FROM s GROUP BY col), nt AS (SELECT col, count(*) AS n FROM t GROUP BY col),
    o AS (SELECT s.col AS source, t.col AS target, count(*) AS shared FROM s JOIN t USING (v) GROUP BY ALL),
    c AS (SELECT source, target, shared, least(1.0, 0.7 * shared / ns.n + 0.3 * CASE WHEN nt.n / ns.n <= 1 THEN 1.0
            ELSE greatest(0.5, 1 - (nt.n / ns.n - 1) * 0.1) END) AS confidence
          FROM o JOIN ns ON source = ns.col JOIN nt ON target = nt.col)
    SELECT source, target, shared, round(confidence, 6) AS confidence FROM c WHERE confidence > 0.7 AND source <> target
    """,
)
def reference_candidates(spark, d):
    sources = {t: (table(spark, d, t), cs) for t, cs in _SOURCES.items()}
    return P.reference_candidates(sources, {t: (table(spark, d, t), c) for t, c in _TARGETS.items()})


@query(
    "claim_primary_key",
    """
    SELECT user_id, event_type, CASE WHEN user_id IS NULL THEN 'null' ELSE 'duplicate' END AS reason, count(*) AS rows
    FROM (SELECT nullif(user_id, 4) AS user_id, event_type FROM events) GROUP BY user_id, event_type HAVING user_id IS NULL OR count(*) > 1
    """,
)
def claim_primary_key(spark, d):
    events = table(spark, d, "events").selectExpr("nullif(user_id, 4) AS user_id", "event_type")
    return C.primary_key(events, ["user_id", "event_type"])


@query(
    "claim_functional_right",
    "SELECT c_name, n FROM (SELECT p_name AS c_name, count(*) AS n FROM part WHERE p_name <> 'blue anvil' GROUP BY 1) WHERE n > 1",
)
def claim_functional_right(spark, d):
    parts = table(spark, d, "part").selectExpr("nullif(p_name, 'blue anvil') AS c_name")
    return C.functional_right(parts, ["c_name"]).withColumnRenamed("rows", "n")


@query(
    "claim_filter_only_nulls",
    """
    SELECT event_type AS value, count(*) AS input_count, count(*) FILTER (value >= 20) AS output_count FROM events
    WHERE event_type <> 'error' GROUP BY event_type HAVING count(*) > count(*) FILTER (value >= 20)
    """,
)
def claim_filter_only_nulls(spark, d):
    events = table(spark, d, "events").selectExpr("nullif(event_type, 'error') AS kind", "value")
    return C.filter_removes_only_nulls(events, events.filter("value >= 20"), "kind")


@query(
    "claim_retain_rate",
    "SELECT count(*) AS input_rows, count(*) FILTER (value >= 20) AS output_rows, round(count(*) FILTER (value >= 20) / count(*), 6) AS retain_rate FROM events",
)
def claim_retain_rate(spark, d):
    events = table(spark, d, "events")
    return C.retain_rate(events, events.filter("value >= 20"), 0.99)


@query(
    "claim_union_lossless",
    """
    SELECT l_suppkey, l_returnflag, count(*) AS input_count, count(*) FILTER (l_quantity > 3) AS output_count FROM lineitem
    GROUP BY ALL HAVING count(*) FILTER (l_quantity > 3) < count(*)
    """,
)
def claim_union_lossless(spark, d):
    items = table(spark, d, "lineitem")
    columns = ["l_suppkey", "l_returnflag"]
    halves = [items.filter("l_linestatus = 'F'").select(*columns), items.filter("l_linestatus <> 'F'").select(*columns)]
    return C.union_lossless(halves, items.filter("l_quantity > 3").select(*columns))


@query(
    "claim_cast_success",
    "SELECT o_orderkey, 'text' AS \"column\", o_orderpriority AS value FROM orders WHERE o_orderstatus = 'P'",
)
def claim_cast_success(spark, d):
    orders = table(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE o_orderstatus WHEN 'P' THEN o_orderpriority WHEN 'F' THEN ' ' ELSE ' 1,000 ' END AS text"
    )
    return C.cast_success(orders, ["o_orderkey"], {"text": "integer"})


@query(
    "claim_cast_lossless",
    """
    SELECT o_orderkey, 'text' AS "column", CASE o_orderstatus WHEN 'P' THEN '1,000' ELSE 'x' END AS original,
      CASE o_orderstatus WHEN 'P' THEN '1000' ELSE '' END AS roundtrip FROM orders WHERE o_orderstatus IN ('P', 'O') AND o_orderpriority < '3'
    """,
)
def claim_cast_lossless(spark, d):
    orders = table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderpriority >= '3' THEN ' 007 ' WHEN o_orderstatus = 'P' THEN '1,000' WHEN o_orderstatus = 'O' THEN 'x' ELSE '0' END AS text",
    )
    return C.cast_lossless(orders, ["o_orderkey"], {"text": "integer"}, ["trim", "strip_leading_zeros"])


@query(
    "schema_drift",
    """
    SELECT * FROM (VALUES
      ('column_renamed', 'c_name', 'c_name', 'c_names', 'warning', 'warning', 0::BIGINT),
      ('column_added', 'tier', '', 'string', 'none', 'info', 0)) t(change, "column", old, new, impact, severity, values_lost)
    UNION ALL SELECT 'column_removed', 'c_nationkey', 'integer', '', 'mapping_invalid', 'breaking', count(*) FROM customer
    UNION ALL SELECT 'type_changed', 'code', 'string', 'integer', 'type_mismatch', 'warning', count(*) FILTER (c_mktsegment = 'BUILDING') FROM customer
    UNION ALL SELECT 'type_changed', 'c_acctbal', 'decimal', 'boolean', 'data_loss', 'breaking',
      count(*) FILTER (CAST(c_acctbal AS VARCHAR) NOT IN ('1', '0')) FROM customer
    """,
)
def schema_drift(spark, d):
    customer = table(spark, d, "customer")
    old = customer.selectExpr(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "CASE c_mktsegment WHEN 'BUILDING' THEN 'n/a' ELSE '12' END AS code"
    )
    new = customer.selectExpr("c_custkey", "c_name AS c_names", "c_acctbal > 0 AS c_acctbal", "12 AS code", "'gold' AS tier")
    return D.drift(old, new)
