"""Queries for entities, links, event replay and write-back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import entities as N
from loomframe.operators import events as E
from loomframe.operators import writeback as B
from loomframe.plans.registry import query, table
from loomframe.session import new_path

_MAPPINGS = [
    ("code", "customer_id", "integer"),
    ("label", "name", "string"),
    ("old_label", "name", "string"),
    ("amount", "balance", "decimal"),
    ("since", "since", "date"),
    ("active", "active", "boolean"),
]
_RAW = {
    "code": "CASE WHEN c_nationkey = 3 THEN ' ' WHEN c_nationkey = 4 THEN CAST(c_custkey AS {t}) || '.5' ELSE CAST(c_custkey AS {t}) || '.0' END",
    "label": "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END",
    "old_label": "CASE WHEN c_mktsegment = 'MACHINERY' THEN c_mktsegment END",
    "amount": "CASE WHEN c_nationkey = 5 THEN 'much' WHEN c_acctbal < 0 THEN '(' || CAST(CAST(-c_acctbal * 100 AS BIGINT) AS {t}) || ')' ELSE '€ ' || CAST(CAST(c_acctbal * 100 AS BIGINT) AS {t}) || ',50' END",
    "since": "CASE WHEN c_nationkey = 6 THEN '20210230' WHEN c_nationkey = 7 THEN '2021/02/03 10:00' ELSE '20210203' END",
    "active": "CASE c_nationkey WHEN 8 THEN 'perhaps' WHEN 9 THEN 'N' ELSE 'yes' END",
}


def _raw(spark, d):
    made = [F.expr(e.format(t="STRING")).alias(c) for c, e in _RAW.items()]
    return table(spark, d, "customer").select(F.col("c_custkey").alias("row_no"), *made)


def _mapped(spark, d):
    return N.map_rows(_raw(spark, d), _MAPPINGS, ["name"], ["customer_id"], ["row_no"])


_DUCK_MAPPED = """
    WITH m AS (SELECT c_custkey AS row_no, CASE WHEN c_nationkey NOT IN (3, 4) THEN c_custkey END AS customer_id,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'MACHINERY' WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS name,
      CASE WHEN c_nationkey = 5 THEN NULL WHEN c_acctbal < 0 THEN -CAST(CAST(-trunc(-c_acctbal * 100) AS BIGINT) AS DOUBLE) * -1
        ELSE CAST(trunc(c_acctbal * 100) AS DOUBLE) + 0.5 END AS balance,
      CASE WHEN c_nationkey <> 6 THEN '2021-02-03' END AS since,
      CASE c_nationkey WHEN 8 THEN NULL WHEN 9 THEN false ELSE true END AS active, c_nationkey, c_mktsegment FROM customer)
"""
_RAW = {k: v.replace("CAST(-c_acctbal * 100 AS BIGINT)", "CAST(floor(-c_acctbal * 100) AS BIGINT)").replace("CAST(c_acctbal * 100 AS BIGINT)", "CAST(floor(c_acctbal * 100) AS BIGINT)") for k, v in _RAW.items()}
_DUCK_MAPPED = _DUCK_MAPPED.replace(
    "-CAST(CAST(-trunc(-c_acctbal * 100) AS BIGINT) AS DOUBLE) * -1", "-CAST(floor(-c_acctbal * 100) AS DOUBLE)"
).replace("trunc(c_acctbal * 100)", "floor(c_acctbal * 100)")


@query(
    "map_rows",
    _DUCK_MAPPED
    + "SELECT row_no, customer_id, name, balance, since, active, CAST((c_nationkey = 4)::INT + (c_nationkey IN (3, 4))::INT + (c_nationkey IN (5, 6, 8))::INT + (name IS NULL)::INT AS INTEGER) AS errors FROM m",
)
def map_rows(spark, d):
    return _mapped(spark, d).withColumns({"errors": F.size("errors"), "since": F.col("since").cast("string")})


@query(
    "map_row_errors",
    _DUCK_MAPPED
    + """
    SELECT row_no, 'customer_id' AS field, 'TYPE_COERCION_FAILED' AS code FROM m WHERE c_nationkey = 4
    UNION ALL SELECT row_no, 'customer_id', 'PRIMARY_KEY_MISSING' FROM m WHERE customer_id IS NULL
    UNION ALL SELECT row_no, 'name', 'REQUIRED_FIELD_MISSING' FROM m WHERE name IS NULL
    UNION ALL SELECT row_no, CASE c_nationkey WHEN 5 THEN 'balance' WHEN 6 THEN 'since' ELSE 'active' END, 'TYPE_COERCION_FAILED' FROM m WHERE c_nationkey IN (5, 6, 8)
    """,
)
def map_row_errors(spark, d):
    return N.error_rows(_mapped(spark, d), ["row_no"])


@query(
    "map_valid_rows",
    _DUCK_MAPPED + "SELECT customer_id, name FROM m WHERE customer_id IS NOT NULL AND name IS NOT NULL AND c_nationkey NOT IN (5, 6, 8)",
)
def map_valid_rows(spark, d):
    return N.valid_rows(_mapped(spark, d)).select("customer_id", "name")


@query(
    "row_keys",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'A' THEN 'target:' || l_orderkey || '|' || l_returnflag END AS row_key FROM lineitem
    """,
)
def row_keys(spark, d):
    items = table(spark, d, "lineitem").withColumn("flag", F.expr("CASE WHEN l_returnflag = 'A' THEN ' ' ELSE l_returnflag END"))
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.row_key(["l_orderkey", "flag"]).alias("row_key"))


@query(
    "instance_ids",
    """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE 'customer_' || substr(sha1(
      from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('objectify:load:1:target:' || c_custkey)), 1, 12) END AS instance_id FROM customer
    """,
)
def instance_ids(spark, d):
    customers = table(spark, d, "customer").withColumn("customer_id", F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END"))
    return N.instance_ids(customers, "Customer", N.row_key(["c_custkey"]), "load").select("c_custkey", "instance_id")


@query(
    "duplicate_rows",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS is_duplicate FROM events",
)
def duplicate_rows(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return N.duplicate_rows(events, ["user_id", "event_type"], "event_id").select("event_id", "is_duplicate")


@query(
    "relationship_refs",
    """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Customer/' || o_custkey WHEN 'O' THEN 'Customer/' || o_custkey END AS ref,
      CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderpriority < '3' THEN 'TARGET_MISMATCH' WHEN o_orderpriority < '4' THEN 'EMPTY' ELSE 'EMPTY_ID' END END AS error
    FROM orders
    """,
)
def relationship_refs(spark, d):
    raw = F.expr(
        "CASE o_orderstatus WHEN 'F' THEN concat(' ', o_custkey) WHEN 'O' THEN concat('Customer/', o_custkey) ELSE "
        "CASE WHEN o_orderpriority < '3' THEN concat('Person/', o_custkey) WHEN o_orderpriority < '4' THEN '  ' ELSE 'Customer/ ' END END"
    )
    return table(spark, d, "orders").select("o_orderkey", N.reference(raw, "Customer").alias("r")).select("o_orderkey", "r.*")


@query(
    "build_links",
    """
    SELECT DISTINCT l_orderkey AS src, l_partkey AS dst, 'contains' AS predicate, p_type = 'PROMO' AS dangling
    FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
)
def build_links(spark, d):
    parts = table(spark, d, "part").filter("p_type <> 'PROMO'")
    return N.build_links(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "contains", parts, "p_partkey", "WARN")


@query(
    "link_statistics",
    """
    WITH g AS (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS links, CAST(sum(n - 1) AS BIGINT) AS repeated,
      count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO')) AS dangling, count(DISTINCT l_orderkey) AS sources FROM g
    """,
)
def link_statistics(spark, d):
    parts = table(spark, d, "part").filter("p_type <> 'PROMO'")
    return N.link_statistics(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", parts, "p_partkey")


@query(
    "overlay_links",
    """
    SELECT DISTINCT o_custkey AS src, o_orderkey AS dst, 'placed' AS predicate FROM orders WHERE o_orderstatus IN ('F', 'O') AND NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')
    """,
)
def overlay_links(spark, d):
    orders = table(spark, d, "orders")
    shape = ["o_custkey AS src", "o_orderkey AS dst", "'placed' AS predicate"]
    edges = orders.filter("o_orderstatus = 'F'").selectExpr(*shape)
    edits = orders.selectExpr(
        *shape,
        "CASE WHEN o_orderstatus = 'O' THEN 'ADD' ELSE 'REMOVE' END AS edit",
        "o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_orderpriority = '5-LOW') AS active",
    )
    return N.overlay_links(edges, edits)


@query(
    "reverse_link_rows",
    "SELECT DISTINCT o_custkey AS c_custkey, 'Order/' || o_orderkey AS ref FROM orders "
    "WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_orderkey IS NOT NULL",
)
def reverse_link_rows(spark, d):
    return N.reverse_link_rows(
        table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_orderkey", "o_custkey", "Order"
    )


@query(
    "reverse_links",
    """
    SELECT o_custkey AS c_custkey, 0 AS chunk, string_agg(ref, ',' ORDER BY ref) AS refs
    FROM (SELECT o_custkey, 'Order/' || o_orderkey AS ref FROM orders) GROUP BY o_custkey
    """,
)
def reverse_links(spark, d):
    lists = N.reverse_links(
        table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_orderkey", "o_custkey", "Order"
    )
    return lists.withColumn("refs", F.concat_ws(",", "refs"))


# Commands: sign-ups create, errors delete, everything else updates; k and value are the data.
_KIND = "CASE event_type WHEN 'signup' THEN 'CREATE_INSTANCE' WHEN 'error' THEN 'DELETE_INSTANCE' ELSE 'UPDATE_INSTANCE' END"
_COMMANDS = f"""
    SELECT event_id, user_id, ts, {_KIND} AS kind, event_type AS author, event_id AS sequence,
      CASE WHEN event_type IN ('signup', 'view') THEN json_extract_string(props, '$.k') END AS k,
      CASE WHEN event_type IN ('click', 'purchase') THEN CAST(value AS VARCHAR) END AS amount FROM events
"""


def _commands(spark, d):
    payload = F.map_filter(
        F.create_map(
            F.lit("k"),
            F.expr("CASE WHEN event_type IN ('signup', 'view') THEN get_json_object(props, '$.k') END"),
            F.lit("amount"),
            F.expr("CASE WHEN event_type IN ('click', 'purchase') THEN CAST(value AS STRING) END"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return table(spark, d, "events").select(
        "event_id",
        "user_id",
        "ts",
        F.expr(_KIND).alias("kind"),
        F.col("event_type").alias("author"),
        F.col("event_id").alias("sequence"),
        payload.alias("payload"),
    )


def _replay_sql(where: str = "true") -> str:
    return f"""
    WITH c AS (SELECT * FROM ({_COMMANDS}) WHERE {where}), o AS (SELECT user_id, max(sequence) FILTER (kind = 'CREATE_INSTANCE') AS origin FROM c GROUP BY user_id),
    l AS (SELECT c.*, origin IS NULL OR sequence >= origin AS live FROM c JOIN o USING (user_id))
    SELECT user_id, count(*) FILTER (live) AS version, strftime(max(ts) FILTER (live AND kind = 'CREATE_INSTANCE'), '%Y-%m-%d %H:%M:%S') AS created_at,
      strftime(arg_max(ts, sequence) FILTER (live AND kind <> 'DELETE_INSTANCE'), '%Y-%m-%d %H:%M:%S') AS updated_at,
      coalesce(arg_max(kind = 'DELETE_INSTANCE', sequence) FILTER (live AND kind <> 'UPDATE_INSTANCE'), false) AS deleted,
      max(event_id) AS last_event_id, max(sequence) AS last_sequence, count(*) AS event_count,
      arg_max(k, sequence) FILTER (live AND k IS NOT NULL) AS k, arg_max(amount, sequence) FILTER (live AND amount IS NOT NULL) AS amount
    FROM l GROUP BY user_id
    """


def _replayed(commands):
    return E.replay(commands, "user_id", "kind", "sequence", "ts", "event_id", "payload", ["k", "amount"])


def _stamped(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


@query("replay_events", _replay_sql())
def replay_events(spark, d):
    return _stamped(_replayed(_commands(spark, d)), "created_at", "updated_at")


@query(
    "replay_fields",
    f"""WITH r AS ({_replay_sql()}) SELECT user_id, 'k' AS field, k AS value FROM r WHERE k IS NOT NULL
    UNION ALL SELECT user_id, 'amount', amount FROM r WHERE amount IS NOT NULL""",
)
def replay_fields(spark, d):
    return E.replay_fields(_commands(spark, d), "user_id", "kind", "sequence", "ts", "event_id", "payload")


@query(
    "replay_deletes",
    f"""WITH c AS ({_COMMANDS}), o AS (SELECT user_id, arg_max(event_id, event_id) AS event_id FROM c WHERE kind <> 'UPDATE_INSTANCE' GROUP BY user_id)
    SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS deleted_at, author AS deleted_by
    FROM o JOIN c USING (user_id, event_id) WHERE kind = 'DELETE_INSTANCE'""",
)
def replay_deletes(spark, d):
    return _stamped(E.replay_deletes(_commands(spark, d), "user_id", "kind", "sequence", "ts", "event_id", "author"), "deleted_at")


@query("replay_up_to_time", _replay_sql("ts <= TIMESTAMP '2024-01-12 00:00:00'"))
def replay_up_to_time(spark, d):
    until = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    return _stamped(_replayed(E.point_in_time(_commands(spark, d), "sequence", "ts", up_to_time=until)), "created_at", "updated_at")


@query("replay_up_to_sequence", _replay_sql("sequence <= 4000"))
def replay_up_to_sequence(spark, d):
    return _stamped(_replayed(E.point_in_time(_commands(spark, d), "sequence", "ts", 4000)), "created_at", "updated_at")


@query("event_history", "SELECT user_id, event_id, event_type AS author FROM events ORDER BY user_id, event_id")
def event_history(spark, d):
    return E.history(_commands(spark, d), "user_id", "sequence", "ts").select("user_id", "event_id", "author")


@query("replay_determinism", "SELECT user_id, true AS same FROM (SELECT DISTINCT user_id FROM events)")
def replay_determinism(spark, d):
    commands = _commands(spark, d)
    runs = [_replayed(commands), _replayed(commands.repartition(7, "event_id"))]
    differing = E.nondeterministic(runs, "user_id").withColumn("_bad", F.lit(True))
    users = commands.select("user_id").distinct()
    return users.join(differing, "user_id", "left").select("user_id", F.col("_bad").isNull().alias("same"))


@query(
    "replay_commands",
    f"""
    WITH c AS ({_COMMANDS}), o AS (SELECT user_id, coalesce(max(sequence) FILTER (kind = 'CREATE_INSTANCE'), min(sequence) FILTER (kind = 'DELETE_INSTANCE')) AS origin FROM c GROUP BY user_id),
    l AS (SELECT c.*, sequence >= origin AS live, sequence = origin AS born FROM c JOIN o USING (user_id) WHERE origin IS NOT NULL)
    SELECT user_id, max(author) FILTER (born AND kind = 'CREATE_INSTANCE') AS created_by, arg_max(author, sequence) FILTER (live AND kind = 'UPDATE_INSTANCE') AS updated_by,
      arg_max(event_id, sequence) FILTER (live AND kind = 'UPDATE_INSTANCE') AS updated_at, count(*) FILTER (live AND kind = 'DELETE_INSTANCE') > 0 AS deleted,
      arg_max(event_id, sequence) FILTER (live AND kind = 'DELETE_INSTANCE') AS deleted_at, count(*) FILTER (born AND kind = 'DELETE_INSTANCE') > 0 AS orphan_deletion,
      count(*) FILTER (live AND kind = 'UPDATE_INSTANCE') + 1 AS version, count(*) AS total_commands,
      arg_max(k, sequence) FILTER (live AND k IS NOT NULL) AS k FROM l GROUP BY user_id
    """,
)
def replay_commands(spark, d):
    states = E.command_replay(_commands(spark, d), "user_id", "kind", ["sequence"], "event_id", "author", "payload", ["k"])
    return states.drop("created_at", "deleted_by")


_EXPECTED = """
    WITH e AS (SELECT user_id, arg_max(event_id, event_id) AS latest_event_id, arg_max(event_type, event_id) AS latest_event_type FROM events GROUP BY user_id)
"""


@query("expected_projection", f"{_EXPECTED} SELECT *, latest_event_type <> 'error' AS should_exist FROM e")
def expected_projection(spark, d):
    return E.expected_projection(table(spark, d, "events"), ["user_id"], "event_type", "event_id", "ts", "event_id", "error")


@query(
    "projection_mismatches",
    f"""
    {_EXPECTED}, docs AS (SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN 'Person' WHEN c_nationkey < 12 THEN '' ELSE 'User' END AS class_id FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT * FROM (SELECT user_id, CASE WHEN latest_event_type <> 'error' AND c_custkey IS NULL THEN 'missing_document'
      WHEN latest_event_type <> 'error' AND class_id NOT IN ('', 'User') THEN 'class_id_mismatch'
      WHEN latest_event_type = 'error' AND c_custkey IS NOT NULL THEN 'deleted_document_present' END AS reason
      FROM e LEFT JOIN docs ON user_id = c_custkey) WHERE reason IS NOT NULL
    """,
)
def projection_mismatches(spark, d):
    events = table(spark, d, "events").withColumn("class", F.lit("User"))
    expected = E.expected_projection(events, ["user_id", "class"], "event_type", "event_id", "ts", "event_id", "error")
    documents = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").selectExpr(
        "c_custkey", "CASE WHEN c_nationkey < 8 THEN 'Person' WHEN c_nationkey < 12 THEN '' ELSE 'User' END AS class_id"
    )
    return E.projection_mismatches(expected, documents, "user_id", "c_custkey", {"class_id_mismatch": ("class", "class_id")})


@query(
    "migrate_events",
    """
    SELECT event_id, 3 AS schema_version, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE event_id END AS sequence_number,
      CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS aggregate_id FROM events
    """,
)
def migrate_events(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id",
        "CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'error' THEN 3 ELSE 2 END AS schema_version",
        "CASE WHEN event_type NOT IN ('view', 'click') THEN event_id END AS sequence_number",
        "CAST(user_id AS STRING) AS instance_id",
    )
    steps = [
        (1, 2, {"sequence_number": "coalesce(sequence_number, 0L)"}),
        (2, 3, {"aggregate_id": "instance_id"}),
    ]
    return E.migrate(rows, "schema_version", steps).drop("instance_id")


@query(
    "audit_chain",
    r"""
    WITH c AS (SELECT conv_id, turn, text AS body, CASE WHEN turn > 0 THEN sha256('seed' || conv_id || '-' || (turn - 1)) END AS prev FROM conversations),
    h AS (SELECT *, sha256(coalesce(prev, '') || chr(10) || CASE WHEN length(body) > 400 THEN 'changed' ELSE body END) AS digest FROM c),
    l AS (SELECT *, lag(digest) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM h)
    SELECT * FROM (SELECT conv_id, turn, CASE WHEN length(body) > 400 THEN 'hash' WHEN prev IS DISTINCT FROM before THEN 'link' END AS reason FROM l) WHERE reason IS NOT NULL
    """,
)
def audit_chain(spark, d):
    log = table(spark, d, "conversations").selectExpr(
        "conv_id",
        "turn",
        "text AS body",
        "CASE WHEN turn > 0 THEN sha2(concat('seed', conv_id, '-', turn - 1), 256) END AS prev",
    )
    signed = log.withColumn(
        "digest", E.entry_hash(F.col("prev"), F.when(F.length("body") > 400, F.lit("changed")).otherwise(F.col("body")))
    )
    return E.broken_chain(signed, "conv_id", "turn", "body", "prev", "digest")


# Patches: every order is a patch on its customer; its key is the sequence.
def _patches(spark, d):
    patch = F.struct(
        F.expr("CASE WHEN o_orderstatus <> 'P' THEN map('segment', o_orderpriority, 'balance', CAST(o_totalprice AS STRING)) END").alias("set"),
        F.expr("CASE WHEN o_orderstatus = 'O' THEN array('balance') END").alias("unset"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN array(named_struct('field', 'orders', 'value', o_orderstatus)) END").alias("link_add"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN array(named_struct('field', 'orders', 'value', 'F')) END").alias("link_remove"),
        F.expr("o_totalprice > 495000").alias("delete"),
    )
    return table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("seq"), patch.cast(B.PATCH).alias("patch"))


def _base(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", "c_mktsegment AS segment", "CAST(c_acctbal AS STRING) AS balance")


def _merge_sql(above: int) -> str:
    return f"""
    WITH p AS (SELECT *, o_totalprice > 495000 AS del FROM orders WHERE o_orderkey > {above}),
    h AS (SELECT o_custkey, max(o_orderkey) AS last, min(o_orderkey) FILTER (del) AS gone,
      arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus <> 'P') AS segment,
      arg_max(CASE WHEN o_orderstatus = 'O' THEN '-' ELSE CAST(o_totalprice AS VARCHAR) END, o_orderkey) FILTER (o_orderstatus <> 'P') AS balance FROM p GROUP BY o_custkey)
    SELECT c_custkey, CASE WHEN gone IS NULL THEN coalesce(segment, c_mktsegment) END AS segment,
      CASE WHEN gone IS NULL THEN nullif(coalesce(balance, CAST(c_acctbal AS VARCHAR)), '-') END AS balance,
      gone IS NOT NULL AS tombstone, coalesce(gone, last) AS last_sequence FROM customer LEFT JOIN h ON c_custkey = o_custkey
    """


@query("writeback_merge", _merge_sql(-1))
def writeback_merge(spark, d):
    return B.merge(_base(spark, d), _patches(spark, d), "c_custkey", "seq", "patch", ["segment", "balance"])


@query("writeback_merge_above", _merge_sql(9000))
def writeback_merge_above(spark, d):
    return B.merge(_base(spark, d), _patches(spark, d), "c_custkey", "seq", "patch", ["segment", "balance"], above=9000)


@query("writeback_snapshot", _merge_sql(-1).replace("LEFT JOIN h", "JOIN h"))
def writeback_snapshot(spark, d):
    path = new_path(spark, "patch-snapshot")
    return B.snapshot(_base(spark, d), _patches(spark, d), "c_custkey", "seq", "patch", ["segment", "balance"], path)


@query(
    "writeback_high_watermark",
    """
    SELECT greatest(0, least(max(o_orderkey), min(o_orderkey) FILTER (NOT known) - 1, max(o_orderkey) FILTER (known))) AS high_watermark
    FROM (SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > -990) AS known FROM orders)
    """,
)
def writeback_high_watermark(spark, d):
    base = table(spark, d, "customer").filter("c_acctbal > -990").select("c_custkey")
    return B.high_watermark(base, _patches(spark, d), "c_custkey", "seq")


@query(
    "patch_apply",
    """
    SELECT o_orderkey, CASE WHEN o_totalprice > 495000 OR o_orderstatus = 'P' THEN c_mktsegment ELSE o_orderpriority END AS segment,
      CASE WHEN o_totalprice > 495000 OR o_orderstatus = 'P' THEN CAST(c_acctbal AS VARCHAR) WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS VARCHAR) END AS balance,
      CASE WHEN o_totalprice > 495000 THEN 'F,X' WHEN o_orderstatus = 'P' THEN 'X' ELSE 'F,X' END AS links, o_totalprice > 495000 AS tombstone
    FROM orders JOIN customer ON o_custkey = c_custkey
    """,
)
def patch_apply(spark, d):
    base = table(spark, d, "customer").selectExpr(
        "c_custkey",
        "map('segment', c_mktsegment, 'balance', CAST(c_acctbal AS STRING)) AS data",
        "map('orders', array('F', 'X')) AS links",
    )
    patched = B.apply_patch(base.join(_patches(spark, d), "c_custkey"), "patch")
    return patched.select(
        F.col("seq").alias("o_orderkey"),
        F.try_element_at("data", F.lit("segment")).alias("segment"),
        F.try_element_at("data", F.lit("balance")).alias("balance"),
        F.concat_ws(",", F.sort_array(F.try_element_at("links", F.lit("orders")))).alias("links"),
        "tombstone",
    )


@query(
    "writeback_link_edits",
    """
    SELECT o_custkey AS c_custkey, 'orders' AS field, 'F' AS target, arg_max(o_orderstatus = 'F', o_orderkey) AS present
    FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_custkey
    """,
)
def writeback_link_edits(spark, d):
    return B.last_link_edits(_patches(spark, d), "c_custkey", "seq", "patch")


@query(
    "writeback_conflicts",
    """
    SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 300000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END) AS fields,
      CASE WHEN o_orderstatus = 'F' THEN 'BASE_REMOVED_PATCH_ADDS' WHEN o_orderstatus = 'P' THEN 'BASE_ADDED_PATCH_REMOVES' ELSE '' END AS links,
      CASE WHEN o_orderstatus = 'O' AND o_totalprice <= 300000 THEN 'APPLIED' WHEN o_orderpriority < '3' THEN 'APPLIED' WHEN o_orderpriority < '4' THEN 'SKIPPED' ELSE 'REJECTED' END AS resolution
    FROM orders
    """,
)
def writeback_conflicts(spark, d):
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "map('price', CAST(o_totalprice AS STRING), 'status', o_orderstatus) AS seen",
        "map_filter(map('price', CAST(least(o_totalprice, 300000D) AS STRING), 'status', nullif(o_orderstatus, 'P')), (k, v) -> v IS NOT NULL) AS now",
        "map('l', CASE WHEN o_orderstatus = 'F' THEN array('a') ELSE array('b') END) AS seen_links",
        "map('l', CASE WHEN o_orderstatus = 'P' THEN array('a', 'b') ELSE array('b') END) AS now_links",
        "named_struct('link_add', CASE WHEN o_orderstatus <> 'P' THEN array(named_struct('field', 'l', 'value', 'a')) END, "
        "'link_remove', CASE WHEN o_orderstatus = 'P' THEN array(named_struct('field', 'l', 'value', 'a')) END) AS patch",
        "CASE WHEN o_orderpriority < '3' THEN 'WRITEBACK_WINS' WHEN o_orderpriority < '4' THEN 'BASE_WINS' ELSE 'FAIL' END AS policy",
    )
    found = rows.select(
        "o_orderkey",
        "policy",
        B.conflicting_fields(F.col("seen"), F.col("now")).alias("fields"),
        B.conflicting_links(F.col("seen_links"), F.col("now_links"), F.col("patch")).alias("links"),
    )
    any_conflict = (F.size("fields") > 0) | (F.size("links") > 0)
    return found.select(
        "o_orderkey",
        F.concat_ws(",", "fields").alias("fields"),
        F.concat_ws(",", "links.direction").alias("links"),
        B.resolution(F.col("policy"), any_conflict).alias("resolution"),
    )
