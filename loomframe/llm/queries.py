"""One query per operator over its whole table, beside the SQL that must give the same rows.

Queries without SQL are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import align, chat, cross_entropy, line_blocks, merkle, minmax_dedup, mixing, packing, quality_rules, string_tiling, token_counts, toxicity, url_lists
from loomframe.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"
MIX_SHARE, MIX_EPOCHS, MIX_SEED, MIX_CYCLE = 1.5, 2, 17, (5.0, 2.0, 1.0)
TOKEN_LIMIT = 1024
END_ID = 2
TOXIC_FROM = 0.3


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir.rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- 1: URL filters. Fetch days and list entries are drawn from the pages by hash.

_BYTE = "CAST(conv(substr(md5({0}), 1, 2), 16, 10) AS int)"
_ADDED = "date_add(DATE'2024-01-01', CAST({0} * 5 % 300 AS int))"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the day they were fetched."""
    day = F.expr("date_add(DATE'2024-01-01', CAST(conv(substr(md5(concat('day', coalesce(url, ''))), 1, 3), 16, 10) AS int) % 366)")
    return read(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))


def list_entries(rows: DataFrame) -> DataFrame:
    """Dated entries for a share of the hosts and pages: added, for some removed again, for some added once more."""
    named = rows.select(url_lists.host_of(F.col("url")).alias("h"), url_lists.page_of(F.col("url")).alias("p"))
    hosts = named.select("h").where("h IS NOT NULL").distinct().withColumn("b", F.expr(_BYTE.format("h"))).where("b < 96")
    pages = named.select("p").where("p IS NOT NULL").distinct().withColumn("b", F.expr(_BYTE.format("p"))).where("b < 16")
    kind = F.expr("CASE WHEN b % 4 = 0 THEN 'host' ELSE 'domain' END")
    named_list = F.expr("CASE b % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' ELSE 'spam' END")
    listed = hosts.select(named_list.alias("list"), kind.alias("kind"), F.col("h").alias("value"), "b").unionByName(
        pages.select(F.lit("pages").alias("list"), F.lit("url").alias("kind"), F.col("p").alias("value"), "b")
    )
    day = F.expr(_ADDED.format("b"))
    first = listed.select("list", "kind", "value", F.lit("add").alias("action"), day.alias("day"))
    gone = listed.where("b % 2 = 0").select("list", "kind", "value", F.lit("remove").alias("action"), F.date_add(day, 40).alias("day"))
    back = listed.where("b % 4 = 0").select("list", "kind", "value", F.lit("add").alias("action"), F.date_add(day, 90).alias("day"))
    return first.unionByName(gone).unionByName(back)


_HOST_SQL = (
    "lower(regexp_replace(rtrim(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#\\\\]*)', 1), "
    "'^.*@', ''), ':[0-9]*$', '')), '\\.$', ''))"
)
_URL_SQL = f"""
WITH r AS (SELECT page_id, url, {_HOST_SQL} AS h,
  {_HOST_SQL} || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#\\\\]*([^?#]*)', 1), '/+$', '') AS p,
  DATE '2024-01-01' + (('0x' || substr(md5('day' || coalesce(url, '')), 1, 3))::INT % 366) AS fetched FROM pages),
k AS (SELECT DISTINCT CASE WHEN b % 4 = 0 THEN 'host' ELSE 'domain' END AS kind, h AS v, b,
  CASE b % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' ELSE 'spam' END AS list
  FROM (SELECT h, ('0x' || substr(md5(h), 1, 2))::INT AS b FROM r WHERE h <> '') WHERE b < 96
  UNION ALL SELECT DISTINCT 'url', p, b, 'pages' FROM (SELECT p, ('0x' || substr(md5(p), 1, 2))::INT AS b FROM r WHERE h <> '') WHERE b < 16),
d AS (SELECT *, DATE '2024-01-01' + (b * 5 % 300) AS d0 FROM k),
s AS (SELECT kind, v, list, d0 AS a, CASE WHEN b % 2 = 0 THEN d0 + 40 END AS z FROM d
  UNION ALL SELECT kind, v, list, d0 + 90, NULL FROM d WHERE b % 4 = 0),
m AS (SELECT DISTINCT r.url, r.fetched, s.list FROM r JOIN s ON (s.kind = 'host' AND s.v = r.h
    OR s.kind = 'domain' AND (r.h = s.v OR ends_with(r.h, '.' || s.v)) OR s.kind = 'url' AND s.v = r.p)
  AND r.fetched >= s.a AND (s.z IS NULL OR r.fetched < s.z)),
n AS (SELECT url, fetched, string_agg(list, ' ' ORDER BY list) AS lists FROM m GROUP BY ALL)
SELECT r.page_id, r.url, CAST(r.fetched AS DATE) AS fetched, coalesce(n.lists, '') AS lists, n.lists IS NOT NULL AS rejected
FROM r LEFT JOIN n ON n.url = r.url AND n.fetched = r.fetched"""


@query("op1_url_filters", _URL_SQL)
def op1_url_filters(spark, d):
    rows = captures(spark, d)
    judged = url_lists.filter_urls(rows, list_entries(rows), "url", "fetched")
    return judged.select("page_id", "url", "fetched", F.array_join("lists", " ").alias("lists"), "rejected")


# --- 2: quality rules


@query("op2_quality_rules")
def op2_quality_rules(spark, d):
    judged = quality_rules.judge(read(spark, d, "documents").select("doc_id", "text"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*columns, F.array_join("broken_rules", " ").alias("broken_rules"))


# --- 3: LM scoring; the target is what labels call good


@query("op3_cross_entropy")
def op3_cross_entropy(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    targets = cross_entropy.target_ids(read(spark, d, "labels"))
    return cross_entropy.difference(docs, targets, columns=["doc_id"])


# --- 4: HTML extraction


@query("op4_html_extraction")
def op4_html_extraction(spark, d):
    return line_blocks.extract(read(spark, d, "pages")).select("page_id", "url", "text", "n_chars")


# --- 5: near duplicates


@query("op5_minmax_dedup")
def op5_minmax_dedup(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    return minmax_dedup.near_duplicates(docs, shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


# --- 6: benchmark decontamination: every pair of a document and an item that it leaks


@query("op6_string_tiling")
def op6_string_tiling(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    return string_tiling.contaminated(docs, read(spark, d, "benchmark").select("item_id", "text"))


# --- 7: toxicity


@query("op7_toxicity")
def op7_toxicity(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, d, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model, TOXIC_FROM)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


# --- 8: mixing

_MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  ('0x' || substr(md5('{MIX_SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
g AS (SELECT *, ({MIX_SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
t AS (SELECT source, source_size, least(cap, w * (SELECT max(rate) FROM g)) AS target FROM g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
f AS (SELECT d.doc_id, d.size, d.u, e.*, target - whole * source_size AS extra,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY u, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN extra > 0 AND (upto < extra OR
  (upto - size < extra AND upto - extra <= extra - (upto - size))) THEN 1 ELSE 0 END))::BIGINT AS taken FROM f"""


@query("op8_mixing", _MIX_SQL)
def op8_mixing(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "text")
    weights = mixing.cycled_weights(docs, MIX_CYCLE)
    mixed = mixing.take(docs, weights, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


# --- 9: token counts


@query("op9_token_counts")
def op9_token_counts(spark, d):
    import public_tokenizers

    docs = read(spark, d, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


# --- 10: chat formatting


def chat_records(turns: DataFrame) -> DataFrame:
    """Every turn as a JSON record in one of the layouts that its role allows, dealt by hash."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    person = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    deal = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    known = role.isin("user", "assistant", "system")
    # Records are written by one function of Spark; a text of any length passes through whole.
    record = (
        F.when(known & (deal == 1), F.to_json(F.struct(F.array(F.struct(person.alias("from"), text.alias("value"))).alias("conversations"))))
        .when(
            known & (deal == 2),
            F.to_json(F.struct(F.struct(F.array(F.struct(role.alias("speaker"), text.alias("text"))).alias("turns")).alias("dialog"))),
        )
        .when((role == "user") & (deal == 3), F.to_json(F.struct(text.alias("prompt"))))
        .when((role == "assistant") & (deal == 3), F.to_json(F.struct(text.alias("completion"))))
        .when((role == "system") & (deal == 3), F.to_json(F.struct(text.alias("system"))))
        .otherwise(F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"))))
    )
    return turns.select("conv_id", "turn", record.alias("record"))


@query("op10_chat_formatting")
def op10_chat_formatting(spark, d):
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id bigint, turn bigint, role string, text string")
    turns = read(spark, d, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    canonical = chat.canonical_turns(chat_records(turns.unionByName(extra)), "record")
    return chat.digests(chat.format_turns(canonical), ["turn", "part", "role", "text"])


# --- 11: Merkle manifest. DuckDB has no crc32, so the SQL works it out bit by bit.

_FIELD_SQL = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(({0})::VARCHAR)) || ':' || ({0})::VARCHAR END"
_LOWER_SQL = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
_LEAF_SQL = "sha256(" + " || ".join(map(_FIELD_SQL.format, ("doc_id", "source", "lang", "n_chars", "{0}"))) + ")"
_CRC_SQL = """xor(4294967295::UBIGINT, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT),
  lambda c, b: list_reduce([0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)), xor(c, b)),
  4294967295::UBIGINT))"""
_MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF_SQL.format('text')} AS leaf,
    CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_LEAF_SQL.replace('{0}', _LOWER_SQL)} ELSE {_LEAF_SQL.format('text')} END AS now FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM d)),
l AS (SELECT d.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
  count(*) OVER (PARTITION BY tree) AS n FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
low AS (SELECT tree, 0 AS level, place, n, leaf AS hash FROM l
  UNION ALL SELECT tree, level + 1, place // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY place)) FROM low WHERE n > 1
  GROUP BY tree, level, n, place // 8),
subs AS (SELECT tree, hash FROM low WHERE n = 1),
top AS (SELECT -1 AS tree, 0 AS level, tree AS place, (SELECT count(*) FROM g) AS n, hash FROM subs
  UNION ALL SELECT tree, level + 1, place // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY place)) FROM top WHERE n > 1
  GROUP BY tree, level, n, place // 8),
nodes AS (SELECT * FROM low WHERE n > 1 UNION ALL SELECT * FROM top WHERE n > 1),
climb AS (SELECT row_number() OVER () AS row, doc_id, leaf, tree AS own, tree, 0 AS level, place, n, now AS folded, '' AS proof FROM l
  UNION ALL SELECT * FROM (
    SELECT c.row, any_value(c.doc_id), any_value(c.leaf), c.own, c.tree, c.level + 1, c.place // 8, (c.n + 7) // 8,
      sha256(string_agg(CASE WHEN s.place = c.place THEN c.folded ELSE s.hash END, '' ORDER BY s.place)),
      any_value(c.proof) || coalesce(string_agg(s.hash, '' ORDER BY s.place) FILTER (s.place <> c.place), '')
    FROM climb c JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.place // 8 = c.place // 8 WHERE c.n > 1
    GROUP BY c.row, c.own, c.tree, c.level, c.place, c.n
    UNION ALL SELECT row, doc_id, leaf, own, -1, 0, tree, (SELECT count(*) FROM g), folded, proof FROM climb WHERE n = 1 AND tree >= 0))
SELECT c.doc_id, c.leaf, s.hash AS subroot, r.hash AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.hash AS verified
FROM climb c JOIN subs s ON s.tree = c.own JOIN (SELECT hash FROM top WHERE n = 1) r ON TRUE WHERE c.tree = -1 AND c.n = 1"""


@query("op11_merkle", _MERKLE_SQL)
def op11_merkle(spark, d):
    return merkle.manifest(read(spark, d, "documents"))


# --- 12: alignment of two tokenizers


@query("op12_align")
def op12_align(spark, d):
    import public_tokenizers

    pair = align.prepare(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align.scored(align.align(read(spark, d, "documents").select("doc_id", "text"), pair))


# --- 13: packing


@query("op13_packing")
def op13_packing(spark, d):
    import public_tokenizers

    return packing.pack(read(spark, d, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), END_ID, TOKEN_LIMIT)
