"""Near duplicates by min-max hashing.

Each permutation is evaluated once and gives two signature values, the least and the greatest; both
are unbiased, so half the evaluations fill the same bands. Texts with equal shingle sets are one
class from the start, so copies are never compared.

Classes that share a band are candidates. Links are confirmed on the full shingle sets:

1. in every band bucket the least class is the centre; each class is confirmed against its least
   centre, which joins most of a group at once;
2. remaining centre pairs that lie in different components are confirmed;
3. buckets that still span components are compared in blocks of bounded size, each class outside
   the largest component against all others on full sets; a block gives only links that join
   components, so nothing grows with the square of a bucket.

Centre pairs whose 8-bit sketches lie more than five deviations below the threshold are not
confirmed in steps 1 and 2, nor pairs already in one component, which cannot change it.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. A text with fewer words than a shingle is
one shingle; without words, or missing, it has none and is linked with nothing. A missing id does
not take part in the least id. Repeated rows share a class; the rows of an id that is kept are all
kept by ``near_duplicates`` and one of them remains after ``drop_near_duplicates``, which also keeps
one row of a group without ids. Extra columns are kept. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.components import components
from loomframe.llm.words import blank_separated, hash_words, map_arrow, mixed, windows
from loomframe.session import materialize

ROWS, BANDS = 6, 30  # a pair at 0.8 shares no band with probability 1e-4, at 0.85 with 1e-6
PERMUTATIONS = ROWS * BANDS // 2
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20  # classes and shingles of a bucket that are held against as many others at once
SEED = 20_240_607
TABLE = blank_separated(lower=True)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
    return factors[:, None], rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)[:, None]


_FACTORS, _SHIFTS = _permutations()
_MIX = np.random.default_rng(SEED + 1).integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation, as 2 * PERMUTATIONS numbers."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        values = short[None, at : at + 2048] * _FACTORS
        values += _SHIFTS
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    number = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed((mixed(parts) * _MIX).sum(axis=2, dtype=np.uint64) + number).view(np.int64)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = hash_words(texts, TABLE)
    return [np.unique(windows(words[at[i] : at[i + 1]], n)) for i in range(len(texts))]


def _class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


_SIGNED = "doc_id bigint, row_key bigint, n_shingles bigint, class binary, bands array<bigint>, sketch binary"


def signed(docs: DataFrame, n: int) -> DataFrame:
    """Per row: shingle count, class (hash of the full shingle set), band keys and sketch; nulls without words."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(2), n)
        marks = [signature(s) if len(s) else np.zeros(2 * PERMUTATIONS, np.uint32) for s in sets]
        matrix = np.array(marks, np.uint32).reshape(len(sets), 2 * PERMUTATIONS)
        keys = band_keys(matrix)
        sketches = ((matrix * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)
        full = [len(s) > 0 for s in sets]
        columns = [
            batch.column(0),
            batch.column(1),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([_class_of(s) if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
            pa.array([k if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())),
            pa.array([s.tobytes() if f else None for s, f in zip(sketches, full, strict=True)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "n_shingles", "class", "bands", "sketch"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "row_key", "text"), step, _SIGNED)


def _agreeing(threshold: float) -> int:
    """Sketch places that a pair at the threshold has in common, less five deviations."""
    places = 2 * PERMUTATIONS
    return int(places * threshold - 5 * (places * threshold * (1 - threshold)) ** 0.5)


def _similar(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sketches allow the threshold."""
    one = sketches.select(F.col("class").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    two = sketches.select(F.col("class").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    least = _agreeing(threshold)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).sum(axis=1) >= least)], names=["a", "b", "ok"])

    sized = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")
    both = pairs.join(one, "a").join(two, "b").filter(sized).select("a", "b", "sa", "sb")
    return map_arrow(both, step, "a binary, b binary, ok boolean").filter("ok").select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity. Each side's text comes by a join, so a hot centre is split."""
    one = texts.select(F.col("class").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("class").alias("b"), F.col("text").alias("tb"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(shingle_sets(batch.column(2), n), shingle_sets(batch.column(3), n), strict=True):
            common = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * common >= percent * (len(x) + len(y) - common))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return map_arrow(both, step, "a binary, b binary, ok boolean").filter("ok").select("a", "b")


def _labelled(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    of = labels.select(F.col("node").alias(column), F.col("component").alias("_c"))
    return df.join(of, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    both = _labelled(_labelled(pairs, labels, "a", "ca"), labels, "b", "cb")
    return both.filter("ca != cb").select("a", "b")


def _links_within(sets: list[np.ndarray], parts: np.ndarray, own: np.ndarray, crossing: bool, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join components of a block; at most one fewer than it has components.

    Every class outside the largest component is held against all classes of other components, on
    full sets: its shingles are marked, and marks are counted for all others in one pass.
    """
    size = np.array([len(s) for s in sets])
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum(size)[:-1]])
    number = np.unique(parts, return_inverse=True)[1]
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(number != np.bincount(number).argmax()):
        mark = np.zeros(len(every), np.int64)
        mark[place[begins[i] : begins[i] + size[i]]] = 1
        common = np.add.reduceat(mark[place], begins)
        near = (100 * common >= percent * (size + size[i] - common)) & (number != number[i])
        if crossing:
            near &= own != own[i]
        for j in np.flatnonzero(near):
            if number[j] != number[i]:
                found.append((i, j))
                number[number == number[j]] = number[i]
    return found


def _block_links(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links across components within a bucket, in blocks of bounded rows and shingles: (key, class, component, n_shingles)."""
    heavy = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    sizes = members.groupBy("key").agg(heavy.alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", others).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids, own = group["class"].to_numpy(), group["own"].to_numpy()
        sets = shingle_sets(pa.array(group["text"], pa.string()), n)
        crossing = group["low"].iat[0] != group["high"].iat[0]
        links = _links_within(sets, group["component"].to_numpy(), own, crossing, percent)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in links], columns=["a", "b"])

    columns = ["key", "low", "high", "own", "class", "component", "text"]
    pairs = dealt.join(texts, "class").select(*columns).groupBy("key", "low", "high").applyInPandas(compare, "a binary, b binary")
    return pairs.distinct()


def classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, row_key, n_shingles, class, component) for every row of (doc_id, row_key, text)."""
    threshold = percent / 100
    rows = materialize(signed(docs, shingle), "dedup-rows")
    nodes = rows.filter("class IS NOT NULL").groupBy("class").agg(
        F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    nodes = materialize(nodes, "dedup-classes")
    placed = nodes.select("class", F.explode("bands").alias("key"))
    heads = placed.groupBy("key").agg(F.min("class").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(placed.join(heads, "key").select("key", "class", "centre", "n"), "dedup-buckets")
    near = nodes.join(members.select("class").distinct(), "class", "left_semi").select("class", "row_key", "n_shingles", "sketch")
    near = materialize(near, "dedup-near")
    stars = members.filter("class != centre").select(F.col("class").alias("a"), F.col("centre").alias("b")).distinct()
    stars = materialize(_similar(stars, near, threshold), "dedup-stars")

    # Whole texts of the classes that have a candidate, one row each.
    wanted = near.select("class", "row_key")
    found = docs.join(wanted, "row_key").select("class", "text")
    texts = materialize(found.groupBy("class").agg(F.first("text").alias("text")), "dedup-texts")

    first = stars.groupBy("a").agg(F.min("b").alias("b"))
    links = materialize(_confirmed(first, texts, shingle, percent), "dedup-links")
    labels = components(links)
    more = materialize(_confirmed(_across(stars.join(first, ["a", "b"], "left_anti"), labels), texts, shingle, percent), "dedup-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)

    # Buckets of three and more that still span components hold pairs that no centre has seen.
    spread = _labelled(members.filter("n > 2").select("key", "class"), labels, "class", "component")
    mixed_up = spread.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("key")
    open_members = spread.join(mixed_up, "key", "left_semi").join(near.select("class", "n_shingles"), "class")
    last = materialize(_block_links(open_members, texts, shingle, percent), "dedup-links")
    if not last.isEmpty():
        labels = components(links.unionByName(last))
    return _labelled(rows.select("doc_id", "row_key", "n_shingles", "class"), labels, "class", "component")


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with ``row_key``: equal for rows with equal id and text only, but for chance."""
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable), kept (it is the least) and row_key, keeper.

    ``keeper`` marks the one text of a component that stays: that of the least id, then row key.
    """
    found = materialize(classes(_keyed(docs.select("doc_id", "text")), shingle, percent), "dedup-classes")
    # Least rows by class first, so the rows of a hot class shrink before they meet.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    by_class = found.filter("class IS NOT NULL").groupBy("class", "component").agg(F.min(place).alias("least"))
    by_component = by_class.groupBy("component").agg(F.min("least").alias("least"))
    of_class = by_class.select("class", "component").join(by_component, "component").select("class", "least")
    out = found.join(of_class, "class", "left").withColumns({
        "component_id": F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")),
        "keeper": F.col("class").isNull() | (F.col("row_key") == F.col("least.row_key")),
    })
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept, "row_key", "keeper")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, one of each group: the row with the least id, once. Columns as given."""
    keepers = near_duplicates(docs, shingle, percent).filter("keeper").select(F.col("row_key").alias("_row_key")).distinct()
    rows = docs.withColumn("_row_key", F.xxhash64("doc_id", "text")).join(keepers, "_row_key", "left_semi")
    return rows.dropDuplicates(["_row_key"]).select(*docs.columns)
