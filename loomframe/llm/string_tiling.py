"""Benchmark decontamination by greedy string tiling.

Windows of MIN_MATCH words of the benchmark are seeds. A document's windows that pass a bit filter
of all seeds are joined with them exactly; pairs of a document and an item that share enough seeds
to reach the coverage are tiled: the longest common stretches of unmarked words are found by
running Karp-Rabin hashes over shrinking lengths, marked, and the share of the item's words under
tiles decides. Order does not matter, so reordered passages are caught.

Words are runs of letters, digits and bytes beyond ASCII, in lower case, so punctuation and line
breaks do not hide a passage. Missing or empty texts match nothing. An item of fewer than MIN_MATCH
words is one seed as a whole; a few words inside a longer text are chance, so it is found in
texts that consist of the same words. Texts of any length are searched whole. Equal texts get equal verdicts: a text is tiled once, however
many rows repeat it. Among stretches of equal length the first in the item, then in the text, is
marked. Extra columns are kept; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.bits import bit_filter
from loomframe.llm.words import hash_words, letters_and_digits, map_arrow, windows
from loomframe.session import materialize

MIN_MATCH = 5  # words of a tile at least
COVERAGE = 0.5  # of an item's words under tiles
START = 20  # words of the first search length
TABLE = letters_and_digits()


def _stretches(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal common stretches of at least ``size`` unmarked words: (length, item place, text place)."""

    def places(words: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(words) < size:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        run = np.concatenate([[0], np.cumsum(free)])
        at = np.flatnonzero(run[size:] - run[:-size] == size)
        return windows(words, size)[at], at

    item_hash, item_at = places(item, free_item)
    text_hash, text_at = places(text, free_text)
    of: dict[int, list[int]] = {}
    for h, p in zip(item_hash.tolist(), item_at.tolist(), strict=True):
        of.setdefault(h, []).append(p)
    hit = np.isin(text_hash, item_hash)
    found = []
    for h, t in zip(text_hash[hit].tolist(), text_at[hit].tolist(), strict=True):
        for p in of[h]:
            if p and t and free_item[p - 1] and free_text[t - 1] and item[p - 1] == text[t - 1]:
                continue  # inside a stretch that began earlier
            n = 0
            while p + n < len(item) and t + n < len(text) and free_item[p + n] and free_text[t + n] and item[p + n] == text[t + n]:
                n += 1
            if n >= size:
                found.append((n, p, t))
    return found


def tile(item: np.ndarray, text: np.ndarray, least: int = MIN_MATCH, start: int = START) -> list[tuple[int, int, int]]:
    """Tiles (length, item place, text place): greedy, longest first, none shorter than ``least`` words."""
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles, size = [], max(least, start)
    while True:
        found = sorted(_stretches(item, text, free_item, free_text, size), key=lambda m: (-m[0], m[1], m[2]))
        if found and found[0][0] > 2 * size:
            size = found[0][0]  # a very long one: search at its length first
            continue
        cut = False
        for n, p, t in found:
            if free_item[p : p + n].all() and free_text[t : t + n].all():
                tiles.append((n, p, t))
                free_item[p : p + n] = free_text[t : t + n] = False
            else:
                cut = True  # what is left of it may still be long enough
        if cut:
            continue
        if size == least:
            return tiles
        size = max(least, size // 2)


def _seeds(items: DataFrame) -> DataFrame:
    """(seed, item_id) of every item, each once per item."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, at = hash_words(batch.column(1), TABLE)
        ids, seeds = [], [np.empty(0, np.uint64)]
        for i in range(batch.num_rows):
            own = words[at[i] : at[i + 1]]
            found = np.unique(windows(own, MIN_MATCH))
            ids += [i] * len(found)
            seeds.append(found)
        taken = batch.column(0).take(pa.array(ids, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds).view(np.int64)), taken], names=["seed", "item_id"])

    return map_arrow(items.select(F.col("item_id").cast("bigint"), "text"), step, "seed bigint, item_id bigint")


def text_key(text: str = "text") -> Column:
    """Key of a text; missing for a missing one."""
    return F.md5(F.col(text))


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(text_key, item_id, item_words, tiles, covered, coverage) of texts that hold at least ``coverage`` of an item."""
    spark = docs.sparkSession
    seeds = materialize(_seeds(items), "leak-seeds")
    passing = spark.sparkContext.broadcast(bit_filter(seeds, "seed"))  # bounded by its MOST bits

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, at = hash_words(batch.column(0), TABLE)
        all_windows = windows(words, MIN_MATCH) if len(words) >= MIN_MATCH else words[:0]
        spots = np.flatnonzero(passing.value.holds(all_windows))
        first, last = np.searchsorted(spots, at[:-1]), np.searchsorted(spots, np.maximum(at[1:] - MIN_MATCH + 1, at[:-1]))
        rows = np.flatnonzero(last > first).tolist()
        found = [np.unique(all_windows[spots[first[i] : last[i]]]).view(np.int64) for i in rows]
        short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < MIN_MATCH))
        whole = np.array([windows(words[at[i] : at[i + 1]], MIN_MATCH)[0] for i in short], np.uint64)
        hit = passing.value.holds(whole)
        rows += short[hit].tolist()
        found += list(whole[hit].view(np.int64)[:, None])
        texts = batch.column(0).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([texts, pa.array(found, pa.list_(pa.int64()))], names=["text", "seeds"])

    hits = map_arrow(docs.select("text"), step, "text string, seeds array<bigint>")
    hits = hits.withColumn("text_key", text_key()).groupBy("text_key").agg(F.first("text").alias("text"), F.first("seeds").alias("seeds"))
    hits = materialize(hits, "leak-hits")

    def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, at = hash_words(batch.column(1), TABLE)
        times = []  # how often the most frequent window of an item occurs in it
        for i in range(batch.num_rows):
            own = windows(words[at[i] : at[i + 1]], MIN_MATCH)
            times.append(int(np.unique(own, return_counts=True)[1].max()) if len(own) else 1)
        made = [pa.array(np.diff(at)), pa.array(times, pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=["item_id", "item", "item_words", "times"])

    columns = "item_id bigint, item string, item_words bigint, times bigint"
    known = map_arrow(items.select(F.col("item_id").cast("bigint"), "text"), sizes, columns)
    shared = hits.select("text_key", F.explode("seeds").alias("seed")).join(seeds, "seed")
    shared = shared.groupBy("text_key", "item_id").agg(F.count(F.lit(1)).alias("shared"))
    # A shared window covers MIN_MATCH words; it may occur again within an item, so its words count for all of them.
    likely = shared.join(known, "item_id").filter(
        F.col("shared") * F.col("times") * MIN_MATCH >= F.lit(coverage) * F.col("item_words")
    )
    pairs = likely.join(hits.select("text_key", "text"), "text_key").select("text_key", "item_id", "item_words", "text", "item")

    def tiled(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, t_at = hash_words(batch.column(3), TABLE)
        wanted, i_at = hash_words(batch.column(4), TABLE)
        counts, covered = [], []
        for k in range(batch.num_rows):
            item = wanted[i_at[k] : i_at[k + 1]]
            tiles = tile(item, texts[t_at[k] : t_at[k + 1]], min(MIN_MATCH, len(item)))
            counts.append(len(tiles))
            covered.append(sum(n for n, _, _ in tiles))
        made = [pa.array(counts, pa.int64()), pa.array(covered, pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["text_key", "item_id", "item_words", "tiles", "covered"])

    out = map_arrow(pairs, tiled, "text_key string, item_id bigint, item_words bigint, tiles bigint, covered bigint")
    out = out.withColumn("coverage", F.col("covered") / F.col("item_words"))
    return out.filter(F.col("coverage") >= F.lit(coverage))


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, tiles, covered, coverage) of every row that leaks an item."""
    found = leaks(docs, items, coverage).withColumnRenamed("text_key", "_key")
    rows = docs.select("doc_id", text_key().alias("_key"))
    return rows.join(found, "_key").select("doc_id", "item_id", "item_words", "tiles", "covered", "coverage")


def drop_contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that leak no item; columns as given."""
    found = leaks(docs, items, coverage).select(F.col("text_key").alias("_key")).distinct()
    return docs.withColumn("_key", text_key()).join(found, "_key", "left_anti").select(*docs.columns)
