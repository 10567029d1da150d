"""Language-model scoring by cross-entropy difference.

Two bigram models, one of target documents and one of all documents (the background), share one
vocabulary. A document's score is the mean over its words of the background's loss less the
target's, in bits: high for texts that the target model finds easier.

The models hold every word and every pair of every document, so they grow with the input. They are
one Spark table of counts by key: of pairs, of words, and of contexts (the word before). Nothing of
it is collected or broadcast. Texts are scored in chunks of bounded bytes: a chunk asks for each of
its keys once, the keys are joined with the counts, and the answers are brought back to the chunk. So a
frequent pair is asked for once a chunk, not once a text. Pairs are discounted by DISCOUNT and
interpolated with smoothed single words, each model from its own counts; probabilities add up to
one. Words that no document had share one unknown word.

The target is named by a table of ids of any size, joined with the documents. Missing texts count as
empty and score 0 over 0 words; a text whose id is no target or missing is background only.
Repeated rows count and score as often as they stand. Added columns replace input columns of the
same name; an empty table gives an empty result. There are no ties: a score depends on its row alone.

Keys are 64-bit hashes of words and of pairs; among n distinct keys about n * n / 2**65 share one.

``fit`` and ``score`` keep the model as a table, so that other texts can be scored by it.
``difference`` fits and scores the same rows, and moves far less: each chunk sends its distinct
words and pairs once, in one block of sorted hashes and counts per bucket of the key space; a bucket
adds them up and answers each block with numbers alone, in the order in which its keys came. The
chunk sorts its keys again and lays the answers beside them. Buckets grow in number with the
text. The pairs of a frequent context are dealt over all buckets and its sums added up
apart; there are at most sixteen such contexts a bucket, so what is told to all tasks is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm.words import blank_separated, hash_words, mixed, slices
from loomframe.session import materialize

DISCOUNT, PRIOR = 0.75, 0.5
HELD = 1 << 21  # distinct keys that a task counts before it passes them on
BUCKET = 12 << 20  # bytes of text whose keys a bucket of ``difference`` adds up at once
CHUNK = 16 << 20  # bytes of text that are scored at once; a longer text is a chunk of its own
TABLE = blank_separated(lower=True)
FIRST = np.uint64(0x6C62272E07BB0142)  # stands before the first word of a text
STEP = np.uint64(0x9E3779B97F4A7C15)
SUMS = ("target", "total", "target_kinds", "kinds")
ANSWERS = "_chunk bigint, run bigint, bucket bigint, words binary, pairs binary"


def _pairs(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each word with the word before it in its text, and the word before."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    before[first] = FIRST
    return (before * STEP + words).view(np.int64), before.view(np.int64)


def _words_and_pairs(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs, before = _pairs(words, row)
    return np.concatenate([words.view(np.int64), pairs]), np.concatenate([row, row]), np.concatenate([np.zeros_like(before), before])


class _Tally:
    """Counts of keys, in target and in all documents, merged whenever many have gathered."""

    def __init__(self) -> None:
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.size = self.known = 0

    def add(self, keys: np.ndarray, before: np.ndarray, target: np.ndarray) -> None:
        self.waiting.append((keys, before, target.astype(np.int64), np.ones(len(keys), np.int64)))
        self.size += len(keys)
        if self.size > HELD:
            self.merge()

    def merge(self) -> None:
        if not self.size:
            return
        keys, before, target, total = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.waiting = [(keys[at], before[by][at], np.add.reduceat(target[by], at), np.add.reduceat(total[by], at))]
        self.size, self.known = 0, len(at)

    def batches(self, last: bool) -> Iterator[pa.RecordBatch]:
        if last:
            self.merge()
        if self.waiting and (self.known > HELD or last):
            self.merge()
            columns = self.waiting[0]
            for at in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=["key", "before", "target", "total"])
            self.waiting, self.size, self.known = [], 0, 0


def _ids(docs: DataFrame, targets) -> DataFrame:
    """Distinct ids from a table of them, an array or a broadcast array."""
    if not isinstance(targets, DataFrame):
        array = getattr(targets, "value", targets)
        targets = docs.sparkSession.createDataFrame([(int(i),) for i in array], "doc_id bigint")
    return targets.select(F.col("doc_id").cast("bigint").alias("_id")).dropna().distinct()


def _counted(docs: DataFrame, targets, keys_of) -> DataFrame:
    """(key, before, target, total) over all documents; tasks add up their own keys before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for whole in batches:
            for batch in slices(whole):
                words, at = hash_words(batch.column(1), TABLE)
                row = np.repeat(np.arange(batch.num_rows), np.diff(at))
                mine = batch.column(0).to_numpy(zero_copy_only=False)
                keys, rows, *before = keys_of(words, row)
                tally.add(keys, before[0] if before else np.zeros_like(keys), mine[rows])
                yield from tally.batches(last=False)
        yield from tally.batches(last=True)

    ids = _ids(docs, targets).withColumn("_target", F.lit(True))
    marked = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text").join(ids, "_id", "left")
    marked = marked.select(F.coalesce("_target", F.lit(False)).alias("target"), "text")
    found = marked.mapInArrow(run, "key bigint, before bigint, target bigint, total bigint")
    return found.groupBy("key").agg(F.min("before").alias("before"), F.sum("target").alias("target"), F.sum("total").alias("total"))


def _logs(pair: np.ndarray, context: np.ndarray, kinds: np.ndarray, word: np.ndarray, total: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Logs of the whole, of what a context leaves to single words, and of single words, from counts (column 0 target, 1 background)."""
    chance = (word + PRIOR) / (total + PRIOR * size)
    rest = np.where(context > 0, (DISCOUNT * kinds + PRIOR) / (context + PRIOR), 1.0)
    own = np.maximum(pair - DISCOUNT, 0) / (context + PRIOR) + rest * chance
    return np.log2(own), np.log2(rest), np.log2(chance)


@dataclass
class Model:
    """Counts by key (key, target, total, target_kinds, kinds): pairs, words, and contexts by the complement of their word.

    ``counts`` has the pairs and words with the word before, 0 for none. ``size`` is the number of
    words, the unknown one included, ``total`` that of all words in target and in all documents.
    """

    counts: DataFrame
    table: DataFrame
    total: np.ndarray
    size: int

    @cached_property
    def _all(self) -> dict[str, np.ndarray]:
        """The whole model as arrays, words by number from 1 on: for looking at small ones only."""
        rows = self.counts.toPandas().sort_values("key")
        single, pair = rows[rows.before == 0], rows[rows.before != 0]
        words = single["key"].to_numpy(np.int64)
        before = pair["before"].to_numpy(np.int64)
        after = (pair["key"].to_numpy(np.int64).view(np.uint64) - before.view(np.uint64) * STEP).view(np.int64)
        numbers = np.where(before.view(np.uint64) == FIRST, self.size, np.searchsorted(words, before) + 1)
        follow = np.searchsorted(words, after) + 1
        counts = pair[["target", "total"]].to_numpy(float).reshape(-1, 2)
        context, kinds = np.zeros((self.size + 1, 2)), np.zeros((self.size + 1, 2))
        np.add.at(context, numbers, counts)
        np.add.at(kinds, numbers, counts > 0)
        word = np.concatenate([np.zeros((1, 2)), single[["target", "total"]].to_numpy(float).reshape(-1, 2)])
        own = _logs(counts, context[numbers], kinds[numbers], word[follow], self.total, self.size)[0]
        _, rest, _ = _logs(context * 0, context, kinds, context * 0, self.total, self.size)
        chance = _logs(word * 0, word * 0, word * 0, word, self.total, self.size)[2]
        return {"vocabulary": words, "pairs": numbers * self.size + follow, "pair_logs": own, "word_logs": chance, "rest_logs": rest}

    vocabulary = property(lambda self: self._all["vocabulary"])
    pairs = property(lambda self: self._all["pairs"])
    pair_logs = property(lambda self: self._all["pair_logs"])
    word_logs = property(lambda self: self._all["word_logs"])
    rest_logs = property(lambda self: self._all["rest_logs"])


def target_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled as of good quality."""
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()


def fit(docs: DataFrame, targets) -> Model:
    """Count every word and pair over all documents; ``targets`` is a table (doc_id) or an array of ids."""
    counts = materialize(_counted(docs, targets, _words_and_pairs), "cross-entropy-counts")
    sums = counts.filter("before = 0").agg(F.sum("target").alias("t"), F.sum("total").alias("n"), F.count(F.lit(1)).alias("words")).first()
    kinds = [F.count_if(F.col("target") > 0).alias("target_kinds"), F.count(F.lit(1)).alias("kinds")]
    contexts = counts.filter("before <> 0").groupBy("before").agg(F.sum("target").alias("target"), F.sum("total").alias("total"), *kinds)
    none = F.lit(0).cast("bigint")
    table = counts.select("key", "target", "total", none.alias("target_kinds"), none.alias("kinds")).unionByName(
        contexts.select(F.bitwise_not("before").alias("key"), "target", "total", "target_kinds", "kinds")
    )
    return Model(counts, table, np.array([sums.t or 0, sums.n or 0], float), sums.words + 1)


def _in_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Adds the chunk of each row: rows of one task up to ``limit`` bytes."""
    task, number, held = TaskContext.get().partitionId(), 0, 0
    for whole in batches:
        for batch in slices(whole):
            if held and held + batch.nbytes > limit:
                number, held = number + 1, 0
            held += batch.nbytes
            chunk = pa.array(np.full(batch.num_rows, (task << 32) + number, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, chunk], names=[*batch.schema.names, "_chunk"])


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys of each run of rows of one chunk: (_chunk, key)."""
    chunk, held = None, []

    def made() -> Iterator[pa.RecordBatch]:
        keys = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
        for at in range(0, len(keys), 100_000):
            part = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part)], names=["_chunk", "key"])

    for whole in batches:
        for batch in slices(whole):
            chunks = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(chunks[1:] != chunks[:-1]) + 1, len(chunks)]
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if chunks[start] != chunk:
                    yield from made()
                    chunk, held = chunks[start], []
                words, at = hash_words(batch.column(1).slice(start, end - start), TABLE)
                pairs, before = _pairs(words, np.repeat(np.arange(end - start), np.diff(at)))
                held.append(np.unique(np.concatenate([pairs, words.view(np.int64), ~before])))
    yield from made()


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The input with ``n_words``, ``target_loss``, ``background_loss`` (bits a word) and ``score``, their difference."""
    names = ("target_loss", "background_loss", "score")
    added = {"n_words": T.LongType(), **dict.fromkeys(names, T.DoubleType())}
    kept = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(k, v) for k, v in added.items()])
    total, size = model.total, model.size

    def judged(rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts = rows.column("_text").combine_chunks()
        words, at = hash_words(texts, TABLE)
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n)
        pairs, before = _pairs(words, row)
        pairs, first, back = np.unique(pairs, return_index=True, return_inverse=True)
        key = answers.column("key").to_numpy()
        by = np.argsort(key)
        key = key[by]
        values = [answers.column(c).to_numpy()[by].astype(float) for c in ("target", "total", "target_kinds", "kinds")]

        def found(keys: np.ndarray) -> list[np.ndarray]:
            if not len(key):
                return [np.zeros(len(keys))] * 4
            place = np.minimum(np.searchsorted(key, keys), len(key) - 1)
            hit = key[place] == keys
            return [np.where(hit, v[place], 0.0) for v in values]

        pair, context, word = found(pairs), found(~before[first]), found(words.view(np.int64)[first])
        both = [np.stack(x, axis=1) for x in (pair[:2], context[:2], context[2:], word[:2])]
        losses = -_logs(*both, total, size)[0][back]
        mean = [np.bincount(row, losses[:, k], len(n)) / np.maximum(n, 1) for k in (0, 1)]
        made = [pa.array(n), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[1] - mean[0])]
        return pa.Table.from_arrays([*(rows.column(c) for c in kept), *made], names=[*kept, *added])

    plain = docs.select(*[docs[c] for c in kept], F.col(text).alias("_text"))
    # Written once, so that both sides below see the same chunks.
    chunked = materialize(plain.mapInArrow(_in_chunks, T.StructType([*plain.schema, T.StructField("_chunk", T.LongType())])), "cross-entropy-chunks")
    wanted = chunked.select("_chunk", "_text").mapInArrow(_wanted, "_chunk bigint, key bigint")
    answers = wanted.join(model.table, "key")
    return chunked.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(judged, schema)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers of shape (k, n) as compressed planes of bytes; the high ones are mostly zero."""
    planes = np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(*values.shape, 8).transpose(0, 2, 1)
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, k: int, n: int) -> np.ndarray:
    if not n:
        return np.zeros((k, 0), np.int64)
    raw = pa.decompress(packed, k * n * 8, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(k, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(k, n)


def _places(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key: its place in the spread key space."""
    return ((mixed(keys) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class _Run:
    """Distinct words and pairs of one run of rows, in the order of buckets, in which blocks and answers have them."""

    def __init__(self, words: np.ndarray, row: np.ndarray, buckets: int, heavy: np.ndarray) -> None:
        self.words, at = np.unique(words, return_inverse=True)
        size = len(self.words)
        before = np.empty_like(at)
        before[1:] = at[:-1]
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        before[first] = size
        codes, self.pair_of = np.unique(before * (size + 1) + at, return_inverse=True)
        self.context, self.after = np.divmod(codes, size + 1)
        self.contexts = np.r_[self.words, FIRST]
        self.heavy = np.isin(self.contexts, heavy)
        self.word_of, self.home = at, _places(self.words, buckets)
        dealt = self.heavy[self.context]
        place = np.r_[self.home, 0][self.context]
        place[dealt] = _places(self.contexts[self.context[dealt]] * STEP + self.words[self.after[dealt]], buckets)
        self.place = place
        # Within a bucket: pairs of home contexts first, then dealt ones, each by context and word.
        self.by_word = np.argsort(self.home, kind="stable")
        self.by_pair = np.argsort(place * 2 + dealt, kind="stable")

    def blocks(self, target: np.ndarray) -> Iterator[tuple]:
        """(bucket, words, dealt contexts, hashes, counts); ``target`` tells of each word whether its text is one."""
        words = np.stack([np.bincount(self.word_of, target, len(self.words)), np.bincount(self.word_of, minlength=len(self.words))])
        pairs = np.stack([np.bincount(self.pair_of, target, len(self.context)), np.bincount(self.pair_of, minlength=len(self.context))])
        words, pairs = words.astype(np.int64), pairs.astype(np.int64)
        home, place = self.home[self.by_word], self.place[self.by_pair]
        for bucket in np.unique(np.concatenate([home, place])).tolist():
            w = self.by_word[slice(*np.searchsorted(home, [bucket, bucket + 1]))]
            p = self.by_pair[slice(*np.searchsorted(place, [bucket, bucket + 1]))]
            own = self.context[p]
            dealt = self.heavy[own]
            followers = np.bincount(np.searchsorted(w, own[~dealt]), minlength=len(w))
            heavy, dealt_followers = np.unique(own[dealt], return_counts=True)
            keys = np.concatenate([self.words[w], self.contexts[heavy], self.words[self.after[p]]])
            counts = np.concatenate([words[:, w].ravel(), followers, dealt_followers, pairs[:, p].ravel()])
            yield bucket, len(w), len(heavy), keys.tobytes(), len(counts), _packed(counts[None])

    def laid(self, answers: list[tuple], sums: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Counts of pairs, words and contexts, each (k, n), from the answers (bucket, words, pairs)."""
        words, pairs = np.zeros((6, len(self.words)), np.int64), np.zeros((2, len(self.context)), np.int64)
        home, place = self.home[self.by_word], self.place[self.by_pair]
        for bucket, w_answer, p_answer in answers:
            w = self.by_word[slice(*np.searchsorted(home, [bucket, bucket + 1]))]
            p = self.by_pair[slice(*np.searchsorted(place, [bucket, bucket + 1]))]
            words[:, w], pairs[:, p] = _unpacked(w_answer, 6, len(w)), _unpacked(p_answer, 2, len(p))
        contexts = np.concatenate([words[2:], np.zeros((4, 1), np.int64)], axis=1)
        for i in np.flatnonzero(self.heavy):
            contexts[:, i] = sums.get(int(self.contexts[i]), np.zeros(4, np.int64))
        return pairs, words[:2], contexts


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(chunk, run, words, row of each word, target of each word) of neighbouring rows of one chunk.

    Batches have chunk, row number in the chunk, target and text; the first row's number names the run.
    """
    now, held, rows = None, [], 0
    for whole in batches:
        for batch in slices(whole):
            chunks = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(chunks[1:] != chunks[:-1]) + 1, len(chunks)]
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if now is None or chunks[start] != now[0]:
                    if held:
                        yield (*now, *map(np.concatenate, zip(*held, strict=True)))
                    now, held, rows = (int(chunks[start]), batch.column(1)[start].as_py()), [], 0
                words, at = hash_words(batch.column(3).slice(start, end - start), TABLE)
                row = np.repeat(np.arange(end - start), np.diff(at))
                target = batch.column(2).slice(start, end - start).to_numpy(zero_copy_only=False)
                held.append((words, row + rows, target[row]))
                rows += end - start
    if held:
        yield (*now, *map(np.concatenate, zip(*held, strict=True)))


def _heavy_contexts(chunked: DataFrame, buckets: int) -> np.ndarray:
    """The contexts to deal: FIRST, and at most 16 * buckets words, all those above 1 / (8 * buckets) of all words among them.

    Runs count words above half that share of theirs. What they leave out of a word is less than
    half that share of all words, so a word above the share keeps more than half of it, and 16 * buckets words at most can.
    """
    share = 1 / (16 * buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, found, _, _ in _runs(batches):
            keys, n = np.unique(found, return_counts=True)
            often = n > share * len(found)
            named = pa.array([None, *keys[often].view(np.int64).tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([named, pa.array(np.r_[len(found), n[often]])], names=["key", "n"])

    named = materialize(chunked.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "cross-entropy-frequent")
    words = named.filter("key IS NULL").agg(F.sum("n")).first()[0] or 0
    found = named.filter(F.col("key").isNotNull() & (F.col("n") > share * words)).collect()
    return np.array([FIRST, *(np.int64(r.key).view(np.uint64) for r in found)], np.uint64)


def _added_up(blocks: pa.Table) -> Iterator[pa.RecordBatch]:
    """Answers to all blocks of a bucket, and under chunk -1 what its dealt contexts and its words add to the sums (there ``bucket`` is the number of keys)."""
    rows = blocks.to_pylist()
    parts = []
    for r in rows:
        keys, counts = np.frombuffer(r["keys"], np.uint64), _unpacked(r["counts"], 1, r["n_counts"])[0]
        w, h = r["n_words"], r["n_heavy"]
        p = len(keys) - w - h
        cut = np.split(counts, np.cumsum([2 * w, w, h]))
        owners = np.repeat(keys[: w + h], np.concatenate([cut[1], cut[2]]))
        home = np.repeat([True, False], [cut[1].sum(), cut[2].sum()])
        parts.append((keys[:w], cut[0].reshape(2, w), owners, home, keys[w + h :], cut[3].reshape(2, p)))
        r["keys"] = r["counts"] = None
    cuts_w, cuts_p = np.cumsum([0, *(len(x[0]) for x in parts)]), np.cumsum([0, *(len(x[2]) for x in parts)])
    words, word_of = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    word_counts = [np.bincount(word_of, np.concatenate([x[1][k] for x in parts]), len(words)).astype(np.int64) for k in (0, 1)]
    owners, home, after = (np.concatenate([x[k] for x in parts]) for k in (2, 3, 4))
    counts = [np.concatenate([x[5][k] for x in parts]) for k in (0, 1)]
    del parts  # the blocks themselves
    pairs = owners * STEP + after
    del after
    _, one, pair_of = np.unique(pairs, return_index=True, return_inverse=True)
    del pairs
    pair_counts = [np.bincount(pair_of, c, len(one)).astype(np.int64) for c in counts]
    del counts
    owners, home = owners[one], home[one]
    each = [pair_counts[0], pair_counts[1], pair_counts[0] > 0, np.ones(len(one), bool)]
    at = np.searchsorted(words, owners[home])
    contexts = [np.bincount(at, c[home], len(words)).astype(np.int64) for c in each]
    dealt, at = np.unique(owners[~home], return_inverse=True)
    spread = np.stack([np.bincount(at, c[~home], len(dealt)).astype(np.int64) for c in each])
    of_words, of_pairs = np.stack([*word_counts, *contexts]), np.stack(pair_counts)
    for i, r in enumerate(rows):
        w = _packed(of_words[:, word_of[cuts_w[i] : cuts_w[i + 1]]])
        p = _packed(of_pairs[:, pair_of[cuts_p[i] : cuts_p[i + 1]]])
        yield _answer(r["_chunk"], r["run"], r["bucket"], w, p)
    sums = np.array([[len(words)], [int(word_counts[0].sum())], [int(word_counts[1].sum())], [0]])
    yield _answer(-1, -1, 1 + len(dealt), np.r_[np.uint64(0), dealt].tobytes(), _packed(np.concatenate([sums, spread], axis=1)))


def _answer(*values) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    names = ["_chunk", "run", "bucket", "words", "pairs"]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def _sums(answers: DataFrame) -> dict[int, np.ndarray]:
    """Sums by dealt context, four numbers each, and under 0 (number of words, words in target, in all, 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = np.frombuffer(r["words"], np.int64)
                values = _unpacked(r["pairs"], 4, r["bucket"])
                yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, values)], names=["key", *SUMS])

    own = answers.filter("_chunk = -1").mapInArrow(run, "key bigint, " + ", ".join(f"{c} bigint" for c in SUMS))
    found = own.groupBy("key").agg(*[F.sum(c).alias(c) for c in SUMS]).collect()
    return {int(np.int64(r.key).view(np.uint64)): np.array(r[1:], np.int64) for r in found}


def difference(
    docs: DataFrame, targets, text: str = "text", columns: list[str] | None = None, chunk: int = CHUNK // 2, bucket: int = BUCKET
) -> DataFrame:
    """Fit on all rows and score them: what ``score(docs, fit(docs, targets))`` gives, with ``columns`` of the input (None: all).

    ``chunk`` and ``bucket`` are bytes of text that a task works on at once; they change no result. With
    larger ones blocks are fewer and longer: at 100 TB a bucket of 1 GB makes 100,000 of them.
    """
    names = ("target_loss", "background_loss", "score")
    added = {"n_words": T.LongType(), **dict.fromkeys(names, T.DoubleType())}
    kept = [c for c in docs.columns if c not in added and (columns is None or c in columns)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(k, v) for k, v in added.items()])
    # Ids grow with the input: merged at every size, so that small inputs show the plan of large ones.
    ids = _ids(docs, targets).withColumn("_target", F.lit(True)).hint("merge")
    marked = docs.select(*kept, F.col(text).alias("_text"), F.col("doc_id").cast("bigint").alias("_id")).join(ids, "_id", "left")
    # A kept text is written once, under the name it is scored by.
    stored = [c for c in kept if c != text]
    marked = marked.select(F.coalesce("_target", F.lit(False)).alias("_target"), "_text", *stored)
    added_by_chunk = [T.StructField("_chunk", T.LongType()), T.StructField("_row", T.LongType())]
    numbered = marked.mapInArrow(lambda batches: _in_numbered_chunks(batches, chunk), T.StructType([*marked.schema, *added_by_chunk]))
    chunked = materialize(numbered, "cross-entropy-texts")
    whole = chunked.agg(F.sum(F.octet_length("_text")).alias("bytes")).first().bytes or 0
    buckets = max(1, -(-whole // bucket))
    texts = chunked.select("_chunk", "_row", "_target", "_text")
    heavy = _heavy_contexts(texts, buckets)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ["_chunk", "run", "bucket", "n_words", "n_heavy", "keys", "n_counts", "counts"]
        for of, run, words, row, target in _runs(batches):
            for block in _Run(words, row, buckets, heavy).blocks(target):
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (of, run, *block)], names=made)

    blocks = texts.mapInArrow(sent, "_chunk bigint, run bigint, bucket bigint, n_words bigint, n_heavy bigint, keys binary, n_counts bigint, counts binary")

    def added_up(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_added_up(rows)))

    answers = materialize(blocks.groupBy("bucket").applyInArrow(added_up, ANSWERS), "cross-entropy-answers")
    sums = _sums(answers)
    size, *total = sums.get(0, np.zeros(4, np.int64))[:3].tolist()
    size, total = size + 1, np.array(total, float)

    def judged(rows: pa.Table, mine: pa.Table) -> pa.Table:
        rows = rows.sort_by("_row").combine_chunks()
        places = rows.column("_row").to_numpy()
        by_run: dict[int, list[tuple]] = {}
        for r in mine.to_pylist():
            by_run.setdefault(r["run"], []).append((r["bucket"], r["words"], r["pairs"]))
        n, means = np.zeros(len(places), np.int64), np.zeros((2, len(places)))
        starts = sorted(by_run)
        for run, end in zip(starts, [*starts[1:], None], strict=False):
            low, high = np.searchsorted(places, run), len(places) if end is None else np.searchsorted(places, end)
            words, at = hash_words(pa.concat_arrays(rows.column("_text").slice(low, high - low).chunks), TABLE)
            n[low:high] = np.diff(at)
            row = np.repeat(np.arange(high - low), n[low:high])
            held = _Run(words, row, buckets, heavy)
            pairs, single, contexts = held.laid(by_run[run], sums)
            follow, own = single[:, held.after].T, contexts[:, held.context].T
            losses = -_logs(pairs.T, own[:, :2], own[:, 2:], follow, total, size)[0][held.pair_of]
            for k in (0, 1):
                means[k, low:high] = np.bincount(row, losses[:, k], high - low) / np.maximum(n[low:high], 1)
        made = [pa.array(n), *map(pa.array, means), pa.array(means[1] - means[0])]
        return pa.Table.from_arrays([*(rows.column("_text" if c == text else c) for c in kept), *made], names=[*kept, *added])

    return chunked.groupBy("_chunk").cogroup(answers.filter("_chunk >= 0").groupBy("_chunk")).applyInArrow(judged, schema)


def _in_numbered_chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Adds the chunk of each row and the number of the row in its chunk."""
    chunk, row = None, 0
    for batch in _in_chunks(batches, limit):
        if batch.column(batch.num_columns - 1)[0].as_py() != chunk:
            chunk, row = batch.column(batch.num_columns - 1)[0].as_py(), 0
        numbers = pa.array(np.arange(row, row + batch.num_rows))
        row += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, numbers], names=[*batch.schema.names, "_row"])
