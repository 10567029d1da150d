"""Best-fit decreasing packing of tokenized documents into sequences of LIMIT tokens.

A document is its ids and the end id. One longer than LIMIT is cut into pieces of LIMIT, of which only
the first may be shorter. Pieces are placed by decreasing length, each into the tightest sequence that
still holds it; a segment tree over remaining capacities finds that in logarithmic time.

Pieces of one length may change places, and so may sequences of one remaining capacity. So the packing
only needs the number of pieces of each length (at most LIMIT numbers, counted by Spark) and
places whole runs of them: a run says which ranks of a length go to which sequences, at which offset.
The plan has as many runs as open capacities were met, whatever the input's size; it is broadcast, and each piece finds its run by its rank among the pieces of its length. Ranks are added up
from counts per task and length, never in one task.

Missing texts count as empty: the end id alone. Very long texts are read in segments and their pieces
passed on in batches. Repeated rows are packed as often as they stand, ties in length are settled by
rank. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.byte_bpe import ByteBpe, Prepared, prepare
from loomframe.session import materialize

BATCH = 1 << 15  # pieces passed on at once
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, _task int, _rank bigint"


class OpenSequences:
    """Ranges of sequences by remaining capacity, under a segment tree of which capacities are open."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.tree = np.zeros(2 * self.size, np.int64)  # ranges below each node
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]

    def _add(self, capacity: int, number: int) -> None:
        node = capacity + self.size
        while node:
            self.tree[node] += number
            node >>= 1

    def put(self, capacity: int, first: int, count: int) -> None:
        if count:
            self.ranges[capacity].append((first, count))
            self._add(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        self._add(capacity, -1)
        return self.ranges[capacity].pop()

    def tightest(self, length: int) -> int | None:
        """The smallest open capacity of at least ``length``."""
        node = length + self.size
        if self.tree[node]:
            return length
        while node > 1:  # up to the first right neighbour with something open, then down to its left end
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def plan(counts: dict[int, int], limit: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, offset) and the number of sequences."""
    open_ones, runs, used = OpenSequences(limit), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = open_ones.tightest(length)
            if capacity is None:
                new = -(-left // (limit // length))
                open_ones.put(limit, used, new)
                capacity, used = limit, used + new
            first, number = open_ones.take(capacity)
            each = capacity // length  # the one just filled stays the tightest until it is too small
            full = min(number, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, limit - capacity))
                open_ones.put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < number and left:
                runs.append((length, rank, left, first + full, left, limit - capacity))
                open_ones.put(capacity - left * length, first + full, 1)
                full, left = full + 1, 0
            open_ones.put(capacity, first + full, number - full)
    return np.array(runs, np.int64).reshape(-1, 6), used


_ENCODERS: dict[int, tuple[Prepared, ByteBpe]] = {}


def encoder(prepared: Prepared, special: bool) -> ByteBpe:
    """The worker's encoder, made once."""
    if id(prepared) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(prepared)] = (prepared, ByteBpe(prepared, special))
    return _ENCODERS[id(prepared)][1]


def cut(docs: DataFrame, path: str, end: int, limit: int, text: str = "text") -> DataFrame:
    """PIECES of all documents, written: each with its rank among the pieces of its length in its task."""
    prepared = docs.sparkSession.sparkContext.broadcast(prepare(path))  # as large as the vocabulary, whatever the input
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(prepared.value, True).ids, TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], pa.int32() if names[k] in ("piece", "_task") else pa.int64()) for k in range(len(names))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for doc_id, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(words.as_py() or ""), np.uint32(end)).astype("<u4")
                start, upto, piece = 0, (len(ids) - 1) % limit + 1, 0
                while start < len(ids):
                    length = upto - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start:upto].data), task, int(seen[length])))
                    seen[length] += 1
                    start, upto, piece = upto, upto + limit, piece + 1
                    if len(rows) >= BATCH:
                        yield made()
        if rows:
            yield made()

    return materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(run, PIECES), "pieces")


def pack(docs: DataFrame, path: str, end: int, limit: int = 1024, text: str = "text") -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``."""
    pieces = cut(docs, path, end, limit, text)
    per_task = pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_count"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("_count").alias("n")).collect()}  # at most ``limit`` rows
    runs, _ = plan(counts, limit)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_task.select("length", "_task", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_shift"))
    ranked = pieces.join(shifts, ["length", "_task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_shift")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        lengths = np.arange(limit + 2)
        low = np.searchsorted(table[:, 0], lengths)  # runs of each length stand together, by first rank
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.empty(len(length), np.int64)
            for value in np.unique(length):
                mine = length == value
                first, last = low[value], low[value + 1]
                at[mine] = first + np.searchsorted(table[first:last, 1], rank[mine], "right") - 1
            chosen = table[at]
            inside = rank - chosen[:, 1]
            made = [pa.array(chosen[:, 3] + inside // chosen[:, 4]), pa.array(chosen[:, 5] + inside % chosen[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema)
