"""Words of whole Arrow text columns as 64-bit hashes, without one Python object per word.

A class table says which bytes belong to words and how they fold. Word hashes come from prefix
sums of a polynomial, in blocks of bounded size, so memory does not follow the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 18  # bytes hashed at once; longer words are hashed one by one
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
SPACE = bytes([0x20, *range(0x09, 0x0E)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(BASE, BLOCK), _powers(pow(BASE, -1, 1 << 64), BLOCK)


def blank_separated(lower: bool) -> np.ndarray:
    """Class table of words ``[^\\x20\\x09-\\x0D]+``: 0 separates, any other value is the folded byte plus one."""
    table = np.arange(1, 257, dtype=np.uint16)
    if lower:
        table[65:91] += 32
    table[list(SPACE)] = 0
    return table


def letters_and_digits() -> np.ndarray:
    """Class table of words of ASCII letters, digits and all bytes beyond ASCII, A-Z in lower case."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[65:91] += 32
    keep = np.zeros(256, bool)
    keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
    table[~keep] = 0
    return table


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def hash_words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and for each row where its words begin (rows + 1 places).

    Missing texts have no words.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    if data is None or not len(texts) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    offsets, raw = offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    inside = table.astype(bool)[raw]
    edge = np.empty(len(raw) + 1, bool)  # a word cannot run from one place into the next
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    begins = inside[np.minimum(cuts[:-1], len(raw) - 1)]
    starts, ends = cuts[:-1][begins], cuts[1:][begins]
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    at = 0
    while at < len(starts):
        if size[at] > BLOCK:
            folded = (table[raw[starts[at] : ends[at]]] - 1).astype(np.uint8).tobytes()
            out[at] = int.from_bytes(hashlib.blake2b(folded, digest_size=8).digest(), "little")
            at += 1
            continue
        upto = int(np.searchsorted(ends, starts[at] + BLOCK, "right"))
        first, last = starts[at], ends[upto - 1]
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(table[raw[first:last]].astype(np.uint64) * _UP[: last - first], out=sums[1:])
        s = starts[at:upto] - first
        out[at:upto] = mixed((sums[ends[at:upto] - first] - sums[s]) * _DOWN[s] + size[at:upto].astype(np.uint64))
        at = upto
    return out, np.searchsorted(starts, offsets).astype(np.int64)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words; of the whole sequence if it is shorter; none without words."""
    k = min(n, len(words))
    if not k:
        return words
    total = np.zeros(len(words) - k + 1, np.uint64)
    factor = 1
    for j in range(k):
        factor = factor * 0xD6E8FEB86659FD93 & MASK
        total += words[j : len(words) - k + 1 + j] * np.uint64(factor)
    return mixed(total + np.uint64(k))


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with one call per slice of bounded bytes, however long the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``limit`` bytes each, or of one row."""
    if batch.nbytes <= limit or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        yield from slices(part, limit)
