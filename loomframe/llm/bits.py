"""A bit filter of hashes: bounded size, no false negatives. Never replaces the join that follows it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBES = 4
LEAST, MOST = 1 << 16, 1 << 27  # bits: 8 KB to 16 MB on the driver and in each worker


def _spots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]


class BitFilter:
    """64 bits per hash as long as MOST allows; beyond that it lets more through, never less."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for spot in _spots(h, 64 * len(self.words)):
            found &= (self.words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        return found


def bit_filter(hashes: DataFrame, column: str) -> BitFilter:
    """Filter of a bigint column; the driver gets the words of the filter, at most MOST / 64 rows."""
    count = hashes.select(F.approx_count_distinct(column)).first()[0]
    bits = LEAST
    while bits < min(MOST, 64 * count):
        bits *= 2

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            h = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            spots = np.unique(np.concatenate([np.empty(0, np.uint64), *_spots(h, bits)]))
            yield pa.RecordBatch.from_arrays([pa.array(spots.astype(np.int64))], names=["spot"])

    spots = hashes.select(column).mapInArrow(spread, "spot bigint")
    words = spots.groupBy(F.shiftright("spot", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), CAST(spot & 63 AS INT))")).alias("word")
    )
    out = np.zeros(bits // 64, np.uint64)
    table = words.toPandas()
    out[table["at"].to_numpy(np.int64)] = table["word"].to_numpy(np.int64).view(np.uint64)
    return BitFilter(out)
