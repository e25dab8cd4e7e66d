"""A filter of fixed size for hashes: a bit for each value of their leading bits.

It is made where the hashes are, sent to the driver as words that have a bit set (at most ``2**(bits - 6)`` of them) and
broadcast. A hash that was put in always passes; with many hashes others pass too, which costs time and no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ (h << np.uint64(31))) >> np.uint64(64 - bits)).astype(np.int64)


def build(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The filter over a bigint column, nulls left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << bits, bool)
        for batch in batches:
            words[_place(batch.column(0).to_numpy().view(np.uint64), bits)] = True
        packed = np.packbits(words).view(np.int64)
        some = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed[some])], names=["word", "set"])

    parts = df.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "word int, set bigint")
    rows = parts.groupBy("word").agg(F.bit_or("set").alias("set")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64)
    return out


def test(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter."""
    at = _place(h, int(len(words)).bit_length() + 5)
    return (words.view(np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
