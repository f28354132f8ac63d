"""Counts of hashed values in a table of slots of fixed size.

Each task packs the slots of its own values by range of slots; ranges are summed
apart from each other, and in several parts where there are many values, so no
task holds more than the counts of the ranges that it meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A part holds about this many values.
PART = 1 << 30


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as compressed differences, byte by byte."""
    return zstandard.compress(np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_sorted(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def ranges(values: np.ndarray, bits: int, range_bits: int) -> list[tuple[int, bytes]]:
    """(range, packed) of 32-bit slots of `bits` bits, cut into 2^range_bits ranges."""
    values = np.sort(values)
    edges = np.searchsorted(values, np.arange(1, 1 << range_bits, dtype=np.uint32) << np.uint32(bits - range_bits))
    return [(k, pack_sorted(x & np.uint32((1 << bits - range_bits) - 1))) for k, x in enumerate(np.split(values, edges)) if len(x)]


def _sum(packed: bool, width: int):
    """(range, counts) of the ranges met: from packed slots, or from counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = total.setdefault(k, np.zeros(1 << width, np.uint64))
                own += np.bincount(unpack_sorted(value.as_py()), minlength=1 << width).astype(np.uint64) if packed else np.frombuffer(zstandard.decompress(value.as_py()), np.uint64)
        for k, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress(own.tobytes(), 1)], pa.binary())], ["range", "counts"])

    return run


def counts(packs: DataFrame, total: int, width: int, finish=None, finished: str = "") -> DataFrame:
    """(range, counts), one row a range, from (range, part, packed): compressed 64-bit counts of the range's 2^width slots. With finish,
    what it makes of them, rows of the schema `finished`, in the same Python worker: a second one a task would stay and hold memory."""
    schema = "range int, counts binary"
    last = _sum(False, width)
    parts = packs.select("range", "packed", F.pmod("part", F.lit(1 + total // PART)).alias("part")).repartition(F.col("range"), F.col("part"))
    ranges = parts.select("range", "packed").mapInArrow(_sum(True, width), schema).repartition(F.col("range"))
    return ranges.mapInArrow(last, schema) if finish is None else ranges.mapInArrow(lambda batches: finish(last(batches)), finished)
