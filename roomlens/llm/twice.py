"""A pair of Bloom filters, for hashes seen once and hashes seen twice, built without a shuffle of the hashes.

Two such pairs merge: seen once is the union; seen twice is the union of both and of
what both have seen once. A hash that occurs twice anywhere is always found in the
second filter; a false find costs only an exact check later. The size follows the number of hashes up to a fixed most, so what is sent
to the driver and the executors is bounded whatever the input; a filter too small for its input finds more, and loses nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame

SEGMENT = 1 << 19  # bits
#: Bits for each hash, and of a filter at most (2**28 bits are 32 MB as sent, and twice that while a task builds a pair).
EACH, MOST = 6, 1 << 28
_SCHEMA = "segment int, part int, once binary, twice binary"


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def bits_for(n: int) -> int:
    """Size of a filter for ``n`` hashes."""
    return max(SEGMENT, min(MOST, 1 << max(0, EACH * n - 1).bit_length()))


def _holds(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _put(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def suspected(h: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """True where the filter ``twice`` (one byte per 8 bits) may hold a hash."""
    a, b = _places(h.astype(np.uint64), len(twice) * 8)
    return _holds(twice, a) & _holds(twice, b)


def fill(hashes: Iterator[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What is seen once and what twice, in one byte per 8 bits: an executor's workers hold a pair each."""
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for got in hashes:
        u, n = np.unique(got, return_counts=True)
        a, b = _places(u, bits)
        again = (n > 1) | (_holds(once, a) & _holds(once, b))
        for at in (a, b):
            _put(twice, at[again])
            _put(once, at)
    return once, twice


def twice_filter(hashes: DataFrame, bits: int) -> Broadcast:
    """Broadcast filter of what ``hashes`` (one long column, nulls are skipped) holds twice; ``bits``: a power of two, at most 2**32."""
    if bits & (bits - 1) or not SEGMENT <= bits <= 1 << 32:
        raise ValueError("bits must be a power of two from 2**19 to 2**32")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = fill((b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches), bits)
        part = TaskContext.get().partitionId()
        for i in range(0, bits // 8, SEGMENT // 8):
            if once[i : i + SEGMENT // 8].any():
                one, two = (zlib.compress(x[i : i + SEGMENT // 8].tobytes(), 1) for x in (once, twice))
                yield pa.RecordBatch.from_pydict({"segment": pa.array([i * 8 // SEGMENT], pa.int32()), "part": pa.array([part], pa.int32()), "once": [one], "twice": [two]})

    def merge(level: int):
        def fold(table: pa.Table) -> pa.Table:
            once = twice = np.zeros(SEGMENT // 8, np.uint8)
            for one, two in zip(table["once"], table["twice"], strict=True):
                one, two = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (one, two))
                once, twice = once | one, twice | two | (once & one)
            packed = (zlib.compress(x.tobytes(), 1) for x in (once, twice))
            return pa.table({"segment": table["segment"][:1], "part": pa.array([table["part"][0].as_py() // level], pa.int32()), "once": [next(packed)], "twice": [next(packed)]})

        return fold

    parts = hashes.mapInArrow(build, _SCHEMA)
    for _ in range(3):  # 64 parts become one, up to 64**3 parts
        parts = parts.selectExpr("segment", "part", "once", "twice", "part div 64 as grp").groupBy("segment", "grp").applyInArrow(merge(64), _SCHEMA)
    whole = np.zeros(bits // 8, np.uint8)
    for row in parts.select("segment", "twice").collect():  # a row per segment and 64**3 parts: bits / 8 bytes
        i = row["segment"] * (SEGMENT // 8)
        whole[i : i + SEGMENT // 8] |= np.frombuffer(zlib.decompress(bytes(row["twice"])), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(whole)


def keep_suspected(rows: DataFrame, column: str, found: Broadcast) -> DataFrame:
    """The rows whose hash in ``column`` the filter may hold."""
    at = rows.columns.index(column)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = found.value
        for batch in batches:
            h = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.filter(pa.array(suspected(h, twice)))

    return rows.mapInArrow(probe, rows.schema)
