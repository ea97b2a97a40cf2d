"""Token sequences of a fixed length from documents of any length.

Method: first-fit decreasing, with a tournament tree over the free space of the bins that names the first bin
in which a piece fits in logarithmic time. Documents are dealt at random (by hash) to groups of a bounded size, each packed
on its own. A document longer than a sequence fills whole sequences; what is left of it, and every shorter document, is a piece to pack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool
from .tokens import byte_bpe

#: Documents in a group.
GROUP = 4096
END = 0


class Bins:
    """Bins of one size; each piece goes to the first with room for it."""

    def __init__(self, most: int, size: int):
        self.size, self.leaves = size, 1
        while self.leaves < most:
            self.leaves *= 2
        self.free = [size] * (2 * self.leaves)
        self.used = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset in it)"""
        free, at = self.free, 1
        if not 0 < length <= self.size or free[1] < length:
            raise ValueError(f"a piece of {length} doesn't fit")
        while at < self.leaves:
            at *= 2
            if free[at] < length:
                at += 1
        place = at - self.leaves, self.size - free[at]
        free[at] -= length
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        self.used = max(self.used, place[0] + 1)
        return place


def first_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; ties go by position."""
    bins = Bins(max(1, len(lengths)), size)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        out[i] = bins.put(lengths[i])
    return out


_WIDE = np.dtype("<u2")
#: Whole sequences and rests that one task numbers at most.
_ROOM = 40


def encoded(docs: DataFrame, tokenizer: str, size: int, end: int = END) -> DataFrame:
    """doc_id, rid (a number for each row), n_ids, whole (the number of the first whole sequence) and ids (packed unsigned integers of 2 bytes).

    Numbers are those of the task and of what it has seen so far; written out with the ids, they hold however often a task runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first, rows, wholes = byte_bpe(tokenizer), TaskContext.get().partitionId() << _ROOM, 0, 0
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [np.array([*encode(t or ""), end], _WIDE) for t in part.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                before = wholes + np.cumsum(n // size) - n // size
                cols = (first + rows + np.arange(len(ids)), n, first + before)
                rows, wholes = rows + len(ids), wholes + int((n // size).sum())
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "rid", "n_ids", "whole", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, rid long, n_ids long, whole long, ids binary")


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = END, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset.

    Only lengths are packed: a group is ``group`` rests of documents, two numbers each, dealt by a hash of their row's number, so neither
    copies of a row nor very long texts meet in a task; ids are joined to their places after. Null text counts as empty: its
    document is the end token alone. Each row of ``docs`` is a document, repeated rows too. A null doc_id is carried on. Extra columns are left out. The
    vocabulary must have at most 65,536 ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spool(encoded(docs, tokenizer, size, end), "encoded")
    rests = rows.select("rid", (F.col("n_ids") % size).alias("rest")).where("rest > 0")
    groups = max(1, -(-rests.count() // group))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        rid, rest = table["rid"].to_numpy(), table["rest"].to_numpy()
        order = np.argsort(rid, kind="stable")
        bins, offset = (np.array(x, np.int64) for x in zip(*first_fit_decreasing(rest[order].tolist(), size), strict=True))
        return pa.table({"rid": rid[order], "bin": (1 << 62) + (key[0].as_py() << 32) + bins, "offset": offset})

    places = rests.withColumn("grp", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("long")).groupBy("grp").applyInArrow(one, "rid long, bin long, offset long")
    placed = rows.join(places, "rid", "left").select("doc_id", "n_ids", "whole", "ids", "bin", "offset")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out, of = [], []
                for r, (n, whole, ids, bin_, offset) in enumerate(zip(*(part.column(k).to_pylist() for k in range(1, 6)), strict=True)):
                    wide = np.frombuffer(ids, _WIDE).astype("<u4")
                    for s in range(0, n, size):
                        full = n - s >= size
                        out.append((s, min(size, n - s), wide[s : s + size].tobytes(), n, whole + s // size if full else bin_, 0 if full else offset))
                        of.append(r)
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return placed.mapInArrow(pieces, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
