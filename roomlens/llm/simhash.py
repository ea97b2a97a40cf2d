"""Near-duplicate documents by SimHash fingerprints that differ in few bits.

Method: pivot distance tables. The Hamming distances of each fingerprint to many fixed reference fingerprints are
computed once; by the triangle inequality two fingerprints within ``radius`` differ by at most ``radius`` in each of these
distances, so a pair is discarded by its largest coordinate difference, and only survivors are compared bit by bit.

All pairs of a corpus are too many even for that test. So equal fingerprints are first made one, and distinct ones meet
only in buckets: of eight bytes, two fingerprints that differ in two bits agree in six at least, and each choice of
six bytes is a bucket key. That leaves 16 free bits, so no bucket can hold more than 65,536 fingerprints, however skewed the
corpus. Of a bucket's links a star per connected part goes on, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, components, spool

SEED = 42
#: The free bytes of the bucket keys limit the radius.
MOST_RADIUS = 2
PIVOTS = np.random.default_rng(2).integers(0, 1 << 64, 24, np.uint64)
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_CHUNK = 1 << 16


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """Majority bits of the shingles' XXH64; 0 for a text without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    whole, k = b" ".join(words), min(words_in_shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = [xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[i : i + _CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), a row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            fp = np.array([fingerprint(t, words_in_shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def close_pairs(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidate pairs (i, j) those within ``radius``: the table discards, the bits decide."""
    for pivot in range(table.shape[1]):
        near = np.abs(table[i, pivot] - table[j, pivot]) <= radius
        i, j = i[near], j[near]
    near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
    return i[near], j[near]


def stars(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked within each bucket (a run of ``fp``): each fingerprint to the first of its part."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 64)]).tolist():
        a, b = np.triu_indices(size, 1)
        runs = starts[sizes == size]
        step = max(1, (1 << 20) // len(a))
        for k in range(0, len(runs), step):
            at = runs[k : k + step, None]
            found.append(close_pairs(fp, table, (at + a).ravel(), (at + b).ravel(), radius))
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        order = start + np.argsort(table[start : start + size, 0], kind="stable")
        first = table[order, 0]
        until = np.searchsorted(first, first + radius, "right")
        for k in range(0, size, 256):  # pairs beyond the first pivot's window are never made
            rows = np.arange(k, min(k + 256, size))
            span = until[rows] - rows - 1
            i = np.repeat(rows, span)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(span) - span, span)
            found.append(close_pairs(fp, table, order[i], order[j], radius))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    label = np.arange(len(fp))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for end in (i, j):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(fp)))
    return member, label[member]


def links(distinct: DataFrame, radius: int = MOST_RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose connected parts are those of all links."""
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"radius must be at most {MOST_RADIUS}")
    masks = [sum(255 << 8 * b for b in range(8) if b not in free) for free in combinations(range(8), MOST_RADIUS)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select(F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))).alias("k"), "fp")
    keyed = keyed.select("k.mask", "k.key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)
        for last, batch in _with_last(batches):
            got = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]) if batch else held[:, :0]
            held = np.concatenate([held, got], axis=1)
            if held.shape[1] < _CHUNK and not last:
                continue
            new = np.flatnonzero((held[:2, 1:] != held[:2, :-1]).any(axis=0)) + 1
            done = held.shape[1] if last else (new[-1] if len(new) else 0)  # the last run may go on
            starts = np.concatenate([[0], new])
            starts = starts[starts < done]
            if len(starts):
                fp = held[2, :done]
                a, b = stars(fp.view(np.uint64), starts, np.diff(np.append(starts, done)), radius)
                yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])
            held = held[:, done:].copy()

    return keyed.mapInArrow(run, "a long, b long")


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for batch in batches:
        yield False, batch
    yield True, None


def simhash_groups(docs: DataFrame, words_in_shingle: int = 3, radius: int = MOST_RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links lead to; one row per row of ``docs``.

    Null and empty texts have fingerprint 0 and link with each other and with what is near 0. A null doc_id
    is the smallest of a group only if there is no other. Repeated rows stay. Extra columns are left out.
    """
    own = spool(fingerprints(docs, words_in_shingle), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    member = distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    member = spool(member, "members")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    group = spool(member.join(least, "component").select("fp", "component_id"), "groups")
    return own.join(group, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its group's component_id; identical repeats of a row become one."""
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.withColumn("__row", F.xxhash64("text")).join(stay, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__row"]).drop("__row")
