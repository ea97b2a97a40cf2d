"""SimHash near-duplicates at a similarity threshold: wide fingerprints of word shingles, for distances far beyond a few bits.

Method: as in simhash.py, pivot distance tables over SimHash fingerprints, but of ``WIDTH`` bits over the set of shingles. Two sets of Jaccard
similarity s differ in a share of at most acos(2s / (1 + s)) / pi of the bits (0.152 at 0.8), so the radius follows from the threshold; the
estimate's standard error at 0.8 is 0.011 of the bits, which is 0.025 of similarity.

1. Fingerprints meet in buckets of equal chosen bits. The bits of a key grow with the logarithm of the number of fingerprints, and
   the number of keys with that, so that a pair at the threshold meets with chance ``RECALL``.
2. In a bucket the first 64 bits rule out most strangers (at a radius that loses 0.3 % of pairs at the threshold, in one bucket).
3. What is left meets once more with all bits. References are taken from the bucket itself: one linked to many settles them at once,
   its distances to all others are kept in a table, and a pair whose distances to any reference differ by more than the radius is
   never compared. (References drawn at random are as far from everything at this radius, so they would discard nothing.)

Of a bucket's links a tree goes on, never all pairs. A bucket of more than ``BLOCK`` members is cut into blocks and each two blocks meet in
a task of their own, so no task grows with a bucket and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, components, spool, whole_runs

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.97
WIDTH, BLOCK, REFERENCES = 1024, 1 << 15, 16
_WORDS = WIDTH // 64
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_TIMES = np.random.default_rng(5).integers(0, 1 << 64, _WORDS, np.uint64) | np.uint64(1)


def differing(similarity: float) -> float:
    """Expected share of differing bits of two sets of that similarity, at most."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float) -> int:
    return int(WIDTH * differing(similarity))


def keys_for(n: int, similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of keys for ``n`` fingerprints: about four strangers in a bucket."""
    bits = max(12, math.ceil(math.log2(max(n, 2))) - 2)
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing(similarity)) ** bits)))


@cache
def chosen_bits(bits: int, keys: int) -> np.ndarray:
    """For each key its bits; all bits are used about equally often."""
    rng = np.random.default_rng(7)
    rounds = [rng.permutation(WIDTH)[: WIDTH // bits * bits].reshape(-1, bits) for _ in range(-(-keys // (WIDTH // bits)))]
    return np.concatenate(rounds)[:keys]


def shingles(text: str | None, words_in_shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the different runs of words, ascending; a shorter text is one run, one without words none."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    whole, k = b" ".join(words), min(words_in_shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.array([xxhash.xxh64_intdigest(whole[a:b]) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def wide(own: np.ndarray) -> bytes:
    """Majority bits over the hashes; in a tie the bit of the least hash, so that short texts aren't biased. All zeros for none."""
    if not len(own):
        return bytes(WIDTH // 8)
    ones, first = np.zeros(WIDTH, np.int64), None
    for k in range(0, len(own), 255):  # so that sums of bytes can't overflow
        h = own[k : k + 255, None] * _TIMES
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        each = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        first = each[0] if first is None else first
        ones += np.add.reduce(each, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones + first > len(own), bitorder="little").tobytes()


def band_keys(fp: np.ndarray, bits: int, keys: int) -> np.ndarray:
    """(fingerprints, keys) hashes of each key's bits, for fingerprints as rows of bytes."""
    at = chosen_bits(bits, keys)
    packed = np.packbits(np.unpackbits(fp, axis=1, bitorder="little")[:, at], axis=2, bitorder="little")
    full = np.zeros((*packed.shape[:2], 8), np.uint8)
    full[:, :, : packed.shape[2]] = packed
    h = full.view(np.uint64)[:, :, 0] + np.arange(keys, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def tree(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) that connect what links of at most ``most`` differing bits connect in one bucket; ``fp``: rows of 64-bit words.

    A search from one member after the other. Distances to the first members of the parts found so far are the table; it
    keeps the latest ``REFERENCES`` of them.
    """
    n = len(fp)
    free, table = np.arange(n), np.zeros((0, n), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(free) > 1:
        root, free = free[0], free[1:]
        own = np.full(n, -1)
        own[free], own[root] = _apart(fp[free], fp[root]), 0
        table = np.concatenate([table, own[None]])[-REFERENCES:]
        near = own[free] <= most
        queue, free = free[near].tolist(), free[~near]
        found.append((np.full(len(queue), root), np.array(queue, np.int64)))
        while queue and len(free):
            at = queue.pop()
            known = table[:, at] >= 0
            maybe = free[(np.abs(table[known][:, free] - table[known, at][:, None]) <= most).all(axis=0)]
            near = maybe[_apart(fp[maybe], fp[at]) <= most]
            if len(near):
                found.append((np.full(len(near), at), near))
                queue += near.tolist()
                free = free[~np.isin(free, near)]
    i, j = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return i, j


def linked(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect each bucket's linked members (a bucket is a run of ``fp``): small buckets many at a time, others by ``tree``."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 16)]).tolist():
        a, b = np.triu_indices(size, 1)
        runs, step = starts[sizes == size], max(1, (1 << 18) // len(a))
        for k in range(0, len(runs), step):
            i, j = ((runs[k : k + step, None] + x).ravel() for x in (a, b))
            near = _apart(fp[i], fp[j]) <= most
            found.append((i[near], j[near]))
    for start, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        i, j = tree(fp[start : start + size], most)
        found.append((i + start, j + start))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return i, j


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def in_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (key, id, ...) with the key of each pair of blocks that a row takes part in, where a bucket has more than ``block`` rows."""
    many = rows.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") * 1.25 / block).cast("int").alias("blocks"))
    out = rows.join(many, "key", "left")
    mine = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("key", F.least(o, mine), F.greatest(o, mine)))
    return out.withColumn("key", F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs))).drop("blocks")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, words_in_shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links lead to; one row per row of ``docs``.

    Documents are linked if their fingerprints tell of a shingle similarity of at least ``similarity`` (0.5 to below 1). Null and empty texts are one
    group. A null doc_id is the smallest of a group only if there is no other. Repeated rows stay. Extra columns are left out.
    """
    if not 0.5 <= similarity < 1:
        raise ValueError("similarity must be from 0.5 to below 1")
    kind, most = docs.schema["doc_id"].dataType.simpleString(), radius(similarity)
    share = differing(similarity)
    loose = math.ceil(64 * share + 3 * math.sqrt(64 * share * (1 - share)))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            fp = [wide(shingles(t, words_in_shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.binary())], ["doc_id", "fp"])

    own = docs.select("doc_id", "text").mapInArrow(prints, f"doc_id {kind}, fp binary").withColumn("id", F.xxhash64("fp"))
    own = spool(own, "wide")
    distinct = spool(own.groupBy("id").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least")), "distinct")
    bits, keys = keys_for(distinct.count(), similarity, recall)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, WIDTH // 8)
            part = np.ascontiguousarray(fp[:, :8]).view(np.int64)[:, 0]
            of = (band_keys(fp, bits, keys).ravel(), np.repeat(batch.column(0).to_numpy(), keys), np.repeat(part, keys))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in of], ["key", "id", "part"])

    def mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            key, part = table["key"].to_numpy(), table["part"].to_numpy().view(np.uint64)
            i, j = linked(part[:, None], *_runs(key), loose)
            has = np.unique(np.concatenate([i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(key[has]), pa.array(table["id"].to_numpy()[has])], ["key", "id"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, 1 << 13):
            fp = np.frombuffer(b"".join(table["fp"].to_pylist()), np.uint64).reshape(-1, _WORDS)
            i, j = linked(fp, *_runs(table["key"].to_numpy()), most)
            ids = table["id"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

    rows = spool(distinct.select("id", "fp").mapInArrow(keyed, "key long, id long, part long"), "keys")
    met = in_blocks(rows).repartition("key").sortWithinPartitions("key").mapInArrow(mates, "key long, id long")
    met = spool(met, "mates").join(distinct.select("id", "fp"), "id").select("key", "id", "fp")
    links = met.repartition("key").sortWithinPartitions("key").mapInArrow(edges, "a long, b long")
    part = components(links).select(F.col("node").alias("id"), "component")
    member = spool(distinct.select("id", "least").join(part, "id", "left").withColumn("component", F.coalesce("component", "id")), "members")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    group = spool(member.join(least, "component").select("id", "component_id"), "groups")
    return own.select("doc_id", "id").join(group, "id").select("doc_id", "component_id")
