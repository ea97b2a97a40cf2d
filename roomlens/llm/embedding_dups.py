"""Vectors that are close in cosine, by collisions on many one-dimensional projections.

Method: collision counting. Vectors are projected on many random lines; on each line, two vectors collide if
one lies in the window centred at the other. A pair that collides on enough lines is verified by its exact cosine. The
window and the count are calibrated so that a pair right at the threshold passes with the chance ``recall``. A pair that passes misses few
windows, so it is found by sorting on one of the first few lines and looking along the window.

Counting for all pairs of a corpus would be quadratic. So vectors are first dealt to cells, in ``tables`` ways, by the side of zero on which
they lie on a few more lines; windows are looked along in cells only. The number of those lines grows with the logarithm of the number of
vectors, so that cells stay small, and the number of tables follows from the chance that a pair at the threshold shares a cell in at least one.

To the cells go a number and the places on the lines, a byte each (windows are a step wider, so none is lost), and not the vector. Only
vectors with enough collisions in a cell are fetched for it and verified there. A pair that shares several cells is judged in the first only, so its
links are counted once without gathering pairs. Cells of more than ``BLOCK`` vectors (a group of near copies) go straight to verification, split
into blocks and dealt out by pairs of blocks. Equal vectors are made one before all this, with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, spool, whole_runs

#: Vectors in a block; vectors that a cell has on average; steps of a place in a window.
BLOCK, CELL, FINE = 2048, 128, 28


@dataclass(frozen=True)
class Plan:
    """What follows from the threshold, the recall and the number of vectors."""

    threshold: float
    bits: int
    tables: int
    lines: int
    window: float
    count: int

    @classmethod
    def of(cls, n: int, threshold: float = 0.9, recall: float = 0.97, lines: int = 24, inside: float = 0.95) -> Plan:
        """``inside``: chance that a pair at the threshold collides on one line. Half of what ``recall`` leaves goes to cells, half to counts."""
        miss = (1 - recall) / 2
        bits = max(0, round(math.log2(max(1, n / CELL))))
        together = (1 - math.acos(threshold) / math.pi) ** bits
        tables = 1 if bits == 0 else math.ceil(math.log(miss) / math.log1p(-together))
        count, below = 0, 0.0
        while (below := below + math.comb(lines, count) * inside**count * (1 - inside) ** (lines - count)) <= miss:
            count += 1
        width = math.sqrt(2 - 2 * threshold) * NormalDist().inv_cdf(0.5 + inside / 2)
        return cls(threshold, bits, tables, lines, width, count)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell of each unit vector in each table."""
        if not self.bits:
            return np.zeros((len(x), 1), np.int64)
        normal = np.random.default_rng(6).standard_normal((x.shape[1], self.tables * self.bits))
        sides = (x @ normal > 0).reshape(len(x), self.tables, self.bits)
        return (sides << np.arange(self.bits)).sum(axis=2, dtype=np.int64)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Place of each unit vector on each line."""
        return x @ np.random.default_rng(7).standard_normal((x.shape[1], self.lines))

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Places in whole steps, a byte each; what collides is at most FINE + 1 steps apart."""
        return np.clip(np.rint(self.places(x) * (FINE / self.window)), -127, 127).astype(np.int8)


def with_mates(cell: np.ndarray, steps: np.ndarray, plan: Plan) -> np.ndarray:
    """Which vectors collide often enough with another of their cell; ``cell`` is ascending.

    All cells are sorted together on a line, and each vector looks along its window; a pair is judged at the first line where it collides.
    """
    rank = np.cumsum(np.append(False, cell[1:] != cell[:-1])) << 10
    at, has = steps.astype(np.int16), np.zeros(len(cell), bool)
    for line in range(plan.lines - plan.count + 1):
        order = np.argsort(rank + at[:, line], kind="stable")
        place = (rank + at[:, line])[order]
        until = np.searchsorted(place, place + FINE + 1, "right")
        span = until - np.arange(len(place)) - 1
        ends = np.cumsum(span)
        begin = 0
        while begin < len(span):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 20), "right")))
            n = span[begin:end]
            i = np.repeat(np.arange(begin, end), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            i, j = order[i], order[j]
            new = ~(has[i] & has[j])
            i, j = i[new], j[new]
            for earlier in range(line):
                new = np.abs(at[i, earlier] - at[j, earlier]) > FINE + 1
                i, j = i[new], j[new]
            missed = np.zeros(len(i), np.int8)
            for other in range(plan.lines):
                missed += np.abs(at[i, other] - at[j, other]) > FINE + 1
                on = missed <= plan.lines - plan.count
                i, j, missed = i[on], j[on], missed[on]
            has[i] = has[j] = True
            begin = end
    return has


def units(raw: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision of packed doubles of one length."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def collided(places: np.ndarray, i: np.ndarray, j: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those with enough window collisions; a pair leaves as soon as it can't reach the count."""
    missed = np.zeros(len(i), np.int8)
    for line in range(plan.lines):
        missed += np.abs(places[i, line] - places[j, line]) > plan.window
        on = missed <= plan.lines - plan.count
        i, j, missed = i[on], j[on], missed[on]
    return i, j


def window_pairs(places: np.ndarray, plan: Plan, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (one of left and one of right, or two of left) that collide often enough, in portions.

    A pair may miss a few windows, so it is in the window of at least one of the first ``lines - count + 1`` lines; where a group is
    large, the windows on those, sorted, give the candidates; each candidate is taken at the first such line.
    """
    either = right is None
    right = left if either else right
    if len(left) * len(right) <= 1 << 16:
        i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        if either:
            i, j = i[i < j], j[i < j]
        yield collided(places, i, j, plan)
        return
    for line in range(plan.lines - plan.count + 1):
        order = right[np.argsort(places[right, line], kind="stable")]
        on_line = places[order, line]
        lo = np.searchsorted(on_line, places[left, line] - plan.window, "left")
        hi = np.searchsorted(on_line, places[left, line] + plan.window, "right")
        for k in range(0, len(left), 128):
            span = (hi - lo)[k : k + 128]
            i = np.repeat(left[k : k + 128], span)
            j = order[np.repeat(lo[k : k + 128], span) + np.arange(len(i)) - np.repeat(np.cumsum(span) - span, span)]
            ok = i < j if either else np.ones(len(i), bool)
            i, j = i[ok], j[ok]
            for earlier in range(line):
                new = np.abs(places[i, earlier] - places[j, earlier]) > plan.window
                i, j = i[new], j[new]
            yield collided(places, i, j, plan)


def links_in(raw: list[bytes], weight: np.ndarray, block: np.ndarray, x: int, y: int, table: int, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of the links that each vector of a cell's block pair (x, y) has in it, and a star per connected part."""
    e = units(raw)
    cells, places = plan.cells(e), plan.places(e)
    sides = [np.flatnonzero(block == x), None if x == y else np.flatnonzero(block == y)]
    total, label = np.zeros(len(raw), np.int64), np.arange(len(raw))
    for i, j in window_pairs(places, plan, *sides):
        for earlier in range(table):
            new = cells[i, earlier] != cells[j, earlier]
            i, j = i[new], j[new]
        near = np.einsum("ij,ij->i", e[i], e[j]) >= plan.threshold
        i, j = i[near], j[near]
        np.add.at(total, i, weight[j])
        np.add.at(total, j, weight[i])
        while len(i) and (label[i] != label[j]).any():
            low = np.minimum(label[i], label[j])
            for end in (label[i], label[j], i, j):
                np.minimum.at(label, end, low)
            label = label[label]
    while not np.array_equal(label, label[label]):
        label = label[label]
    return total, np.flatnonzero(label != np.arange(len(raw))), label


def embedding_links(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row per row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither do rows with a null
    vec_id or vectors of different lengths. Rows with equal vectors link with each other. kept: the row's vec_id is
    its component_id; rows that repeat a vec_id share it. Extra columns are left out.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.coalesce(~bad & F.exists("e", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("cls", F.when(sound, F.xxhash64(F.size("e"), "e")))
    classes = rows.where("cls is not null").groupBy("cls", "e").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = spool(classes.select("cls", "least", "n", F.size("e").alias("dim"), "e"), "vectors")
    plan = Plan.of(classes.count(), threshold, recall)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = part.column(2).flatten().to_numpy().reshape(part.num_rows, dim)
                x = units([v.tobytes() for v in np.ascontiguousarray(x)])
                cells, tables = plan.cells(x), plan.tables
                key = (cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(tables, dtype=np.uint64) + np.uint64(dim << 20)) * np.uint64(0xD6E8FEB86659FD93)
                steps = [r.tobytes() for r in plan.steps(x)]
                t = np.tile(np.arange(tables, dtype=np.int32), len(x))
                cols = (key.view(np.int64).ravel(), t, np.repeat(part.column(0).to_numpy(), tables))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.repeat(np.array(steps, object), tables), pa.binary())], ["key", "tbl", "cls", "steps"])

    def mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            steps = np.frombuffer(b"".join(table["steps"].to_pylist()), np.int8).reshape(table.num_rows, plan.lines)
            has = pa.array(with_mates(table["key"].to_numpy(), steps, plan))
            yield from table.select(["key", "tbl", "cls"]).filter(has).combine_chunks().to_batches()

    dealt = spool(classes.select("cls", "dim", "e").mapInArrow(deal, "key long, tbl int, cls long, steps binary"), "cells")
    full = spool(dealt.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "full")
    small = dealt.join(full, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(mates, "key long, tbl int, cls long")
    large = dealt.drop("steps").join(full, "key").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("key", "tbl", "cls", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block")
    met = spool(small.select("*", *(F.lit(0).alias(c) for c in ("x", "y", "block"))).unionByName(large), "mates")
    # as bytes, which the Python side reads without a conversion of each component
    packed = classes.select("cls", "n", "dim", "e").mapInArrow(_packed, "cls long, n long, dim int, e binary")
    pair = ["tbl", "key", "dim", "x", "y"]
    placed = met.join(packed, "cls").select("tbl", "key", "dim", "x", "y", "block", "cls", "n", "e").repartition(*pair).sortWithinPartitions(*pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (t, _, _, x, y), table in _runs(batches, pair):
            cls, weight = table["cls"].to_numpy(), table["n"].to_numpy()
            total, member, label = links_in([v.as_py() for v in table["e"]], weight, table["block"].to_numpy(), x, y, t, plan)
            some = np.flatnonzero(total)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.nulls(len(some), pa.int64()), pa.array(total[some])], ["a", "b", "w"])
                yield pa.RecordBatch.from_arrays([pa.array(cls[member]), pa.array(cls[label[member]]), pa.nulls(len(member), pa.int64())], ["a", "b", "w"])

    found = spool(placed.mapInArrow(run, "a long, b long, w long"), "links")
    sums = found.where("w is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("links"))
    joined = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("cls"), "component")
    member = classes.drop("e").join(sums, "cls", "left").join(joined, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    member = spool(member, "members")
    least = member.groupBy("component").agg(F.min("least").alias("first"))
    member = spool(member.join(least, "component").select("cls", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "groups")
    out = rows.select("vec_id", "cls").join(member, "cls", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [np.asarray(v.values, np.float64).tobytes() for v in batch.column(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(raw, pa.binary())], ["cls", "n", "dim", "e"])


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in sorted batches; a run that spans batches is put together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in key])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(keys[:, a].tolist())
            if held and own != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield last, pa.Table.from_batches(held)
