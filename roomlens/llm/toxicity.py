"""A toxicity score from the nearest labelled examples.

Method: exact TF-IDF cosine by a block-max index, over all terms of the sampled examples. Examples lie in blocks of similar ones; for each
term and block the largest weight is kept. A batch of texts first gets a bound of its cosines for every block; the most promising
blocks are scored whole, and then only those whose bound reaches the k-th best cosine found so far. No cosine that could
be among the k best is left out. The votes of the k nearest, weighted by closeness, are turned into a probability by a
logistic curve fitted on examples' own left-out votes. The neighbours' ids are the evidence.

Terms are words, all of them. A term's idf is multiplied by how far it tells the classes apart (the square of the
log of its odds, plus a little, so that no term is without weight): a text has no neighbours only if no example holds any of its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame

from .sample import labelled

#: Examples of a class and neighbours at most; examples whose left-out votes set the curve; texts scored at once.
PER_CLASS, NEIGHBOURS, CURVE, AT_ONCE = 6000, 15, 2000, 96
#: Examples of a block; terms with a bound for each block (the others' postings are few, and are added up whole).
BLOCK, DENSE = 64, 2048
#: Least weight of a term for telling the classes apart, and what is added to its counts before.
LEAST, SMOOTH = 0.001, 2.0
#: Cosines are taken in single precision, and are ties if this close.
TIE = 1e-6
_WORD = re.compile(r"[^\W\d_]+")


def term_counts(text: str) -> Counter[str]:
    return Counter(_WORD.findall(text.lower()))


@dataclass
class Index:
    """Terms with weights; per term its examples (ascending) and how often each holds it."""

    terms: list[str]
    idf: np.ndarray
    starts: np.ndarray
    postings: np.ndarray
    counts: np.ndarray
    y: np.ndarray
    ids: np.ndarray
    #: weight of each example's vote: labelled rows of its class over examples of it
    share: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    #: made again where the index is used
    made: dict = field(default_factory=dict)
    #: as it was sent to the executors, before its curve was known
    sent: Broadcast | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": {}, "sent": None, "terms": "\n".join(self.terms)}  # terms are letters

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"terms": state["terms"].split("\n") if state["terms"] else []})

    def parts(self) -> _Blocks:
        """The blocks, made from the postings where the index is used."""
        if "blocks" not in self.made:
            self.made["blocks"] = _Blocks.of(self)
        return self.made["blocks"]

    def places(self) -> dict[str, int]:
        if "places" not in self.made:
            self.made["places"] = {t: i for i, t in enumerate(self.terms)}
        return self.made["places"]

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit weights of a text."""
        place = self.places()
        counts = [(place[t], n) for t, n in term_counts(text).items() if t in place]
        at, n = np.array(counts, np.int64).reshape(-1, 2).T
        order = np.argsort(at)
        return weighted(at[order], n[order].astype(float), self.idf)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above zero, best first, ties by place; without the example ``but``."""
        return self.nearest_of([(terms, weights)], k, [but])[0]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each vector."""
        b = self.parts()
        out, n = [], len(b.order)
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        asked = np.zeros((len(vectors), b.heavy.shape[2]), np.float32)
        rest = np.zeros((len(vectors), len(b.heavy) * BLOCK), np.float32)
        for i, (terms, weights) in enumerate(vectors):
            r = b.row[terms]
            asked[i, r[r >= 0]] = weights[r >= 0]
            few = terms[r < 0]
            low, size = b.starts[few], b.starts[few + 1] - b.starts[few]
            at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            rest[i] = np.bincount(b.postings[at], b.weights[at] * np.repeat(weights[r < 0], size), rest.shape[1])
        bound = asked @ b.most + rest.reshape(len(vectors), -1, BLOCK).max(axis=2)
        cosines = np.zeros_like(rest)
        least = np.full(len(vectors), TIE)
        first = np.argsort(-bound, axis=1, kind="stable")
        blocks, rows = cosines.reshape(len(vectors), -1, BLOCK), np.arange(len(vectors))[:, None]
        left = np.full(len(vectors), -1) if but is None else np.array(but)
        for since, upto in ((0, 2), (2, 2 + len(b.heavy) // 16), (2 + len(b.heavy) // 16, len(b.heavy))):
            todo = np.zeros(bound.shape, bool)
            todo[rows, first[:, since:upto]] = True
            todo &= bound >= least[:, None] - TIE
            for block in np.flatnonzero(todo.any(axis=0)).tolist():
                who = np.flatnonzero(todo[:, block])
                blocks[who, block] = asked[who] @ b.heavy[block].T + rest[who, block * BLOCK : block * BLOCK + BLOCK]
            cosines[np.flatnonzero(left >= 0), b.place[left[left >= 0]]] = 0.0
            seen = blocks[rows, first[:, :upto]].reshape(len(vectors), -1)
            if upto < len(b.heavy) and seen.shape[1] > k:
                least = np.maximum(np.partition(seen, -k, axis=1)[:, -k], TIE)
        for cos, floor in zip(cosines, least.tolist(), strict=True):
            best = np.flatnonzero(cos[:n] >= max(floor - TIE, TIE))
            near, best = np.round(cos[best].astype(float), 6), b.order[best]
            order = np.lexsort((best, -near))[:k]
            out.append((best[order], near[order]))
        return out

    def vote(self, best: np.ndarray, cos: np.ndarray) -> float:
        """Share of toxic votes: an example counts by its closeness; a little weight lies on the prior."""
        w = self.share[best] / (1.05 - np.minimum(cos, 1.0))
        return float((w @ self.y[best] + self.prior) / (w.sum() + 1))


def calibrated(vote: float, slope: float, shift: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(slope * np.log(vote / (1 - vote)) + shift, -30, 30))))


@dataclass
class _Blocks:
    """Examples in blocks: ``order`` names the example of each place, ``place`` the place of each example.

    heavy: (blocks, examples of a block, frequent terms) weights; most: (frequent terms, blocks) the largest of them; row: of a term among
    the frequent ones, or -1; starts, postings, weights: places and weights of the other terms.
    """

    order: np.ndarray
    place: np.ndarray
    heavy: np.ndarray
    most: np.ndarray
    row: np.ndarray
    starts: np.ndarray
    postings: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, index: Index) -> _Blocks:
        n, sizes = len(index.ids), np.diff(index.starts)
        term = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        w = (1 + np.log(index.counts)) * index.idf[term]
        w /= np.sqrt(np.bincount(index.postings, w * w, n))[index.postings]
        # similar examples: of one class, and with the same heaviest term
        best, heaviest = np.zeros(n), np.full(n, -1, np.int64)
        np.maximum.at(best, index.postings, w)
        tops = w == best[index.postings]
        heaviest[index.postings[tops]] = term[tops]
        order = np.lexsort((np.arange(n), heaviest, index.y))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        often = np.sort(np.argsort(-sizes, kind="stable")[:DENSE])
        row = np.full(len(sizes), -1, np.int32)
        row[often] = np.arange(len(often))
        heavy = np.zeros((-(-n // BLOCK) * BLOCK, len(often)), np.float32)
        frequent = row[term] >= 0
        heavy[place[index.postings[frequent]], row[term[frequent]]] = w[frequent]
        heavy = heavy.reshape(-(-n // BLOCK), BLOCK, len(often))
        rare = np.where(row < 0, sizes, 0)
        return cls(order, place, heavy, np.ascontiguousarray(heavy.max(axis=1).T), row, np.concatenate([[0], np.cumsum(rare)]), place[index.postings[~frequent]].astype(np.int32), w[~frequent])


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms ``at`` (ascending) and their weights, of length one together."""
    w = (1 + np.log(counts)) * idf[at]
    return at, w / np.sqrt(w @ w) if len(at) else w


def unit(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(sorted(counts), np.int64)
    return weighted(at, np.array([counts[t] for t in at.tolist()], float), idf)


def build(terms: list[str], df: np.ndarray, n: int, ids: np.ndarray, y: np.ndarray, counts: list[dict[int, int]], share: dict[int, float]) -> Index:
    """``df``: examples of ``n`` that hold each term; ``share``: labelled rows for each example, by class."""
    flat = lambda values: np.fromiter((x for c in counts for x in values(c)), np.int32)
    return assembled(terms, df, n, ids, y, np.repeat(np.arange(len(ids), dtype=np.int32), [len(c) for c in counts]), flat(dict.keys), flat(dict.values), share)


def assembled(terms: list[str], df: np.ndarray, n: int, ids: np.ndarray, y: np.ndarray, example: np.ndarray, at: np.ndarray, times: np.ndarray, share: dict[int, float]) -> Index:
    """As ``build``, of single terms: their examples, numbers, and how often they stand there."""
    toxic_df = np.bincount(at[y[example] == 1], minlength=len(terms))
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(terms)))]).astype(np.int64)
    clean_df = np.diff(starts) - toxic_df
    odds = np.log((toxic_df + SMOOTH) / ((y == 1).sum() + 2 * SMOOTH) / ((clean_df + SMOOTH) / ((y == 0).sum() + 2 * SMOOTH)))
    idf = (np.log((1 + n) / (1 + df)) + 1) * (odds * odds + LEAST)
    votes_of = np.array([share.get(int(v), 1.0) for v in y])
    toxic, empty = float(votes_of @ y), np.bincount(example, minlength=len(ids)) == 0
    # the share of toxic ones among texts without a term of the index, which have no neighbours
    prior = float((votes_of[empty] @ y[empty] + 0.01) / (votes_of[empty].sum() + 1)) if empty.any() else min(0.5, max(0.01, toxic / max(votes_of.sum(), 1)))
    order = np.argsort(at, kind="stable")
    return Index(terms, idf, starts, example[order], times[order], y.astype(float), ids, votes_of / max(votes_of.mean(), 1e-12) if len(y) else votes_of, prior)


def platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of a weighted logistic curve, by Newton steps with a weak pull to the identity."""
    a, b, w = 1.0, 0.0, w / w.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (y - p)) @ x - (a - 1), (w * (y - p)).sum() - b])
        h = w * p * (1 - p)
        step = np.linalg.solve(np.array([[h @ (x * x) + 1, h @ x], [h @ x, h.sum() + 1]]), g)
        a, b = max(0.05, a + step[0]), b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def toxicity_index(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> Index:
    """Built from at most ``per_class`` labelled documents of each class for which ``usable`` (on doc_id) holds, with all their terms."""
    rows, labelled_counts = labelled(docs, labels, "toxic", usable, per_class)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[str] = set()
            for text in batch.column(0).to_pylist():
                found.update(term_counts(text))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["term"])

    terms = rows.select("text").mapInArrow(held, "term string").distinct().toArrow()["term"]  # of at most 2 x per_class texts
    terms = sorted(terms.to_pylist())
    shared = docs.sparkSession.sparkContext.broadcast("\n".join(terms))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value.split("\n"))}
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            got = [{place[t]: min(c, 32767) for t, c in term_counts(text).items()} for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(g) for g in got], pa.list_(pa.int32())), pa.array([list(g.values()) for g in got], pa.list_(pa.int16()))], ["doc_id", "y", "t", "c"])

    got = rows.select("doc_id", "y", "text").mapInArrow(vectors, "doc_id long, y int, t array<int>, c array<smallint>").toArrow()
    shared.unpersist()
    y, ids = (got[c].to_numpy() for c in ("y", "doc_id"))
    order = np.lexsort((ids, -y))
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids), dtype=np.int32)
    example = np.repeat(place, pc.list_value_length(got["t"]).to_numpy())
    at, times = (pc.list_flatten(got[c]).to_numpy() for c in ("t", "c"))
    del got
    y, ids = y[order], ids[order]
    share = {c: labelled_counts.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
    index = assembled(terms, np.bincount(at, minlength=len(terms)).astype(float), len(y), ids, y, example, at, times, share)
    del example, at, times
    index.sent = docs.sparkSession.sparkContext.broadcast(index)  # of a bounded number of examples and their terms
    if 0 < y.sum() < len(y):
        index.slope, index.shift = _curve(rows, index)
    return index


def _curve(rows: DataFrame, index: Index) -> tuple[float, float]:
    """Slope and shift from the left-out votes of CURVE examples, the same share of each class; the voting is done by the executors."""
    sent = index.sent
    asked = dict.fromkeys(index.ids[np.unique(np.linspace(0, len(index.ids) - 1, min(CURVE, len(index.ids))).astype(np.int64))].tolist())

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        place = {i: k for k, i in enumerate(index.ids.tolist())}
        for batch in batches:
            mine = [(place[i], text) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if i in asked]
            for k in range(0, len(mine), AT_ONCE):
                own = mine[k : k + AT_ONCE]
                near = index.nearest_of([index.vector(text) for _, text in own], but=[p for p, _ in own])
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.int64()), pa.array([index.vote(*found) for found in near], pa.float64())], ["place", "vote"])

    got = rows.select("doc_id", "text").mapInArrow(voted, "place long, vote double").toArrow().sort_by("place")  # at most CURVE rows
    place, votes = got["place"].to_numpy(), got["vote"].to_numpy()
    return platt(np.log(votes / (1 - votes)), index.y[place], index.share[place])


def toxicity(docs: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score and evidence (doc_ids of the neighbours, nearest first), a row per row of ``docs``.

    Null and empty texts have no terms: no neighbours, the prior's score. Repeated rows stay; a null
    doc_id is carried on. Extra columns are left out. With no labelled examples all scores are the same.
    """
    sent = index.sent or docs.sparkSession.sparkContext.broadcast(index)
    slope, shift = index.slope, index.shift
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for part in (batch.slice(i, AT_ONCE) for i in range(0, batch.num_rows, AT_ONCE)):
                score, near = [], []
                for best, cos in index.nearest_of([index.vector(text or "") for text in part.column(1).to_pylist()], k):
                    score.append(calibrated(index.vote(best, cos), slope, shift))
                    near.append(index.ids[best].tolist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array(near, pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence array<long>")
