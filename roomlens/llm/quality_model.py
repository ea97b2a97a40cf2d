"""A document quality score by a generalised additive model with pairwise interactions.

Method: shallow trees, boosted cyclically, one feature (then one pair of features) at a time on binned values, add up to a lookup table per
feature and per pair. A score is the sum of the tables' entries at a document's bins: vectorised
additions. The model is fitted on the driver from a bounded sample of labelled feature rows; its tables have a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import labelled

#: Labelled documents of a class that the model is fitted on at most.
PER_CLASS = 15_000
BINS, PAIR_BINS, PAIRS = 64, 12, 8

FEATURES = (
    "log_words", "log_chars_per_word", "spread_of_word_length", "distinct_words", "distinct_pairs", "repeated_neighbours", "log_words_per_line", "repeated_lines", "short_lines",
    "symbols", "bars", "marks", "stops_and_commas", "digits", "letters_beyond_a_z", "all_capital_words", "bars_tabs_returns", "longest_word", "most_frequent_word",
)
_SYMBOL = re.compile(r"[#*$%&<>{}\[\]\\^~=_+/@]")
_MARK = re.compile(r"[!?;:]")
_CAPITAL = re.compile(r"[^\W\d_a-z]")
_DIGIT = re.compile(r"\d")


def features(text: str) -> list[float]:
    """Shape of a text; defined for the empty text too."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [line for line in text.split("\n") if line.strip()]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = set(zip(words, words[1:], strict=False))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(len(words)), np.log(max(1, sizes.sum()) / n), float(sizes.std()), len(counts) / n, len(pairs) / max(1, len(words) - 1), same / n,
        np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), sum(len(x) < 20 for x in lines) / max(1, len(lines)),
        len(_SYMBOL.findall(text)) / n, text.count("|") / n, len(_MARK.findall(text)) / n, (text.count(".") + text.count(",")) / n, len(_DIGIT.findall(text)) / chars,
        len(_CAPITAL.findall(text)) / chars, sum(map(str.isupper, words)) / n, sum(map(text.count, "|\t\r")) / chars, np.log1p(float(sizes.max())), max(counts.values(), default=0) / n,
    ]


def feature_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Additive:
    """Tables of a fitted model."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f])]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.pair_edges[f], x[:, f]), np.searchsorted(self.pair_edges[g], x[:, g])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _step(g: np.ndarray, h: np.ndarray, smooth: float, leaves: int = 3) -> np.ndarray:
    """The shallow tree over bins that lowers the loss most: best split, then best split of a part; value of each bin."""
    cuts = [0, len(g)]
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain_of = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + smooth)
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            gains = gain_of(a, k) + gain_of(k, b) - gain_of(a, b)
            if gains.max() > best:
                best, where = gains.max(), int(k[gains.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + smooth)
    return out


def _pair_step(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """A tree of depth two on two features: a split on one, then a split of each side on the other; and its gain."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        ca, cb = a.cumsum(0).cumsum(1), b.cumsum(0).cumsum(1)
        for i in range(len(a) - 1):
            gain, values = 0.0, np.zeros_like(a)
            for rows, top in ((slice(0, i + 1), True), (slice(i + 1, None), False)):
                left_g, left_h = (ca[i], cb[i]) if top else (ca[-1] - ca[i], cb[-1] - cb[i])
                right_g, right_h = left_g[-1] - left_g, left_h[-1] - left_h
                gains = left_g**2 / (left_h + smooth) + right_g**2 / (right_h + smooth)
                k = int(gains[:-1].argmax())
                gain += gains[k]
                values[rows, : k + 1], values[rows, k + 1 :] = left_g[k] / (left_h[k] + smooth), right_g[k] / (right_h[k] + smooth)
            if gain > best:
                best, out = gain, values.T if flip else values
    return out, best


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 150, rate: float = 0.1, smooth: float = 5.0) -> Additive:
    """Weighted logistic loss; a fifth of the rows says when to stop. With one class only, the score is its (smoothed) share."""
    model = Additive(base=float(np.log((w @ y + 1) / (w @ (1 - y) + 1))) if len(y) else 0.0)
    if len(y) == 0 or y.min() == y.max():
        return model
    cut = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
    model.edges, model.pair_edges = [cut(v, BINS) for v in x.T], [cut(v, PAIR_BINS) for v in x.T]
    bins = [np.searchsorted(e, v) for e, v in zip(model.edges, x.T, strict=True)]
    coarse = [np.searchsorted(e, v) for e, v in zip(model.pair_edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    held = np.arange(len(y)) % 5 == 0
    on = ~held
    at = np.full(len(y), model.base)

    def loss() -> float:
        return float(w[held] @ np.logaddexp(0, np.where(y[held] > 0, -at[held], at[held])))

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-at))
        return (w * (y - p))[on], (w * p * (1 - p))[on]

    def boost(tables: list[np.ndarray], turn) -> None:
        best, kept, patience = loss(), [t.copy() for t in tables], 0
        for _ in range(rounds):
            for k in range(len(tables)):
                turn(k)
            now = loss()
            if now < best - 1e-7 * w.sum():
                best, kept, patience = now, [t.copy() for t in tables], 0
            elif (patience := patience + 1) >= 10:
                break
        for table, old in zip(tables, kept, strict=True):
            table[...] = old

    def one(f: int) -> None:
        g, h = slopes()
        n = len(model.tables[f])
        step = rate * _step(np.bincount(bins[f][on], g, n), np.bincount(bins[f][on], h, n), smooth)
        model.tables[f] += step
        at[:] += step[bins[f]]

    boost(model.tables, one)
    at[:] = model.logit(x)
    g, h = slopes()

    def grid(v: np.ndarray, f: int, k: int) -> np.ndarray:
        m = len(model.pair_edges[k]) + 1
        return np.bincount(coarse[f][on] * m + coarse[k][on], v, (len(model.pair_edges[f]) + 1) * m).reshape(-1, m)

    usable = [f for f in range(x.shape[1]) if len(model.pair_edges[f])]
    gains = {(f, k): _pair_step(grid(g, f, k), grid(h, f, k), smooth)[1] for f, k in combinations(usable, 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((len(model.pair_edges[f]) + 1, len(model.pair_edges[k]) + 1)) for f, k in model.pairs]

    def two(p: int) -> None:
        f, k = model.pairs[p]
        g, h = slopes()
        step = rate * _pair_step(grid(g, f, k), grid(h, f, k), smooth)[0]
        model.pair_tables[p] += step
        at[:] += step[coarse[f], coarse[k]]

    boost(model.pair_tables, two)
    return model


def quality_model(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> Additive:
    """Fitted on labels for which ``usable`` (an expression on doc_id) holds; the classes weigh as in all usable labels."""
    rows, counts = labelled(docs, labels, "quality", usable, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "y", "x"])

    got = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x binary").toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(float)
    x = np.frombuffer(b"".join(v.as_py() for v in got["x"]), np.float64).reshape(len(y), len(FEATURES))
    share = {c: counts.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
    w = np.array([share[int(v)] for v in y])
    return fit(x, y, w / w.mean() if len(w) else w)


def quality_scores(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id and score (0 to 1), a row per row of ``docs``.

    Null text counts as empty and is scored like it. Repeated rows stay; a null doc_id is carried on. Extra columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(feature_rows(part.column(1).to_pylist())))], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, score double")
