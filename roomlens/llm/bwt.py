"""Burrows-Wheeler transforms of collections of short strings, and their merge by interleave refinement.

A shard's suffixes are sorted once, on its own. Shards are then merged without sorting suffixes again: an interleave
says which shard each place of the merged order comes from, at first simply shard by shard. Each round deals the places stably to
the symbols before their suffixes, which puts them in order of one symbol more; after h rounds the interleave is right for
prefixes of length h. Where two neighbours fall apart in round h, their longest common prefix is h - 1, so the rounds
also give the common prefixes, and the blocks left after h rounds are the intervals of strings that repeat in length h.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Symbol that ends each string, below all others.
END = 0


class Shard(NamedTuple):
    #: symbol before each suffix in suffix order (END for a whole string), and the suffix's place: string * width + offset
    bwt: np.ndarray
    places: np.ndarray
    strings: int


def transform(strings: np.ndarray, first: int = 0) -> Shard:
    """Of the rows of ``strings`` (symbols above END, all of one length); ``first``: number of the first string."""
    n, m = strings.shape
    full = np.zeros((n, m + 1), np.int64)
    full[:, :m] = strings
    rank = np.unique(full, return_inverse=True)[1].reshape(full.shape)
    step = 1
    while step <= m:  # prefix doubling inside each string
        after = np.zeros_like(rank)
        after[:, : m + 1 - step] = rank[:, step:] + 1
        rank = np.unique(rank * (rank.max() + 3) + after, return_inverse=True)[1].reshape(full.shape)
        step *= 2
    order = np.argsort(rank.ravel(), kind="stable")
    before = np.zeros_like(full)
    before[:, 1:] = strings
    return Shard(before.ravel()[order].astype(np.uint16), order + first * (m + 1), n)


class Merged(NamedTuple):
    #: place of each suffix in merged order; block of suffixes that agree in ``depth`` symbols; common prefix with the one before, at most ``depth``
    places: np.ndarray
    block: np.ndarray
    lcp: np.ndarray


def merge(shards: list[Shard], depth: int) -> Merged:
    """The merged order of all shards' suffixes by their first ``depth`` symbols."""
    sizes = np.array([len(s.bwt) for s in shards])
    bwt = np.concatenate([s.bwt for s in shards])
    ends = np.repeat(np.arange(len(shards)), [s.strings for s in shards])  # one end symbol per string, shard by shard
    total = len(bwt)
    interleave = np.repeat(np.arange(len(shards)), sizes)
    block = np.zeros(total, np.int64)
    lcp = np.full(total, depth, np.int16)
    for h in range(1, depth + 1):
        source = _source(interleave)
        symbols = bwt[source]
        going = np.argsort(symbols, kind="stable")
        going = going[np.count_nonzero(symbols == END) :]  # nothing stands before a whole string
        interleave = np.concatenate([ends, interleave[going]])
        of, was = symbols[going], block[going]
        apart = np.concatenate([[True], (of[1:] != of[:-1]) | (was[1:] != was[:-1])])
        new = np.concatenate([np.zeros(len(ends), np.int64), np.cumsum(apart)])
        falls = np.concatenate([[True], new[1:] != new[:-1]]) & (lcp == depth)
        lcp[falls] = h - 1
        block = new
    places = np.concatenate([s.places for s in shards])[_source(interleave)]
    return Merged(places, block, lcp)


def _source(interleave: np.ndarray) -> np.ndarray:
    """Index into the shards' concatenation of each place: the k-th place of a shard is its k-th suffix."""
    order = np.argsort(interleave.astype(np.uint16), kind="stable")
    out = np.empty(len(interleave), np.int64)
    out[order] = np.arange(len(interleave))  # shards lie one after another, in order
    return out
