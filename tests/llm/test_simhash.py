import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from roomlens.llm import simhash as S


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def parts(fp, radius=2):
    label = list(range(len(fp)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if bin(int(fp[i]) ^ int(fp[j])).count("1") <= radius:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(fp))]


def test_groups_as_brute_force(edge_docs, edge_rows):
    rows = [(i, t if t is None or len(t) < 60_000 else t[:60_000]) for i, t in edge_rows]
    fp = [fingerprint(t) for _, t in edge_rows] if rows else []
    group = parts(fp)
    least = {g: min((i for (i, _), h in zip(edge_rows, group, strict=True) if h == g and i is not None), default=None) for g in group}
    got = S.simhash_groups(edge_docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == Counter((i, f, least[g]) for (i, _), f, g in zip(edge_rows, fp, group, strict=True))


def test_one_of_each(edge_docs):
    kept = S.one_of_each(edge_docs, S.simhash_groups(edge_docs))
    groups = {r.component_id for r in S.simhash_groups(edge_docs).collect()}
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == groups


def test_empty(no_docs):
    assert S.simhash_groups(no_docs).count() == 0
    assert S.one_of_each(no_docs, S.simhash_groups(no_docs)).count() == 0


@pytest.mark.parametrize("size", [2, 5, 64, 65, 2500])
def test_buckets(size):
    rng = np.random.default_rng(size)
    fp = np.unique(rng.integers(0, 1 << 63, 1, np.uint64) ^ rng.integers(0, 1 << (16 if size > 100 else 6), size, np.uint64))
    a, b = S.stars(fp, np.array([0]), np.array([len(fp)]), 2)
    assert len(a) < len(fp)
    label = np.arange(len(fp))
    label[a] = b
    want = parts(fp.tolist()) if len(fp) < 400 else None
    if want:
        assert len(set(zip(label.tolist(), want, strict=True))) == len(set(want)) == len(set(label.tolist()))
    for i, j in zip(a, b, strict=True):
        assert j < i


def test_chains_and_hubs_join(spark):
    """A chain of fingerprints two bits apart is one group, whatever the distance of its ends."""
    chain = [0]
    for k in range(20):
        chain.append(chain[-1] ^ (3 << 3 * k))
    far = (1 << 63) | 0x5555
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in [*chain, far]], "fp long")
    from roomlens.llm.common import components

    got = {r.node: r.component for r in components(S.links(df)).collect()}
    assert set(got) == set(chain)
    assert set(got.values()) == {0}


def test_components_of_random_graphs(spark):
    from roomlens.llm.common import components

    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(7, 7), (1000, 1000 + 1), (1000, None)] + [(5000, 5000 + k) for k in range(1, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        if b is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            if b is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
