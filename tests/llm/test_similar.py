import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as C
from roomlens.llm import similar as S


def components(n, links):
    label = list(range(n))
    for i, j in links:
        old, new = max(label[i], label[j]), min(label[i], label[j])
        label = [new if x == old else x for x in label]
    return label


def prints(rng, families, each, most):
    """Families of fingerprints that differ from their first in up to ``most`` bits."""
    out = []
    for _ in range(families):
        base = rng.integers(0, 2, S.WIDTH).astype(np.uint8)
        for k in range(each):
            own = base.copy()
            own[rng.choice(S.WIDTH, (k * most) // each, replace=False)] ^= 1
            out.append(np.packbits(own, bitorder="little"))
    return np.stack(out).view(np.uint64)


@pytest.mark.parametrize("families, each", [(1, 60), (6, 9), (40, 1), (3, 30)])
def test_trees_connect_what_all_pairs_connect(families, each):
    rng = np.random.default_rng(families)
    fp = prints(rng, families, each, 240)
    fp = fp[rng.permutation(len(fp))]
    links = [(i, j) for i, j in combinations(range(len(fp)), 2) if np.bitwise_count(fp[i] ^ fp[j]).sum() <= 155]
    want = components(len(fp), links)
    for of in (S.tree(fp, 155), S.linked(fp, np.array([0]), np.array([len(fp)]), 155)):
        pairs = list(zip(*(x.tolist() for x in of), strict=True))
        assert components(len(fp), pairs) == want and set(map(tuple, map(sorted, pairs))) <= set(links)
    assert len(S.tree(fp, 155)[0]) < len(fp)


def test_wide_fingerprints_tell_similarity():
    rng = np.random.default_rng(3)
    for n, cut in ((40, 4), (400, 44), (4000, 444)):
        sets = rng.integers(0, 1 << 63, n + cut, np.uint64)
        apart = S._apart(*(np.frombuffer(S.wide(np.sort(x)), np.uint64) for x in (sets[:n], sets[cut:])))
        assert abs(apart / S.WIDTH - S.differing((n - cut) / (n + cut))) < 0.06
    assert S.wide(np.zeros(0, np.uint64)) == bytes(128)
    assert 0.4 < np.mean([np.unpackbits(np.frombuffer(S.wide(rng.integers(0, 1 << 63, 2, np.uint64)), np.uint8)).mean() for _ in range(50)]) < 0.6


def copies(rng, texts, each):
    """Texts of 150 words, and copies with up to six words replaced."""
    rows = []
    for t in range(texts):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for k in range(each):
            own = list(words)
            for at in rng.sample(range(150), k % 7):
                own[at] = f"x{rng.randrange(5000)}"
            rows.append((t * 100 + k, " ".join(own)))
    return rows


def test_groups_against_all_pairs(spark):
    """Pairs at 0.85 and more are linked, those under 0.75 aren't; 0.97 of the pairs within the radius meet."""
    rows = copies(random.Random(3), 60, 7)
    sets = [set(S.shingles(t).tolist()) for _, t in rows]
    group = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sure = {t * 100: t for t in range(60)}
    for t in range(60):
        own = range(7 * t, 7 * t + 7)
        likely = components(7, [(i, j) for i, j in combinations(range(7), 2) if len(sets[own[i]] & sets[own[j]]) >= 0.85 * len(sets[own[i]] | sets[own[j]])])
        for k, root in enumerate(likely):
            assert group[t * 100 + k] == group[t * 100 + root]
    assert set(group.values()) >= set(sure) and {g // 100 for g in group.values()} == set(range(60))
    fp = np.stack([np.frombuffer(S.wide(S.shingles(t)), np.uint64) for _, t in rows])
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if i // 7 == j // 7 and S._apart(fp[i], fp[j]) <= S.radius(0.8)]
    assert np.mean([group[rows[i][0]] == group[rows[j][0]] for i, j in near]) >= 0.97


def test_blocks_of_a_full_bucket_lose_no_pair(spark):
    rows = spark.range(1000).selectExpr("id % 2 as key", "id")
    met = S.in_blocks(rows, 100).groupBy("key").agg({"id": "collect_list"}).collect()
    assert max(len(r[1]) for r in met) < 250
    pairs = {p for r in met for p in combinations(sorted(r[1]), 2)}
    assert pairs == {(i, j) for i, j in combinations(range(1000), 2) if i % 2 == j % 2}


def test_odd_documents(spark, edge_docs, edge_rows, no_docs):
    got = S.similar_groups(edge_docs).collect()
    assert len(got) == len(edge_rows)
    group = {}
    for r in got:
        group.setdefault(r.doc_id, set()).add(r.component_id)
    empty = [34, 35, 36, 37]
    assert all(group[i] == {34} for i in empty) and group[38] == {38} and group[39] == {39} and group[3] == {3} and group[42] == {42}
    assert S.similar_groups(no_docs).count() == 0


def test_stage_merges_copies_with_a_few_words_replaced(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [r for r in copies(random.Random(5), 20, 4)]  # three words of 150 at most: similarity 0.81 and more to the first
    odd = spark.createDataFrame(rows, "doc_id long, text string").join(docs.drop("doc_id", "text").limit(1)).select(*docs.columns)
    kept = sorted(r.doc_id for r in C.near_duplicates(spark, odd, small).collect())
    assert {i // 100 for i in kept} == set(range(20)) and set(kept) >= {t * 100 for t in range(20)} and len(kept) <= 24
