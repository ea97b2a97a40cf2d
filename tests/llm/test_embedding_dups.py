import numpy as np

from roomlens.llm import embedding_dups as E


def brute(rows, threshold=0.9):
    unit = {}
    for k, (i, e) in enumerate(rows):
        if i is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            x = np.array(e, float)
            unit[k] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    label = {k: k for k in range(len(rows))}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    links = dict.fromkeys(range(len(rows)), 0)
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                label[root(a)] = root(b)
    least = {}
    for k in unit:
        least[root(k)] = min(least.get(root(k), 1 << 62), rows[k][0])
    return [(i, links[k], least[root(k)] if k in unit else i) for k, (i, _) in enumerate(rows)]


def planted(n=600, groups=12, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    for g in range(groups):
        size = 3 + 4 * g
        base[g * 50 : g * 50 + size] = base[g * 50] + rng.standard_normal((size, dim)) * rng.choice([0.05, 0.2, 0.33])
    return [(int(i), [float(v) for v in x]) for i, x in enumerate(base[:n])]


def test_recall_and_no_false_link(spark):
    rows = planted()
    got = {r.vec_id: r for r in E.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    f32 = [(i, [float(np.float32(v)) for v in e]) for i, e in rows]
    want = {i: (n, c) for i, n, c in brute(f32)}
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert np.mean([got[i].component_id == want[i][1] for i in want]) > 0.95


def test_odd_rows(spark):
    e = [1.0, 2.0, 0.5]
    rows = [(1, e), (2, e), (2, [2 * v for v in e]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (None, e), (9, [*e, 0.0]), (10, [-v for v in e]), (11, [1e200, 2e200, 0.5e200]), (1, e)]
    df = spark.createDataFrame([(i, v, 7, 7) for i, v in rows], "vec_id long, embedding array<double>, cls int, n_links int")
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in E.embedding_links(df).collect()))
    assert got == sorted((i is None, i or 0, n, c) for i, n, c in brute(rows))
    assert E.embedding_links(df.limit(0)).count() == 0


def test_blocks_agree_with_one_piece():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16)) * 0.15 + rng.standard_normal(16)
    raw = [v.tobytes() for v in x]
    plan = E.Plan.of(100)
    weight = np.ones(300, np.int64)
    whole, _, _ = E.links_in(raw, weight, np.zeros(300, np.int32), 0, 0, 0, plan)
    block = (np.arange(300) % 3).astype(np.int32)
    split = np.zeros(300, np.int64)
    for a in range(3):
        for b in range(a, 3):
            own = np.flatnonzero((block == a) | (block == b))
            split[own] += E.links_in([raw[i] for i in own], weight[own], block[own], a, b, 0, plan)[0]
    assert np.array_equal(whole, split)
    u = E.units(raw)
    assert np.array_equal(whole, (u @ u.T >= 0.9).sum(axis=1) - 1) or whole.sum() >= 0.95 * ((u @ u.T >= 0.9).sum() - 300)


def test_sorted_windows_find_what_all_pairs_find():
    rng = np.random.default_rng(5)
    x = E.units([v.tobytes() for v in rng.standard_normal((400, 8))])
    plan = E.Plan.of(100)
    places = plan.places(x)
    i, j = np.triu_indices(400, 1)
    want = set(zip(*(v.tolist() for v in E.collided(places, i, j, plan)), strict=True))
    found = [p for a, b in E.window_pairs(places, plan, np.arange(400), None) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(found) == len(set(found))
    assert set(found) == want


def test_mates_are_all_that_collide():
    rng = np.random.default_rng(8)
    x = E.units([v.tobytes() for v in np.concatenate([rng.standard_normal((300, 8)), rng.standard_normal(8) + 0.2 * rng.standard_normal((100, 8))])])
    plan, cell = E.Plan.of(100), np.sort(rng.integers(0, 9, 400))
    has = E.with_mates(cell, plan.steps(x), plan)
    i, j = np.triu_indices(400, 1)
    i, j = (v[cell[i] == cell[j]] for v in (i, j))
    sure, at = np.unique(np.concatenate(E.collided(plan.places(x), i, j, plan))), plan.steps(x).astype(int)
    assert has[sure].all()
    near = (np.abs(at[i] - at[j]) <= E.FINE + 1).sum(axis=1) >= plan.count
    assert set(np.flatnonzero(has).tolist()) == set(i[near].tolist()) | set(j[near].tolist())


def at_threshold(n, pairs, dim=48, seed=3):
    """Random vectors, and partners of some of them at a cosine of 0.900 to 0.910."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((pairs, dim))
    away -= (away * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.91, (pairs, 1))
    return np.concatenate([x, c * x[:pairs] + np.sqrt(1 - c * c) * away])


def test_recall_at_the_threshold(spark):
    x = at_threshold(5000, 1000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in E.embedding_links(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert all(got[i].n_links <= n for i, n in enumerate(near.sum(axis=1).tolist()))
    assert sum(r.n_links for r in got.values()) >= 0.95 * near.sum()


def test_full_cells_are_split_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 40)
    test_recall_and_no_false_link(spark)
