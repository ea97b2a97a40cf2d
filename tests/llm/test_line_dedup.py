from collections import Counter, defaultdict

from roomlens.llm.line_dedup import line_dedup
from roomlens.llm.twice import suspected, twice_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, chars, docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                held[key(line)].add(i)
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= docs}
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


def test_as_brute_force(edge_docs, edge_rows):
    for chars, docs in ((40, 5), (1, 2), (3, 3)):
        got = line_dedup(edge_docs, chars, docs, 1 << 19)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute(edge_rows, chars, docs)
    assert set(got.columns) == set(edge_docs.columns) | {"n_dropped"}


def test_empty(no_docs):
    assert line_dedup(no_docs).count() == 0


def test_a_filter_that_is_too_small_loses_nothing(spark):
    import numpy as np

    h = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 400_000)
    twice = h[:2000]
    df = spark.createDataFrame([(int(x),) for x in [*h[:50_000], *twice]], "h long").repartition(7)
    assert suspected(twice.view(np.uint64), twice_filter(df, 1 << 19).value).all()
    assert suspected(h[60_000:].view(np.uint64), twice_filter(df, 1 << 22).value).mean() < 0.01


def test_a_pair_of_filters_is_built_in_its_own_size():
    import tracemalloc

    import numpy as np

    from roomlens.llm.twice import MOST, fill

    h = np.random.default_rng(1).integers(0, 1 << 63, 40_000).astype(np.uint64)
    tracemalloc.start()
    once, twice = fill(iter([*np.split(h, 4), h[:500], h[500:900].repeat(2)]), MOST)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < MOST // 4 + (8 << 20)  # 64 MB for both and a batch
    assert suspected(h, once).all() and suspected(h[:900], twice).all() and suspected(h[900:], twice).sum() < 40
