import hashlib
from collections import Counter

import numpy as np
import pytest

from roomlens.llm import suffix_dedup as D
from roomlens.llm.bwt import merge, transform


def brute(texts, m):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + m] for d in data for i in range(len(d) - m + 1))
    out = []
    for d in data:
        on = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - m + 1):
            if seen[d[i : i + m]] > 1:
                on[i] += 1
                on[i + m] -= 1
        on = np.cumsum(on)[: len(d)] > 0
        kept = np.frombuffer(d, np.uint8)[~on].tobytes()
        out.append((len(d), int(on.sum()), int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("limit", [512, 1])
def test_as_brute_force(edge_docs, edge_rows, monkeypatch, limit):
    monkeypatch.setattr(D, "LIMIT", limit)  # 1: all open groups go the way of hot ones
    rows = [(i, t) for i, t in edge_rows if len(t or "") < 60_000]
    got = D.suffix_dedup(edge_docs.where("text is null or length(text) < 60000"), 100)
    assert set(got.columns) == set(edge_docs.columns) | {"n_removed", "n_spans"}
    want = Counter((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 100), strict=True))
    found = got.collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == want
    assert all(r.text == bytes(r.kept).decode(errors="ignore") for r in found)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_in_other_texts(spark, seed):
    rng = np.random.default_rng(seed)
    say = lambda letters, n: "".join(rng.choice(list(letters), n))
    base, texts = [say("abcdefgh é", 600) for _ in range(3)], []
    for _ in range(60):
        b, a = base[rng.integers(0, 3)], int(rng.integers(0, 300))
        z = a + int(rng.integers(50, 300))
        texts.append([b[a:z], say("abcdefghijk", 80) + b[a:z] + say("abc", 60), b, "Der " * int(rng.integers(1, 120)), say("xyz", 30) + b[a:z] + "-" + b[a + 3 : z]][rng.integers(0, 5)])
    got = D.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 100).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == brute(texts, 100)


def test_empty(no_docs):
    assert D.suffix_dedup(no_docs).count() == 0


def test_owners_of_windows():
    """Each string has one first anchor, the leftmost least hash of its window."""
    rng = np.random.default_rng(3)
    for data in (bytes(rng.integers(97, 100, 900).astype(np.uint8)), b"abcd" * 200, b"a" * 500, b"short"):
        at, first, last = D.anchors(data, 100, 62)
        owned = [p for a, b in zip(first.tolist(), last.tolist(), strict=True) for p in range(a, b + 1)]
        assert owned == list(range(max(0, len(data) - 99)))
        assert all(lo <= hi <= a < lo + 62 + (hi - lo) for a, lo, hi in zip(at.tolist(), first.tolist(), last.tolist(), strict=True))


def test_merge_is_the_order_of_all_suffixes():
    rng = np.random.default_rng(0)
    for _ in range(15):
        n, m, depth = (int(v) for v in rng.integers((2, 3, 1), (40, 12, 9)))
        s = rng.integers(1, 3, (n, m))
        cuts = [0, *sorted(rng.integers(0, n + 1, 3).tolist()), n]
        merged = merge([transform(s[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a], depth)
        suffix = [(*s[p // (m + 1)][p % (m + 1) :].tolist(), 0) for p in merged.places.tolist()]
        heads = [x[:depth] for x in suffix]
        assert heads == sorted(heads)
        for k in range(1, len(heads)):
            assert (heads[k] == heads[k - 1]) == (merged.block[k] == merged.block[k - 1])
            if heads[k] != heads[k - 1]:
                common = next(i for i, (x, y) in enumerate(zip(suffix[k], suffix[k - 1], strict=False)) if x != y)
                assert merged.lcp[k] == common


def test_documents_at_the_length_of_the_contract(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id")
    rows = docs.select("doc_id", "text").collect()
    got = D.suffix_dedup(docs).orderBy("doc_id").collect()
    want = brute([r.text for r in rows], 400)
    assert sum(n for _, n, *_ in want) > 0
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == [(r.doc_id, *w) for r, w in zip(rows, want, strict=True)]


def test_copies_of_a_row(spark):
    """2,000 copies of one row, with another row that shares a part of it."""
    rng = np.random.default_rng(7)
    base, tail = ("".join(rng.choice(list("abcdefgh "), n)) for n in (700, 300))
    rows = spark.range(2000).selectExpr("5L as doc_id", f"'{base}' as text").unionByName(spark.createDataFrame([(6, base[100:600] + tail)], "doc_id long, text string"))
    got = D.suffix_dedup(rows).collect()
    assert all((r.n_removed, r.n_spans) == ((700, 1) if r.doc_id == 5 else (500, 1)) for r in got) and len(got) == 2001


def test_query_shows_what_is_left(spark, small):
    """After the columns of the contract the query has the text that its digest is of (without the rest of a character that a cut goes through)."""
    from roomlens.llm import queries as Q

    got = Q.op2_suffix_dedup(spark, small)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    rows, before = got.collect(), {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(before) and any(r.n_removed for r in rows)
    for r in rows:
        left = r.text.encode()
        assert (r.text == before[r.doc_id]) == (r.n_removed == 0)
        if len(left) == r.n_bytes - r.n_removed:
            assert hashlib.sha256(left).hexdigest() == r.kept_sha256
