import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from roomlens.llm.packing import Bins, first_fit_decreasing, pack
from roomlens.llm.tokens import byte_bpe, library

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_every_id_lies_in_one_piece(edge_docs, edge_rows):
    got = pack(edge_docs, PATH, size=64, group=10).collect()
    want = Counter((i, np.array([*library(PATH).encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in edge_rows)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 > 0
        pieces[r.doc_id].append((r.start, r.doc_tokens, bytes(r.ids)))
        bins[r.sequence_id].append((r.offset, r.length))
    for filled in bins.values():
        at = 0
        for offset, length in sorted(filled):
            assert offset == at
            at += length
        assert at <= 64
    for i in {i for i, _ in edge_rows}:
        texts = [ids for (j, ids), n in want.items() for _ in range(n) if j == i]
        assert Counter((s, len(ids) // 4, ids[4 * s : 4 * (s + 64)]) for ids in texts for s in range(0, len(ids) // 4, 64)) == Counter(pieces[i])


def test_empty(no_docs):
    assert pack(no_docs, PATH).count() == 0


def test_tree_is_first_fit():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    free, want = [], [None] * 500
    for i in sorted(range(500), key=lambda i: (-lengths[i], i)):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), None)
        if b is None:
            b = len(free)
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= lengths[i]
    assert first_fit_decreasing(lengths, 100) == want


def test_bins_refuse_what_is_too_long():
    with pytest.raises(ValueError, match="doesn't fit"):
        Bins(1, 10).put(11)


def test_little_padding():
    rng = random.Random(2)
    lengths = [rng.randint(1, 1023) for _ in range(4000)]
    bins = 1 + max(b for b, _ in first_fit_decreasing(lengths, 1024))
    assert sum(lengths) / (bins * 1024) > 0.98


def test_ids_are_the_library_s():
    encode = byte_bpe(PATH)
    for text in ("", " ", "<|endoftext|>a<|endoftext|>", "I'll  go\n\n\t x", "é日本😀\x00\x1c", "a" * 5000, " " * 3000 + "x", "1234567 !!!"):
        assert encode(text) == library(PATH).encode(text, add_special_tokens=False).ids


def test_copies_of_a_row_are_spread(spark):
    """3,000 copies of one row and a very long text: groups stay small, and each id lies in one piece."""
    rows = spark.range(3000).selectExpr("7L as doc_id", "'one two three' as text").unionByName(spark.createDataFrame([(8, "word " * 30_000)], "doc_id long, text string"))
    got = pack(rows, PATH, group=50).toPandas()
    own = got[got.doc_id == 7]
    assert len(own) == 3000 and own.ids.nunique() == 1
    assert got[got.doc_id == 8].length.sum() == got[got.doc_id == 8].doc_tokens.iloc[0] == 30_002
    assert not got.duplicated(["sequence_id", "offset"]).any()
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 1024
    packed = own.groupby(own.sequence_id // (1 << 32)).size()
    assert packed.max() < 100 and len(packed) > 40
