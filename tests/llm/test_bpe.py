import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roomlens.llm.bpe import WordBpe, bpe_encode, halves

PATH = public_tokenizers.path("word_bpe_49k.json")
BPE = WordBpe(PATH)
POOL = ["a", "b", "é", "ab", "the ", "  ", "\n", "'s", "'", "'re", "!", "!!", "9", "12", "ß", "Σ", "日本", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "é", "İ", "\x1c", "\x85", " ", "x" * 50, "'" * 20, "I'LL ", "ﬁ", "²", "ª"]


def library(text):
    return BPE.library.encode(text, add_special_tokens=False).ids


def by_tree(text, leaf):
    ids = []
    for part in BPE.parts(text):
        if part in BPE.special:
            ids.append(BPE.special[part])
        elif normal := BPE.normal(part):
            ids += BPE.tree([(h, BPE.tokens(h)) for h in halves(normal, leaf)]).ids.tolist()
    return ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(POOL), max_size=60).map("".join), st.sampled_from([1, 3, 7, 20]))
def test_exact(text, leaf):
    want = library(text)
    assert BPE.encode(text) == want
    assert by_tree(text, leaf) == want
    assert BPE.decode(want) == BPE.library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["ab", "abcdeinth", "rosé", "!?'s"])
def test_words_longer_than_any_window(letters):
    rng = random.Random(letters)
    for leaf in (30, 100, 500):
        text = "".join(rng.choice(letters) for _ in range(3000))
        assert by_tree(text, leaf) == library(text)


def test_rows(edge_docs, edge_rows):
    for leaf in (64, 1 << 15):
        got = bpe_encode(edge_docs, PATH, leaf).collect()
        want = Counter()
        for i, t in edge_rows:
            ids = library(t or "")
            want[(i, len(ids), np.array(ids, "<u4").tobytes(), BPE.library.decode(ids, skip_special_tokens=False))] += 1
        assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == want


def test_empty(no_docs):
    assert bpe_encode(no_docs, PATH).count() == 0
