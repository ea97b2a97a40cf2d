"""BPE encoding and decoding of whole texts, with one text's work spread over many tasks.

Method: tree concatenation. A long text is halved again and again, at any place, inside words too; the leaves are encoded in
parallel, by tasks of their own. Then neighbours are joined, pair by pair up the tree: a window around the join is encoded
again and grows until it agrees with the left side at its start and with the right side at its end. Agreement means

- a word start that the window and the side both have: the splitter looks at nothing before a match, so from a
  common start on both go on alike; or, inside a word longer than the window,
- a run of equal tokens: a token sequence is a BPE encoding if each two neighbours are, so what is exact on
  both sides of a shared token is exact as a whole.

A window that takes in both sides is an encoding of the whole, so the loop always ends with an exact result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .tokens import byte_to_char

#: Characters of a leaf at most, and of a text that is encoded at once.
LEAF = 1 << 15
#: Words whose ids are kept by a worker.
CACHE = 300_000
#: Tokens of each side in the first window, and equal tokens that count as agreement.
WINDOW, AGREE = 16, 4
#: Characters for which lower() and the splitter's classes are the same in all Unicode versions, and which NFC leaves alone.
_PLAIN = re.compile("[\x00-\u012f\u0131-\u0248\u2010-\u2027\u2030-\u205e]*")


class Tokens(NamedTuple):
    """ids; bytes at which each token ends, from the start of its text; whether it starts a word."""

    ids: np.ndarray
    ends: np.ndarray
    first: np.ndarray


class WordBpe:
    """A tokenizers model whose splitter drops white space and whose words are encoded apart from each other."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.model, self.normalizer = self.library.model, self.library.normalizer
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.text = {i: t for t, i in model["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        suffix = model["model"].get("end_of_word_suffix") or ""
        self.size = {i: len(t.removesuffix(suffix) if suffix else t) for i, t in self.text.items()}
        split = next(p for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        spaces = r"\t-\r \x85\xa0"  # of the plain characters; others go through the library's splitter
        self.word = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", f"[^{spaces}"))
        self.splitter = self.library.pre_tokenizer
        self.char = byte_to_char()
        self.known: dict[str, tuple[int, ...]] = {}

    def normal(self, text: str) -> str:
        if _PLAIN.fullmatch(text):
            return text.lower()
        return self.normalizer.normalize_str(text)

    def _of_word(self, word: str) -> tuple[int, ...]:
        ids = tuple(t.id for t in self.model.tokenize("".join(map(self.char.__getitem__, word.encode()))))
        if len(self.known) >= CACHE:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = ids
        return ids

    def _words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.word.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def encode_normal(self, text: str) -> list[int]:
        """ids of a normalised text without special tokens."""
        known, of = self.known, self._of_word
        return list(chain.from_iterable([known.get(w) or of(w) for w in self._words(text)]))

    def encode(self, text: str) -> list[int]:
        """ids of a text; what the library gives with add_special_tokens=False."""
        ids: list[int] = []
        for part in self.parts(text):
            ids += [self.special[part]] if part in self.special else self.encode_normal(self.normal(part))
        return ids

    def parts(self, text: str) -> list[str]:
        """The text cut at special tokens, these included."""
        return [p for p in self.cut.split(text) if p] if self.cut and "<" in text else [text]

    def decode(self, ids: list[int]) -> str:
        """What the library gives with skip_special_tokens=False."""
        return " ".join(map(self.text.__getitem__, ids))

    def tokens(self, text: str) -> Tokens:
        """Of a normalised text, with places."""
        if _PLAIN.fullmatch(text):
            spans = [(m.start(), m.end()) for m in self.word.finditer(text)]
        else:
            spans = [place for _, place in self.splitter.pre_tokenize_str(text)]
        ids: list[int] = []
        ends: list[int] = []
        first: list[bool] = []
        done = at = 0
        for a, b in spans:
            at += len(text[done:a].encode())
            word = text[a:b]
            got = self.known.get(word) or self._of_word(word)
            for k, i in enumerate(got):
                at += self.size[i]
                ids.append(i)
                ends.append(at)
                first.append(k == 0)
            done = b
        return Tokens(np.array(ids, np.int64), np.array(ends, np.int64), np.array(first, bool))

    def join(self, left: str, a: Tokens, right: str, b: Tokens) -> Tokens:
        """Tokens of left + right from those of both."""
        text, mid = (left + right).encode(), len(left.encode())
        a_starts, b_starts = self._begins(a), self._begins(b) + mid
        b_ends = b.ends + mid
        n = WINDOW
        while True:
            i, j = max(0, len(a.ids) - n), min(len(b.ids), n)
            while i > 0 and (text[a_starts[i]] & 0xC0) == 0x80:  # inside a character
                i -= 1
            while j < len(b.ids) and (text[b_ends[j - 1]] & 0xC0 if b_ends[j - 1] < len(text) else 0) == 0x80:
                j += 1
            lo = int(a_starts[i]) if i else 0
            hi = int(b_ends[j - 1]) if 0 < j < len(b.ids) else len(text)
            w = self.tokens(text[lo:hi].decode())
            w_starts, w_ends = self._begins(w) + lo, w.ends + lo
            head = self._left(a, a_starts, i, w, w_starts)
            tail = self._right(b, b_starts, b_ends, j, w, w_starts, w_ends, mid)
            if head is not None and tail is not None:
                at, upto, back = head, *tail
                return Tokens(
                    np.concatenate([a.ids[:at], w.ids[:upto], b.ids[back:]]),
                    np.concatenate([a.ends[:at], w_ends[:upto], b_ends[back:]]),
                    np.concatenate([a.first[:at], w.first[:upto], b.first[back:]]),
                )
            n *= 2

    def _begins(self, t: Tokens) -> np.ndarray:
        return t.ends - np.array([self.size[i] for i in t.ids.tolist()], np.int64)

    @staticmethod
    def _left(a: Tokens, a_starts: np.ndarray, i: int, w: Tokens, w_starts: np.ndarray) -> int | None:
        """Tokens of the left side that stay, if the window that begins at its token i agrees with it."""
        if i == 0 or a.first[i]:
            return i
        same = min(AGREE, len(a.ids) - i, len(w.ids))
        ok = same == AGREE and np.array_equal(a.ids[i : i + same], w.ids[:same]) and np.array_equal(a_starts[i : i + same], w_starts[:same]) and not a.first[i : i + same].any() and not w.first[1:same].any()
        return i if ok else None

    @staticmethod
    def _right(b: Tokens, b_starts, b_ends, j: int, w: Tokens, w_starts, w_ends, mid: int) -> tuple[int, int] | None:
        """(tokens of the window that are taken, tokens of the right side that go), if both agree."""
        if j == len(b.ids):
            return len(w.ids), len(b.ids)
        ours = {int(s): k for k, s in enumerate(w_starts) if w.first[k] and s > mid}
        for k in range(1, j):
            if b.first[k] and int(b_starts[k]) in ours:
                return ours[int(b_starts[k])], k
        if b.first[1 : j + 1].any():
            return None
        # one word as far as the window goes: a run of equal tokens beyond what the splitter's short rules reach
        ours = {(int(s), int(e), int(t)): k for k, (s, e, t) in enumerate(zip(w_starts, w_ends, w.ids, strict=True)) if s >= mid + 16}
        run = 0
        for k in range(j):
            at = ours.get((int(b_starts[k]), int(b_ends[k]), int(b.ids[k])))
            run = run + 1 if at is not None and not w.first[at] else 0
            if run == AGREE:
                return at + 1, k + 1
        return None

    def tree(self, leaves: list[tuple[str, Tokens]]) -> Tokens:
        """Tokens of the leaves' texts, joined pair by pair."""
        while len(leaves) > 1:
            pairs = [(x[0] + y[0], self.join(*x, *y)) for x, y in zip(leaves[::2], leaves[1::2], strict=False)]
            leaves = pairs + leaves[len(pairs) * 2 :]
        return leaves[0][1] if leaves else Tokens(*(np.zeros(0, t) for t in (np.int64, np.int64, bool)))


def halves(text: str, leaf: int) -> list[str]:
    """Leaves of the tree over ``text``."""
    parts = [text]
    while max(map(len, parts)) > leaf:
        parts = [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :]) if h]
    return parts


@functools.lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def bpe_encode(docs: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded, a row per row of ``docs``.

    Null text counts as empty: no tokens, decoded to the empty text. Repeated rows stay repeated, a null doc_id is
    carried on, extra columns are left out. Texts of more than ``leaf`` characters go through the tree.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids binary, decoded string"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def batch_of(ids_of, got: list[list[int]], bpe: WordBpe) -> pa.RecordBatch:
        cols = [ids_of, pa.array([len(x) for x in got], pa.int64()), pa.array(map(packed, got), pa.binary()), pa.array(map(bpe.decode, got), pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                yield batch_of(part.column(0), [bpe.encode(t) for t in part.column(1).to_pylist()], bpe)

    # long texts: leaves, their tokens, the joined tree
    leaf_cols = f"doc_id {kind}, row string, part int, leaf int, special int, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                row = hashlib.sha256(text.encode()).hexdigest()
                made = []
                for p, part in enumerate(bpe.parts(text)):
                    if part in bpe.special:
                        made.append((p, 0, bpe.special[part], ""))
                    else:
                        made += [(p, k, None, x) for k, x in enumerate(halves(bpe.normal(part), leaf))]
                p, k, s, x = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * len(p), batch.schema.field(0).type), pa.array([row] * len(p)), pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(s, pa.int32()), pa.array(x, pa.string())],
                    ["doc_id", "row", "part", "leaf", "special", "text"],
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            got = [bpe.tokens(t) for t in batch.column("text").to_pylist()]
            more = [pa.array([np.ascontiguousarray(t[k], kind).tobytes() for t in got], pa.binary()) for k, kind in enumerate(("<i8", "<i8", "u1"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "ids", "ends", "first"])

    def join(table: pa.Table) -> pa.Table:
        bpe = word_bpe(tokenizer)
        leaves, specials, copies = {}, {}, 0
        for x in table.to_pylist():
            copies += (x["part"], x["leaf"]) == (0, 0)  # repeated rows have equal leaves
            if x["special"] is not None:
                specials[x["part"]] = x["special"]
            else:
                leaves.setdefault(x["part"], {})[x["leaf"]] = (x["text"], Tokens(*(np.frombuffer(x[c], k).astype(t) for c, k, t in (("ids", "<i8", np.int64), ("ends", "<i8", np.int64), ("first", "u1", bool)))))
        ids: list[int] = []
        for p in range(len(leaves) + len(specials)):
            ids += [specials[p]] if p in specials else bpe.tree([leaves[p][k] for k in sorted(leaves[p])]).ids.tolist()
        return pa.Table.from_batches([batch_of(table["doc_id"][:1].combine_chunks(), [ids], bpe)] * copies)

    long = rows.where(F.length("text") > leaf).mapInArrow(cut, leaf_cols)
    long = long.repartition("doc_id", "row", "part", "leaf").mapInArrow(encode, f"{leaf_cols}, ids binary, ends binary, first binary")
    return rows.where(F.length("text") <= leaf).mapInArrow(short, out).unionByName(long.groupBy("doc_id", "row").applyInArrow(join, out))
