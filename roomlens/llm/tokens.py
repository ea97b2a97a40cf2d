"""Tokenizers from files; the path is the caller's."""

from __future__ import annotations

import functools
import json

import tiktoken
from tokenizers import Tokenizer


def byte_to_char() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: itself if it is one, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@functools.lru_cache(4)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@functools.lru_cache(4)
def byte_bpe(path: str):
    """text -> ids of the byte-level tokenizer in ``path``, as the tokenizers library gives them without special tokens added.

    The merges run in tiktoken, several times as fast; where it gives up (such as on its stack's limit), the library runs.
    """
    model = json.load(open(path, encoding="utf-8"))
    byte = {c: b for b, c in byte_to_char().items()}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as error:  # a panic of the extension is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
            return library(path).encode(text, add_special_tokens=False).ids

    return encode
