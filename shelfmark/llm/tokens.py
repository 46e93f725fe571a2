"""Byte-level BPE by a public tokenizer file."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: How this vocabulary cuts a text before merging; fixed by the tokenizer file's own pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_by_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a byte-level BPE file, one for each process.

    The vocabulary's ids are its merge ranks, so tiktoken gives the ids of `tokenizers` at several times its speed. The
    file's added special tokens are cut out of a text before anything else, as `tokenizers` does it, and are one id each.
    """
    import tiktoken

    file = json.load(open(path, encoding="utf-8"))
    letters = _bytes_by_letter()
    special = {t["content"]: t["id"] for t in file["added_tokens"] if t["special"]}
    ranks = {bytes(letters[c] for c in word): i for word, i in file["model"]["vocab"].items() if all(c in letters for c in word)}
    for word in special:
        ranks.pop(word.encode(), None)
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(path: str, text: str) -> np.ndarray:
    """The ids of a text: those of `tokenizers` with add_special_tokens=False."""
    return encoder(path).encode_to_numpy(text, allowed_special="all")


def specials(path: str) -> list[str]:
    """The strings that are one id each wherever they stand, the longest first."""
    return sorted(encoder(path).special_tokens_set, key=lambda t: (-len(t), t))
