"""Word shingles as 64-bit hashes, for one text at a time in a Python worker."""

from __future__ import annotations

import numpy as np
import xxhash

from shelfmark.llm.common import PY_WORD

WIDTH = 5
_MEMO: dict[str, int] = {}
_MEMO_WORDS = 100_000


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_MEMO) > _MEMO_WORDS:
        _MEMO.clear()
    get, digest, out = _MEMO.get, xxhash.xxh3_64_intdigest, []
    for w in words:
        h = get(w)
        if h is None:
            h = _MEMO[w] = digest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def finalised(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants of splitmix64, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of `width` words.

    A text of fewer words is one shingle; one without words has none. Words are compared as they stand.
    """
    words = PY_WORD.findall(text) if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = _word_hashes(words)
    with np.errstate(over="ignore"):
        n = min(width, len(words))
        total = np.zeros(len(words) - n + 1, dtype=np.uint64)
        for k in range(n):
            # an own odd factor for each place, and for the number of words
            total += h[k : k + len(total)] * (np.uint64(2 * k + 2 * n * width + 1) * np.uint64(0x9E3779B97F4A7C15))
        return np.unique(finalised(total))
