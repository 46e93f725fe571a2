"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A document's pre-tokens are cut into runs of `LEAF`; a leaf has its run's characters and tokens, an inner node
its children's sums, both as arrays in heap order (node 1 is the root, leaves fill the last half). The tokenizer's
special strings are pre-tokens of their own, and the text between two is cut as if it stood alone. An edit of
characters a to b can only move pre-token ends after a - `reach`, as a pre-token's match looks at most two
characters past its end, and at most a special string's length to see that one begins there. So encoding starts
anew at the leaf that holds such an end, and stops at the first boundary that was one before at or after b: from
there the pre-tokens are the old ones. The new run is dealt to the leaves it
replaces, and the sums above them are updated; a leaf that outgrows `SPLIT` times its size makes the tree anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tokens import PATTERN, default_path, encode, specials

LEAF = 64
SPLIT = 4
_PIECES = regex.compile(PATTERN)
_MEMO_PIECES = 400_000


class Counter:
    """Pre-tokens and the tokens of each, remembered up to a bound."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.memo: dict[str, int] = {}
        special = specials(path)
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        #: How far before an edit a pre-token's end can be moved by it.
        self.reach = max([2, *map(len, special)])

    def pieces(self, text: str, begin: int = 0) -> Iterator[str]:
        """The pre-tokens from character `begin` on, which is the end of one or the text's start."""
        while True:
            hit = self.special.search(text, begin)
            for m in _PIECES.finditer(text, begin, hit.start() if hit else len(text)):
                yield m[0]
            if not hit:
                return
            yield hit[0]
            begin = hit.end()

    def total(self, pieces: list[str]) -> int:
        get, n = self.memo.get, 0
        for p in pieces:
            k = get(p)
            if k is None:
                if len(self.memo) > _MEMO_PIECES:
                    self.memo.clear()
                k = self.memo[p] = len(encode(self.path, p))
            n += k
        return n


@dataclass
class Tree:
    chars: list[int]
    tokens: list[int]

    @classmethod
    def over(cls, leaves: list[tuple[int, int]]) -> Tree:
        size = 1 << max(0, len(leaves) - 1).bit_length()
        chars, tokens = [0] * (2 * size), [0] * (2 * size)
        for i, (c, t) in enumerate(leaves):
            chars[size + i], tokens[size + i] = c, t
        for i in range(size - 1, 0, -1):
            chars[i], tokens[i] = chars[2 * i] + chars[2 * i + 1], tokens[2 * i] + tokens[2 * i + 1]
        return cls(chars, tokens)

    @property
    def size(self) -> int:
        return len(self.chars) // 2

    def leaf_after(self, at: int) -> tuple[int, int]:
        """The first leaf that ends after character `at`, or else the last filled one; with its first character."""
        node, start = 1, 0
        at = max(0, min(at, self.chars[1] - 1))
        while node < self.size:
            node *= 2
            if start + self.chars[node] <= at:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        dc, dt = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2


def built(text: str, counter: Counter, leaf: int = LEAF) -> Tree:
    pieces = list(counter.pieces(text))
    runs = [pieces[i : i + leaf] for i in range(0, len(pieces), leaf)]
    return Tree.over([(sum(map(len, r)), counter.total(r)) for r in runs])


def apply_edit(text: str, tree: Tree, start: int, end: int, new: str, counter: Counter, leaf: int = LEAF) -> tuple[str, Tree, int]:
    """The edited text, its tree, and how many characters were encoded anew."""
    start = max(0, min(start, len(text)))
    end = max(start, min(end, len(text)))
    after = text[:start] + new + text[end:]
    if not text or not after:
        return after, built(after, counter, leaf), len(after)
    moved = len(after) - len(text)
    first, begin = tree.leaf_after(start - counter.reach)
    # the old leaf starts at or after the edit's end, in new places
    last, at = tree.leaf_after(end)
    if at < end or last == first:  # the leaf where encoding starts is always replaced
        at += tree.chars[tree.size + last]
        last += 1
    pieces: list[str] = []
    here = begin
    goal = at + moved
    for piece in counter.pieces(after, begin):
        here += len(piece)
        pieces.append(piece)
        while goal < here and last < tree.size and tree.chars[tree.size + last]:
            goal += tree.chars[tree.size + last]
            last += 1
        if here == goal:
            break
    else:
        last = tree.size
    done = here - begin
    spots = max(1, min(last, tree.size) - first)
    share = -(-len(pieces) // spots)
    if share > SPLIT * leaf:
        kept = [(c, t) for c, t in zip(tree.chars[tree.size :], tree.tokens[tree.size :], strict=True)]
        runs = [pieces[i : i + leaf] for i in range(0, len(pieces), leaf)]
        fresh = [(sum(map(len, r)), counter.total(r)) for r in runs]
        return after, Tree.over([x for x in kept[:first] + fresh + kept[last:] if x[0]]), done
    for k in range(spots):
        run = pieces[k * share : (k + 1) * share]
        tree.put(first + k, sum(map(len, run)), counter.total(run))
    return after, tree, done


TREE = "chars array<int>, tokens array<int>"


def _counting(path: str, leaf: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(path)
        for b in batches:
            trees = [built(t or "", counter, leaf) for t in b["text"]]
            yield b.assign(chars=[t.chars for t in trees], tokens=[t.tokens for t in trees])

    return run


def _editing(path: str, leaf: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(path)
        for b in batches:
            texts, chars, tokens, work, first = [], [], [], [], [int(t[1]) for t in b["tokens"]]
            for text, c, t, edits in zip(b["text"], b["chars"], b["tokens"], b["edits"], strict=True):
                text, tree, n = text or "", Tree(list(map(int, c)), list(map(int, t))), 0
                for e in edits if edits is not None else ():
                    if e is None:
                        continue
                    text, tree, done = apply_edit(text, tree, int(e["start"] or 0), int(e["end"] or 0), e["new"] or "", counter, leaf)
                    n += done
                texts.append(text)
                chars.append(tree.chars)
                tokens.append(tree.tokens)
                work.append(n)
            yield pd.DataFrame({"key": b["key"], "text": texts, "chars": chars, "tokens": tokens, "tokens_before": first, "reencoded": work})

    return run


def counted(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(key, text, chars, tokens): each row's text with its tree; `tokens[1]` is its number of tokens.

    A null text is an empty one, whose tree has one empty leaf. Repeated rows are counted each by themselves, a null
    key stays null, other columns play no part, and an empty table gives no rows. Keys keep their type, which may be any
    that text can tell.
    """
    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    made = rows.mapInPandas(_counting(tokenizer or default_path(), leaf), f"key string, text string, {TREE}")
    return made.withColumn("key", F.col("key").cast(df.schema[key].dataType))


def recounted(trees: DataFrame, edits: str = "edits", tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(key, text, chars, tokens, tokens_before, reencoded): `trees` after each row's edits, an array of (start, end, new).

    Edits apply in order; places are code points of the text at that time and are clipped to it. A null array, a null
    edit or one that changes nothing leaves the text as it is; null fields count as 0 or an empty text. `reencoded` is
    the number of characters that were encoded anew.
    """
    rows = trees.select(F.col("key").cast("string").alias("key"), "text", "chars", "tokens", F.col(edits).alias("edits"))
    made = rows.mapInPandas(_editing(tokenizer or default_path(), leaf), f"key string, text string, {TREE}, tokens_before long, reencoded long")
    return made.withColumn("key", F.col("key").cast(trees.schema["key"].dataType))
