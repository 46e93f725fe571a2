"""Hierarchical packing of documents into windows of several lengths.

A document is cut into whole windows of the longest tier; its rest is routed to the shortest tier that holds
it. Tiers are packed from long to short: each window opens with the longest document of its tier, its gap is
filled with the longest fitting documents of shorter tiers, and the last bit of the gap with the head of a
shorter document, whose tail goes on to the tier that holds it. So all windows are full but one for each task.
Full windows of one tier are dealt into step groups of equal tokens, the costly ones spread evenly.

Packing works on a bounded run of a partition's documents at a time and carries the unfilled rest over, so
memory is bounded by `chunk_tokens` and the longest document, and nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.tokens import default_path, encode

#: Window lengths, powers of two.
TIERS = (256, 512, 1024)
#: Tokens of each optimiser step's group of windows.
STEP_TOKENS = 16_384
CHUNK_TOKENS = 1 << 20

PIECES = T.StructType(
    [
        T.StructField("row", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("context", T.IntegerType()),
        T.StructField("step_group", T.LongType()),
    ]
)


@dataclass
class Packer:
    """Plans windows over document lengths; it never sees tokens.

    A part is (length, document, start). `windows` of a plan are (tier, parts).
    """

    tiers: tuple[int, ...] = TIERS
    pools: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    windows: list[tuple[int, list[tuple[int, int, int]]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.pools = {t: [] for t in self.tiers}

    def route(self, part: tuple[int, int, int]) -> None:
        insort(self.pools[self.tiers[bisect_left(self.tiers, part[0])]], part)

    def add(self, document: int, length: int) -> None:
        top, start = self.tiers[-1], 0
        while length - start >= top:
            self.windows.append((top, [(top, document, start)]))
            start += top
        if length > start:
            self.route((length - start, document, start))

    def _fill(self, gap: int, below: list[int], parts: list[tuple[int, int, int]]) -> int:
        for t in below:  # whole documents, the longest that fit first
            pool = self.pools[t]
            while gap and (i := bisect_right(pool, (gap, 1 << 62, 0))):
                part = pool.pop(i - 1)
                parts.append(part)
                gap -= part[0]
        for t in reversed(below) if gap else ():  # then the head of one that is too long
            if self.pools[t]:
                n, document, start = self.pools[t].pop(0)
                parts.append((gap, document, start))
                self.route((n - gap, document, start + gap))
                return 0
        return gap

    def pack(self) -> None:
        """Full windows of all that is there; what fills none stays in the pools."""
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, below = self.tiers[k], [*self.tiers[: k + 1]][::-1]
            pool = self.pools[tier]
            while pool:
                if sum(p[0] for t in below for p in self.pools[t][: tier + 1]) < tier:
                    break  # too little left for one more window
                first = pool.pop()
                parts = [first]
                gap = self._fill(tier - first[0], below[1:] or below, parts)
                if gap:
                    gap = self._fill(gap, below, parts)
                assert not gap
                self.windows.append((tier, parts))
            if k:  # the rest fills shorter windows, in pieces of their length
                for part in pool:
                    n, document, start = part
                    while n:
                        m = min(n, self.tiers[k - 1])
                        self.route((m, document, start))
                        n, start = n - m, start + m
                pool.clear()

    def rest(self) -> list[tuple[int, int, int]]:
        """What filled no window; shorter than the shortest tier in all."""
        left = [p for pool in self.pools.values() for p in pool]
        for pool in self.pools.values():
            pool.clear()
        return left


def step_groups(windows: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int) -> list[int]:
    """A group number for each window: windows of one tier, `step_tokens` in a group, dealt to and fro by falling attention cost."""
    out, base = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}):
        mine = sorted((i for i, w in enumerate(windows) if w[0] == tier), key=lambda i: (-sum(p[0] ** 2 for p in windows[i][1]), i))
        groups = max(1, -(-len(mine) * tier // step_tokens))
        for n, i in enumerate(mine):
            lap, at = divmod(n, groups)
            out[i] = base + (groups - 1 - at if lap % 2 else at)
        base += groups
    return out


def _pack_partition(path: str, tiers: tuple[int, ...], step_tokens: int, chunk_tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        packer = Packer(tiers)
        held: list[np.ndarray] = []
        rows: list[str | None] = []
        state = {"sequence": task << 40, "group": task << 40}

        def emit(last: bool) -> pd.DataFrame:
            packer.pack()
            left = packer.rest()
            windows, packer.windows = packer.windows, []
            groups = step_groups(windows, step_tokens)
            if last and left:
                windows.append((tiers[-1], left))
                groups.append(max(groups, default=-1) + 1)
                left = []
            out: list[tuple] = []
            for (tier, parts), group in zip(windows, groups, strict=True):
                at = 0
                for n, d, start in parts:
                    ids = held[d]
                    out.append((rows[d], start, n, ids[start : start + n].tobytes(), len(ids), state["sequence"], at, tier, state["group"] + group))
                    at += n
                state["sequence"] += 1
            state["group"] += max(groups, default=-1) + 1
            keep = sorted({d for _, d, _ in left})
            new = {d: i for i, d in enumerate(keep)}
            held[:], rows[:] = [held[d] for d in keep], [rows[d] for d in keep]
            for n, d, start in left:
                packer.route((n, new[d], start))
            return pd.DataFrame(out, columns=PIECES.names)

        waiting = 0
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"], strict=True):
                ids = np.append(encode(path, text or ""), np.uint32(0)).astype("<u4", copy=False)
                packer.add(len(held), len(ids))
                held.append(ids)
                rows.append(row)
                waiting += len(ids)
                if waiting >= chunk_tokens:
                    yield emit(False)
                    waiting = 0
        yield emit(True)

    return run


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row for each piece of a document in a window.

    Columns: the key's, `start` (the document's ids before the piece), `length`, `ids` (little-endian unsigned
    32-bit ids as bytes), `doc_tokens` (with the end id 0), `sequence_id`, `offset` in the window (gapless from
    0), `context` (the window's length) and `step_group`. Every id of every document lies in one piece. A null
    text is an empty one, which has the end id alone; a text of any length is cut into windows; repeated rows are
    packed each by themselves; a key is of any type that text can tell, and a null one stays null; other columns
    play no part; an empty table gives no rows. A task's last window may be short.
    """
    assert all(t & (t - 1) == 0 for t in tiers) and list(tiers) == sorted(tiers)
    # as text, for pandas makes floats of whole numbers among nulls
    rows = df.select(F.col(f"`{key}`").cast("string").alias("row"), F.col(f"`{text}`").alias("text"))
    run = _pack_partition(tokenizer or default_path(), tuple(tiers), step_tokens, chunk_tokens)
    packed = rows.mapInPandas(run, PIECES)
    return packed.select(F.col("row").cast(df.schema[key].dataType).alias(key), *PIECES.names[1:])
