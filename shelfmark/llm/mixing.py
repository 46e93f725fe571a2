"""Mixing sources to target weights by blocks of words.

Each source's documents, in a seeded order, form one stream of words, cut into blocks of `block_words`. A
source's quota is the run of draws that adds up to its target: whole passes over its blocks, then part of a
pass, whose last draw is cut to length. Each output shard draws its sources' slot counts from a multinomial
with the quotas as weights; a source's draws are numbered through the shards, and what the shards draw beyond
a quota falls away while what they draw short of it goes to one last shard. Draw j of a source takes the block
that a pseudorandom permutation of the source's block numbers (a cycle-walking Feistel network, a key for each
source and pass) maps j to, and slots meet their blocks by an equi-join on source and block number.

No step gathers a source: streams are laid out by a running sum in hash buckets, as many as the root of the
source's rows, and a running sum over the buckets' totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import unused, words_of
from shelfmark.llm.shingles import finalised
from shelfmark.store import written

#: Weights of the sources in code point order, repeating; null last.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
ROUNDS = 6
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Each index under the pseudorandom permutation of range(size) that its key names; vectorised."""
    x, n, k = (np.asarray(v).astype(np.uint64) for v in np.broadcast_arrays(index, size, key))
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n.astype(np.float64), 2)) / 2)).astype(np.uint64)
    bits += (np.uint64(1) << (bits + bits)) < n  # where rounding fell short
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            b, m, kk = bits[todo], mask[todo], k[todo]
            left, right = out[todo] >> b, out[todo] & m
            for r in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
                tweak = kk + np.uint64(r + 1) * _GOLDEN
                if inverse:
                    left, right = right ^ (finalised(left + tweak) & m), left
                else:
                    left, right = right, left ^ (finalised(right + tweak) & m)
            out[todo] = (left << b) | right
            todo = todo[out[todo] >= n[todo]]  # walk on until the value is in range
    return out.astype(np.int64)


@dataclass(frozen=True)
class Quota:
    """What one source gives: `draws` slots in all; the last one gives `last_words` at most."""

    source: int
    size: int
    blocks: int
    target: float
    draws: int
    last_words: int


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets by weight, each at most `most` times its size, the excess shared anew until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(w[i] for i in open_)
        over = {i for i in open_ if left * w[i] / total >= most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        open_ -= over
        left -= sum(out[i] for i in over)
    return out


def pass_key(seed: int, source, turn):
    with np.errstate(over="ignore"):
        return finalised(np.asarray(source).astype(np.uint64) * np.uint64(1_000_003) + np.asarray(turn).astype(np.uint64) + np.uint64(seed) * _GOLDEN)


def quota(source: int, size: int, target: float, block_words: int, seed: int) -> Quota:
    """The draws whose words add up to the rounded target."""
    if not size:
        return Quota(source, 0, 0, target, 0, 0)
    words, blocks = int(target + 0.5), -(-size // block_words)
    turns, rest = divmod(words, size)
    if not rest:
        return Quota(source, size, blocks, target, turns * blocks, block_words)
    short = size - (blocks - 1) * block_words
    at = int(permuted(np.array([blocks - 1]), np.array([blocks]), pass_key(seed, [source], [turns]), inverse=True)[0])
    slots = -(-rest // block_words)
    before = (slots - 1) * block_words
    if at < slots - 1 or at == slots - 1 and before + short < rest:  # the short block comes early: more draws
        slots = -(-(rest + block_words - short) // block_words)
        before = (slots - 1) * block_words - (block_words - short)
    return Quota(source, size, blocks, target, turns * blocks + slots, rest - before)


def _shard_counts(quotas: list[Quota], slots: int, seed: int):
    weights = np.array([q.draws for q in quotas], dtype=float)
    share = weights / weights.sum() if weights.sum() else weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                n = np.random.default_rng([seed, int(shard)]).multinomial(slots, share)
                yield pd.DataFrame({"shard": shard, "src": [q.source for q in quotas], "n": n})

    return run


def _mapped(quotas: list[Quota], block_words: int, seed: int):
    blocks = np.array([q.blocks for q in quotas], dtype=np.int64)
    draws = np.array([q.draws for q in quotas], dtype=np.int64)
    last = np.array([q.last_words for q in quotas], dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            src, j = b["src"].to_numpy(), b["j"].to_numpy()
            n = blocks[src]
            turn, at = j // n, j % n
            block = permuted(at, n, pass_key(seed, src, turn))
            slot = permuted(b["at"].to_numpy(), b["of"].to_numpy(), pass_key(seed + 1, b["shard"].to_numpy(), 0))
            most = np.where(j == draws[src] - 1, last[src], block_words)
            yield pd.DataFrame({"shard": b["shard"], "slot": slot, "src": src, "turn": turn, "block": block, "most": most})

    return run


def _hash(text: str, source: str) -> Column:
    """Tells rows of one key apart by their texts and sources."""
    of = F.col(f"`{source}`").cast("string")
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(of, F.lit("")), of.isNull())


@dataclass(frozen=True)
class Mix:
    """documents: (key, hash of text and source, src, size, off); slots: (shard, slot, src, turn, block, most); pieces: the
    slots' parts of documents (shard, slot, turn, src, off, start, words)."""

    documents: DataFrame
    quotas: list[Quota]
    slots: DataFrame
    pieces: DataFrame


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 29) -> Mix:
    """Plans the mix of df's rows.

    A row's size is its text's number of words; a null or empty text has none and is never taken. A null source
    is a source, the last. Repeated rows count each by themselves. `off` is the row's first word in its source's
    stream (null for rows without words) and with `src` names the row. Other columns play no part. The sources
    themselves, one small row each, are planned on the driver; rows, blocks and slots never are. Reruns agree:
    order and draws depend on keys, texts and the seed alone.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), F.size(words_of(F.col(f"`{text}`"))).cast("long").alias("size"), _hash(text, source).alias("h"))
    rows = written(rows, "mix-rows")
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    goal = targets([r["size"] or 0 for r in found], weights)
    quotas = [quota(i, r["size"] or 0, goal[i], block_words, seed) for i, r in enumerate(found)]
    numbered = spark.createDataFrame([(r["source"], i, isqrt(r["n"] - 1) + 1) for i, r in enumerate(found)], "source string, src long, buckets long")
    rows = rows.join(numbered, rows["source"].eqNullSafe(numbered["source"])).select("key", "h", "src", "size", F.pmod(F.xxhash64(F.lit(seed), "key", "h"), "buckets").alias("bucket"), F.xxhash64(F.lit(seed + 2), "key", "h").alias("order"))
    ahead = Window.partitionBy("src", "bucket").orderBy("order", "key", "h").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.where("size > 0").withColumn("within", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    firsts = rows.where("size > 0").groupBy("src", "bucket").agg(F.sum("size").alias("total"))
    firsts = firsts.select("src", "bucket", F.coalesce(F.sum("total").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    laid = laid.join(firsts, ["src", "bucket"]).select("key", "h", "src", "size", (F.col("first") + F.col("within")).alias("off"))
    documents = written(laid.unionByName(rows.where("size = 0").select("key", "h", "src", "size", F.lit(None).cast("long").alias("off"))), "mix-documents")

    live = [q for q in quotas if q.draws]
    shards = -(-sum(q.draws for q in live) // shard_slots) if live else 0
    drawn = spark.range(shards).mapInPandas(_shard_counts(live, shard_slots, seed), "shard long, src long, n long")
    wanted = spark.createDataFrame([(q.source, q.draws) for q in quotas], "src long, draws long")
    ordered = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("j", F.coalesce(F.sum("n").over(ordered), F.lit(0))).join(wanted, "src")
    placed = placed.select("shard", "src", "j", F.greatest(F.lit(0), F.least(F.col("n"), F.col("draws") - F.col("j"))).alias("n"))
    given = drawn.groupBy("src").agg(F.sum("n").alias("given"))
    rest = wanted.join(given, "src").where("given < draws").select(F.lit(shards).cast("long").alias("shard"), "src", F.col("given").alias("j"), (F.col("draws") - F.col("given")).alias("n"))
    placed = placed.where("n > 0").unionByName(rest)
    in_shard = Window.partitionBy("shard").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.coalesce(F.sum("n").over(in_shard), F.lit(0))).withColumn("of", F.sum("n").over(Window.partitionBy("shard")))
    each = placed.select("shard", "src", "of", "j", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    each = each.select("shard", "src", "of", (F.col("j") + F.col("i")).alias("j"), (F.col("at") + F.col("i")).alias("at"))
    # written, so that the planner knows its size: an estimate from the few shards above would have it broadcast
    slots = each.mapInPandas(_mapped(quotas, block_words, seed), "shard long, slot long, src long, turn long, block long, most long")
    slots = written(slots, "mix-slots")

    b = F.lit(block_words)
    cut = documents.where("size > 0").select("src", "off", "size", F.explode(F.expr(f"sequence(off div {block_words}, (off + size - 1) div {block_words})")).alias("block"))
    begin, end = F.greatest(F.col("off"), F.col("block") * b), F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * b)
    cut = cut.select("src", "block", "off", (begin - F.col("off")).alias("start"), (end - begin).alias("len"), (begin - F.col("block") * b).alias("skip"))
    pieces = slots.hint("merge").join(cut, ["src", "block"]).select("shard", "slot", "turn", "src", "off", "start", "skip", F.least(F.col("len"), F.col("most") - F.col("skip")).alias("words")).where("words > 0")
    return Mix(documents, quotas, slots, pieces)


def taken(plan: Mix) -> DataFrame:
    """(key, h, src, size, off, taken): each row of the table with the words the mix takes of it, repeats counted."""
    words = plan.pieces.groupBy("src", "off").agg(F.sum("words").alias("taken"))
    full = plan.documents.where("size > 0").join(words.hint("merge"), ["src", "off"], "left")
    none = plan.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["key", "h", "src", "size", "off"]
    return full.select(*cols, F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(none.select(*cols, "taken"))


def mixed_documents(df: DataFrame, plan: Mix, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """df's columns, a row for each pass that takes words of a row, its text cut to the words taken.

    A text taken whole stays as it is; else its taken runs of words are joined by single blanks. Keys need not be
    unique and may be null or of any type: rows of one key are told apart by their texts and sources, and of rows alike in
    all three each is taken by itself, with the other columns of one of them. Columns may have any names.
    """
    spans = plan.pieces.groupBy("src", "off", "turn").agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("spans"), F.sum("words").alias("n"))
    k, h, m = (unused(df, c) for c in ("_k", "_h", "_mix"))
    named = lambda c: F.xxhash64(F.col(f"`{c}`"), F.col(f"`{c}`").isNull())
    # one exchange of the texts: repeats are dropped and spans are met by the same two columns
    rows = plan.documents.where("size > 0").join(spans, ["src", "off"]).select(named("key").alias(k), F.col("h").alias(h), F.struct("size", "spans", "n").alias(m))
    full = df.withColumn(k, named(key)).withColumn(h, _hash(text, source)).dropDuplicates([k, h])
    joined = full.join(rows, [k, h])
    words = words_of(F.col(f"`{text}`"))
    cut = F.array_join(F.flatten(F.transform(F.col(m)["spans"], lambda s: F.slice(words, (s["start"] + 1).cast("int"), s["words"].cast("int")))), " ")
    new = F.when(F.col(m)["n"] == F.col(m)["size"], F.col(f"`{text}`")).otherwise(cut)
    return joined.withColumn(text, new).select(*[F.col(f"`{c}`") for c in df.columns])
