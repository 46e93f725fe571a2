"""Merkle fixity audit of replicated record archives.

Records stand in their archive in the order of their numbers; `FANOUT ** FILE_LEVELS` numbers make one file. A
leaf of the tree is a record number, hashed from its bytes; a node of level k covers FANOUT ** k numbers, that is
one ordered range of offsets, and is hashed from its children's places, hashes and byte counts. Two replicas are
compared at the root; where hashes differ, the children of the differing nodes alone are compared, down to the
records. A node's byte count gives the offset of each child by a sum over its siblings, so the way down also tells
where in the file the damage lies. A lost record changes the path above it and no other.

Each level is a grouped aggregate of at most FANOUT rows a group over the level below, written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.store import written

FANOUT = 16
FILE_LEVELS = 3
_CHUNKS = ((1, 15), (16, 15), (31, 15), (46, 15), (61, 4))


def warc_record(number: Column, url: Column, body: Column) -> Column:
    """A response record as text: header fields, a blank line, the body, two line ends."""
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(number.cast("string"), F.lit("?")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")))
    text = F.coalesce(body, F.lit(""))
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n"))


def leaves(records: DataFrame, number: str, content: str) -> DataFrame:
    """(number, n, bytes, hash): one row for each record number, which may be null.

    A number with one record has that record's SHA-256. One with several (repeated rows, or versions) has the hash
    of their count and of their digests' sums, which combine in any order and in constant memory.
    """
    hashed = records.select(F.col(f"`{number}`").cast("long").alias("number"), F.octet_length(F.col(f"`{content}`")).cast("long").alias("bytes"), F.sha2(F.col(f"`{content}`"), 256).alias("digest"))
    part = lambda at, n: F.conv(F.substring("digest", at, n), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(part(at, n)).alias(f"s{at}") for at, n in _CHUNKS]
    each = hashed.groupBy("number").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("digest").alias("digest"), *sums)
    many = F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"s{at}").cast("string") for at, _ in _CHUNKS]), 256)
    return each.select("number", "n", "bytes", F.when(F.col("n") == 1, F.col("digest")).otherwise(many).alias("hash"))


@dataclass(frozen=True)
class Tree:
    """levels[k]: (node, hash, bytes, n) of the nodes of level k; the last has the root alone, or nothing."""

    levels: list[DataFrame]
    first: int


def tree(leaf: DataFrame, first: int, last: int) -> Tree:
    """The tree over numbers first to last; a null number stands before all others."""
    at = F.when(F.col("number").isNull(), F.lit(0)).otherwise(F.col("number") - F.lit(first) + 1)
    level = written(leaf.select(at.alias("node"), "hash", "bytes", "n", "number"), "merkle-leaves")
    levels, width = [level], last - first + 2
    while width > 1 or len(levels) <= FILE_LEVELS:
        child = F.struct(F.pmod("node", F.lit(FANOUT)).alias("place"), "hash", "bytes")
        up = level.groupBy(F.expr(f"node div {FANOUT}").alias("up")).agg(F.sort_array(F.collect_list(child)).alias("below"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        told = F.array_join(F.transform("below", lambda x: F.concat_ws(":", x["place"].cast("string"), x["hash"], x["bytes"].cast("string"))), "|")
        level = written(up.select(F.col("up").alias("node"), F.sha2(told, 256).alias("hash"), "bytes", "n"), "merkle-level")
        levels.append(level)
        width = -(-width // FANOUT)
    return Tree(levels, first)


def bounds(*tables: DataFrame) -> tuple[int, int]:
    """The least and greatest record number of all replicas; 0 and -1 if they have none."""
    seen = [t.agg(F.min("number"), F.max("number")).first() for t in tables]
    low, high = [r[0] for r in seen if r[0] is not None], [r[1] for r in seen if r[1] is not None]
    return (min(low), max(high)) if low else (0, -1)


def differing(a: Tree, b: Tree) -> tuple[DataFrame, list[int]]:
    """The record numbers whose leaves differ, with both sides' offsets in their file; and how many nodes differ on each level, root first."""

    def opened(t: Tree, k: int, wanted: DataFrame | None) -> DataFrame:
        nodes = t.levels[k].select("node", "hash", "bytes", "n", *(["number"] if not k else []))
        if wanted is None:
            return nodes.withColumn("start", F.lit(0).cast("long"))
        met = nodes.withColumn("up", F.expr(f"node div {FANOUT}")).join(wanted, "up")
        if k >= FILE_LEVELS:  # offsets count from the start of a file
            return met.drop("up", "base").withColumn("start", F.lit(0).cast("long"))
        before = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        return met.withColumn("start", F.col("base") + F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("up", "base")

    counts: list[int] = []
    bad = None
    for k in range(len(a.levels) - 1, -1, -1):
        side = lambda s: None if bad is None else bad.select(F.col("node").alias("up"), F.coalesce(f"start_{s}", F.lit(0)).alias("base"))  # noqa: E731,B023
        name = lambda df, s: df.select("node", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "node"])
        both = name(opened(a, k, side("a")), "a").join(name(opened(b, k, side("b")), "b"), "node", "full")
        bad = written(both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))), "merkle-differing")
        counts.append(bad.count())
        if not counts[-1]:
            break
    if k:  # the roots, or all below some level, agree: nothing to tell
        empty = name(opened(a, 0, None), "a").join(name(opened(b, 0, None), "b"), "node", "full").where(F.lit(False))
        return empty, counts
    return bad, counts


def audit(a: DataFrame, b: DataFrame, number: str, content: str) -> DataFrame:
    """One row for each damaged record: number, file, kind, and each side's offset in the file, bytes and hash.

    `kind` is `corrupt` (both replicas have the number with unlike bytes), `missing` (only the first has it) or
    `extra` (only the second). A null number is one of its own. Null contents count as records of no bytes with a
    null hash, like on both sides only if both are null. Equal replicas, and empty ones, give no rows.
    """
    la, lb = written(leaves(a, number, content), "merkle-a"), written(leaves(b, number, content), "merkle-b")
    first, last = bounds(la, lb)
    found, _ = differing(tree(la, first, last), tree(lb, first, last))
    kind = F.when(F.col("n_b").isNull(), F.lit("missing")).when(F.col("n_a").isNull(), F.lit("extra")).otherwise(F.lit("corrupt"))
    file = F.expr(f"node div {FANOUT**FILE_LEVELS}")
    return found.select(F.coalesce("number_a", "number_b").alias("number"), file.alias("file"), kind.alias("kind"), F.when(F.col("n_a").isNotNull(), F.col("start_a")).alias("offset_a"), F.col("bytes_a"), F.col("hash_a"), F.when(F.col("n_b").isNotNull(), F.col("start_b")).alias("offset_b"), F.col("bytes_b"), F.col("hash_b"))
