"""N-gram Jaccard self-join by a MinHash LSH forest.

A text's set of word shingles has `trees` MinHash signatures of `longest` values, each a path of a prefix trie. Two
sets of similarity s share a path's first d values with probability s^d, so matched prefixes start long and are
shortened, value by value, until some tree is expected to match with the target recall at the threshold.

1. Texts of one shingle set are one node with a count of copies.
2. Each tree's paths are sorted. A node is tied to the path before its own if they share the shortened prefix: in
   sorted order that is the one of the longest common prefix. A trie node of more than `LANE` paths is split by its
   whole paths, and each part's first path is tied to one path of that trie node, so no crowd is one task's work.
   A tie stays if the signatures agree as those of sets at the threshold do (within four standard errors).
3. A trie node whose members the ties leave in several groups is compared wholly, signature with signature, in
   blocks, but for pairs of one group. So every pair that shares a shortened prefix in some tree is either in one
   group or ruled out by its signatures, however crowded the trie node.
4. Within a group all pairs of nodes are verified by exact intersection sizes, in blocks: a group of many nodes is
   cut into blocks by hash, and each pair of blocks is a piece of work of bounded size that returns a row a node
   (its links there and its least linked node), not a row a pair.
5. Links are summed; linked nodes form the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import unused
from shelfmark.llm.shingles import finalised, shingle_set
from shelfmark.operators.components import connected_components
from shelfmark.store import written

THRESHOLD = 0.8
TREES = 32
LONGEST_PREFIX = 12
TARGET_RECALL = 0.9999
#: A tie's signatures agree within so many standard errors of the threshold; a pair at it fails with probability 0.00003.
ERRORS = 4
#: Paths of a trie node that one task puts in order.
LANE = 4096
#: Nodes in one block of a group, and of a trie node that is compared wholly, on average.
BLOCK = 256
#: Rows in one verifying task, and in one that compares signatures, on average.
TASK_ROWS = 512
CROWD_ROWS = 4096
#: Ids broadcast to pick texts weigh at most this; more are met by a shuffle join.
BROADCAST_BYTES = 8 << 20
#: Rows that a Python worker turns into output at a time.
PART = 1000
#: Distinct shingles laid out as bits at a time.
COLUMNS = 1 << 16


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL, longest: int = LONGEST_PREFIX) -> int:
    """The longest prefix whose expected recall at the threshold meets the target: shortened from `longest` on."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _factors(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return finalised(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(grams: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash values of a nonempty set of hashes under multiplicative permutations of the 64-bit numbers."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(grams), 2048):
            np.minimum(out, (factors[:, None] * grams[None, i : i + 2048]).min(axis=1), out=out)
    return out


def _signer(trees: int, depth: int, longest: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors = _factors(trees * longest, seed)
        for batch in batches:
            out = []
            for key, mark, text in zip(batch["key"], batch["mark"], batch["text"], strict=True):
                if len(out) >= PART:
                    yield _signed(out)
                    out = []
                grams = shingle_set(text)
                if not len(grams):
                    out.append((key, mark, None, 0, None, None, None))
                    continue
                values = signature(grams, factors)
                paths = values.reshape(trees, longest)
                ends = [xxhash.xxh3_64_intdigest(p[:depth].tobytes(), seed=t) - (1 << 63) for t, p in enumerate(paths)]
                # a minimum's top bits are near 0, so labels and sketch come from its hash
                mixed = finalised(values)
                tails = (mixed.reshape(trees, longest)[:, depth:] >> np.uint64(48)).astype(">u2").tobytes()
                out.append((key, mark, xxhash.xxh3_128_digest(grams.tobytes()), len(grams), ends, tails, (mixed & np.uint64(255)).astype(np.uint8).tobytes()))
            yield _signed(out)

    return run


def _signed(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["key", "mark", "node", "grams", "ends", "tails", "sketch"])
    frame["key"] = frame["key"].astype("Int64")
    return frame


def likeness(same: np.ndarray) -> np.ndarray:
    """The similarity that a share of equal bytes tells, as one byte in 256 is equal by chance."""
    return (same - 1 / 256) / (1 - 1 / 256)


def _agreeing(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.frombuffer(b"".join(b["sa"]), dtype=np.uint8).reshape(len(b), -1)
            y = np.frombuffer(b"".join(b["sb"]), dtype=np.uint8).reshape(len(b), -1)
            yield b.loc[likeness((x == y).mean(axis=1)) >= least, ["a", "b"]]

    return run


def labelled(link: np.ndarray) -> np.ndarray:
    """The least member that each one reaches, of a symmetric matrix of links."""
    label = np.arange(len(link))
    while True:
        least = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1, initial=len(link)))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _crowd(least: float):
    """Ties among the members of trie nodes that lie in several groups; a tie for each tied member, not for each pair."""

    def run(task: pd.DataFrame) -> pd.DataFrame:
        task = task.sort_values(["end", "i", "j"], kind="stable")
        where = task[["end", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(axis=1)])
        nodes, group, block = task["node"].to_numpy(), task["group"].to_numpy(), task["block"].to_numpy()
        sketch = np.frombuffer(b"".join(task["sketch"]), dtype=np.uint8).reshape(len(task), -1)
        found: list[tuple] = []
        for lo, hi in zip(starts, [*starts[1:], len(task)], strict=True):
            g, b, x = group[lo:hi], block[lo:hi], sketch[lo:hi]
            asked = g[:, None] != g[None, :]
            if where[lo][1] != where[lo][2]:  # pairs within one block are the work of that block alone
                asked &= b[:, None] != b[None, :]
            if not asked.any():
                continue
            same = np.zeros(asked.shape)
            for k in range(len(x) - 1):
                same[k, k + 1 :] = (x[k] == x[k + 1 :]).mean(axis=1)
            tied = asked & (likeness(np.maximum(same, same.T)) >= least)
            label = labelled(tied)
            found += [(nodes[lo + k], nodes[lo + m]) for k, m in enumerate(label) if k != m]
        return pd.DataFrame(found, columns=["a", "b"], dtype=object)

    return run


def _shingler(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in (batch.iloc[i : i + PART] for batch in batches for i in range(0, len(batch), PART)):
        grams = [shingle_set(t).tobytes() for t in b["text"]]
        right = np.array([xxhash.xxh3_128_digest(g) == n for g, n in zip(grams, b["node"], strict=True)], dtype=bool)
        out = b[["group", "node", "copies", "blocks", "block"]].assign(grams=grams)
        yield out[right]


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by bit counts over bounded runs of the shared hashes."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    use = shared[place]
    owner, column = owner[use], column[place[use]]
    out = np.zeros((m, m), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for begin in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [begin, begin + COLUMNS])
        width = min(COLUMNS, -(-int(column[hi - 1] - begin + 1) // 64) * 64)
        grid = np.zeros((m, width), dtype=bool)
        grid[owner[lo:hi], column[lo:hi] - begin] = True
        bits = np.packbits(grid, axis=1).view(np.uint64)
        for i in range(m):
            out[i, i:] += np.bitwise_count(bits[i] & bits[i:]).sum(axis=1, dtype=np.int64)
    return np.maximum(out, out.T)


def _verifier(threshold: float):
    scaled = round(threshold * 1_000_000)

    def work(part: pd.DataFrame) -> pd.DataFrame | None:
        sets = [np.frombuffer(g, dtype=np.uint64) for g in part["grams"]]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        both = intersections(sets)
        link = both * 1_000_000 >= scaled * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(link, False)
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        if i != j:  # pairs within one block are the work of that block alone
            block = part["block"].to_numpy()
            link &= block[:, None] != block[None, :]
        links = link @ part["copies"].to_numpy()
        label = labelled(link)
        nodes = part["node"].to_numpy()
        linked = links > 0
        return pd.DataFrame({"node": nodes[linked], "label": nodes[label[linked]], "links": links[linked]})

    def run(task: pd.DataFrame) -> pd.DataFrame:
        found = [work(part) for _, part in task.groupby(["group", "i", "j"], sort=False) if len(part) > 1]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"node": pd.Series(dtype=object), "label": pd.Series(dtype=object), "links": pd.Series(dtype="int64")})

    return run


def _below(nodes: DataFrame, trees: int, width: int) -> DataFrame:
    """(end, tail, node, draw, n, lo): the paths of the tries' nodes that have several members, at the shortened prefix.

    `end` names the tree and the prefix, `tail` is the rest of the path in sortable form.
    """
    ends = nodes.select("node", "tails", F.posexplode("ends").alias("t", "end"))
    ends = ends.select("node", "end", F.substring("tails", F.col("t") * width + 1, F.lit(width)).alias("tail"))
    ends = ends.withColumn("draw", F.xxhash64("end", "node"))
    # counts and extremes of longs combine before the shuffle
    several = ends.groupBy("end").agg(F.count("*").alias("n"), F.min("draw").alias("lo")).where("n > 1")
    return written(ends.join(several, "end"), "forest-below")


def _ties(below: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): neighbours in the sorted tries whose signatures agree well enough."""
    crowded = F.col("n") > LANE
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / LANE))
    paths = below.withColumn("lane", F.when(crowded, F.xxhash64("tail", salt)).otherwise(F.lit(0)))
    ordered = paths.withColumn("before", F.lag("node").over(Window.partitionBy("end", "lane").orderBy("tail", "node")))
    hubs = below.where(crowded & (F.col("draw") == F.col("lo"))).select("end", F.col("node").alias("hub"))
    firsts = ordered.where(crowded & F.col("before").isNull()).select("end", "node").join(hubs, "end").where("node != hub")
    pairs = ordered.where("before is not null").select("node", "before").unionByName(firsts.select("node", F.col("hub").alias("before")))
    pairs = pairs.select(F.greatest("node", "before").alias("a"), F.least("node", "before").alias("b")).distinct()
    sketch = nodes.select("node", "sketch")
    met = pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    return met.mapInPandas(_agreeing(least), "a binary, b binary")


def _crowd_ties(below: DataFrame, nodes: DataFrame, groups: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b): ties among members of one trie node that are in different groups so far."""
    # two members are one pair of neighbours, which is settled
    of = below.where("n > 2").join(groups, "node", "left").select("end", "n", "node", F.xxhash64(F.coalesce("group", "node")).alias("group"))
    open_ = of.groupBy("end").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x != y").select("end")
    members = of.join(open_, "end").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    members = written(members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "forest-open")
    rows = members.agg(F.sum("blocks")).first()[0] or 0
    each = members.join(nodes.select("node", "sketch"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("end", "node", "group", "block", "sketch", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tasks = max(1, rows // CROWD_ROWS)
    return each.withColumn("task", F.pmod(F.xxhash64("end", "i", "j"), F.lit(tasks))).groupBy("task").applyInPandas(_crowd(least), "a binary, b binary")


def _marked(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("long").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text"))


@dataclass(frozen=True)
class Forest:
    """signs: a row's key, text hash and node; nodes: each with its first row's key and mark; placed: nodes with their group
    of candidates; links: (node, label, links); classes: (node, component) of linked nodes."""

    signs: DataFrame
    nodes: DataFrame
    placed: DataFrame
    links: DataFrame
    classes: DataFrame

    def verified(self) -> DataFrame:
        """(group, nodes, pairs): how many pairs of each group of candidates were verified exactly."""
        n = F.count("*")
        return self.placed.groupBy("group").agg(n.alias("nodes"), (n * (n - 1) / 2).cast("long").alias("pairs"))


def forest(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL, longest: int = LONGEST_PREFIX, block: int = BLOCK, seed: int = 11) -> Forest:
    """The links and classes of df's rows, with the tables they came from."""
    depth = prefix_depth(threshold, trees, recall, longest)
    least = threshold - ERRORS * (threshold * (1 - threshold) / (trees * longest)) ** 0.5
    docs = _marked(df, key, text)
    signs = written(docs.mapInPandas(_signer(trees, depth, longest, seed), "key long, mark long, node binary, grams int, ends array<long>, tails binary, sketch binary"), "forest-signs")
    worded = signs.where("node is not null")
    row = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("row")
    nodes = worded.groupBy("node").agg(row, F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("ends", "tails", "sketch")])
    nodes = written(nodes.select("node", F.col("row.key").alias("first"), F.col("row.mark").alias("mark"), "copies", "ends", "tails", "sketch"), "forest-nodes")

    below = _below(nodes, trees, 2 * (longest - depth))
    groups = written(connected_components(_ties(below, nodes, least)).withColumnRenamed("component", "group"), "forest-groups")
    more = written(_crowd_ties(below, nodes, groups, least, block), "forest-crowds")
    if not more.isEmpty():
        edges = more.unionByName(groups.select(F.col("node").alias("a"), F.col("group").alias("b")))
        groups = written(connected_components(edges).withColumnRenamed("component", "group"), "forest-groups")
    sized = groups.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = groups.join(sized, "group").join(nodes.select("node", "first", "mark", "copies"), "node")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = written(placed, "forest-placed")
    n, work = placed.agg(F.count("*"), F.sum("blocks")).first()
    chosen = F.broadcast(placed) if n * 128 <= BROADCAST_BYTES else placed
    texts = docs.join(chosen, docs["key"].eqNullSafe(placed["first"]) & (docs["mark"] == placed["mark"])).select("text", "group", "node", "copies", "blocks", "block")
    # rows that share a key and a text are one node: one of them is enough
    grams = texts.mapInPandas(_shingler, "group binary, node binary, copies long, blocks int, block int, grams binary")
    grams = written(grams, "forest-grams").dropDuplicates(["node"])
    each = grams.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("group", "node", "copies", "block", "grams", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tasks = max(1, (work or 0) // TASK_ROWS)
    found = each.withColumn("task", F.pmod(F.xxhash64("group", "i", "j"), F.lit(tasks))).groupBy("task").applyInPandas(_verifier(threshold), "node binary, label binary, links long")
    found = written(found, "forest-links")

    return Forest(signs, nodes, placed, found, connected_components(found, "node", "label"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """One row for each row of df: key, `class_id`, `n_links`.

    `n_links` is the number of other rows whose shingle set has a Jaccard similarity of `threshold` or more (rows
    of the same set included), `class_id` the least key that links lead to. Keys are integers. A text without
    words (null, empty, blank) has no links and is its own class; so has a null key's row the least other key of
    its class, or null. Rows of one key count each by themselves. An empty table gives no rows; other columns play
    no part.
    """
    made = forest(df, key, text, threshold, trees, recall, block=block, seed=seed)
    signs, nodes, classes = made.signs, made.nodes, made.classes
    linked = made.links.groupBy("node").agg(F.sum("links").alias("links"))
    firsts = classes.join(nodes.select("node", "first"), "node")
    least = firsts.groupBy("component").agg(F.min("first").alias("class_id"))
    of_class = firsts.join(least, "component").select("node", "class_id")
    per_node = nodes.select("node", "first", "copies").join(linked, "node", "left").join(of_class, "node", "left")
    per_node = per_node.select("node", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = signs.where("node is not null").select("key", "node").join(per_node, "node").select("key", "class_id", "n_links")
    alone = signs.where("node is null").select("key", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.unionByName(alone).withColumnRenamed("key", key)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df with one row of each class of near duplicates: that of the class's least key, null coming last.

    Keys need not be unique: rows of one key and unlike texts are of several classes, each of which keeps a row. If rows of
    unlike texts share a class's least key, that of the least text hash stays. Rows of one key and one text are one row;
    those are all that a text without words loses. Rows meet the kept ones and drop repeats under one exchange by key and
    text hash, where a null key counts as the least number.
    """
    made = forest(df, key, text, **options)
    signs, nodes, classes = made.signs, made.nodes, made.classes
    row = F.struct(F.col("first").isNull().alias("none"), "first", "mark")
    of_class = nodes.select("node", row.alias("row")).join(classes, "node", "left").groupBy(F.coalesce("component", "node").alias("class"))
    kept = of_class.agg(F.min("row").alias("row")).select(F.col("row.first").alias("key"), F.col("row.mark").alias("_mark"))
    kept = kept.unionByName(signs.where("node is null").select("key", F.col("mark").alias("_mark")))
    at = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    k, mark = unused(df, "_k"), unused(df, "_mark")
    marked = df.withColumn(k, at(f"`{key}`")).withColumn(mark, F.xxhash64(F.col(f"`{text}`")))
    return marked.join(kept.select(at("key").alias(k), F.col("_mark").alias(mark)), [k, mark], "left_semi").dropDuplicates([k, mark]).drop(k, mark)
