"""Analytics of an undirected weighted graph: vertices (id) and edges (a, b, w) with a < b."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.components import connected_components
from shelfmark.operators.profile import spearman
from shelfmark.operators.windows import global_top, top
from shelfmark.store import written


def ends(edges: DataFrame) -> DataFrame:
    """(id, other, w): each edge from both ends."""
    return edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "w").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "w"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, weighted_degree); a vertex without edges has zeros."""
    d = ends(edges).groupBy("id").agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"))
    return vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """(id, rank): weighted PageRank; a vertex whose edges weigh nothing is dangling, and its rank spreads evenly.

    Each round is one join and one grouped sum, written to the shared folder; it ends when the ranks move less than
    `tolerance` a vertex in all, and it is an error if they do not in `rounds` rounds. Without positive edges the ranks are
    uniform.
    """
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    out = ends(edges).where("w > 0")
    share = out.join(out.groupBy("id").agg(F.sum("w").alias("_t")), "id").select("id", "other", (F.col("w") / F.col("_t")).alias("p"))
    share = written(share, "pagerank-shares")
    linked = share.select("id").distinct().withColumn("linked", F.lit(True))
    ranks = written(vertices.select("id").join(linked, "id", "left").select("id", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(1.0 / n).alias("rank")), "pagerank")
    spread = F.coalesce(F.sum(F.when(~F.col("linked"), F.col("rank"))), F.lit(0.0))
    loose = ranks.agg(spread).first()[0]
    for _ in range(rounds):
        given = ranks.join(share, "id").groupBy(F.col("other").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        new = ranks.join(given, "id", "left").select("id", "linked", (damping * (F.coalesce("got", F.lit(0.0)) + loose / n) + (1 - damping) / n).alias("rank"), F.col("rank").alias("_old"))
        new = written(new, "pagerank")
        moved, loose = new.agg(F.sum(F.abs(F.col("rank") - F.col("_old"))), spread).first()
        ranks = new.drop("_old")
        if moved < n * tolerance:
            return ranks.select("id", "rank")
    raise RuntimeError(f"ranks did not settle in {rounds} rounds")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of the component; a vertex without edges is its own."""
    found = connected_components(edges)
    return vertices.select("id").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, density, isolated, components, largest_fraction) in one row."""
    d = degrees(vertices, edges)
    n, e = F.col("nodes"), F.col("edges")
    counts = d.agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") == 0).alias("isolated"))
    sizes = components(vertices, edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    all_ = counts.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(sizes)
    density = F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(F.lit(0.0))
    return all_.select("nodes", "edges", density.alias("density"), "isolated", "components", (F.col("largest") / n).alias("largest_fraction"))


def sensitivity(vertices: DataFrame, edges: DataFrame, cuts: list[int]) -> DataFrame:
    """(threshold, edges, connected_nodes, components, largest_fraction): what is left at each least co_count.

    All cuts go through one search of components, whose nodes are pairs of cut and vertex, so its rounds are those of the
    longest path of any cut. A vertex without edges is a component of its own. Without vertices the fraction is 0.
    """
    each = edges.withColumn("threshold", F.explode(F.array(*[F.lit(c) for c in cuts]))).where("co_count >= threshold")
    each = written(each.select("threshold", "a", "b"), "cut-edges")
    e = each.groupBy("threshold").agg(F.count("*").alias("edges"))
    of = lambda c: F.struct("threshold", F.col(c).alias("id"))
    found = connected_components(each.select(of("a").alias("a"), of("b").alias("b")))
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).groupBy("component.threshold")
    c = sizes.agg(F.sum("n").alias("connected_nodes"), F.count("*").alias("_groups"), F.max("n").alias("_largest"))
    n = F.col("_nodes")
    base = edges.sparkSession.createDataFrame([(c,) for c in cuts], "threshold int").crossJoin(vertices.agg(F.count("*").alias("_nodes")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    alone = n - zero("connected_nodes")
    largest = F.greatest(zero("_largest"), F.least(n, F.lit(1)))
    return base.join(e, "threshold", "left").join(c, "threshold", "left").select(
        "threshold",
        zero("edges").alias("edges"),
        zero("connected_nodes").alias("connected_nodes"),
        (zero("_groups") + alone).alias("components"),
        F.when(n > 0, largest / n).otherwise(F.lit(0.0)).alias("largest_fraction"),
    )


def _paths_from(source: str, near: dict[str, list[tuple[str, float]]]) -> dict[str, float]:
    """Each vertex's dependency on shortest paths from one source, weights being lengths."""
    dist: dict[str, float] = {source: 0.0}
    count: dict[str, float] = defaultdict(float, {source: 1.0})
    before: dict[str, list[str]] = defaultdict(list)
    done: list[str] = []
    closed: set[str] = set()
    queue = [(0.0, source)]
    while queue:
        d, v = heapq.heappop(queue)
        if v in closed:
            continue
        closed.add(v)
        done.append(v)
        for u, w in near.get(v, ()):
            far = d + w
            if u in closed:
                continue
            if u not in dist or far < dist[u]:
                dist[u], count[u], before[u] = far, count[v], [v]
                heapq.heappush(queue, (far, u))
            elif far == dist[u]:
                count[u] += count[v]
                before[u].append(v)
    out: dict[str, float] = defaultdict(float)
    for v in reversed(done):
        for p in before[v]:
            out[p] += count[p] / count[v] * (1 + out[v])
    out.pop(source, None)
    return out


def betweenness(vertices: DataFrame, edges: DataFrame, sources: int = 500, seed: int = 42, most_edges: int = 20_000_000) -> DataFrame:
    """(id, betweenness): normalised shortest-path betweenness from up to `sources` seeded sources, weights being lengths.

    Sources are drawn from the vertices with edges, as no path starts at the others. They are dealt over the tasks, each of
    which needs the adjacency, so the edge table is broadcast behind a check of its size; a graph beyond `most_edges` is
    refused. Vertices at one distance, joined by edges of length 0, are passed only in the order in which the search closes them.
    """
    connected = vertices.select("id").join(edges.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_semi")
    n, m, reached = vertices.count(), edges.count(), connected.count()
    if m > most_edges:
        raise ValueError(f"{m} edges do not fit a broadcast; cut the graph by a threshold first")
    near: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for r in edges.select("a", "b", "w").toLocalIterator():
        near[r[0]].append((r[1], r[2]))
        near[r[1]].append((r[0], r[2]))
    shared = vertices.sparkSession.sparkContext.broadcast(dict(near))
    chosen = connected.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sources)
    used = min(sources, reached)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total: dict[str, float] = defaultdict(float)
            for s in b["id"]:
                for v, x in _paths_from(s, shared.value).items():
                    total[v] += x
            yield pd.DataFrame({"id": list(total), "x": list(total.values())})

    parts = chosen.repartition(vertices.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "id string, x double")
    scale = 1.0 / ((n - 1) * (n - 2)) * (reached / used) if n > 2 and used else 0.0
    sums = parts.groupBy("id").agg((F.sum("x") * scale).alias("betweenness"))
    return vertices.select("id").join(sums, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def against_popularity(nodes: DataFrame, metric: str, popularity: str, k: int) -> DataFrame:
    """(rho, overlap): Spearman on connected nodes; the share of common items in the two top k over all nodes."""
    rho = spearman(nodes.where("degree > 0"), metric, popularity)
    best = lambda c: nodes.orderBy(F.desc(F.round(c, 9)), "id").limit(k).select("id")
    common = best(metric).join(best(popularity), "id", "left_semi").agg((F.count("*") / F.lit(float(k))).alias("overlap"))
    return rho.crossJoin(common)


def export_edges(edges: DataFrame, ranks: DataFrame, nodes: int = 600, per_node: int = 8) -> DataFrame:
    """The strongest `per_node` edges of either end among the `nodes` vertices of highest rank."""
    keep = global_top(ranks, nodes, [F.desc(F.round("rank", 9)), F.col("id")], rank="_r").select("id")
    inner = edges.join(keep.withColumnRenamed("id", "a"), "a", "left_semi").join(keep.withColumnRenamed("id", "b"), "b", "left_semi")
    strong = top(ends(inner), per_node, [F.desc(F.round("w", 9)), F.col("other")], over=["id"], rank="_r")
    pairs = strong.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return inner.join(pairs, ["a", "b"], "left_semi").select("a", "b", "w")


def view(items: DataFrame, edges: DataFrame, least: float, flag: Column | None = None) -> DataFrame:
    """(a, b, w): the edges shown by a viewer: of at least this weight, and between items that the flag shows."""
    shown = edges.where(F.col("w") >= least)
    if flag is None:
        return shown
    ids = items.where(flag).select("book_id")
    for end in ("a", "b"):
        shown = shown.join(ids.withColumnRenamed("book_id", end), end, "left_semi")
    return shown.select("a", "b", "w")
