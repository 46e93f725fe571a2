"""Candidate retrieval by clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.vectors import dot_of, finite, mean_by, unit, width_of
from shelfmark.operators.windows import round_robin, top


def eligible(items: DataFrame, clusters: int) -> DataFrame:
    """Items with an id, a title, a finite vector and a cluster that exists."""
    has = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    return items.where(has("book_id") & has("title") & finite(F.col("vec")) & F.col("cluster").isNotNull() & F.col("cluster").between(0, clusters - 1))


def centroids(items: DataFrame) -> DataFrame:
    """(cluster, vec)."""
    return mean_by(items, ["cluster"], "vec")


def cluster_scores(modes: DataFrame, centres: DataFrame) -> DataFrame:
    """(user_id, mode, cluster, score): mode weight times cosine. The centres are a bounded table and are broadcast."""
    d = width_of(centres, "vec")
    c = F.broadcast(centres.select("cluster", unit(F.col("vec")).alias("centre")))
    m = modes.select("user_id", "mode", "weight", unit(F.col("vec")).alias("_u"))
    return m.join(c).select("user_id", "mode", "cluster", (F.col("weight") * dot_of(F.col("_u"), F.col("centre"), d)).alias("score"))


def pooled_clusters(modes: DataFrame, centres: DataFrame, n: int = 5) -> DataFrame:
    """(user_id, cluster, score, rank): the clusters of greatest weighted cosine over a reader's modes."""
    best = cluster_scores(modes, centres).groupBy("user_id", "cluster").agg(F.max("score").alias("score"))
    return top(best, n, [F.desc(F.round("score", 9)), F.col("cluster")], over=["user_id"])


def interleaved_clusters(modes: DataFrame, centres: DataFrame, n: int = 5) -> DataFrame:
    """(user_id, cluster, rank): each mode's own best clusters, taken in turns, strongest mode first, up to n."""
    s = cluster_scores(modes, centres).join(modes.select("user_id", "mode", "weight"), ["user_id", "mode"])
    lanes = top(s, n, [F.desc(F.round("score", 9)), F.col("cluster")], over=["user_id", "mode"], rank="_rank")
    order = modes.select("user_id", "mode", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("weight"), "mode")).alias("_lane"))
    return round_robin(lanes.join(order, ["user_id", "mode"]), "user_id", "_lane", "_rank", "cluster", n)


def candidates(clusters: DataFrame, items: DataFrame, consumed: DataFrame) -> DataFrame:
    """(user_id, book_id, cluster): unseen items of a reader's clusters."""
    met = clusters.select("user_id", "cluster").join(items.select("book_id", "cluster"), "cluster")
    return met.join(consumed.select("user_id", "book_id").distinct(), ["user_id", "book_id"], "left_anti")


def candidate_counts(clusters: DataFrame, items: DataFrame, consumed: DataFrame) -> DataFrame:
    """(user_id, n): how many `candidates` each reader has, if any; the sizes of its clusters less what it read of them."""
    of = items.select("book_id", "cluster")
    all_of = clusters.select("user_id", "cluster").join(F.broadcast(of.groupBy("cluster").agg(F.count("*").alias("n"))), "cluster")
    gone = consumed.select("user_id", "book_id").distinct().join(of, "book_id").join(clusters.select("user_id", "cluster"), ["user_id", "cluster"])
    both = all_of.select("user_id", "n").unionByName(gone.select("user_id", F.lit(-1).cast("long").alias("n")))
    return both.groupBy("user_id").agg(F.sum("n").alias("n")).where("n > 0")


def candidates_among(asked: DataFrame, clusters: DataFrame, items: DataFrame, consumed: DataFrame) -> DataFrame:
    """(user_id, book_id): those of the asked pairs that are `candidates`, which are not all listed for it."""
    of = asked.select("user_id", "book_id").distinct().join(items.select("book_id", "cluster"), "book_id")
    return of.join(clusters.select("user_id", "cluster"), ["user_id", "cluster"], "left_semi").join(consumed.select("user_id", "book_id").distinct(), ["user_id", "book_id"], "left_anti")


def relevance(cands: DataFrame, modes: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, book_id, relevance): the greatest weighted cosine over a reader's modes."""
    d = width_of(items, "vec")
    with_vec = cands.select("user_id", "book_id").join(items.select("book_id", unit(F.col("vec")).alias("_v")), "book_id")
    scored = with_vec.join(modes.select("user_id", "weight", unit(F.col("vec")).alias("_u")), "user_id")
    return scored.groupBy("user_id", "book_id").agg(F.max(F.col("weight") * dot_of(F.col("_u"), F.col("_v"), d)).alias("relevance"))
