"""Item co-occurrence: pairs with PMI, and scores from a reader's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.store import written

PAIR_CAP = 200
LEAST = 3


def pairs(positive: DataFrame, cap: int = PAIR_CAP, least: int = LEAST, order: Column | None = None) -> DataFrame:
    """(book_id_a, book_id_b, co_count, pmi) with a < b as strings and co_count >= least.

    PMI is ln(co * N / (ca * cb)), floored at 0 and kept there. Marginals and N cover all positives; a reader's pairs come
    from the first `cap` items by id, which bounds what one reader can emit and is how the pairs are defined.
    """
    if order is None:
        return pairs_of(written(positive.groupBy("user_id").agg(F.sort_array(F.collect_set("book_id")).alias("b")), "cooc-lists"), cap, least)
    seen = positive.select("user_id", "book_id").distinct()
    marginal = seen.groupBy("book_id").agg(F.count("*").alias("c"))
    total = seen.agg(F.countDistinct("user_id").alias("n"))
    w = Window.partitionBy("user_id").orderBy(order)
    capped = seen.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")
    return _counted(capped.groupBy("user_id").agg(F.sort_array(F.collect_list("book_id")).alias("b")), marginal, total, least)


def pairs_of(lists: DataFrame, cap: int = PAIR_CAP, least: int = LEAST) -> DataFrame:
    """`pairs` of (user_id, b): each reader's distinct items in order. Nothing of a reader is exchanged but its pairs."""
    marginal = lists.select(F.explode("b").alias("book_id")).groupBy("book_id").agg(F.count("*").alias("c"))
    total = lists.where("user_id is not null").agg(F.count("*").alias("n"))
    return _counted(lists.select("user_id", F.slice("b", 1, cap).alias("b")), marginal, total, least)


def _counted(lists: DataFrame, marginal: DataFrame, total: DataFrame, least: int) -> DataFrame:
    # one row a reader: its sorted items; the pairs come from the array, so readers are not joined with themselves
    both = F.flatten(F.transform("b", lambda x, i: F.transform(F.slice("b", i + 2, F.size("b")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    counted = lists.select(F.explode(both).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("co_count")).where(F.col("co_count") >= least)
    ca = marginal.select(F.col("book_id").alias("a"), F.col("c").alias("ca"))
    cb = marginal.select(F.col("book_id").alias("b"), F.col("c").alias("cb"))
    pmi = F.greatest(F.lit(0.0), F.log(F.col("co_count") * F.col("n") / (F.col("ca") * F.col("cb"))))
    return counted.join(ca, "a").join(cb, "b").join(F.broadcast(total)).select(F.col("a").alias("book_id_a"), F.col("b").alias("book_id_b"), "co_count", pmi.alias("pmi"))


def pairs_before(df: DataFrame, cutoff: Column, **options) -> DataFrame:
    """Pairs of the positives added up to the cutoff; rows without a date are left out."""
    return pairs(df.where(F.col("date_added").isNotNull() & (F.col("date_added") <= cutoff)), **options)


def both_ways(edges: DataFrame, value: str = "pmi") -> DataFrame:
    """(book_id, other, value): each pair from both ends."""
    return edges.select(F.col("book_id_a").alias("book_id"), F.col("book_id_b").alias("other"), value).unionByName(edges.select(F.col("book_id_b").alias("book_id"), F.col("book_id_a").alias("other"), value))


def history_scores(history: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, book_id, score): the greatest PMI of each item with any item of the reader's history that it has a pair with."""
    return _scores(history.select("user_id", F.col("book_id").alias("other")).distinct(), edges)


def scores_of(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """`history_scores` of (user_id, b), as `pairs_of` takes them."""
    return _scores(lists.select("user_id", F.explode("b").alias("other")), edges)


def _scores(history: DataFrame, edges: DataFrame) -> DataFrame:
    near = history.join(both_ways(edges), "other")
    return near.groupBy("user_id", "book_id").agg(F.max("pmi").alias("score"))


def max_pmi(cands: DataFrame, history: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, book_id, score): the greatest PMI of a candidate with any item of the reader's history; 0 without a pair."""
    best = history_scores(history, edges)
    return cands.select("user_id", "book_id").join(best, ["user_id", "book_id"], "left").select("user_id", "book_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def collaborative_candidates(scores: DataFrame, n: int = 250) -> DataFrame:
    """(user_id, book_id, rank): a reader's n best by score, ties by id; none for a reader without a positive score."""
    w = Window.partitionBy("user_id")
    ranked = scores.withColumn("_best", F.max("score").over(w)).where("_best > 0")
    return ranked.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "book_id"))).where(F.col("rank") <= n).select("user_id", "book_id", "rank")
