"""Ranking metrics over lists (user_id, system, k, rank, book_id) and relevant items (user_id, book_id)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.vectors import cosine


def ranking(recs: DataFrame, relevant: DataFrame) -> DataFrame:
    """(user_id, system, k, precision, recall, ndcg, average_precision) for each list of a reader with relevant items.

    Precision divides by k, average precision by min(relevant, k).
    """
    # one row a reader of what is relevant to it: lists are dealt by reader once, and all that follows is of one reader
    rel = relevant.select("user_id", "book_id").distinct().groupBy("user_id").agg(F.count("*").alias("n_rel"), F.collect_list("book_id").alias("_rel"))
    met = recs.select("user_id", "system", "k", "rank", "book_id").join(rel, "user_id")
    hit = met.select("user_id", "system", "k", "rank", "n_rel", F.coalesce(F.array_contains("_rel", F.col("book_id")).cast("int"), F.lit(0)).alias("hit"))
    so_far = F.sum("hit").over(Window.partitionBy("user_id", "system", "k").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    scored = hit.withColumn("_p", F.col("hit") * so_far / F.col("rank")).withColumn("_g", F.col("hit") / F.log2(F.col("rank") + 1.0))
    joined = scored.groupBy("user_id", "system", "k").agg(F.max("n_rel").alias("n_rel"), F.sum("hit").alias("hits"), F.sum("_p").alias("ap"), F.sum("_g").alias("dcg"))
    most = F.least("n_rel", F.col("k").cast("long"))
    ideal = F.aggregate(F.sequence(F.lit(1), most.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return joined.select("user_id", "system", "k", (F.col("hits") / F.col("k")).alias("precision"), (F.col("hits") / F.col("n_rel")).alias("recall"), (F.col("dcg") / ideal).alias("ndcg"), (F.col("ap") / most).alias("average_precision"))


def candidate_recall(cands: DataFrame, relevant: DataFrame) -> DataFrame:
    """(user_id, candidate_recall): the share of relevant items among the candidates."""
    rel = relevant.select("user_id", "book_id").distinct()
    got = rel.join(cands.select("user_id", "book_id").distinct().withColumn("_in", F.lit(1)), ["user_id", "book_id"], "left")
    return got.groupBy("user_id").agg((F.count("_in") / F.count("*")).alias("candidate_recall"))


def diversity(recs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, system, k, diversity): the mean of 1 - cosine (clipped to -1..1, so up to 2) over the pairs of a list; 0 below two items."""
    keys = ["user_id", "system", "k"]
    v = recs.join(vectors.select("book_id", "vec"), "book_id").select(*keys, "rank", "vec")
    pairs = v.join(v.select(*keys, F.col("rank").alias("_r"), F.col("vec").alias("_v")), keys).where("rank < _r")
    apart = 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("vec"), F.col("_v"))))
    return v.select(*keys).distinct().join(pairs.groupBy(*keys).agg(F.avg(apart).alias("diversity")), keys, "left").select(*keys, F.coalesce("diversity", F.lit(0.0)).alias("diversity"))


def slot_metrics(recs: DataFrame, relevant: DataFrame) -> DataFrame:
    """(user_id, system, k, slot, precision, hit_rate) by kind of slot; an empty slot has no row."""
    hit = recs.join(relevant.select("user_id", "book_id").distinct().withColumn("hit", F.lit(1)), ["user_id", "book_id"], "left")
    return hit.groupBy("user_id", "system", "k", "slot").agg((F.count("hit") / F.count("*")).alias("precision"), F.when(F.count("hit") > 0, 1.0).otherwise(0.0).alias("hit_rate"))


def novelty(recs: DataFrame, books: DataFrame) -> DataFrame:
    """(system, k, novelty, mean_log_popularity, tail_share, head_share): -log2 of an item's smoothed share of popularity.

    The denominator covers all books; `books` has book_id, n, segment.
    """
    total = books.agg((F.sum(F.coalesce("n", F.lit(0))) + F.count("*")).alias("_total"))
    p = (F.coalesce("n", F.lit(0)) + 1) / F.col("_total")
    # counted by item before items are looked up, so that what is exchanged does not grow with the readers
    joined = _shown(recs).join(books.select("book_id", "n", "segment"), "book_id").join(F.broadcast(total))
    mean = lambda x: F.sum(x * F.col("_n")) / F.sum(F.when(x.isNotNull(), F.col("_n")))
    share = lambda s: mean((F.col("segment") == s).cast("double"))
    return joined.groupBy("system", "k").agg(mean(-F.log2(p)).alias("novelty"), mean(F.log1p(F.coalesce("n", F.lit(0)).cast("double"))).alias("mean_log_popularity"), share("tail").alias("tail_share"), share("head").alias("head_share"))


def _shown(recs: DataFrame) -> DataFrame:
    """How often each system showed each item."""
    return recs.groupBy("system", "k", "book_id").agg(F.count("*").alias("_n"))


def coverage(recs: DataFrame, books: DataFrame) -> DataFrame:
    """(system, k, coverage, tail_coverage): distinct items shown over eligible ones, and the same among the tail."""
    n = books.agg(F.count("*").alias("_n"), F.count_if(F.col("segment") == "tail").alias("_t"))
    shown = _shown(recs).join(books.select("book_id", "segment"), "book_id")
    agg = shown.groupBy("system", "k").agg(F.count("*").alias("_s"), F.count_if(F.col("segment") == "tail").alias("_st"))
    return agg.join(F.broadcast(n)).select("system", "k", (F.col("_s") / F.col("_n")).alias("coverage"), F.coalesce(F.col("_st") / F.nullif("_t", F.lit(0)), F.lit(0.0)).alias("tail_coverage"))


def by_system(per_user: DataFrame, metrics: list[str]) -> DataFrame:
    """(system, k, users, mean of each metric); NaN counts as missing."""
    mean = lambda c: F.avg(F.when(~F.isnan(c), F.col(c))).alias(c)
    return per_user.groupBy("system", "k").agg(F.countDistinct("user_id").alias("users"), *[mean(c) for c in metrics])


def verdict(summary: DataFrame, model: str, baseline: str) -> DataFrame:
    """(k, recall_gain, ndcg_gain, wins): whether the model is above the baseline in recall and NDCG at each k."""
    of = lambda s, c: F.max(F.when(F.col("system") == s, F.col(c)))
    gains = summary.groupBy("k").agg((of(model, "recall") - of(baseline, "recall")).alias("recall_gain"), (of(model, "ndcg") - of(baseline, "ndcg")).alias("ndcg_gain"))
    return gains.withColumn("wins", (F.col("recall_gain") > 0) & (F.col("ndcg_gain") > 0))


def bootstrap(per_user: DataFrame, metric: str, resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(system, k, mean, low, high): percentile intervals of the mean over readers.

    A reader's weight in a resample is a seeded Poisson draw from a hash, so the resamples are one grouped sum over the
    table, and no reader's rows are gathered. Rows with a missing metric are left out.
    """
    u = per_user.where(F.col(metric).isNotNull() & ~F.isnan(metric)).select("user_id", "system", "k", F.col(metric).alias("x"))
    each = u.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    unit = F.pmod(F.xxhash64(F.lit(seed), "r", "user_id"), F.lit(1 << 40)) / float(1 << 40)
    weight, edge, p = F.lit(0), 0.0, float(np.exp(-1))
    for i in range(1, 12):
        edge += p
        p /= i
        weight = weight + (unit >= edge).cast("int")
    means = each.withColumn("w", weight).groupBy("system", "k", "r").agg((F.sum(F.col("x") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    tail = (1 - level) / 2
    cuts = means.groupBy("system", "k").agg(F.percentile("m", F.lit([tail, 1 - tail])).alias("c"))
    return u.groupBy("system", "k").agg(F.avg("x").alias("mean")).join(cuts, ["system", "k"]).select("system", "k", "mean", F.col("c")[0].alias("low"), F.col("c")[1].alias("high"))


def full_summary(recs: DataFrame, relevant: DataFrame, books: DataFrame) -> DataFrame:
    """(system, k, users, precision, recall, ndcg, average_precision, novelty, coverage, tail_coverage, ...) of each list family."""
    means = by_system(ranking(recs, relevant), ["precision", "recall", "ndcg", "average_precision"])
    return means.join(novelty(recs, books), ["system", "k"]).join(coverage(recs, books), ["system", "k"])


_FLOORS = ("coverage", "novelty", "tail_coverage")


def _beside(summary: DataFrame, system: str, tag: str) -> DataFrame:
    return summary.where(F.col("system") == system).select("k", *[F.col(c).alias(f"{tag}_{c}") for c in ("recall", "ndcg", *_FLOORS)])


def _beats(tag: str) -> Column:
    ok = (F.col("recall") > F.col(f"{tag}_recall")) & (F.col("ndcg") > F.col(f"{tag}_ndcg"))
    for c in _FLOORS:
        ok = ok & (F.col(c) >= F.col(f"{tag}_{c}"))
    return ok


def grid_winner(summary: DataFrame, baseline: str, content: str, k: int = 10) -> DataFrame:
    """(winner): of the systems that beat the baseline at every k, the best at `k` by NDCG, recall, coverage and novelty; else the content system.

    To beat is more recall and NDCG, and no less coverage, novelty and tail coverage.
    """
    ks = summary.where(F.col("system") == baseline).agg(F.countDistinct("k").alias("_ks"))
    met = summary.where(~F.col("system").isin(baseline, content)).join(_beside(summary, baseline, "b"), "k")
    good = met.groupBy("system").agg(F.count_if(_beats("b")).alias("_won")).join(ks).where("_won = _ks").select("system")
    order = [F.desc("ndcg"), F.desc("recall"), F.desc("coverage"), F.desc("novelty"), F.col("system")]
    best = summary.where(F.col("k") == k).join(good, "system", "left_semi").orderBy(*order).limit(1)
    return best.agg(F.coalesce(F.max("system"), F.lit(content)).alias("winner"))


def ab_winner(summary: DataFrame, baseline: str, content: str, k: int = 10) -> DataFrame:
    """(winner): at one k, the best variant that beats the baseline and is no worse than the content system; else the content system.

    Best is by NDCG, recall, then candidate recall where the summary has it; what is still tied goes to the first name.
    """
    at = summary.where(F.col("k") == k)
    met = at.where(~F.col("system").isin(baseline, content)).join(_beside(at, baseline, "b"), "k").join(_beside(at, content, "c"), "k")
    ok = _beats("b") & (F.col("recall") >= F.col("c_recall")) & (F.col("ndcg") >= F.col("c_ndcg"))
    order = [F.desc(c) for c in ("ndcg", "recall", "candidate_recall") if c in summary.columns]
    best = met.where(ok).orderBy(*order, "system").limit(1)
    return best.agg(F.coalesce(F.max("system"), F.lit(content)).alias("winner"))


def signal_rows(results: DataFrame, signal: str = "cooccurrence") -> DataFrame | None:
    """The label, system, k, recall and NDCG of one signal's rows in a table of results; None where it lacks the columns."""
    if not {"collaborative_signal", "system"} <= set(results.columns):
        return None
    told = [c for c in ("config_label", "system", "k", "recall", "ndcg") if c in results.columns]
    return results.where(F.col("collaborative_signal") == signal).select(*told)
