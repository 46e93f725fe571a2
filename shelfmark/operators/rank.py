"""Ranking: relevance blends, diversity, exploration, popularity baselines and the hybrid ranker."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.temporal import popularity_score
from shelfmark.operators.windows import average_percentile, title_fill, top


@dataclass(frozen=True)
class Config:
    """Defaults of the diversity ranker; fixed values."""

    k: int = 10
    explore: int = 2
    trade: float = 0.7
    genre_penalty: float = 0.15
    access: float = 0.05
    clusters: int = 5
    least_pages: int = 50
    floor: float = 0.75
    sparse_share: float = 0.5


@dataclass(frozen=True)
class Weights:
    """Shares of the hybrid ranker's five signals; fixed values."""

    content: float = 0.35
    popularity: float = 0.30
    genre: float = 0.20
    cooccurrence: float = 0.10
    neighbours: float = 0.05

    @classmethod
    def of(cls, **given: float) -> Weights:
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown weights: {', '.join(sorted(unknown))}")
        return cls(**given)


#: Items that each source gives the hybrid ranker, for one reader.
SOURCE_LIMIT = 250


def access_score(pages: Column, least: int, *, over: list[str]) -> Column:
    """Short books first: log pages, min-max in the pool and inverted; too few or unknown pages 0, one length for all 1."""
    ok = pages.isNotNull() & (pages >= least)
    x = F.when(ok, F.log1p(pages.cast("double")))
    w = Window.partitionBy(*over)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(~ok, F.lit(0.0)).when(low == high, F.lit(1.0)).otherwise((high - x) / (high - low))


def greedy(rel: np.ndarray, unit: np.ndarray, genre: np.ndarray, k: int, trade: float, penalty: float) -> tuple[list[int], np.ndarray]:
    """(positions in the order picked, the score that each had then): greedy maximal marginal relevance over one pool.

    The first pick is the most relevant. The similarity to what is picked counts from 0 up. The genre penalty is the
    overlap with all genres picked, over the candidate's own genres. Ties, at twelve places, go to the earlier row.
    """
    near, covered, left, out, best = np.zeros(len(rel)), np.zeros(genre.shape[1], bool), np.ones(len(rel), bool), [], []
    while len(out) < k and left.any():
        score = rel
        if out:
            overlap = (genre & covered).sum(1) / np.maximum(genre.sum(1), 1)
            score = np.round(trade * rel - (1 - trade) * near - penalty * overlap, 12)
        pick = int(np.argmax(np.where(left, score, -np.inf)))
        out.append(pick)
        best.append(score[pick])
        left[pick] = False
        covered |= genre[pick]
        near = np.maximum(near, unit @ unit[pick])
    return out, np.array(best)


def diversify(user_rows: pd.DataFrame, k: int, trade: float, penalty: float) -> list[int]:
    """`greedy` over one reader's pool (relevance, vec, genres); positions in the order picked."""
    vec = np.array(user_rows["vec"].tolist(), dtype=float)
    length = np.linalg.norm(vec, axis=1)
    unit = vec / np.where(length == 0, 1, length)[:, None]
    return greedy(user_rows["relevance"].to_numpy(float), unit, np.array(user_rows["genres"].tolist(), dtype=bool), k, trade, penalty)[0]


def mmr(pool: DataFrame, k: int = 10, trade: float = 0.7, penalty: float = 0.15) -> DataFrame:
    """(user_id, book_id, rank) from a pool (user_id, book_id, relevance, vec, genres).

    Picking is sequential, so each reader's pool (the retrieved clusters) goes to Python; only it does.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["book_id"]).reset_index(drop=True)
        picks = diversify(g, k, trade, penalty)
        return pd.DataFrame({"user_id": g["user_id"].iloc[picks].to_numpy(), "book_id": g["book_id"].iloc[picks].to_numpy(), "rank": np.arange(1, len(picks) + 1)})

    return pool.select("user_id", "book_id", "relevance", "vec", "genres").groupBy("user_id").applyInPandas(run, "user_id string, book_id string, rank int")


def exploration(scored: DataFrame, picked: DataFrame, config: Config) -> DataFrame:
    """(user_id, book_id, rank): tail or mid items of macros without a pick, near enough to the best; tail first.

    `scored` has user_id, book_id, macro, segment, relevance. The floor is a share of the reader's best relevance, or that
    best itself where it is not positive.
    """
    best = F.max("relevance").over(Window.partitionBy("user_id"))
    floor = F.when(best > 0, best * config.floor).otherwise(best)
    taken = picked.join(scored.select("user_id", "book_id", "macro"), ["user_id", "book_id"]).select("user_id", "macro").distinct()
    free = scored.withColumn("_floor", floor).where("relevance >= _floor and segment in ('tail', 'mid')")
    free = free.join(taken, ["user_id", "macro"], "left_anti")
    order = [F.when(F.col("segment") == "tail", 0).otherwise(1), F.desc("relevance"), F.col("book_id")]
    one = top(free, 1, order, over=["user_id", "macro"], rank="_m")
    return top(one, config.explore, order, over=["user_id"]).select("user_id", "book_id", "rank")


def slots(interest: DataFrame, explore: DataFrame, k: int, n_explore: int) -> DataFrame:
    """(user_id, book_id, slot, rank): k - n interest picks, then exploration, then interest again until k."""
    first = interest.where(F.col("rank") <= k - n_explore).select("user_id", "book_id", F.lit("interest").alias("slot"), F.lit(0).alias("_o"), "rank")
    second = explore.select("user_id", "book_id", F.lit("exploration").alias("slot"), F.lit(1).alias("_o"), "rank")
    third = interest.where(F.col("rank") > k - n_explore).join(explore, ["user_id", "book_id"], "left_anti").select("user_id", "book_id", F.lit("interest").alias("slot"), F.lit(2).alias("_o"), "rank")
    both = first.unionByName(second).unionByName(third)
    return top(both.withColumnRenamed("rank", "_r"), k, [F.col("_o"), F.col("_r"), F.col("book_id")], over=["user_id"]).drop("_o", "_r")


def popularity_top(users: DataFrame, items: DataFrame, consumed: DataFrame, k: int) -> DataFrame:
    """(user_id, book_id, score, rank): each reader's k most popular unread items.

    A reader's k best unread are among the first k + reads of the one global order, so a reader meets that prefix only,
    by a join on its positions; the order itself is kept once.
    """
    order = items.select("book_id", popularity_score(F.col("n"), F.col("mean_rating")).alias("score"))
    order = order.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "book_id")))
    reads = consumed.select("user_id", "book_id").distinct()
    seen = reads.join(order.select("book_id"), "book_id").groupBy("user_id").agg(F.count("*").alias("n_seen"))
    want = users.select("user_id").distinct().join(seen, "user_id", "left").withColumn("pos", F.explode(F.sequence(F.lit(1), (F.coalesce("n_seen", F.lit(0)) + k).cast("int"))))
    met = want.join(order, "pos").join(reads, ["user_id", "book_id"], "left_anti")
    return top(met, k, [F.col("pos")], over=["user_id"]).select("user_id", "book_id", "score", "rank")


def genre_popularity_top(user_genres: DataFrame, items: DataFrame, consumed: DataFrame, k: int) -> DataFrame:
    """The same among items that share any genre with the reader's mask; a reader without genres gets the global order.

    Readers meet one order for each distinct mask (a bounded number), cut to the first k + reads.
    """
    masks = user_genres.select("mask").distinct()
    order = items.select("book_id", F.col("mask").alias("item_mask"), popularity_score(F.col("n"), F.col("mean_rating")).alias("score"))
    fits = (F.col("mask") == 0) | (F.col("mask").bitwiseAND(F.col("item_mask")) != 0)
    ranked = F.broadcast(masks).join(order, fits).withColumn("pos", F.row_number().over(Window.partitionBy("mask").orderBy(F.desc(F.round("score", 9)), "book_id")))
    reads = consumed.select("user_id", "book_id").distinct()
    seen = reads.groupBy("user_id").agg(F.count("*").alias("n_seen"))
    want = user_genres.join(seen, "user_id", "left").withColumn("pos", F.explode(F.sequence(F.lit(1), (F.coalesce("n_seen", F.lit(0)) + k).cast("int"))))
    met = want.join(ranked.select("mask", "pos", "book_id", "score"), ["mask", "pos"]).join(reads, ["user_id", "book_id"], "left_anti")
    return top(met, k, [F.col("pos")], over=["user_id"]).select("user_id", "book_id", "score", "rank")


def random_top(users: DataFrame, items: DataFrame, consumed: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(user_id, book_id, rank): k unread items of each reader in a seeded pseudorandom order.

    Items stand in one seeded order, read as a ring; a reader's own order is the ring from a place that its hash names, so
    it meets the first k + reads places only, by a join on them.
    """
    ring = items.select("book_id").distinct()
    n = ring.count()
    ring = ring.withColumn("pos", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "book_id"), "book_id")) - 1)
    reads = consumed.select("user_id", "book_id").distinct()
    seen = reads.join(ring.select("book_id"), "book_id").groupBy("user_id").agg(F.count("*").alias("n_seen"))
    want = users.select("user_id").distinct().join(seen, "user_id", "left")
    steps = F.sequence(F.lit(0), F.least(F.lit(n), F.coalesce("n_seen", F.lit(0)) + k).cast("int") - 1)
    want = want.where(F.lit(n > 0)).withColumn("step", F.explode(steps)).withColumn("pos", F.pmod(F.xxhash64(F.lit(seed + 1), "user_id") + F.col("step"), F.lit(max(1, n))).cast("int"))
    met = want.join(ring, "pos").join(reads, ["user_id", "book_id"], "left_anti")
    return top(met, k, [F.col("step")], over=["user_id"]).select("user_id", "book_id", "rank")


def cold_start(items: DataFrame, least_pages: int = 50) -> DataFrame:
    """(macro, book_id): the shortest accessible item of each macro, or its first item where none is."""
    ok = F.col("num_pages").isNotNull() & (F.col("num_pages") >= least_pages)
    return top(items, 1, [(~ok).cast("int"), F.when(ok, F.col("num_pages")), F.col("book_id")], over=["macro"], rank="_r").select("macro", "book_id")


def hybrid(signals: DataFrame, weights: Weights, titles: DataFrame, k: int) -> DataFrame:
    """(user_id, book_id, score, rank): the weighted sum of average-rank percentiles of five signals over a reader's pool.

    `signals` has user_id, book_id and one column for each weight, missing values 0. A signal that is one value for all
    counts a half. Ties go to the lower id; repeats of a title fill up at the end.
    """
    parts = [average_percentile(F.coalesce(F.col(f.name).cast("double"), F.lit(0.0)), over=["user_id"]) * getattr(weights, f.name) for f in fields(weights)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    scored = signals.withColumn("score", F.round(total, 9)).join(titles.select("book_id", "title_key"), "book_id", "left")
    return title_fill(scored, "user_id", [F.desc("score"), F.col("book_id")], "title_key", k).select("user_id", "book_id", "score", "rank")


def blend(pool: DataFrame, alpha: float, content: str = "content", collaborative: str = "collaborative") -> DataFrame:
    """`blend`: alpha times the content percentile plus the rest times the collaborative one."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    return pool.withColumn("blend", average_percentile(content, over=["user_id"]) * alpha + average_percentile(collaborative, over=["user_id"]) * (1 - alpha))
