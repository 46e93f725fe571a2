"""Reader profiles: taste vectors, counts, taste modes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.vectors import cosine, mean_by

POSITIVE = 4.0
COLD_BELOW = 3
#: Readers with fewer positives have one mode; others one for every three, four at most.
MODES_FROM, MODES_MOST, PER_MODE = 6, 4, 3


def positives(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("is_read", F.lit(False)) & (F.col("rating_clean") >= POSITIVE))


def engagement() -> Column:
    """How much a positive counts: stars over 3, more with a text, more for a plausible reading time; an unknown time changes nothing."""
    days = F.col("reading_duration_days")
    timely = F.coalesce((days >= 1) & (days <= 180), F.lit(False))
    return (F.col("rating_clean") - 3) * F.when(F.col("has_review_text"), 1.3).otherwise(1.0) * F.when(timely, 1.2).otherwise(1.0)


def taste_vectors(df: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, vec): the plain mean of the vectors of a reader's positives; positives without a vector are dropped."""
    return mean_by(positives(df).join(vectors.select("book_id", "vec"), "book_id"), ["user_id"], "vec")


def dropped_positives(df: DataFrame, vectors: DataFrame) -> DataFrame:
    """(n): positives whose item has no vector."""
    return positives(df).join(vectors, "book_id", "left_anti").agg(F.count("*").alias("n"))


def user_meta(df: DataFrame, genres: DataFrame, flags: list[str], features: DataFrame) -> DataFrame:
    """(user_id, n_interactions, n_positives, n_reviews, n_want_to_read, last_date, genre_breadth, bias, cold_start)."""
    pos = F.coalesce("is_read", F.lit(False)) & (F.col("rating_clean") >= POSITIVE)
    joined = df.join(genres.select("book_id", *flags), "book_id", "left")
    on = [F.max(F.when(pos, F.col(f))).alias(f"_{f}") for f in flags]
    agg = joined.groupBy("user_id").agg(
        F.count("*").alias("n_interactions"),
        F.count_if(pos).alias("n_positives"),
        F.count_if("has_review_text").alias("n_reviews"),
        F.count_if(F.col("engagement_mode") == "want_to_read").alias("n_want_to_read"),
        F.max("date_added").alias("last_date"),
        *on,
    )
    breadth = sum((F.coalesce(F.col(f"_{f}"), F.lit(0)) for f in flags), F.lit(0))
    bias = features.select("user_id", F.col("user_rating_bias").alias("bias"))
    return agg.join(bias, "user_id", "left").select("user_id", "n_interactions", "n_positives", "n_reviews", "n_want_to_read", "last_date", breadth.alias("genre_breadth"), F.coalesce("bias", F.lit(0.0)).alias("bias"), (F.col("n_positives") < COLD_BELOW).alias("cold_start"))


def mode_count(n: Column) -> Column:
    return F.when(n < MODES_FROM, F.lit(1)).otherwise(F.least(F.lit(MODES_MOST), F.floor(n / PER_MODE))).cast("int")


def lloyd(x: np.ndarray, k: int, seed: int, starts: int = 10, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(centres, labels) of the best of several seeded k-means runs with distance-weighted starts."""
    rng, first = np.random.default_rng(seed), []
    for _ in range(starts):
        own = [rng.integers(len(x))]
        d = ((x - x[own[0]]) ** 2).sum(-1)
        while len(own) < k:
            total = d.sum()
            if total:  # as rng.choice(len(x), p=d / total) draws, without its checks
                at = (d / total).cumsum()
                own.append((at / at[-1]).searchsorted(rng.random(), side="right"))
            else:
                own.append(rng.integers(len(x)))
            d = np.minimum(d, ((x - x[own[-1]]) ** 2).sum(-1))
        first.append(own)
    # the rounds draw nothing, so all starts go through them together, each until it stands still
    centres, live = x[np.array(first)], np.arange(starts)
    for _ in range(rounds):
        now = centres[live]
        dist = _apart(x, now)
        of = dist.argmin(2)[:, None] == np.arange(k)[None, :, None]
        n = of.sum(2)
        new = (of[..., None] * x).sum(2) / np.maximum(n, 1)[:, :, None]
        for s, j in np.argwhere(n == 0):
            new[s, j] = x[dist[s].min(1).argmax()]
        still = (np.abs(new - now) <= 1e-8 + 1e-5 * np.abs(now)).all((1, 2))
        live = live[~still]
        if not len(live):
            break
        centres[live] = new[~still]
    dist = _apart(x, centres)
    best = int(np.argmin([d.min(1).sum() for d in dist]))
    return centres[best], dist[best].argmin(1)


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(start, row, centre): squared distances."""
    return ((x[None, :, None] - centres[:, None]) ** 2).sum(-1)


def _modes_of(seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("book_id")
        x = np.array(g["vec"].tolist(), dtype=float)
        centres, label = lloyd(x, int(g["m"].iloc[0]), seed)
        w = g["w"].to_numpy()
        rows = [(g["user_id"].iloc[0], j, int((label == j).sum()), (label == j).mean(), w[label == j].sum() / w.sum(), c.tolist()) for j, c in enumerate(centres) if (label == j).any()]
        return pd.DataFrame(rows, columns=["user_id", "mode", "n_books", "weight", "centroid_weight", "vec"])

    return run


def taste_modes(df: DataFrame, vectors: DataFrame, seed: int = 42) -> DataFrame:
    """(user_id, mode, n_books, weight, centroid_weight, vec): 1 to 4 modes of each reader's positives.

    One mode is a grouped mean; only readers of several modes, with their bounded number of positives, go to Python.
    """
    have = positives(df).join(vectors.select("book_id", "vec"), "book_id").withColumn("w", engagement())
    n = F.count("*").over(Window.partitionBy("user_id"))
    sized = have.withColumn("n", n).withColumn("m", mode_count(F.col("n")))
    one = sized.where("m = 1")
    single = mean_by(one, ["user_id", "n"], "vec").select("user_id", F.lit(0).alias("mode"), F.col("n").cast("long").alias("n_books"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("centroid_weight"), "vec")
    many = sized.where("m > 1").select("user_id", "book_id", "vec", "w", "m")
    rest = many.groupBy("user_id").applyInPandas(_modes_of(seed), "user_id string, mode int, n_books long, weight double, centroid_weight double, vec array<double>")
    return single.unionByName(rest)


def variance_captured(points: DataFrame, group: list[str], value: str, centre: str) -> DataFrame:
    """1 - within / total squared distance, for each group; both vectors are columns of `points`."""
    sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    mean = mean_by(points, group, value, out="_mean")
    joined = points.join(mean, group)
    total = F.sum(sq(F.col(value), F.col("_mean")))
    return joined.groupBy(*group).agg(F.when(total > 0, 1 - F.sum(sq(F.col(value), F.col(centre))) / total).otherwise(F.lit(1.0)).alias("captured"))


def shrunk(profiles: DataFrame, centroids: DataFrame, share: float = 0.5) -> DataFrame:
    """Sparse profiles blended with the nearest centroid by cosine; ties go to the lower cluster.

    The centroids are a bounded table (one row for each cluster), so they are broadcast.
    """
    scored = profiles.join(F.broadcast(centroids.select("cluster", F.col("vec").alias("centre")))).withColumn("_s", cosine(F.col("vec"), F.col("centre")))
    w = Window.partitionBy("user_id").orderBy(F.desc("_s"), "cluster")
    best = scored.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return best.select("user_id", "cluster", F.zip_with("vec", "centre", lambda x, y: x * share + y * (1 - share)).alias("vec"))
