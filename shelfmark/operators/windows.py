"""Ranks, segments and interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_percentile(value: Column | str, *, over: list[str]) -> Column:
    """The average-rank percentile in [0, 1] of a value in its group; 0.5 for a group of one value.

    Ties share the mean of their ranks, so it is not `percent_rank`.
    """
    v = F.col(value) if isinstance(value, str) else value
    rank = F.rank().over(Window.partitionBy(*over).orderBy(v))
    same = F.count("*").over(Window.partitionBy(*over, v))
    n = F.count("*").over(Window.partitionBy(*over))
    flat = F.min(v).over(Window.partitionBy(*over)).eqNullSafe(F.max(v).over(Window.partitionBy(*over)))
    return F.when(flat, F.lit(0.5)).otherwise((rank + (same - 1) / 2.0 - 1) / (n - 1))


def top(df: DataFrame, n: int, by: list[Column], *, over: list[str], rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*over).orderBy(*by)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def global_top(df: DataFrame, n: int, by: list[Column], rank: str = "rank") -> DataFrame:
    """The first n rows of an order, ranked: each partition keeps n, so only the candidates meet in one task."""
    return df.orderBy(*by).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*by)))


def popularity_segments(df: DataFrame, value: str, low: float = 0.25, high: float = 0.9) -> DataFrame:
    """`segment`: head from the upper quantile on, tail up to the lower, mid between, unknown without a finite value."""
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    cuts = df.where(ok).agg(F.percentile(v, F.array(F.lit(low), F.lit(high))).alias("_cuts"))
    seg = F.when(~ok, "unknown").when(v >= F.col("_cuts")[1], "head").when(v <= F.col("_cuts")[0], "tail").otherwise("mid")
    return df.join(F.broadcast(cuts)).withColumn("segment", F.when(v.isNull(), "unknown").otherwise(seg)).drop("_cuts")


def tertiles(df: DataFrame, value: str, out: str = "activity") -> DataFrame:
    """low up to the first third's quantile, high above the second's, mid between."""
    cuts = df.agg(F.percentile(F.col(value).cast("double"), F.expr("array(1D/3D, 2D/3D)")).alias("_cuts"))
    seg = F.when(F.col(value) <= F.col("_cuts")[0], "low").when(F.col(value) > F.col("_cuts")[1], "high").otherwise("mid")
    return df.join(F.broadcast(cuts)).withColumn(out, seg).drop("_cuts")


def round_robin(df: DataFrame, group: str, lane: str, rank: str, item: str, budget: int) -> DataFrame:
    """Interleaves each group's ranked lanes: first of each lane, then second, ...; an item counts where it comes first."""
    spot = F.row_number().over(Window.partitionBy(group).orderBy(rank, lane))
    firsts = df.withColumn("_spot", spot).groupBy(group, item).agg(F.min("_spot").alias("_spot"))
    return top(firsts, budget, [F.col("_spot")], over=[group]).drop("_spot")


def positions(df: DataFrame, user: str, date: str, tie: list[Column]) -> DataFrame:
    """`position` from 0 by date, and `total` rows, of each reader."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(user).orderBy(date, *tie)) - 1).withColumn("total", F.count("*").over(Window.partitionBy(user)))


def title_fill(df: DataFrame, user: str, order: list[Column], title: str, k: int) -> DataFrame:
    """k rows of each reader, first titles first; repeats of a title fill up at the end. Empty titles never repeat."""
    named = F.col(title).isNotNull() & (F.col(title) != "")
    repeat = named & (F.row_number().over(Window.partitionBy(user, title).orderBy(*order)) > 1)
    return top(df.withColumn("_repeat", repeat), k, [F.col("_repeat"), *order], over=[user]).drop("_repeat")
