"""Reading habits in a window of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.temporal import valid_date
from shelfmark.operators.windows import tertiles

#: Mean days of a month.
MONTH = 30.4375


def proxies(df: DataFrame, genres: DataFrame, flags: list[str], at) -> DataFrame:
    """(user_id, n_reads, span_days, monthly, recency_days, completion, breadth) from rows of valid dates up to `at`."""
    ok = df.where(valid_date("date_added") & (F.col("date_added") <= at)).join(genres.select("book_id", *flags), "book_id", "left")
    read = F.coalesce("is_read", F.lit(False))
    days = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / F.lit(86_400e6)
    agg = ok.groupBy("user_id").agg(F.count_if(read).alias("n_reads"), F.count("*").alias("n"), days(F.max("date_added"), F.min("date_added")).alias("span_days"), F.greatest(F.lit(0.0), days(at, F.max("date_added"))).alias("recency_days"), *[F.max(F.when(read, F.col(f))).alias(f"_{f}") for f in flags])
    breadth = sum((F.coalesce(F.col(f"_{f}"), F.lit(0)) for f in flags), F.lit(0))
    return agg.select("user_id", "n_reads", "span_days", (F.col("n_reads") * MONTH / F.greatest("span_days", F.lit(1.0))).alias("monthly"), "recency_days", (F.col("n_reads") / F.col("n")).alias("completion"), breadth.alias("breadth"))


def habit_table(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both windows side by side for readers of either, zeros where one is missing, with activity by tertiles of prior reads."""
    side = lambda df, s: df.select("user_id", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "user_id"])
    both = side(before, "train").join(side(after, "future"), "user_id", "full_outer").fillna(0)
    return tertiles(both, "n_reads_train")
