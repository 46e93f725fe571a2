"""Splits, cutoffs and what was known at a date."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dates before this are invalid.
FIRST_VALID = "2006-01-01"


def valid_date(c: str, floor: str | None = FIRST_VALID) -> Column:
    ok = F.col(c).isNotNull()
    return ok if floor is None else ok & (F.col(c) >= F.lit(floor).cast("timestamp"))


def per_user_split(df: DataFrame, fraction: float, tie: list[Column], date: str = "date_added") -> DataFrame:
    """`part`: train for a reader's first rows by date, future for the rest; a reader of one row is all future."""
    w = Window.partitionBy("user_id")
    n = F.count("*").over(w)
    at = F.row_number().over(w.orderBy(date, *tie))
    cut = F.greatest(F.lit(1), F.least(n - 1, F.floor(n * fraction)))
    return df.withColumn("part", F.when((n > 1) & (at <= cut), "train").otherwise("future"))


def split_at(df: DataFrame, cutoff: Column, date: str = "date_added", floor: str | None = FIRST_VALID) -> DataFrame:
    """`part`: train up to the cutoff, future after it; rows of invalid dates are in neither."""
    return df.where(valid_date(date, floor)).withColumn("part", F.when(F.col(date) <= cutoff, "train").otherwise("future"))


def global_cutoff(df: DataFrame, fraction: float, date: str = "date_added", floor: str | None = FIRST_VALID) -> DataFrame:
    """(cutoff): the interpolated quantile of the valid dates."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction lies between 0 and 1")
    micros = F.percentile(F.unix_micros(date).cast("double"), F.lit(fraction))
    return df.where(valid_date(date, floor)).agg(F.timestamp_micros(F.floor(micros).cast("long")).alias("cutoff"))


def popularity_as_of(df: DataFrame, cutoff: datetime | Column, floor: str | None = FIRST_VALID) -> DataFrame:
    """(book_id, n, mean_rating, n_reviews, first_seen, n_invalid) as of the cutoff, in one pass of conditional aggregates."""
    cut = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    ok = valid_date("date_added", floor) & (F.col("date_added") <= cut)
    rated = ok & F.col("rating_clean").isNotNull()
    return df.groupBy("book_id").agg(F.count_if(rated).alias("n"), F.avg(F.when(rated, F.col("rating_clean"))).alias("mean_rating"), F.count_if(ok & F.col("has_review_text")).alias("n_reviews"), F.min(F.when(valid_date("date_added", floor), F.col("date_added"))).alias("first_seen"), F.count_if(~valid_date("date_added", floor)).alias("n_invalid"))


def available(books: DataFrame, seen: DataFrame, cutoff: Column) -> DataFrame:
    """`available`: published by the cutoff's year, or, without a year, first seen by the cutoff."""
    year = F.col("publication_year")
    ok = F.when(year.isNotNull(), year <= F.year(cutoff)).otherwise(F.coalesce(F.col("first_seen") <= cutoff, F.lit(False)))
    return books.join(seen.select("book_id", "first_seen"), "book_id", "left").withColumn("available", ok)


def popularity_score(n: Column, mean: Column) -> Column:
    return F.log1p(n.cast("double")) * F.coalesce(mean, F.lit(0.0))
