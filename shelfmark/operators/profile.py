"""Exploratory profiles: counts, spreads, correlations, concentration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """(value, n, share) by falling count, ties by value; nulls are a value."""
    counts = df.groupBy(F.col(by).cast("string").alias("value")).agg(F.count("*").alias("n"))
    out = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return out.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n) if n else out


def describe(df: DataFrame, values: list[str]) -> DataFrame:
    """(column, n, mean, std, min, p25, p50, p75, p95, max): one pass, exact percentiles with linear interpolation."""
    aggs = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.percentile(c, F.lit([0.25, 0.5, 0.75, 0.95])).alias("p"), F.max(F.col(c).cast("double")).alias("max")) for c in values]
    one = df.agg(F.array(*aggs).alias("_a")).select(F.explode("_a").alias("s"))
    return one.select("s.column", "s.n", "s.mean", "s.std", "s.min", *[F.col("s.p")[i].alias(k) for i, k in enumerate(("p25", "p50", "p75", "p95"))], "s.max")


def iqr_outliers(df: DataFrame, values: list[str]) -> DataFrame:
    """(column, q1, q3, upper, n_outliers): values over the upper fence."""
    cuts = df.agg(*[F.percentile(c, F.lit([0.25, 0.75])).alias(f"_{c}") for c in values])
    upper = {c: F.col(f"_{c}")[1] + 1.5 * (F.col(f"_{c}")[1] - F.col(f"_{c}")[0]) for c in values}
    counted = df.join(F.broadcast(cuts)).agg(*[F.count_if(F.col(c) > upper[c]).alias(f"n_{c}") for c in values])
    both = counted.join(cuts)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}")[0].alias("q1"), F.col(f"_{c}")[1].alias("q3"), upper[c].alias("upper"), F.col(f"n_{c}").alias("n_outliers")) for c in values])
    return both.select(F.explode(rows).alias("s")).select("s.*")


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, n_null, n_empty, n_distinct, missing_share), all in one aggregate."""
    empty = lambda f: F.count_if(F.col(f.name) == "") if f.dataType.simpleString() == "string" else F.lit(0).cast("long")
    rows = [F.struct(F.lit(f.name).alias("column"), F.count_if(F.col(f.name).isNull()).alias("n_null"), empty(f).alias("n_empty"), F.countDistinct(f.name).alias("n_distinct"), F.count("*").alias("n")) for f in df.schema]
    one = df.agg(F.array(*rows).alias("_a")).select(F.explode("_a").alias("s"))
    return one.select("s.column", "s.n_null", "s.n_empty", "s.n_distinct", ((F.col("s.n_null") + F.col("s.n_empty")) / F.col("s.n")).alias("missing_share"))


def duplicate_counts(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """(key, n_duplicates): rows beyond the first of each key; nulls are equal."""
    parts = [df.groupBy(*cols).agg(F.count("*").alias("n")).agg(F.lit(name).alias("key"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates")) for name, cols in keys.items()]
    return reduce(DataFrame.unionByName, parts)


def correlations(df: DataFrame, values: list[str]) -> DataFrame:
    """(a, b, r) for each pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs])
    return df.agg(rows.alias("_a")).select(F.explode("_a").alias("s")).select("s.*")


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the average rank of `value` over the whole table.

    Ranks come from the distinct values' counts, so the one global sort is over values, not rows.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(F.col(value).alias("_v"), (before + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df.select(a, b).dropna(), a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("rho"))


def concentration(df: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """(fraction, share): what the top fraction of rows holds of the total; a fraction is rounded up to a whole row.

    Rows of one value are interchangeable, so cumulative counts over the distinct values are enough.
    """
    counts = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    cum = counts.select("v", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("rows"), F.sum(F.col("v") * F.col("n")).over(Window.partitionBy()).alias("total"))
    each = cum.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    take = F.greatest(F.lit(0), F.least(F.col("n"), F.ceil(F.col("fraction") * F.col("rows")) - F.col("before")))
    return each.groupBy("fraction").agg((F.sum(F.col("v") * take) / F.max("total")).alias("share"))


def thresholds(df: DataFrame, value: str, cuts: list[int]) -> DataFrame:
    """(threshold, n_below, share)."""
    rows = F.array(*[F.struct(F.lit(c).alias("threshold"), F.count_if(F.col(value) < c).alias("n_below"), F.count("*").alias("n")) for c in cuts])
    return df.agg(rows.alias("_a")).select(F.explode("_a").alias("s")).select("s.threshold", "s.n_below", (F.col("s.n_below") / F.col("s.n")).alias("share"))


def histogram(df: DataFrame, value: str, edges: list[float], labels: list[str]) -> DataFrame:
    from shelfmark.functions.text import binned

    return df.groupBy(binned(value, edges, labels).alias("bin")).agg(F.count("*").alias("n")).where("bin is not null")


def user_types(df: DataFrame) -> DataFrame:
    """(user_type, n, mean): readers of three ratings and more by their mean: strict below 3, generous from 4.5, balanced between."""
    users = df.groupBy("user_id").agg(F.avg("rating_clean").alias("m"), F.count("rating_clean").alias("k")).where("k >= 3")
    kind = F.when(F.col("m") < 3, "strict").when(F.col("m") >= 4.5, "generous").otherwise("balanced")
    return users.groupBy(kind.alias("user_type")).agg(F.count("*").alias("n"), F.avg("m").alias("mean_rating"))


def flag_overlaps(df: DataFrame, flags: list[str]) -> DataFrame:
    """(a, b, n_both, jaccard) for each pair of 0/1 columns."""
    on = lambda c: F.col(c) == 1
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i + 1 :]]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(on(a) & on(b)).alias("n_both"), (F.count_if(on(a) & on(b)) / F.nullif(F.count_if(on(a) | on(b)), F.lit(0))).alias("jaccard")) for a, b in pairs])
    return df.agg(rows.alias("_a")).select(F.explode("_a").alias("s")).select("s.*")


def first_true(flags: dict[str, Column]) -> Column:
    """The name of the first flag that is set, in the order given."""
    return F.coalesce(*[F.when(v, F.lit(k)) for k, v in flags.items()], F.lit("other"))


def schema_summary(df: DataFrame) -> DataFrame:
    """(column, type, n_present): the declared type of each column and its non-null values, in one aggregate."""
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(f.name).alias("n_present")) for f in df.schema]
    return df.agg(F.array(*rows).alias("_a")).select(F.explode("_a").alias("s")).select("s.*")


def full(books_raw: DataFrame, books: DataFrame, raw: DataFrame, clean: DataFrame, keys: dict[str, tuple[str, list[str]]], book_numbers: list[str], numbers: list[str], more: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every profile of a catalogue and its interactions by name, `summary` among them; each is a plan, run where it is read.

    `keys` names duplicate checks, each of the table `books` or `interactions` and its columns; `more` adds profiles that
    need columns of their own, such as those of authors, shelves or series.
    """
    both = {"books": (books_raw, books, book_numbers), "interactions": (raw, clean, numbers)}
    out: dict[str, DataFrame] = {}
    for name, (before, after, values) in both.items():
        out |= {f"{name}_schema": schema_summary(before), f"{name}_missing": missing_summary(before), f"{name}_numeric": describe(after, values), f"{name}_outliers": iqr_outliers(after, values)}
    out["duplicates"] = reduce(DataFrame.unionByName, [duplicate_counts(both[table][1], {key: columns}) for key, (table, columns) in keys.items()])
    out["user_types"] = user_types(clean)
    taken = set(out) & set(more) | {"summary"} & set(more)
    if taken:
        raise ValueError(f"profile names are taken: {', '.join(sorted(taken))}")
    out |= more
    count = lambda df, name: df.agg(F.lit(name).alias("metric"), F.count("*").cast("double").alias("value"))
    rated = clean.agg(F.lit("explicit_rating_pct").alias("metric"), F.coalesce(F.count("rating_clean") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("value"))
    width = books_raw.sparkSession.createDataFrame([("books_columns", float(len(books_raw.columns))), ("interactions_columns", float(len(raw.columns)))], "metric string, value double")
    rows = [count(books_raw, "books_raw_rows"), count(raw, "interactions_raw_rows"), count(books, "books_clean_rows"), count(clean, "interactions_clean_rows"), rated, width]
    out["summary"] = reduce(DataFrame.unionByName, rows)
    return out
