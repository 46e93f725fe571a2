"""From raw interactions to the curated table: clean, keep the best of each key, reader statistics, K-core, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.store import written

#: Rank and weight of each engagement mode, strongest first.
MODES = (("review", 3, 1.0), ("rating_only", 2, 0.9), ("read_no_rating", 1, 0.5), ("want_to_read", 0, 0.3))
MIN_EVENTS = 3


def lookup(key: Column, pairs: dict, default=None) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def clean(raw: DataFrame) -> DataFrame:
    """Raw interactions with rating, text and mode columns and the dedup key: one projection.

    A rating of 0 or none is missing; only 1 to 5 is kept in `rating_clean`. The key is the review's id, else reader
    and item.
    """
    rating = F.col("rating")
    good = rating.between(1, 5)
    has_text = F.col("review_id").isNotNull()
    mode = F.when(has_text, "review").when(good, "rating_only").when(F.coalesce("is_read", F.lit(False)), "read_no_rating").otherwise("want_to_read")
    out = raw.select(
        "*",
        (rating.isNull() | (rating == 0)).alias("rating_missing"),
        F.when(good, rating.cast("double")).alias("rating_clean"),
        has_text.alias("has_review_text"),
        mode.alias("engagement_mode"),
        F.coalesce("review_id", F.concat_ws("|", "user_id", "book_id")).alias("interaction_key"),
    )
    return out.withColumn("engagement_weight", lookup(F.col("engagement_mode"), {m: w for m, _, w in MODES}))


def priority() -> Column:
    """What decides between rows of one key, as an ordered struct: mode, rating given, read, whole seconds of the last change."""
    when = F.coalesce("date_updated", "date_added")
    seconds = F.greatest(F.lit(0), F.coalesce(F.floor(F.unix_micros(when) / 1_000_000), F.lit(0)))
    rank = lookup(F.col("engagement_mode"), {m: r for m, r, _ in MODES})
    return F.struct(rank.alias("rank"), F.col("rating_clean").isNotNull().alias("rated"), F.coalesce("is_read", F.lit(False)).alias("read"), seconds.cast("long").alias("seconds"))


def keep_best(df: DataFrame, tie: list[Column], key: str = "interaction_key") -> DataFrame:
    """The row of highest priority of each key; exact ties go to the first by `tie`.

    A grouped maximum would do for the priority alone; the window keeps the whole row and needs one exchange, by key.
    """
    w = Window.partitionBy(key).orderBy(priority().desc(), *tie)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def category_counts(df: DataFrame, key: str = "interaction_key") -> DataFrame:
    """How many sources hold each key, before deduplication."""
    return df.groupBy(key).agg(F.countDistinct("category").alias("source_category_count"))


def user_partials(df: DataFrame) -> DataFrame:
    """Sums for each reader that add up across parts of the table."""
    engaged = F.coalesce("is_read", F.lit(False)) | F.col("rating_clean").isNotNull()
    return df.groupBy("user_id").agg(F.count_if(engaged).alias("read_or_rated_count"), F.coalesce(F.sum("rating_clean"), F.lit(0.0)).alias("rating_sum"), F.coalesce(F.sum(F.col("rating_clean") ** 2), F.lit(0.0)).alias("rating_sq_sum"), F.count("rating_clean").alias("rating_count"))


def user_features(df: DataFrame, least: int = MIN_EVENTS) -> DataFrame:
    """Mean, sample deviation and bias of each reader's ratings, and whether the reader stays.

    The global mean covers all rows given, those of readers who will go included. It is one row, joined by broadcast.
    """
    p = user_partials(df)
    mean = p.agg((F.sum("rating_sum") / F.sum("rating_count")).alias("global_mean"))
    n = F.col("rating_count")
    var = (F.col("rating_sq_sum") - F.col("rating_sum") ** 2 / n) / (n - 1)
    return p.join(F.broadcast(mean)).select(
        "user_id",
        F.when(n > 0, F.col("rating_sum") / n).alias("user_mean_rating"),
        F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(0.0)).alias("user_rating_std"),
        n.alias("user_rating_count"),
        F.when(n > 0, F.col("rating_sum") / n - F.col("global_mean")).otherwise(F.lit(0.0)).alias("user_rating_bias"),
        "read_or_rated_count",
        (F.col("read_or_rated_count") >= least).alias("valid"),
    )


def canonical(raw: DataFrame, universe: DataFrame, tie: list[Column], least: int = MIN_EVENTS) -> tuple[DataFrame, DataFrame]:
    """(interactions, user features): universe filter, best of each key, features over the winners, one-pass K-core, bias."""
    cleaned = clean(raw.join(universe.select("book_id").distinct(), "book_id", "left_semi"))
    winners = keep_best(cleaned, tie).join(category_counts(cleaned), "interaction_key")
    features = user_features(winners, least)
    kept = features.where("valid").select("user_id", "user_rating_bias")
    return winners.join(kept, "user_id"), features


def k_core(df: DataFrame, books: int, users: int, rounds: int = 20) -> DataFrame:
    """Rows of items with at least `books` rows and readers with at least `users`, both counted over the rows kept.

    Rounds stop when neither the set of items nor that of readers shrinks. Each round's rows are written, so lineage
    does not grow.
    """
    before = None
    for _ in range(rounds):
        b = df.groupBy("book_id").agg(F.count("*").alias("n")).where(F.col("n") >= books).select("book_id")
        u = df.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= users).select("user_id")
        df = written(df.join(b, "book_id", "left_semi").join(u, "user_id", "left_semi"), "k-core")
        now = tuple(df.agg(F.countDistinct("book_id"), F.countDistinct("user_id"), F.count("*")).first())
        if now == before:
            break
        before = now
    return df


def category_views(df: DataFrame, flags: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """For each flag column, the rows of the items that carry it; an item of several flags is in several views."""
    return {n: df.join(flags.where(F.col(n) == 1).select("book_id"), "book_id", "left_semi") for n in names}


def best_book(books: DataFrame) -> DataFrame:
    """One row for each item: most ratings, then most text reviews, nulls last."""
    w = Window.partitionBy("book_id").orderBy(F.desc_nulls_last("ratings_count"), F.desc_nulls_last("text_reviews_count"), "source_ord")
    return books.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_by(df: DataFrame, keys: list[str], date: str, tie: list[Column]) -> DataFrame:
    """Full-row duplicates removed, then the latest row of each key; null keys are one key."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(date), *tie)
    return df.dropDuplicates().withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge_master(books: DataFrame, flags: list[str], order: str = "source_ord") -> DataFrame:
    """One row for each item: the greatest of each flag, the first non-null of every other column by source order."""
    rest = [c for c in books.columns if c not in (*flags, "book_id", order)]
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    merged = books.groupBy("book_id").agg(*[F.max(c).cast("int").alias(c) for c in flags], *first)
    return merged.dropna(subset=[c for c in ("title",) if c in rest])


#: Readers below which an item counts as new, the years kept, the period bounds and their names.
COLD_BELOW = 10
YEARS = (1450, 2026)
PERIODS = (1450, 1800, 1900, 1950, 1980, 2000, 2010, 2027)
PERIOD_NAMES = ("1450-1799", "1800-1899", "1900-1949", "1950-1979", "1980-1999", "2000-2009", "2010-2026")
COUNTS = ("interaction_count", "explicit_rating_count", "review_count", "shelf_only_count", "read_count")


def book_activity(df: DataFrame) -> DataFrame:
    """What readers did with each item: five counts and the mean of the given ratings."""
    read = F.coalesce("is_read", F.lit(False))
    return df.groupBy("book_id").agg(
        F.count("*").alias("interaction_count"),
        F.count("rating_clean").alias("explicit_rating_count"),
        F.count_if("has_review_text").alias("review_count"),
        F.count_if(F.col("engagement_mode") == "want_to_read").alias("shelf_only_count"),
        F.count_if(read).alias("read_count"),
        F.avg("rating_clean").alias("mean_user_rating"),
    )


def logged_and_capped(df: DataFrame, values: list[str], share: float = 0.99) -> DataFrame:
    """Two more columns for each of `values`: its log, and the value cut at the quantile of the whole table; one aggregate for all. Null stays null."""
    caps = df.agg(*[F.percentile(F.col(c).cast("double"), F.lit(share)).alias(f"_cap_{c}") for c in values])
    out = df.join(F.broadcast(caps))
    for c in values:
        x = F.col(c).cast("double")
        out = out.withColumn(f"{c}_log1p", F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))).withColumn(f"{c}_p99_capped", F.when(x.isNotNull(), F.least(x, F.col(f"_cap_{c}"))))
    return out.drop(*[f"_cap_{c}" for c in values])


def curated_books(books: DataFrame, activity: DataFrame, themes: dict[str, list[str]], order: str = "source_ord", shelves: int = 10) -> DataFrame:
    """Raw item metadata as curated items: one plan from cleaning to cold start.

    `books` has text columns and the arrays `authors` and `shelves`; of rows with one id the first by `order` stays. Years
    out of range are null, shares are of the whole table, and an item without interactions has zero counts and no mean.
    """
    from shelfmark.functions import nested as N
    from shelfmark.functions import text as X

    first = books.withColumn("_rn", F.row_number().over(Window.partitionBy("book_id").orderBy(order))).where("_rn = 1")
    b = X.blank_to_null(first.drop("_rn", order))
    year = X.number("publication_year")
    names = N.shelf_names(F.col("shelves"), shelves)
    flags = {t: N.theme_flag(names, words) for t, words in themes.items()}
    b = b.select(
        "book_id",
        X.trimmed("title").alias("title"),
        X.trimmed("language_code", lower=True).alias("language_code_clean"),
        X.trimmed("format", lower=True).alias("format_clean"),
        X.trimmed("publisher", lower=True).alias("publisher_clean"),
        X.boolean("is_ebook").alias("is_ebook"),
        F.when(year.between(*YEARS), year).alias("publication_year_clean"),
        N.author_count(F.col("authors")).alias("author_count"),
        N.main_author(F.col("authors")).alias("main_author_id"),
        N.list_count(F.col("shelves")).alias("shelf_count"),
        N.to_read_count(F.col("shelves"), shelves).alias("to_read_count"),
        *[v.alias(f"theme_{t}") for t, v in flags.items()],
        *[X.number(c).alias(c) for c in ("ratings_count", "num_pages")],
    )
    b = b.withColumn("publication_period", X.binned("publication_year_clean", list(PERIODS), list(PERIOD_NAMES)))
    b = b.withColumn("theme_count", sum((F.col(f"theme_{t}").cast("int") for t in flags), F.lit(0)))
    b = b.join(activity, "book_id", "left").fillna(0, list(COUNTS))
    n = F.col("interaction_count")
    b = b.withColumn("is_cold_start_all_books", n < COLD_BELOW).withColumn("is_cold_start_interacted_books", (n > 0) & (n < COLD_BELOW))
    b = b.withColumn("interaction_confidence_bucket", X.binned(n, [-1, 0, 9, 49, float("inf")], ["none", "low", "medium", "high"], right=True))
    return logged_and_capped(b, ["ratings_count", "to_read_count", "num_pages", "interaction_count"])
