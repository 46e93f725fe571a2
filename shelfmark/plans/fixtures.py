"""The supplied tables seen as reader interactions, items, vectors and nested metadata; in Spark and in SQL.

An item is a work: there are as many as `embeddings` has rows, and a part is an edition of the work whose number is the
part's key modulo that count. So every part, line and vector is read, and items grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.vectors import without_axes

GENRES = ("fantasy", "history", "mystery", "ya", "romance")
#: The leading axes of a vector, which hold tabular features; taste is what is left.
TABULAR_AXES = 6
WORKS_SQL = "(SELECT greatest(1, count(*)) FROM embeddings)"
_WORKS: dict[tuple[str, str], int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str) -> int:
    """The number of works; counted once in a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _WORKS:
        _WORKS[at] = max(1, table(spark, sf_dir, "embeddings").count())
    return _WORKS[at]


def work_of(spark: SparkSession, sf_dir: str, part: str) -> Column:
    return (F.col(part) % works(spark, sf_dir)).cast("string")


_DAY = 86_400_000_000


def _parted(date: str, name: str) -> list[Column]:
    """A date as its day and the microseconds of it, which are mostly 0: nothing is lost, and little is left to exchange."""
    x = F.unix_micros(F.col(date).cast("timestamp"))
    rest = F.pmod(x, F.lit(_DAY))
    return [F.round((x - rest) / _DAY).cast("int").alias(f"{name}_day"), rest.alias(f"{name}_rest")]


def _whole(name: str) -> Column:
    return F.timestamp_micros(F.col(f"{name}_day").cast("long") * _DAY + F.col(f"{name}_rest"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their orders, as the numbers that interactions are made of."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user"), *_parted("o_orderdate", "added"))
    told = F.col("l_returnflag") == "R"
    of = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(told, F.col("l_linenumber")).alias("line"),
        (F.col("l_partkey") % works(spark, sf_dir)).alias("work"),
        told.alias("told"),
        F.when(F.col("l_returnflag") == "N", F.lit(0)).otherwise(1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int").alias("rating"),
        ((F.col("l_linestatus") == "F") | (F.col("l_returnflag") == "A")).alias("is_read"),
        *_parted("l_shipdate", "updated"),
        (F.col("l_suppkey") % 5).cast("int").alias("category"),
    )
    both = of.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.withColumn("order", F.when(F.col("told"), F.col("l_orderkey"))).drop("l_orderkey", "o_orderkey")


def raw(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Raw interactions: a line of an order is a reader's act on an item. `of`: the `lines`, where they are at hand.

    `dealt`: with the rows of one interaction key together. They travel as numbers, without what follows from these.
    """
    of = lines(spark, sf_dir) if of is None else of
    user, book = F.col("user").cast("string"), F.col("work").cast("string")
    review = F.when(F.col("told"), F.concat_ws("-", F.col("order").cast("string"), F.col("line").cast("string")))
    if dealt:
        of = of.repartition(F.coalesce(review, F.concat_ws("|", user, book)))
    return of.select(
        user.alias("user_id"),
        book.alias("book_id"),
        review.alias("review_id"),
        "rating",
        "is_read",
        _whole("added").alias("date_added"),
        _whole("updated").alias("date_updated"),
        "category",
    )


RAW = f"""raw AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey % {WORKS_SQL} AS VARCHAR) AS book_id,
  CASE WHEN l_returnflag = 'R' THEN l_orderkey || '-' || l_linenumber END AS review_id,
  CAST(CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 + floor((l_quantity - 1) / 10) END AS INTEGER) AS rating,
  (l_linestatus = 'F' OR l_returnflag = 'A') AS is_read, o_orderdate AS date_added, l_shipdate AS date_updated,
  CAST(l_suppkey % 5 AS INTEGER) AS category FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each work with an edition: title, pages, year, genre flags, author and counts, of all its editions.

    A work is of a genre if more than a fifth of its editions are.
    """
    part = table(spark, sf_dir, "part").withColumn("book_id", work_of(spark, sf_dir, "p_partkey"))
    flags = [(5 * F.count_if(F.col("p_size") % 5 == g) > F.count("*")).cast("int").alias(f"genre_{name}") for g, name in enumerate(GENRES)]
    of = part.groupBy("book_id").agg(F.min("p_name").alias("title"), (F.min("p_size") * 20).alias("num_pages"), F.min("p_brand").alias("author"), F.min("p_type").alias("language"), F.count("*").alias("editions"), *flags)
    return of.withColumn("publication_year", (1995 + F.col("book_id").cast("int") % 7).cast("int"))


ITEMS_SQL = f"""items AS (SELECT *, CAST(1995 + CAST(book_id AS INTEGER) % 7 AS INTEGER) AS publication_year FROM
  (SELECT CAST(p_partkey % {WORKS_SQL} AS VARCHAR) AS book_id, min(p_name) AS title, min(p_size) * 20 AS num_pages, min(p_brand) AS author, min(p_type) AS language, count(*) AS editions,
  {', '.join(f'CAST(5 * count(*) FILTER (p_size % 5 = {i}) > count(*) AS INTEGER) AS genre_{g}' for i, g in enumerate(GENRES))} FROM part GROUP BY 1))"""


def _as_vectors(e: DataFrame) -> DataFrame:
    return e.select(F.col("vec_id").cast("string").alias("book_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("cluster"), F.floor(F.col("label") / 2).cast("int").alias("macro"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, vec, cluster, macro) of every embedding."""
    return _as_vectors(table(spark, sf_dir, "embeddings"))


def taste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors without their tabular axes: the space in which readers and items are compared."""
    return vectors(spark, sf_dir).withColumn("vec", without_axes(F.col("vec"), TABULAR_AXES))


def _vectors_sql(embedding: str) -> str:
    return f"""vectors AS (SELECT CAST(vec_id AS VARCHAR) AS book_id, CAST({embedding} AS DOUBLE[]) AS vec, label AS cluster, CAST(label // 2 AS INTEGER) AS macro FROM embeddings)"""


VECTORS_SQL = _vectors_sql("embedding")
TASTE_SQL = _vectors_sql(f"embedding[{TABULAR_AXES + 1}:]")


def clean_sql() -> str:
    """CTEs raw and clean: cleaned interactions with their mode, weight and key."""
    return RAW + """,
clean AS (SELECT *, (rating = 0) AS rating_missing, CASE WHEN rating BETWEEN 1 AND 5 THEN CAST(rating AS DOUBLE) END AS rating_clean,
  review_id IS NOT NULL AS has_review_text,
  CASE WHEN review_id IS NOT NULL THEN 'review' WHEN rating BETWEEN 1 AND 5 THEN 'rating_only' WHEN is_read THEN 'read_no_rating' ELSE 'want_to_read' END AS engagement_mode,
  CASE WHEN review_id IS NOT NULL THEN 1.0 WHEN rating BETWEEN 1 AND 5 THEN 0.9 WHEN is_read THEN 0.5 ELSE 0.3 END AS engagement_weight,
  coalesce(review_id, user_id || '|' || book_id) AS interaction_key FROM raw)"""


def best_sql() -> str:
    """And best: the winner of each key."""
    return clean_sql() + """,
best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY interaction_key ORDER BY
  CASE engagement_mode WHEN 'review' THEN 3 WHEN 'rating_only' THEN 2 WHEN 'read_no_rating' THEN 1 ELSE 0 END DESC, (rating_clean IS NOT NULL) DESC, is_read DESC,
  greatest(0, epoch_ms(coalesce(date_updated, date_added)) // 1000) DESC, category, book_id, user_id, rating DESC, date_added DESC) AS rn FROM clean) WHERE rn = 1)"""
