"""Queries: whole chains of operators, component reports, viewer operations, text vectors, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import contracts, curation, features, graph, metrics, profile, rank, users
from shelfmark.plans import fixtures as fx
from shelfmark.plans.q_curation import canonical as best
from shelfmark.plans.q_experiments import _SMALL, _items, _profiles
from shelfmark.plans.q_profile import _G, featured, graph_of
from shelfmark.plans.q_ranking import BEST, FLAGS, r6, read
from shelfmark.sources import files
from shelfmark.store import shared_dir, written

Q: dict = {}
SQL: dict[str, str] = {}
THEMES = {"cheap": ["economy", "small"], "offer": ["promo"], "usual": ["standard", "econ"]}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# curated items, from raw texts to cold start


def raw_books(spark, sf) -> DataFrame:
    """Each part as a raw edition: numbers and flags as texts, an author and two shelves."""
    p = fx.table(spark, sf, "part")
    size = F.col("p_size")
    author = F.struct(F.when(size % 7 != 0, F.col("p_brand")).alias("author_id"), F.when(size % 2 == 0, F.lit("")).otherwise(F.lit("Editor")).alias("role"))
    shelves = F.array(F.struct(F.col("p_type").alias("name"), size.cast("long").alias("count")), F.struct(F.when(size % 3 == 0, F.lit("to-read")).otherwise(F.lit("owned")).alias("name"), (size * 2).cast("long").alias("count")))
    return p.select(
        fx.work_of(spark, sf, "p_partkey").alias("book_id"),
        F.concat(F.lit("  "), "p_name").alias("title"),
        F.when(size % 4 == 0, F.lit(" ")).otherwise(F.upper("p_brand")).alias("language_code"),
        F.concat("p_brand", F.lit(" ")).alias("format"),
        F.upper("p_type").alias("publisher"),
        F.when(size % 3 == 0, F.lit("TRUE")).when(size % 3 == 1, F.lit("0")).otherwise(F.lit("maybe")).alias("is_ebook"),
        (1440 + size * 12).cast("string").alias("publication_year"),
        F.when(size % 10 == 0, F.lit("n/a")).otherwise((size * 20).cast("string")).alias("num_pages"),
        size.cast("string").alias("ratings_count"),
        F.array(author).alias("authors"),
        shelves.alias("shelves"),
        F.col("p_partkey").alias("source_ord"),
    )


_PERIOD = "CASE " + " ".join(f"WHEN y >= {a} AND y < {b} THEN '{n}'" for a, b, n in zip(curation.PERIODS, curation.PERIODS[1:], curation.PERIOD_NAMES)) + " END"
_THEMES = {t: f"regexp_matches(lower(p_type), '{'|'.join(w)}')" for t, w in THEMES.items()}
_CAPPED = ("ratings_count", "to_read_count", "num_pages", "interaction_count")
_BOOKS = f"""WITH {BEST}, act AS (SELECT book_id, count(*) AS interaction_count, count(rating_clean) AS explicit_rating_count, count(*) FILTER (has_review_text) AS review_count, count(*) FILTER (engagement_mode = 'want_to_read') AS shelf_only_count, count(*) FILTER (is_read) AS read_count, avg(rating_clean) AS mean_user_rating FROM best GROUP BY 1),
one AS (SELECT *, CAST(p_partkey % {fx.WORKS_SQL} AS VARCHAR) AS book_id, 1440.0 + p_size * 12 AS y0 FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % {fx.WORKS_SQL} ORDER BY p_partkey) = 1),
b AS (SELECT book_id, trim(p_name) AS title, CASE WHEN p_size % 4 <> 0 THEN lower(trim(p_brand)) END AS language_code_clean, lower(trim(p_brand)) AS format_clean, lower(trim(p_type)) AS publisher_clean, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_ebook,
 CASE WHEN y0 BETWEEN 1450 AND 2026 THEN CAST(y0 AS DOUBLE) END AS y, CASE WHEN p_size % 7 <> 0 AND p_brand IS NOT NULL THEN 1 ELSE 0 END AS author_count, CASE WHEN p_size % 7 <> 0 THEN p_brand END AS main_author_id, 2 AS shelf_count, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS BIGINT) * 2 ELSE 0 END AS to_read_count,
 {', '.join(f'{c} AS theme_{t}' for t, c in _THEMES.items())}, CAST(p_size AS DOUBLE) AS ratings_count, CASE WHEN p_size % 10 <> 0 THEN CAST(p_size * 20 AS DOUBLE) END AS num_pages FROM one),
f AS (SELECT b.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in curation.COUNTS)}, mean_user_rating FROM b LEFT JOIN act USING (book_id)), caps AS (SELECT {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), 0.99) AS cap_{c}' for c in _CAPPED)} FROM f)
SELECT book_id, title, language_code_clean, format_clean, publisher_clean, is_ebook, y AS publication_year_clean, {_PERIOD} AS publication_period, CAST(author_count AS INTEGER) AS author_count, main_author_id, CAST(shelf_count AS INTEGER) AS shelf_count, CAST(to_read_count AS BIGINT) AS to_read_count,
 {', '.join(f'theme_{t}' for t in THEMES)}, CAST({' + '.join(f'CAST(theme_{t} AS INTEGER)' for t in THEMES)} AS INTEGER) AS theme_count, {', '.join(curation.COUNTS)}, round(mean_user_rating, 6) AS mean_user_rating, interaction_count < 10 AS is_cold_start_all_books, interaction_count > 0 AND interaction_count < 10 AS is_cold_start_interacted_books,
 CASE WHEN interaction_count <= 0 THEN 'none' WHEN interaction_count <= 9 THEN 'low' WHEN interaction_count <= 49 THEN 'medium' ELSE 'high' END AS interaction_confidence_bucket, {', '.join(f'round(ln(1 + {c}), 6) AS {c}_log1p, CASE WHEN {c} IS NOT NULL THEN round(least({c}, cap_{c}), 6) END AS {c}_p99_capped' for c in _CAPPED)} FROM f, caps"""


@query("cur_books_pipeline", _BOOKS)
def cur_books(spark, sf):
    c = curation.curated_books(raw_books(spark, sf), curation.book_activity(best(spark, sf)), THEMES)
    rounded = ["mean_user_rating", *[f"{v}_{k}" for v in _CAPPED for k in ("log1p", "p99_capped")]]
    c = c.withColumn("to_read_count", F.col("to_read_count").cast("long"))
    return c.select(*[F.round(n, 6).alias(n) if n in rounded else F.col(n) for n in c.columns if n not in ("ratings_count", "num_pages")])


@query("flt_drop_list", "SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders)")
def flt_drop(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return contracts.without(o, ["o_orderstatus", "o_shelf"])


# the whole profile


def full_profile(spark, sf) -> dict[str, DataFrame]:
    raw_b, raw_i, clean = raw_books(spark, sf), fx.raw(spark, sf), best(spark, sf)
    books = fx.items(spark, sf)
    keys = {"book_id": ("books", ["book_id"]), "title": ("books", ["title"]), "interaction_key": ("interactions", ["interaction_key"]), "pair": ("interactions", ["user_id", "book_id"])}
    more = {"categoricals": profile.value_counts(books, "language", 20), "reader_segments": clean.groupBy("engagement_mode").agg(F.count("*").alias("n"))}
    return profile.full(raw_b, books, raw_i, clean, keys, ["num_pages", "publication_year", "editions"], ["rating_clean"], more)


@query("eda_full_profile", f"WITH {BEST}, {fx.ITEMS_SQL} SELECT 'books_raw_rows' AS metric, CAST((SELECT count(*) FROM part) AS DOUBLE) AS value UNION ALL SELECT 'interactions_raw_rows', CAST((SELECT count(*) FROM raw) AS DOUBLE) UNION ALL SELECT 'books_clean_rows', CAST((SELECT count(*) FROM items) AS DOUBLE) UNION ALL SELECT 'interactions_clean_rows', CAST((SELECT count(*) FROM best) AS DOUBLE) UNION ALL SELECT 'explicit_rating_pct', round((SELECT count(rating_clean) / count(*)::DOUBLE FROM best), 6) UNION ALL SELECT 'books_columns', 12.0::DOUBLE UNION ALL SELECT 'interactions_columns', 8.0::DOUBLE")
def eda_full(spark, sf):
    return full_profile(spark, sf)["summary"].withColumn("value", F.round("value", 6))


@query("eda_duplicates", f"WITH {BEST}, {fx.ITEMS_SQL} SELECT 'book_id' AS key, count(*) - count(DISTINCT book_id) AS n_duplicates FROM items UNION ALL SELECT 'title', count(*) - (SELECT count(*) FROM (SELECT DISTINCT title FROM items)) FROM items UNION ALL SELECT 'interaction_key', count(*) - count(DISTINCT interaction_key) FROM best UNION ALL SELECT 'pair', count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, book_id FROM best)) FROM best")
def eda_duplicates(spark, sf):
    return full_profile(spark, sf)["duplicates"]


# components


_NUMBERS = ["average_rating", "log_ratings_count", "log_reviews_count", "num_pages", "num_pages_missing", "publication_year", "publication_year_missing", "author_count", "genre_count"]
_PATTERNS = {"popularity": set(_NUMBERS[:3]), "genre": set(FLAGS), "completeness": {"num_pages_missing", "publication_year_missing"}, "recency": {"publication_year", "num_pages"}}


def components(spark, sf):
    """(components, ratios, names, widths) of the three blocks of all items."""
    f = written(featured(spark, sf).join(fx.vectors(spark, sf).select("book_id", "vec"), "book_id"), "component-items")
    binary = features.binary_block(f, FLAGS, "language", 3)
    n_binary = len(binary.first()["bin"])
    names = [*_NUMBERS, *FLAGS, *[f"category_{i}" for i in range(n_binary - len(FLAGS))]]
    joined = written(features.joined_blocks([(features.numeric_block(f, FLAGS), "num"), (binary, "bin"), (f.select("book_id", "vec"), "vec")]), "component-blocks")
    c, r = features.fit_pca(joined)
    return c, r, names, {"numeric": len(_NUMBERS), "binary": n_binary, "vectors": len(c) - len(names)}


@query("int_component_report")
def int_report(spark, sf):
    c, r, names, widths = components(spark, sf)
    rows = features.component_report(c, r, names, widths, "vectors", _PATTERNS)
    return spark.createDataFrame([(x["component"], x["ratio"], x["title"], x["pattern"], x["semantic"], x["summary"]) for x in rows], "component int, ratio double, title string, pattern string, semantic boolean, summary string")


@query("int_rank_shift")
def int_shift(spark, sf):
    c, r, names, _ = components(spark, sf)
    return spark.createDataFrame(features.rank_shift(c, r, names), "feature string, importance double, rank int, rank_first int, shift int")


@query("usr_variance_captured", f"WITH {BEST}, {fx.VECTORS_SQL}, pt AS (SELECT interaction_key, user_id, cluster, vec FROM best JOIN vectors USING (book_id) WHERE is_read AND rating_clean >= 4), l AS (SELECT *, unnest(range(1, 65)) AS axis FROM pt), d AS (SELECT user_id, pow(vec[axis] - avg(vec[axis]) OVER (PARTITION BY user_id, axis), 2) AS t, pow(vec[axis] - avg(vec[axis]) OVER (PARTITION BY user_id, cluster, axis), 2) AS w FROM l) SELECT user_id, round(CASE WHEN sum(t) > 1e-12 THEN 1 - sum(w) / sum(t) ELSE 1 END, 5) AS captured FROM d GROUP BY 1")
def usr_captured(spark, sf):
    """How much of the spread of a reader's positives lies between the clusters that they are of."""
    from shelfmark.functions.vectors import mean_by

    v = fx.vectors(spark, sf)
    points = written(users.positives(best(spark, sf)).select("user_id", "book_id").join(v.select("book_id", "cluster", "vec"), "book_id"), "positives")
    centred = points.join(mean_by(points, ["user_id", "cluster"], "vec", out="centre"), ["user_id", "cluster"])
    return users.variance_captured(centred, ["user_id"], "vec", "centre").withColumn("captured", F.round("captured", 5))


# viewer


@query("web_graph_view", f"WITH {_G}, {fx.ITEMS_SQL}, i AS (SELECT book_id FROM items WHERE genre_history = 1) SELECT a, b, round(w, 6) AS w FROM e WHERE w >= 0.5 AND a IN (SELECT book_id FROM i) AND b IN (SELECT book_id FROM i)")
def web_view(spark, sf):
    _, e = graph_of(spark, sf)
    return graph.view(fx.items(spark, sf), e.select("a", "b", "w"), 0.5, F.col("genre_history") == 1).withColumn("w", F.round("w", 6))


@query("web_neighbours", f"WITH {_G} SELECT other AS book_id, round(w, 6) AS w FROM x WHERE id = '7' AND w >= 0.2")
def web_neighbours(spark, sf):
    _, e = graph_of(spark, sf)
    shown = graph.view(fx.items(spark, sf), e.select("a", "b", "w"), 0.2)
    near = shown.where("a = '7' or b = '7'")
    return near.select(F.when(F.col("a") == "7", F.col("b")).otherwise(F.col("a")).alias("book_id"), F.round("w", 6).alias("w"))


# text vectors


_DIMS, _KEPT = 64, 16


@query("emb_hashed_titles", f"WITH {fx.ITEMS_SQL}, w AS (SELECT book_id, md5(w) AS h FROM (SELECT book_id, unnest(regexp_split_to_array(lower(title), '[^0-9a-z]+')) AS w FROM items) WHERE w <> ''), c AS (SELECT book_id, CAST('0x' || substr(h, 1, 6) AS BIGINT) % {_DIMS} AS axis, sum(CASE WHEN substr(h, 7, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM w GROUP BY 1, 2), n AS (SELECT book_id, sqrt(sum(x * x)) AS n FROM c GROUP BY 1), g AS (SELECT book_id, unnest(range({_KEPT})) AS axis FROM items) SELECT book_id, CAST(axis AS INTEGER) AS axis, round(CASE WHEN n > 0 THEN coalesce(x, 0) / n ELSE 0 END, 6) AS x FROM g LEFT JOIN c USING (book_id, axis) LEFT JOIN n USING (book_id)")
def emb_titles(spark, sf):
    v = features.hashed_vectors(fx.items(spark, sf), "book_id", "title", _DIMS)
    cut = v.select("book_id", features.truncated(F.col("vec"), _KEPT).alias("vec"))
    return cut.select("book_id", F.posexplode("vec").alias("axis", "x")).withColumn("x", F.round("x", 6))


# samples


@query("rec_sample")
def rec_sample(spark, sf):
    """Lists of the readers whose id 20 divides, and the cold start list of a reader without history."""
    from shelfmark.operators.recommend import sample

    known = written(_profiles(spark, sf, F.col("user_id").cast("long") % 20 == 0), "profiles")
    asked = known.select("user_id")
    return sample(asked, known, _items(spark, sf), fx.taste(spark, sf), read(spark, sf), rank.Config())


# CSV


def _at(spark, sf, name: str) -> str:
    return f"{shared_dir(spark)}/shelfmark/{name}-{spark.sparkContext.applicationId}-{abs(hash(sf))}"


@query("src_csv_round_trip", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name || ', \"' || s_nationkey || '\"' AS told, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier")
def src_csv(spark, sf):
    s = fx.table(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "'), F.col("s_nationkey").cast("string"), F.lit('"')).alias("told"), F.col("s_acctbal").cast("double").alias("s_acctbal"))
    files.write_csv(s, _at(spark, sf, "sink-supplier"))
    return files.csv_table(spark, _at(spark, sf, "sink-supplier"), "s_suppkey bigint, told string, s_acctbal double")


@query("gra_signal_rows", f"SELECT system, CAST(k AS INTEGER) AS k, CAST(recall AS DOUBLE) AS recall, CAST(ndcg AS DOUBLE) AS ndcg FROM {_SMALL} WHERE system IN ('x', 'y')")
def gra_signal(spark, sf):
    table = spark.sql(f"SELECT system, k, recall, ndcg, CASE WHEN system IN ('x', 'y') THEN 'cooccurrence' ELSE 'none' END AS collaborative_signal FROM {_SMALL}")
    files.write_csv(table, _at(spark, sf, "ab-results"))
    got = files.csv_table(spark, _at(spark, sf, "ab-results"), "system string, k int, recall double, ndcg double, collaborative_signal string")
    return metrics.signal_rows(got)
