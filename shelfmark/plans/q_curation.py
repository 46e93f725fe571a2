"""Queries: scans, cleaning, curation, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.operators import curation as C
from shelfmark.plans import fixtures as fx
from shelfmark.store import lent, written

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def tie():
    """The order of rows of one key and one priority."""
    return [F.col("category"), F.col("book_id"), F.col("user_id"), F.col("rating").desc(), F.col("date_added").desc()]


def best(spark, sf, lines=None):
    return C.keep_best(C.clean(fx.raw(spark, sf, lines, dealt=True)), tie())


_CANONICAL: dict[tuple[str, str], DataFrame] = {}


def canonical(spark, sf):
    """best, built once in a session and written to the shared folder: what the queries downstream of curation read.

    Lines meet their orders in one step and their keys in another, so that no two exchanges of them are on disk together;
    what cleaning adds to a row is not stored but worked out again.
    """
    at = (spark.sparkContext.applicationId, sf)
    if at not in _CANONICAL:
        with lent(fx.lines(spark, sf), "lines") as lines:
            rows = best(spark, sf, lines)
            _CANONICAL[at] = C.clean(written(rows.select(*fx.raw(spark, sf, lines).columns), "canonical"))
    return _CANONICAL[at]


@query("cur_clean_interactions", f"WITH {fx.clean_sql()} SELECT user_id, book_id, rating_missing, rating_clean, has_review_text, engagement_mode, CAST(engagement_weight AS DOUBLE) AS engagement_weight, interaction_key FROM clean")
def cur_clean(spark, sf):
    return C.clean(fx.raw(spark, sf)).select("user_id", "book_id", "rating_missing", "rating_clean", "has_review_text", "engagement_mode", "engagement_weight", "interaction_key")


@query("cur_dedup_keep_best", f"WITH {fx.best_sql()} SELECT interaction_key, user_id, book_id, rating_clean, engagement_mode, is_read, category FROM best")
def cur_best(spark, sf):
    return best(spark, sf).select("interaction_key", "user_id", "book_id", "rating_clean", "engagement_mode", "is_read", "category")


_FEATURES = """,
parts AS (SELECT user_id, count(*) FILTER (is_read OR rating_clean IS NOT NULL) AS read_or_rated_count, coalesce(sum(rating_clean), 0) AS s, count(rating_clean) AS k, stddev_samp(rating_clean) AS sd FROM best GROUP BY 1),
feat AS (SELECT user_id, CASE WHEN k > 0 THEN s / k END AS user_mean_rating, CASE WHEN k > 1 THEN sd ELSE 0 END AS user_rating_std, k AS user_rating_count,
  CASE WHEN k > 0 THEN s / k - (SELECT sum(s) / sum(k) FROM parts) ELSE 0 END AS user_rating_bias, read_or_rated_count, read_or_rated_count >= 3 AS valid FROM parts)"""


@query("agg_user_features", f"WITH {fx.best_sql()}{_FEATURES} SELECT user_id, round(user_mean_rating, 6) AS user_mean_rating, round(user_rating_std, 6) AS user_rating_std, user_rating_count, round(user_rating_bias, 6) AS user_rating_bias, read_or_rated_count, valid FROM feat")
def agg_features(spark, sf):
    f = C.user_features(best(spark, sf))
    return f.select("user_id", F.round("user_mean_rating", 6).alias("user_mean_rating"), F.round("user_rating_std", 6).alias("user_rating_std"), "user_rating_count", F.round("user_rating_bias", 6).alias("user_rating_bias"), "read_or_rated_count", "valid")


@query("agg_user_partials", f"WITH {fx.clean_sql()} SELECT user_id, count(*) FILTER (is_read OR rating_clean IS NOT NULL) AS read_or_rated_count, coalesce(sum(rating_clean), 0) AS rating_sum, coalesce(sum(rating_clean * rating_clean), 0) AS rating_sq_sum, count(rating_clean) AS rating_count FROM clean GROUP BY 1")
def agg_partials(spark, sf):
    return C.user_partials(C.clean(fx.raw(spark, sf)))


@query("agg_key_categories", f"WITH {fx.clean_sql()} SELECT interaction_key, count(DISTINCT category) AS source_category_count FROM clean GROUP BY 1")
def agg_categories(spark, sf):
    return C.category_counts(C.clean(fx.raw(spark, sf)))


@query("agg_key_priority", f"""WITH {fx.clean_sql()} SELECT interaction_key, max(CASE engagement_mode WHEN 'review' THEN 3 WHEN 'rating_only' THEN 2 WHEN 'read_no_rating' THEN 1 ELSE 0 END) AS best_rank FROM clean GROUP BY 1""")
def agg_priority(spark, sf):
    return C.clean(fx.raw(spark, sf)).groupBy("interaction_key").agg(F.max(C.priority()).alias("p")).select("interaction_key", F.col("p.rank").alias("best_rank"))


@query("cur_canonical_interactions", f"""WITH {fx.best_sql()}{_FEATURES}, cats AS (SELECT interaction_key, count(DISTINCT category) AS source_category_count FROM clean GROUP BY 1)
SELECT interaction_key, user_id, book_id, engagement_mode, source_category_count, round(user_rating_bias, 6) AS user_rating_bias FROM best JOIN cats USING (interaction_key) JOIN feat USING (user_id) WHERE valid""")
def cur_canonical(spark, sf):
    out, _ = C.canonical(fx.raw(spark, sf), fx.vectors(spark, sf), tie())
    return out.select("interaction_key", "user_id", "book_id", "engagement_mode", "source_category_count", F.round("user_rating_bias", 6).alias("user_rating_bias"))


@query("cur_review_texts", f"WITH {fx.best_sql()} SELECT interaction_key, review_id, CAST(length(review_id) AS INTEGER) AS review_text_length FROM best WHERE has_review_text")
def cur_reviews(spark, sf):
    return best(spark, sf).where("has_review_text").select("interaction_key", "review_id", F.length("review_id").alias("review_text_length"))


@query("cur_category_views", f"WITH {fx.best_sql()}, {fx.ITEMS_SQL} SELECT view, count(*) AS n, count(DISTINCT user_id) AS n_users FROM ({' UNION ALL '.join(f'''SELECT '{g}' AS view, user_id FROM best SEMI JOIN (SELECT book_id FROM items WHERE genre_{g} = 1) USING (book_id)''' for g in fx.GENRES)}) GROUP BY 1")
def cur_views(spark, sf):
    views = C.category_views(best(spark, sf), fx.items(spark, sf), [f"genre_{g}" for g in fx.GENRES])
    out = None
    for name, v in views.items():
        part = v.select(F.lit(name.removeprefix("genre_")).alias("view"), "user_id")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("view").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("cur_build_summary", f"""WITH {fx.best_sql()}{_FEATURES} SELECT (SELECT count(*) FROM clean) AS rows_in, (SELECT count(*) FROM best) AS rows_dedup, (SELECT count(*) FROM best JOIN feat USING (user_id) WHERE valid) AS rows_kept,
(SELECT count(*) FROM feat WHERE valid) AS users_kept, (SELECT count(*) FROM best WHERE engagement_mode = 'want_to_read') AS want_to_read""")
def cur_summary(spark, sf):
    cleaned = C.clean(fx.raw(spark, sf))
    b = C.keep_best(cleaned, tie())
    f = C.user_features(b)
    kept = b.join(f.where("valid"), "user_id", "left_semi")
    one = lambda df, e, name: df.agg(e.alias(name))
    parts = [one(cleaned, F.count("*"), "rows_in"), one(b, F.count("*"), "rows_dedup"), one(kept, F.count("*"), "rows_kept"), one(f.where("valid"), F.count("*"), "users_kept"), one(b, F.count_if(F.col("engagement_mode") == "want_to_read"), "want_to_read")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def _core_sql(rounds: int) -> str:
    ctes = [f"{fx.best_sql()}, c0 AS MATERIALIZED (SELECT interaction_key, user_id, book_id FROM best)"]
    for i in range(rounds):
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT * FROM c{i} WHERE book_id IN (SELECT book_id FROM c{i} GROUP BY 1 HAVING count(*) >= 30) AND user_id IN (SELECT user_id FROM c{i} GROUP BY 1 HAVING count(*) >= 35))")
    return f"WITH {', '.join(ctes)} SELECT * FROM c{rounds}"


@query("cur_iterative_k_core", _core_sql(20))
def cur_core(spark, sf):
    return C.k_core(best(spark, sf).select("interaction_key", "user_id", "book_id"), 30, 35)


@query("cur_best_book", f"SELECT CAST(p_partkey % {fx.WORKS_SQL} AS VARCHAR) AS book_id, arg_max(p_name, (p_size, p_retailprice, -p_partkey)) AS title, max(p_size) AS ratings_count FROM part GROUP BY 1")
def cur_books(spark, sf):
    b = fx.table(spark, sf, "part").select(fx.work_of(spark, sf, "p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.col("p_size").alias("ratings_count"), F.col("p_retailprice").alias("text_reviews_count"), F.col("p_partkey").alias("source_ord"))
    return C.best_book(b).select("book_id", "title", "ratings_count")


@query("cur_last_interaction", f"WITH {fx.RAW} SELECT user_id, book_id, max(date_updated) AS date_updated FROM raw GROUP BY 1, 2")
def cur_last(spark, sf):
    return C.last_by(fx.raw(spark, sf), ["user_id", "book_id"], "date_updated", tie()).select("user_id", "book_id", "date_updated")


@query("cur_merge_master", f"SELECT CAST(p_partkey % {fx.WORKS_SQL} AS VARCHAR) AS book_id, max(CAST(p_size % 5 = 0 AS INTEGER)) AS genre_fantasy, max(CAST(p_size % 5 = 1 AS INTEGER)) AS genre_history, arg_min(p_name, p_partkey) AS title, arg_min(p_brand, p_partkey) FILTER (p_size > 10) AS author FROM part GROUP BY 1")
def cur_master(spark, sf):
    p = fx.table(spark, sf, "part")
    b = p.select(fx.work_of(spark, sf, "p_partkey").alias("book_id"), (F.col("p_size") % 5 == 0).cast("int").alias("genre_fantasy"), (F.col("p_size") % 5 == 1).cast("int").alias("genre_history"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("author"), F.col("p_partkey").alias("source_ord"))
    return C.merge_master(b, ["genre_fantasy", "genre_history"])


@query("prj_review_text", "SELECT page_id, nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '[\\s ]+', ' ', 'g')), '') AS body FROM pages")
def prj_review(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", X.review_text("html").alias("body"))


@query("prj_review_text_all_entities")
def prj_review_all(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", X.review_text("html", every_entity=True).alias("body"))


@query("prj_scalars", """SELECT c_custkey, nullif(trim(lower(c_mktsegment)), '') AS segment, TRY_CAST(c_name AS DOUBLE) AS as_number, TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) AS balance,
CASE WHEN lower(substr(c_name, 1, 4)) IN ('true', '1') THEN true WHEN lower(substr(c_name, 1, 4)) IN ('false', '0') THEN false END AS as_flag, round(ln(1 + greatest(c_acctbal, 0)), 9) AS log_balance,
regexp_replace(lower(trim(c_name)), '[^0-9a-z]+', '_', 'g') AS label, regexp_replace(lower(trim(c_name)), '\\s+', ' ', 'g') AS key FROM customer""")
def prj_scalars(spark, sf):
    c = fx.table(spark, sf, "customer")
    return c.select("c_custkey", X.trimmed("c_mktsegment", lower=True).alias("segment"), X.number("c_name").alias("as_number"), X.number(F.col("c_acctbal").cast("string")).alias("balance"), X.boolean(F.substring("c_name", 1, 4)).alias("as_flag"), F.round(X.log_clipped("c_acctbal"), 9).alias("log_balance"), X.label_of("c_name").alias("label"), X.title_key("c_name").alias("key"))


@query("prj_dates", """SELECT o_orderkey, o_orderdate AS parsed, round(date_diff('microsecond', o_orderdate, TIMESTAMP '2000-01-01') / 86400e6, 6) AS days,
make_date(CAST(year(o_orderdate) AS INTEGER), CAST(month(o_orderdate) AS INTEGER), 1) AS first_day FROM orders""")
def prj_dates(spark, sf):
    o = fx.table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    stamp = F.date_format("o_orderdate", "MMM dd HH:mm:ss Z yyyy")
    return o.select("o_orderkey", X.weekday_timestamp(F.concat(F.lit("Wed "), stamp)).alias("parsed"), F.round(X.days_between(F.lit("2000-01-01").cast("timestamp"), "o_orderdate"), 6).alias("days"), X.date_of_parts(F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.lit(None)).alias("first_day"))


@query("prj_year_periods", f"WITH {fx.ITEMS_SQL} SELECT book_id, CASE WHEN publication_year BETWEEN 1450 AND 2026 THEN publication_year END AS year, CASE WHEN publication_year < 1997 THEN 'early' WHEN publication_year < 2000 THEN 'middle' ELSE 'late' END AS period, CASE WHEN editions <= 0 THEN 'none' WHEN editions <= 9 THEN 'low' WHEN editions <= 49 THEN 'medium' ELSE 'high' END AS confidence FROM items")
def prj_periods(spark, sf):
    i = fx.items(spark, sf)
    y = F.col("publication_year")
    return i.select("book_id", F.when(y.between(1450, 2026), y).alias("year"), X.binned(y, [1450, 1997, 2000, 2027], ["early", "middle", "late"]).alias("period"), X.binned("editions", [-1, 0, 9, 49, float("inf")], ["none", "low", "medium", "high"], right=True).alias("confidence"))


@query("prj_engagement_weight", f"WITH {fx.best_sql()} SELECT interaction_key, round((rating_clean - 3) * CASE WHEN has_review_text THEN 1.3 ELSE 1 END * CASE WHEN date_diff('microsecond', date_added, date_updated) / 86400e6 BETWEEN 1 AND 180 THEN 1.2 ELSE 1 END, 6) AS weight FROM best WHERE is_read AND rating_clean >= 4")
def prj_weight(spark, sf):
    from shelfmark.operators.users import engagement

    b = best(spark, sf).where("is_read AND rating_clean >= 4").withColumn("reading_duration_days", X.days_between("date_updated", "date_added"))
    return b.select("interaction_key", F.round(engagement(), 6).alias("weight"))


@query("prj_percentile_cap", f"WITH {fx.ITEMS_SQL} SELECT book_id, round(least(num_pages, (SELECT quantile_cont(num_pages, 0.99) FROM items)), 6) AS pages_cap FROM items")
def prj_cap(spark, sf):
    i = fx.items(spark, sf)
    cap = i.agg(F.percentile("num_pages", F.lit(0.99)).alias("cap"))
    return i.join(F.broadcast(cap)).select("book_id", F.round(F.least(F.col("num_pages").cast("double"), F.col("cap")), 6).alias("pages_cap"))


@query("prj_first_text", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END), ''), nullif(trim(CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE source END), ''), '[no description]') AS body FROM documents")
def prj_first(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", X.first_text(F.when(F.col("doc_id") % 3 != 0, F.col("text")), F.when(F.col("doc_id") % 2 == 0, F.lit("  ")).otherwise(F.col("source")), default="[no description]").alias("body"))


@query("prj_genre_labels", f"WITH {fx.ITEMS_SQL} SELECT book_id, array_to_string(list_filter([{', '.join(f'''CASE WHEN genre_{g} = 1 THEN '{g}' END''' for g in fx.GENRES)}], lambda x: x IS NOT NULL), '|') AS genres, CASE WHEN {' + '.join(f'genre_{g}' for g in fx.GENRES)} > 1 THEN 'multi' {' '.join(f'''WHEN genre_{g} = 1 THEN '{g}' ''' for g in fx.GENRES)} ELSE 'other' END AS main FROM items")
def prj_genres(spark, sf):
    from shelfmark.functions.nested import dominant, flag_names

    flags = {g: F.col(f"genre_{g}") for g in fx.GENRES}
    return fx.items(spark, sf).select("book_id", flag_names(flags).alias("genres"), dominant(flags).alias("main"))


@query("prj_title_terms", """WITH t AS (SELECT p_type AS grp, unnest(regexp_extract_all(lower(p_name), '[a-z]{3,}')) AS term FROM part), c AS (SELECT grp, term, count(*) AS n FROM t WHERE term NOT IN ('part', 'the', 'and') GROUP BY 1, 2)
SELECT grp AS p_type, term, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 5""")
def prj_terms(spark, sf):
    return X.title_terms(fx.table(spark, sf, "part"), "p_type", "p_name", ["part", "the", "and"], 5)


@query("flt_language_rating", f"WITH {fx.ITEMS_SQL}, {fx.RAW} SELECT user_id, book_id, rating FROM raw SEMI JOIN (SELECT book_id FROM items WHERE (language IN (SELECT language FROM items GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) OR language IS NULL) AND title IS NOT NULL) USING (book_id) WHERE rating BETWEEN 1 AND 5")
def flt_language(spark, sf):
    i = fx.items(spark, sf)
    langs = i.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(2).select("language")
    ok = i.where("title is not null").join(langs, "language", "left_semi").unionByName(i.where("title is not null and language is null"))
    return fx.raw(spark, sf).where(F.col("rating").between(1, 5)).join(ok, "book_id", "left_semi").select("user_id", "book_id", "rating")


@query("flt_eligible", f"WITH {fx.ITEMS_SQL}, {fx.VECTORS_SQL} SELECT book_id FROM items JOIN vectors USING (book_id) WHERE book_id <> '' AND trim(title) <> '' AND cluster BETWEEN 0 AND 8 AND len(list_filter(vec, lambda x: isfinite(x))) = len(vec)")
def flt_eligible(spark, sf):
    from shelfmark.operators.retrieve import eligible

    return eligible(fx.items(spark, sf).join(fx.vectors(spark, sf), "book_id"), 9).select("book_id")


@query("joi_books_aggregates", f"WITH {fx.ITEMS_SQL}, {fx.RAW}, a AS (SELECT book_id, count(*) AS n, count(*) FILTER (is_read) AS n_read, count(review_id) AS n_reviews, avg(nullif(rating, 0)) AS mean_rating FROM raw WHERE category = 1 AND rating <> 3 GROUP BY 1) SELECT book_id, coalesce(n, 0) AS n, coalesce(n_read, 0) AS n_read, coalesce(n_reviews, 0) AS n_reviews, round(mean_rating, 6) AS mean_rating FROM items LEFT JOIN a USING (book_id)")
def joi_aggregates(spark, sf):
    r = fx.raw(spark, sf).where("category = 1 and rating <> 3")
    a = r.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if("is_read").alias("n_read"), F.count("review_id").alias("n_reviews"), F.avg(F.nullif("rating", F.lit(0))).alias("mean_rating"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return fx.items(spark, sf).join(a, "book_id", "left").select("book_id", zero("n"), zero("n_read"), zero("n_reviews"), F.round("mean_rating", 6).alias("mean_rating"))


@query("joi_inner_books", f"WITH {fx.ITEMS_SQL}, {fx.RAW} SELECT user_id, title, count(*) AS n FROM raw JOIN items USING (book_id) GROUP BY 1, 2")
def joi_inner(spark, sf):
    return fx.raw(spark, sf).join(fx.items(spark, sf).select("book_id", "title"), "book_id").groupBy("user_id", "title").agg(F.count("*").alias("n"))


@query("joi_validated", f"WITH {fx.ITEMS_SQL}, {fx.VECTORS_SQL} SELECT book_id, title, cluster, macro FROM items LEFT JOIN vectors USING (book_id)")
def joi_validated(spark, sf):
    from shelfmark.operators.contracts import joined_one_to_one

    return joined_one_to_one(fx.items(spark, sf), fx.vectors(spark, sf).select("book_id", "cluster", "macro"), "book_id").select("book_id", "title", "cluster", "macro")


@query("joi_consumed_anti", f"WITH {fx.RAW} SELECT DISTINCT user_id, book_id FROM raw r WHERE NOT EXISTS (SELECT 1 FROM raw x WHERE x.is_read AND x.user_id = r.user_id AND x.book_id = r.book_id)")
def joi_anti(spark, sf):
    r = fx.raw(spark, sf)
    return r.select("user_id", "book_id").distinct().join(r.where("is_read").select("user_id", "book_id").distinct(), ["user_id", "book_id"], "left_anti")


@query("set_difference", f"WITH {fx.RAW} SELECT user_id, book_id FROM raw WHERE is_read EXCEPT SELECT user_id, book_id FROM raw WHERE review_id IS NOT NULL")
def set_difference(spark, sf):
    r = fx.raw(spark, sf)
    return r.where("is_read").select("user_id", "book_id").subtract(r.where("review_id is not null").select("user_id", "book_id"))


@query("set_intersection", f"WITH {fx.RAW} SELECT user_id, book_id FROM raw WHERE is_read INTERSECT SELECT user_id, book_id FROM raw WHERE review_id IS NOT NULL")
def set_intersection(spark, sf):
    r = fx.raw(spark, sf)
    return r.where("is_read").select("user_id", "book_id").intersect(r.where("review_id is not null").select("user_id", "book_id"))


@query("set_union_distinct", f"WITH {fx.RAW} SELECT book_id FROM raw WHERE rating = 5 UNION SELECT book_id FROM raw WHERE NOT is_read")
def set_union(spark, sf):
    r = fx.raw(spark, sf)
    return r.where("rating = 5").select("book_id").unionByName(r.where("not is_read").select("book_id")).distinct()


@query("set_full_row_distinct", f"WITH {fx.RAW} SELECT DISTINCT * FROM raw")
def set_distinct(spark, sf):
    return fx.raw(spark, sf).dropDuplicates()


@query("set_concat_all", f"WITH {fx.ITEMS_SQL}, {fx.VECTORS_SQL} SELECT book_id, title, CAST(NULL AS INTEGER) AS cluster FROM items UNION ALL SELECT book_id, NULL, cluster FROM vectors")
def set_concat(spark, sf):
    return fx.items(spark, sf).select("book_id", "title").unionByName(fx.vectors(spark, sf).select("book_id", "cluster"), allowMissingColumns=True)


@query("set_equality_report", f"WITH {fx.ITEMS_SQL}, {fx.VECTORS_SQL} SELECT (SELECT count(*) FROM items ANTI JOIN vectors USING (book_id)) AS only_left, (SELECT count(*) FROM vectors ANTI JOIN items USING (book_id)) AS only_right")
def set_equality(spark, sf):
    from shelfmark.operators.contracts import id_difference

    return id_difference(fx.items(spark, sf), fx.vectors(spark, sf), "book_id")
