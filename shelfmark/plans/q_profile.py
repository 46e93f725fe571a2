"""Queries: exploratory profiles, nested metadata, graph, features, clusters, contracts, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import nested as N
from shelfmark.operators import cluster, contracts, cooc, features, graph, profile, retrieve, users
from shelfmark.plans import fixtures as fx
from shelfmark.plans.q_curation import canonical as best
from shelfmark.plans.q_ranking import _PAIRS, BEST, FLAGS, POS, catalog, r6
from shelfmark.sources import files
from shelfmark.store import shared_dir

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# profiles


@query("agg_value_counts", "SELECT CAST(l_shipdate IS NOT NULL AND l_returnflag = 'R' AS VARCHAR) AS value, count(*) AS n, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS share FROM lineitem GROUP BY 1")
def agg_counts(spark, sf):
    li = fx.table(spark, sf, "lineitem").withColumn("v", F.col("l_shipdate").isNotNull() & (F.col("l_returnflag") == "R"))
    return profile.value_counts(li, "v")


@query("agg_top_values", "SELECT p_brand AS value, count(*) AS n, count(*) / (SELECT count(*) FROM part)::DOUBLE AS share FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def agg_top(spark, sf):
    return profile.value_counts(fx.table(spark, sf, "part"), "p_brand", 5)


_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


@query("agg_describe", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(quantile_cont({c}, 0.95), 4) AS p95, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in _NUM))
def agg_describe(spark, sf):
    d = profile.describe(fx.table(spark, sf, "lineitem"), _NUM)
    return d.select("column", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75", "p95")], "max")


@query("agg_iqr_outliers", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 + 1.5 * (q3 - q1), 4) AS upper, (SELECT count(*) FROM orders WHERE {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM orders)" for c in ("o_totalprice", "o_custkey")))
def agg_iqr(spark, sf):
    o = profile.iqr_outliers(fx.table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    return o.select("column", *[F.round(c, 4).alias(c) for c in ("q1", "q3", "upper")], "n_outliers")


@query("eda_missing_summary", f"WITH {fx.RAW} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, {f'''count(*) FILTER ({c} = '')''' if s else '0::BIGINT'} AS n_empty, count(DISTINCT {c}) AS n_distinct, round(count(*) FILTER ({c} IS NULL{f''' OR {c} = ''' + chr(39) * 2 if s else ''}) / count(*)::DOUBLE, 6) AS missing_share FROM raw" for c, s in (("user_id", 1), ("book_id", 1), ("review_id", 1), ("rating", 0))))
def eda_missing(spark, sf):
    return profile.missing_summary(fx.raw(spark, sf).select("user_id", "book_id", "review_id", "rating")).withColumn("missing_share", F.round("missing_share", 6))


@query("agg_duplicate_counts", f"WITH {fx.RAW} SELECT 'review' AS key, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM raw GROUP BY review_id) UNION ALL SELECT 'pair', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM raw GROUP BY user_id, book_id)")
def agg_duplicates(spark, sf):
    return profile.duplicate_counts(fx.raw(spark, sf), {"review": ["review_id"], "pair": ["user_id", "book_id"]})


@query("agg_correlations", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def agg_corr(spark, sf):
    return profile.correlations(fx.table(spark, sf, "lineitem"), _NUM).withColumn("r", F.round("r", 6))


@query("agg_spearman", "WITH r AS (SELECT l_quantity, l_discount, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS rb FROM lineitem) SELECT round(corr(ra, rb), 6) AS rho FROM r")
def agg_spearman(spark, sf):
    return profile.spearman(fx.table(spark, sf, "lineitem"), "l_quantity", "l_discount").select(r6("rho"))


@query("agg_concentration", f"WITH {BEST}, u AS (SELECT count(*) AS n FROM best GROUP BY user_id), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS rk FROM u) SELECT f AS fraction, round(sum(n) FILTER (rk <= ceil(f * (SELECT count(*) FROM u))) / sum(n)::DOUBLE, 6) AS share FROM r, (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE)) AS v(f) GROUP BY 1")
def agg_concentration(spark, sf):
    return profile.concentration(best(spark, sf).groupBy("user_id").count(), "count", [0.01, 0.1, 0.5]).select("fraction", r6("share"))


@query("agg_cold_start_thresholds", f"WITH {BEST}, u AS (SELECT count(*) AS n FROM best GROUP BY user_id) SELECT t AS threshold, count(*) FILTER (n < t) AS n_below, count(*) FILTER (n < t) / count(*)::DOUBLE AS share FROM u, (VALUES (3), (10), (30)) AS v(t) GROUP BY 1")
def agg_thresholds(spark, sf):
    return profile.thresholds(best(spark, sf).groupBy("user_id").count(), "count", [3, 10, 30])


@query("agg_growth", f"WITH {BEST} SELECT CAST(year(date_added) AS INTEGER) AS year, count(*) AS n, count(DISTINCT user_id) AS users, round(count(rating_clean) / count(*)::DOUBLE, 6) AS rated_share FROM best GROUP BY 1")
def agg_growth(spark, sf):
    return best(spark, sf).groupBy(F.year("date_added").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.count("rating_clean") / F.count("*"), 6).alias("rated_share"))


@query("agg_user_types", f"WITH {BEST}, u AS (SELECT avg(rating_clean) AS m FROM best GROUP BY user_id HAVING count(rating_clean) >= 3) SELECT CASE WHEN m < 3 THEN 'strict' WHEN m >= 4.5 THEN 'generous' ELSE 'balanced' END AS user_type, count(*) AS n, round(avg(m), 6) AS mean_rating FROM u GROUP BY 1")
def agg_types(spark, sf):
    return profile.user_types(best(spark, sf)).withColumn("mean_rating", F.round("mean_rating", 6))


@query("agg_group_quantiles", f"WITH {fx.ITEMS_SQL} SELECT author, count(*) AS n, round(quantile_cont(num_pages, 0.95), 4) AS p95, round(median(num_pages), 4) AS median FROM items GROUP BY 1")
def agg_quantiles(spark, sf):
    return fx.items(spark, sf).groupBy("author").agg(F.count("*").alias("n"), F.round(F.percentile("num_pages", F.lit(0.95)), 4).alias("p95"), F.round(F.percentile("num_pages", F.lit(0.5)), 4).alias("median"))


@query("agg_flag_overlaps", f"WITH {fx.ITEMS_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} = 1 AND {b} = 1) AS n_both, round(count(*) FILTER ({a} = 1 AND {b} = 1) / nullif(count(*) FILTER ({a} = 1 OR {b} = 1), 0)::DOUBLE, 6) AS jaccard FROM items" for i, a in enumerate(FLAGS) for b in FLAGS[i + 1 :]))
def agg_overlaps(spark, sf):
    return profile.flag_overlaps(fx.items(spark, sf), FLAGS).withColumn("jaccard", F.round("jaccard", 6))


@query("agg_pivot_systems", f"WITH {BEST} SELECT category, count(*) FILTER (engagement_mode = 'review') AS review, count(*) FILTER (engagement_mode = 'rating_only') AS rating_only, count(*) FILTER (engagement_mode = 'want_to_read') AS want_to_read FROM best GROUP BY 1")
def agg_pivot(spark, sf):
    p = best(spark, sf).groupBy("category").pivot("engagement_mode", ["review", "rating_only", "want_to_read"]).count()
    return p.select("category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("review", "rating_only", "want_to_read")])


@query("agg_ordered_lists", f"WITH {BEST} SELECT user_id, array_to_string(list(book_id ORDER BY d, book_id), '|') AS books FROM (SELECT user_id, book_id, min(date_added) AS d FROM best WHERE is_read AND rating_clean >= 4 GROUP BY 1, 2) GROUP BY 1")
def agg_lists(spark, sf):
    f = users.positives(best(spark, sf)).groupBy("user_id", "book_id").agg(F.min("date_added").alias("d"))
    return f.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("d", "book_id"))).alias("l")).select("user_id", F.array_join(F.transform("l", lambda s: s["book_id"]), "|").alias("books"))


@query("agg_median_imputation", f"WITH {fx.ITEMS_SQL} SELECT book_id, round(coalesce(CASE WHEN editions > 1 AND num_pages < 200 THEN num_pages END, (SELECT median(num_pages) FROM items WHERE editions > 1 AND num_pages < 200)), 4) AS pages FROM items")
def agg_median(spark, sf):
    i = fx.items(spark, sf).withColumn("p", F.when((F.col("editions") > 1) & (F.col("num_pages") < 200), F.col("num_pages").cast("double")))
    return i.join(F.broadcast(i.agg(F.percentile("p", F.lit(0.5)).alias("m")))).select("book_id", F.round(F.coalesce("p", "m"), 4).alias("pages"))


@query("eda_engagement_profile", f"WITH {BEST} SELECT engagement_mode, count(*) AS n, round(count(*) / (SELECT count(*) FROM best)::DOUBLE, 6) AS share, round(avg(rating_clean), 6) AS mean_rating FROM best GROUP BY 1")
def eda_engagement(spark, sf):
    b = best(spark, sf).groupBy("engagement_mode").agg(F.count("*").alias("n"), F.avg("rating_clean").alias("m"))
    total = best(spark, sf).agg(F.count("*").alias("t"))
    return b.join(F.broadcast(total)).select("engagement_mode", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), F.round("m", 6).alias("mean_rating"))


@query("eda_duration_profile", f"WITH {BEST}, d AS (SELECT floor(date_diff('microsecond', date_added, date_updated) / 86400e6) AS d FROM best) SELECT count(*) AS n, round(avg(d), 6) AS mean, median(d) AS p50 FROM d WHERE d BETWEEN 0 AND 365")
def eda_duration(spark, sf):
    d = best(spark, sf).select(F.floor((F.unix_micros("date_updated") - F.unix_micros("date_added")) / F.lit(86_400e6)).cast("double").alias("d")).where("d between 0 and 365")
    return d.agg(F.count("*").alias("n"), r6(F.avg("d"), "mean"), F.percentile("d", F.lit(0.5)).alias("p50"))


@query("eda_identifier_quality", "SELECT count(*) AS n, count(*) FILTER (p_name IS NULL OR trim(p_name) = '') AS no_title, count(DISTINCT p_partkey) AS ids, count(*) FILTER (NOT regexp_matches(CAST(p_partkey AS VARCHAR), '^[0-9]+$')) AS odd_ids FROM part")
def eda_identifiers(spark, sf):
    return fx.table(spark, sf, "part").agg(F.count("*").alias("n"), F.count_if(F.col("p_name").isNull() | (F.trim("p_name") == "")).alias("no_title"), F.countDistinct("p_partkey").alias("ids"), F.count_if(~F.col("p_partkey").cast("string").rlike("^[0-9]+$")).alias("odd_ids"))


@query("eda_histogram", "SELECT CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 51 GROUP BY 1")
def eda_histogram(spark, sf):
    return profile.histogram(fx.table(spark, sf, "lineitem"), "l_quantity", [0, 10, 30, 51], ["few", "some", "many"])


@query("eda_theme_profile", f"WITH {fx.ITEMS_SQL} SELECT coalesce({', '.join(f'''CASE WHEN genre_{g} = 1 THEN '{g}' END''' for g in fx.GENRES)}, 'other') AS theme, count(*) AS n, round(avg(num_pages), 4) AS mean_pages FROM items GROUP BY 1")
def eda_themes(spark, sf):
    t = profile.first_true({g: F.col(f"genre_{g}") == 1 for g in fx.GENRES})
    return fx.items(spark, sf).groupBy(t.alias("theme")).agg(F.count("*").alias("n"), F.round(F.avg("num_pages"), 4).alias("mean_pages"))


@query("eda_theme_ratings", f"WITH {BEST}, {fx.ITEMS_SQL} " + " UNION ALL ".join(f"SELECT '{g}' AS theme, count(rating_clean) AS n, round(avg(rating_clean), 6) AS mean, round(count(*) FILTER (rating_clean IN (1, 5)) / count(rating_clean)::DOUBLE, 6) AS extreme FROM best JOIN items USING (book_id) WHERE genre_{g} = 1" for g in fx.GENRES))
def eda_theme_ratings(spark, sf):
    j = best(spark, sf).join(fx.items(spark, sf).select("book_id", F.explode(F.array(*[F.when(F.col(f"genre_{g}") == 1, F.lit(g)) for g in fx.GENRES])).alias("theme")).where("theme is not null"), "book_id")
    return j.groupBy("theme").agg(F.count("rating_clean").alias("n"), r6(F.avg("rating_clean"), "mean"), r6(F.count_if(F.col("rating_clean").isin(1, 5)) / F.count("rating_clean"), "extreme"))


@query("eda_most_editions", f"WITH {fx.ITEMS_SQL} SELECT lower(author) AS work, sum(editions)::BIGINT AS n FROM items GROUP BY 1 ORDER BY n DESC, work LIMIT 5")
def eda_editions(spark, sf):
    return fx.items(spark, sf).groupBy(F.lower("author").alias("work")).agg(F.sum("editions").alias("n")).orderBy(F.desc("n"), "work").limit(5)


@query("eda_rating_delta", f"WITH {BEST}, m AS (SELECT book_id, avg(rating_clean) AS m FROM best GROUP BY 1) SELECT round(avg(abs(rating_clean - m)), 6) AS mean_delta, round(count(*) FILTER (abs(rating_clean - m) <= 1) / count(*)::DOUBLE, 6) AS agreement FROM best JOIN m USING (book_id) WHERE rating_clean IS NOT NULL")
def eda_delta(spark, sf):
    b = best(spark, sf).where("rating_clean is not null")
    j = b.join(b.groupBy("book_id").agg(F.avg("rating_clean").alias("m")), "book_id")
    d = F.abs(F.col("rating_clean") - F.col("m"))
    return j.agg(r6(F.avg(d), "mean_delta"), r6(F.count_if(d <= 1) / F.count("*"), "agreement"))


@query("eda_sampled_scatter")
def eda_scatter(spark, sf):
    return best(spark, sf).select("user_id", "rating_clean").sample(0.05, seed=42)


# nested metadata, made of the part table

_PARTS = f"SELECT p_partkey % {fx.WORKS_SQL} AS g, p_partkey, p_brand, p_type, p_name, p_size FROM part"


def nested(spark, sf):
    p = fx.table(spark, sf, "part").withColumn("book_id", fx.work_of(spark, sf, "p_partkey"))
    author = F.struct(F.col("p_partkey").alias("o"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("author_id"), F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.lit("Editor")).alias("role"))
    shelf = F.struct(F.col("p_partkey").alias("o"), F.when(F.col("p_size") % 5 == 0, F.lit("to-read")).otherwise(F.col("p_type")).alias("name"), F.col("p_size").cast("long").alias("count"))
    g = p.groupBy("book_id").agg(F.sort_array(F.collect_list(author)).alias("a"), F.sort_array(F.collect_list(shelf)).alias("s"))
    return g.select("book_id", F.transform("a", lambda x: F.struct(x["author_id"].alias("author_id"), x["role"].alias("role"))).alias("authors"), F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias("shelves"))


@query("arr_author_summary", f"WITH p AS ({_PARTS}), a AS (SELECT *, p_size % 2 = 0 AS plain FROM p WHERE p_size % 7 <> 0) SELECT CAST(g AS VARCHAR) AS book_id, string_agg(p_brand, '|' ORDER BY p_partkey) AS author_ids, arg_min(p_brand, p_partkey) AS first_author, arg_min(CASE WHEN plain THEN '' ELSE 'Editor' END, p_partkey) AS first_role, CAST(count(p_brand) AS INTEGER) AS n_authors, coalesce(arg_min(p_brand, p_partkey) FILTER (plain), arg_min(p_brand, p_partkey)) AS main_author, CAST(count(*) FILTER (NOT plain AND p_brand IS NOT NULL) AS INTEGER) AS n_other FROM (SELECT DISTINCT g FROM p) LEFT JOIN a USING (g) GROUP BY 1")
def arr_authors(spark, sf):
    a = F.col("authors")
    return nested(spark, sf).select("book_id", N.author_ids(a).alias("author_ids"), N.first_author(a).alias("first_author"), N.first_role(a).alias("first_role"), N.author_count(a).alias("n_authors"), N.main_author(a).alias("main_author"), N.other_roles(a).alias("n_other"))


@query("arr_shelf_summary", f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p_partkey) AS i, CASE WHEN p_size % 5 = 0 THEN 'to-read' ELSE p_type END AS name FROM ({_PARTS})) SELECT CAST(g AS VARCHAR) AS book_id, string_agg(name, '|' ORDER BY i) FILTER (i <= 3) AS names, CAST(count(*) AS INTEGER) AS n_shelves, coalesce(arg_max(p_size, i) FILTER (name = 'to-read' AND i <= 3), 0)::BIGINT AS to_read, bool_or(regexp_matches(lower(name), 'steel|tin')) FILTER (i <= 3) AS metal FROM p GROUP BY 1")
def arr_shelves(spark, sf):
    s = F.col("shelves")
    names = N.shelf_names(s, 3)
    return nested(spark, sf).select("book_id", F.array_join(names, "|").alias("names"), N.list_count(s).alias("n_shelves"), N.to_read_count(s, 3).alias("to_read"), N.theme_flag(names, ["steel", "tin"]).alias("metal"))


@query("arr_shelf_json", f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p_partkey) AS i, CASE WHEN p_size % 5 = 0 THEN 'to-read' ELSE p_type END AS name FROM ({_PARTS})) SELECT CAST(g AS VARCHAR) AS book_id, '[' || string_agg('{{\"name\":\"' || name || '\",\"count\":' || p_size || '}}', ',' ORDER BY i) FILTER (i <= 2) || ']' AS top FROM p GROUP BY 1".replace("{{", "{").replace("}}", "}"))
def arr_json(spark, sf):
    return nested(spark, sf).select("book_id", N.shelf_json(F.col("shelves"), 2).alias("top"))


@query("arr_name_pairs", f"WITH p AS (SELECT g, CASE WHEN p_size % 5 = 0 THEN 'to-read' ELSE p_type END AS name, row_number() OVER (PARTITION BY g ORDER BY p_partkey) AS i FROM ({_PARTS})), d AS (SELECT DISTINCT g, name FROM p WHERE i <= 4) SELECT a.name AS a, b.name AS b, count(*) AS n FROM d a JOIN d b ON a.g = b.g AND a.name < b.name GROUP BY 1, 2")
def arr_pairs(spark, sf):
    names = N.shelf_names(F.col("shelves"), 4)
    return nested(spark, sf).select(F.explode(N.name_pairs(names, 4)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


@query("eda_author_profile", f"WITH p AS ({_PARTS}), c AS (SELECT g, count(*) FILTER (p_size % 7 <> 0) AS n FROM p GROUP BY 1) SELECT CAST(n AS INTEGER) AS n_authors, count(*) AS books FROM c GROUP BY 1")
def eda_authors(spark, sf):
    return nested(spark, sf).groupBy(N.author_count(F.col("authors")).alias("n_authors")).agg(F.count("*").alias("books"))


@query("src_json_props", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def src_props(spark, sf):
    return fx.table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k long")["k"]).alias("total"), F.count("*").alias("n"))


# graph


def graph_of(spark, sf):
    e = cooc.pairs(users.positives(best(spark, sf))).select(F.col("book_id_a").alias("a"), F.col("book_id_b").alias("b"), F.col("pmi").alias("w"), "co_count")
    return fx.vectors(spark, sf).select(F.col("book_id").alias("id")), e


_G = f"{POS}{_PAIRS}, {fx.VECTORS_SQL}, e AS (SELECT book_id_a AS a, book_id_b AS b, pmi AS w, co_count FROM pmi), x AS (SELECT a AS id, b AS other, w FROM e UNION ALL SELECT b, a, w FROM e)"


@query("gra_degrees", f"WITH {_G} SELECT v.book_id AS id, count(x.id) AS degree, round(coalesce(sum(w), 0), 5) AS weighted_degree FROM vectors v LEFT JOIN x ON x.id = v.book_id GROUP BY 1")
def gra_degrees(spark, sf):
    return graph.degrees(*graph_of(spark, sf)).withColumn("weighted_degree", F.round("weighted_degree", 5))


def _pagerank_sql(rounds: int = 40) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT book_id AS id, 1.0::DOUBLE / (SELECT count(*) FROM vectors) AS rank FROM vectors)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT r.id, 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT id FROM t)) / (SELECT count(*) FROM vectors)) + 0.15 / (SELECT count(*) FROM vectors) AS rank FROM r{i} r LEFT JOIN (SELECT x.other AS id, sum(rank * w / tw) AS got FROM r{i} JOIN x USING (id) JOIN t USING (id) WHERE w > 0 GROUP BY 1) g USING (id))")
    return f"WITH {_G}, t AS (SELECT id, sum(w) AS tw FROM x WHERE w > 0 GROUP BY 1), {', '.join(steps)} SELECT id, round(rank, 4) AS rank FROM r{rounds}"


@query("gra_pagerank", _pagerank_sql())
def gra_pagerank(spark, sf):
    return graph.pagerank(*graph_of(spark, sf), tolerance=1e-9).withColumn("rank", F.round("rank", 4))


@query("gra_components", f"WITH RECURSIVE {_G}, walk(id, root) AS (SELECT book_id, book_id FROM vectors UNION SELECT x.other, walk.root FROM walk JOIN x ON x.id = walk.id WHERE w > 0.3) SELECT id, min(root) AS component FROM walk GROUP BY 1")
def gra_components(spark, sf):
    v, e = graph_of(spark, sf)
    return graph.components(v, e.where("w > 0.3"))


@query("gra_summary", f"WITH RECURSIVE {_G}, walk(id, root) AS (SELECT book_id, book_id FROM vectors UNION SELECT x.other, walk.root FROM walk JOIN x ON x.id = walk.id WHERE w > 0.3), c AS (SELECT id, min(root) AS component FROM walk GROUP BY 1), f AS (SELECT * FROM e WHERE w > 0.3) SELECT (SELECT count(*) FROM vectors) AS nodes, (SELECT count(*) FROM f) AS edges, round(2 * (SELECT count(*) FROM f) / ((SELECT count(*) FROM vectors) * ((SELECT count(*) FROM vectors) - 1))::DOUBLE, 6) AS density, (SELECT count(*) FROM vectors WHERE book_id NOT IN (SELECT a FROM f UNION SELECT b FROM f)) AS isolated, (SELECT count(DISTINCT component) FROM c) AS components, round((SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY component)) / (SELECT count(*) FROM vectors)::DOUBLE, 6) AS largest_fraction")
def gra_summary(spark, sf):
    v, e = graph_of(spark, sf)
    return graph.summary(v, e.where("w > 0.3")).withColumn("density", F.round("density", 6)).withColumn("largest_fraction", F.round("largest_fraction", 6))


_CUTS = "WITH RECURSIVE {g}, cuts(t) AS (VALUES (2), (3), (5), (10)), walk(t, id, root) AS (SELECT t, book_id, book_id FROM vectors, cuts UNION SELECT walk.t, y.other, walk.root FROM walk JOIN (SELECT a AS id, b AS other, co_count FROM e UNION ALL SELECT b, a, co_count FROM e) y ON y.id = walk.id AND co_count >= t), c AS (SELECT t, id, min(root) AS component FROM walk GROUP BY 1, 2), s AS (SELECT t, component, count(*) AS n FROM c GROUP BY 1, 2) SELECT t AS threshold, (SELECT count(*) FROM e WHERE co_count >= t) AS edges, (SELECT count(*) FROM (SELECT a FROM e WHERE co_count >= t UNION SELECT b FROM e WHERE co_count >= t)) AS connected_nodes, (SELECT count(*) FROM s WHERE s.t = cuts.t) AS components, round((SELECT max(n) FROM s WHERE s.t = cuts.t) / (SELECT count(*) FROM vectors)::DOUBLE, 6) AS largest_fraction FROM cuts"


@query("gra_sensitivity", _CUTS.format(g=_G))
def gra_sensitivity(spark, sf):
    return graph.sensitivity(*graph_of(spark, sf), [2, 3, 5, 10]).withColumn("largest_fraction", F.round("largest_fraction", 6))


@query("gra_against_popularity", f"WITH {_G}, n AS (SELECT v.book_id AS id, count(x.id) AS degree, round(coalesce(sum(w), 0), 6) AS m, coalesce(max(c), 0) AS p FROM vectors v LEFT JOIN x ON x.id = v.book_id LEFT JOIN marg ON marg.book_id = v.book_id GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS b FROM n WHERE degree > 0) SELECT (SELECT round(corr(a, b), 5) FROM r) AS rho, (SELECT count(*) / 20.0::DOUBLE FROM (SELECT id FROM n ORDER BY m DESC, id LIMIT 20) SEMI JOIN (SELECT id FROM n ORDER BY p DESC, id LIMIT 20) USING (id)) AS overlap")
def gra_popularity(spark, sf):
    v, e = graph_of(spark, sf)
    pop = users.positives(best(spark, sf)).select("user_id", "book_id").distinct().groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("p"))
    n = graph.degrees(v, e).join(pop, "id", "left").select("id", "degree", r6("weighted_degree", "m"), F.coalesce("p", F.lit(0)).alias("p"))
    return graph.against_popularity(n, "m", "p", 20).withColumn("rho", F.round("rho", 5))


@query("gra_betweenness")
def gra_betweenness(spark, sf):
    v, e = graph_of(spark, sf)
    return graph.betweenness(v, e.select("a", "b", "w"))


@query("gra_export", f"WITH {_G}, d AS (SELECT v.book_id AS id, coalesce(sum(w), 0) AS rank FROM vectors v LEFT JOIN x ON x.id = v.book_id GROUP BY 1), k AS (SELECT id FROM d ORDER BY round(rank, 9) DESC, id LIMIT 60), i AS (SELECT * FROM e WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)), y AS (SELECT a AS id, b AS other, w FROM i UNION ALL SELECT b, a, w FROM i), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, other) AS r FROM y) WHERE r <= 3) SELECT a, b, round(w, 6) AS w FROM i WHERE (a, b) IN (SELECT (least(id, other), greatest(id, other)) FROM s)")
def gra_export(spark, sf):
    v, e = graph_of(spark, sf)
    d = graph.degrees(v, e).select("id", F.col("weighted_degree").alias("rank"))
    return graph.export_edges(e.select("a", "b", "w"), d, 60, 3).withColumn("w", F.round("w", 6))


@query("web_item_search", f"WITH {fx.ITEMS_SQL} SELECT book_id, title FROM items WHERE contains(lower(title), '1') AND genre_fantasy = 1 ORDER BY title, book_id LIMIT 15")
def web_search(spark, sf):
    return fx.items(spark, sf).where(F.lower("title").contains("1") & (F.col("genre_fantasy") == 1)).orderBy("title", "book_id").limit(15).select("book_id", "title")


# features, clusters


def featured(spark, sf):
    i = fx.items(spark, sf)
    r = best(spark, sf).groupBy("book_id").agg(F.avg("rating_clean").alias("average_rating"), F.count("rating_clean").alias("ratings_count"), F.count_if("has_review_text").alias("reviews_count"))
    return i.join(r, "book_id", "left").withColumn("num_pages", F.when(F.col("num_pages") > 40, F.col("num_pages"))).withColumn("author_count", F.lit(1))


@query("fea_numeric_block", f"WITH {BEST}, {fx.ITEMS_SQL}, f AS (SELECT i.* REPLACE (CASE WHEN num_pages > 40 THEN num_pages END AS num_pages), average_rating, ratings_count, reviews_count FROM items i LEFT JOIN (SELECT book_id, avg(rating_clean) AS average_rating, count(rating_clean) AS ratings_count, count(*) FILTER (has_review_text) AS reviews_count FROM best GROUP BY 1) USING (book_id)) SELECT book_id, round(coalesce(average_rating, (SELECT median(average_rating) FROM f)), 6) AS x0, round(ln(1 + coalesce(ratings_count, 0)), 6) AS x1, round(ln(1 + coalesce(reviews_count, 0)), 6) AS x2, round(coalesce(num_pages, (SELECT median(num_pages) FROM f)), 6) AS x3, CAST(num_pages IS NULL AS DOUBLE) AS x4, CAST(publication_year AS DOUBLE) AS x5, 0.0::DOUBLE AS x6, 1.0::DOUBLE AS x7, CAST({' + '.join(f'genre_{g}' for g in fx.GENRES)} AS DOUBLE) AS x8 FROM f".replace("CAST(num_pages IS NULL AS DOUBLE)", "CASE WHEN num_pages IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))
def fea_numeric(spark, sf):
    n = features.numeric_block(featured(spark, sf), FLAGS)
    return n.select("book_id", *[F.round(F.col("num")[i], 6).alias(f"x{i}") for i in range(9)])


@query("fea_binary_block", f"WITH {fx.ITEMS_SQL}, l AS (SELECT *, regexp_replace(lower(trim(language)), '[^0-9a-z]+', '_', 'g') AS v FROM items), t AS (SELECT v, row_number() OVER (ORDER BY count(*) DESC, v) AS r FROM l WHERE v NOT IN ('', 'other') GROUP BY 1 QUALIFY r <= 3) SELECT book_id, {', '.join(f'CAST(genre_{g} AS DOUBLE) AS b{i}' for i, g in enumerate(fx.GENRES))}, {', '.join(f'CASE WHEN v = (SELECT v FROM t WHERE r = {k}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h{k}' for k in (1, 2, 3))}, CASE WHEN v IN (SELECT v FROM t) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS other FROM l")
def fea_binary(spark, sf):
    b = features.binary_block(fx.items(spark, sf), FLAGS, "language", 3)
    return b.select("book_id", *[F.col("bin")[i].alias(f"b{i}") for i in range(5)], *[F.col("bin")[4 + k].alias(f"h{k}") for k in (1, 2, 3)], F.col("bin")[8].alias("other"))


@query("fea_scaled_block", f"WITH {fx.VECTORS_SQL} SELECT book_id, CAST(axis - 1 AS INTEGER) AS axis, round((x - avg(x) OVER (PARTITION BY axis)) / stddev_pop(x) OVER (PARTITION BY axis) / 8, 5) AS z FROM (SELECT book_id, axis, vec[axis] AS x FROM vectors, (SELECT unnest(range(1, 65)) AS axis))")
def fea_scaled(spark, sf):
    s = features.scaled_block(fx.vectors(spark, sf), "vec", "z")
    return s.select("book_id", F.posexplode("z").alias("axis", "z")).withColumn("z", F.round("z", 5))


@query("fea_pca_projection")
def fea_pca(spark, sf):
    f = featured(spark, sf)
    blocks = [(features.numeric_block(f, FLAGS), "num"), (features.binary_block(f, FLAGS, "language", 3), "bin"), (fx.vectors(spark, sf).select("book_id", "vec"), "vec")]
    whole = catalog(spark, sf).select("book_id")
    joined = features.joined_blocks([(b.join(whole, "book_id", "left_semi"), c) for b, c in blocks])
    components, _ = features.fit_pca(joined)
    return features.project(joined, components).select("book_id", F.size("vec").alias("n"), F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("fea_spot_check", f"WITH {fx.ITEMS_SQL}, {fx.VECTORS_SQL}, j AS (SELECT * FROM items JOIN vectors USING (book_id)) " + " UNION ALL ".join(f"SELECT '{g}' AS genre, round(1 - list_cosine_similarity(a, b), 6) AS near, round(1 - list_cosine_similarity(a, c), 6) AS far FROM (SELECT (SELECT vec FROM j WHERE {g} = 1 ORDER BY book_id LIMIT 1) AS a, (SELECT vec FROM j WHERE {g} = 1 ORDER BY book_id LIMIT 1 OFFSET 1) AS b, (SELECT vec FROM j WHERE {g} = 0 ORDER BY book_id LIMIT 1) AS c)" for g in FLAGS[:3]))
def fea_spot(spark, sf):
    s = features.spot_check(catalog(spark, sf), FLAGS)
    return s.select("genre", r6("near"), r6("far"))


@query("int_genre_centroids", f"WITH {fx.ITEMS_SQL}, {fx.VECTORS_SQL} " + " UNION ALL ".join(f"SELECT '{g}' AS genre, CAST(axis - 1 AS INTEGER) AS axis, round(avg(vec[axis]), 6) AS mean FROM (SELECT vec, unnest(range(1, 65)) AS axis FROM items JOIN vectors USING (book_id) WHERE {g} = 1) GROUP BY 2" for g in FLAGS))
def int_centroids(spark, sf):
    return features.genre_centroids(catalog(spark, sf), FLAGS).select("genre", "axis", r6("mean"))


@query("cch_missing_vectors", f"WITH {fx.ITEMS_SQL}, {fx.VECTORS_SQL} SELECT book_id, CAST(book_id AS INTEGER) < 150 AS cached FROM items")
def cch_vectors(spark, sf):
    v = fx.vectors(spark, sf).select("book_id", "vec")
    cache = v.where("cast(book_id as int) < 150")
    out = features.cached_vectors(fx.items(spark, sf), cache, lambda lost: lost.join(v, "book_id").select("book_id", "vec"))
    return out.join(cache.select("book_id", F.lit(True).alias("c")), "book_id", "left").select("book_id", F.coalesce("c", F.lit(False)).alias("cached"))


_ASSIGN = f"{fx.VECTORS_SQL}, centre AS (SELECT cluster, list(x ORDER BY axis) AS vec FROM (SELECT cluster, axis, avg(vec[axis]) AS x FROM vectors, (SELECT unnest(range(1, 65)) AS axis) GROUP BY 1, 2) GROUP BY 1), assigned AS (SELECT book_id, cluster, d AS distance FROM (SELECT v.book_id, c.cluster, round(list_distance(v.vec, c.vec), 9) AS d, row_number() OVER (PARTITION BY v.book_id ORDER BY round(list_distance(v.vec, c.vec), 9), c.cluster) AS r FROM vectors v, centre c) WHERE r = 1)"


def assigned(spark, sf):
    v = fx.vectors(spark, sf)
    return cluster.assign(v, retrieve.centroids(v))


@query("clu_assignment", f"WITH {_ASSIGN} SELECT book_id, cluster, round(distance, 5) AS distance FROM assigned")
def clu_assign(spark, sf):
    return assigned(spark, sf).withColumn("distance", F.round("distance", 5))


@query("clu_size_stats", f"WITH {_ASSIGN}, s AS (SELECT count(*) AS n FROM assigned GROUP BY cluster) SELECT count(*) AS clusters, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, count(*) FILTER (n < 20) AS tiny, count(*) FILTER (n < 50) AS small, count(*) FILTER (n > 3000) AS large FROM s")
def clu_sizes(spark, sf):
    return cluster.size_stats(assigned(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("clu_quality", f"WITH {_ASSIGN} SELECT cluster, count(*) AS n, count(*) / (SELECT count(*) FROM assigned)::DOUBLE AS share, CASE WHEN count(*) < 20 THEN 'tiny' WHEN count(*) < 50 THEN 'small' WHEN count(*) > 3000 THEN 'large' ELSE 'ok' END AS flag, round(avg(distance), 5) AS mean, round(median(distance), 5) AS median, round(max(distance), 5) AS farthest, round(coalesce(stddev_samp(distance), 0), 5) AS std FROM assigned GROUP BY 1")
def clu_quality(spark, sf):
    q = cluster.quality_flags(assigned(spark, sf))
    return q.select("cluster", "n", "share", "flag", *[F.round(c, 5).alias(c) for c in ("mean", "median", "farthest", "std")])


@query("clu_nearest", f"WITH {_ASSIGN} SELECT cluster, book_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, book_id) AS rank FROM assigned) WHERE rank <= 10")
def clu_nearest(spark, sf):
    return cluster.nearest(assigned(spark, sf)).select("cluster", "book_id", "rank")


@query("clu_macro_summary", f"WITH {_ASSIGN} SELECT CAST(cluster // 2 AS INTEGER) AS macro, count(DISTINCT cluster) AS clusters, count(*) AS n, count(*) / (SELECT count(*) FROM assigned)::DOUBLE AS share FROM assigned GROUP BY 1")
def clu_macro(spark, sf):
    a = assigned(spark, sf)
    m = fx.vectors(spark, sf).select("cluster", "macro").distinct()
    return cluster.macro_summary(a, m)


@query("clu_ward_macros")
def clu_ward(spark, sf):
    return cluster.macros(retrieve.centroids(fx.vectors(spark, sf)), 4)


@query("clu_kmeans")
def clu_kmeans(spark, sf):
    v = fx.vectors(spark, sf)
    return cluster.assign(v, cluster.centres_of(spark, cluster.fit_kmeans(v, 10)))


@query("clu_compare_k")
def clu_compare(spark, sf):
    return cluster.compare_k(fx.vectors(spark, sf), [5, 10])


@query("clu_group_terms", f"WITH {fx.ITEMS_SQL}, v AS (SELECT author AS grp, unnest(string_split(array_to_string(list_filter([{', '.join(f'''CASE WHEN genre_{g} = 1 THEN '{g}' END''' for g in fx.GENRES)}], lambda x: x IS NOT NULL), '|'), '|')) AS genre FROM items), c AS (SELECT grp, genre, count(*) AS n FROM v WHERE genre <> '' GROUP BY 1, 2) SELECT grp AS author, genre, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, genre) AS rank FROM c) WHERE rank <= 2")
def clu_terms(spark, sf):
    i = fx.items(spark, sf).withColumn("genres", N.flag_names({g: F.col(f"genre_{g}") for g in fx.GENRES}))
    return cluster.group_terms(i, "author", "genres", "genre", 2)


# contracts, sources, sinks


@query("val_contracts", f"WITH {BEST}, {fx.ITEMS_SQL}, {fx.VECTORS_SQL} SELECT 'title' AS \"check\", count(*) FILTER (title IS NULL) AS violations FROM items UNION ALL SELECT 'rating range', count(*) FILTER (NOT coalesce(rating_clean BETWEEN 1 AND 5, false)) FROM best UNION ALL SELECT 'dimensions', count(*) FILTER (len(vec) <> 64) FROM vectors")
def val_contracts(spark, sf):
    return contracts.validate({"title": (fx.items(spark, sf), F.col("title").isNotNull()), "rating range": (best(spark, sf), F.col("rating_clean").between(1, 5)), "dimensions": (fx.vectors(spark, sf), F.size("vec") == 64)})


@query("src_multi_file_union", "SELECT category, count(*) AS n FROM (SELECT 'customer' AS category FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100) UNION ALL SELECT 'supplier' FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 100)) GROUP BY 1")
def src_union(spark, sf):
    parts = {"customer": fx.table(spark, sf, "customer").orderBy("c_custkey").select(F.col("c_name").alias("name")), "supplier": fx.table(spark, sf, "supplier").orderBy("s_suppkey").select(F.col("s_name").alias("name"))}
    return files.tagged_union(parts, "category", rows_per_source=100).groupBy("category").agg(F.count("*").alias("n"))


@query("src_pushed_filter", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey IN (1, 5, 9) AND l_linestatus = 'F'")
def src_pushed(spark, sf):
    return files.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"], F.col("l_orderkey").isin(1, 5, 9) & (F.col("l_linestatus") == "F"))


@query("snk_json_lines_round_trip", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer")
def snk_json(spark, sf):
    path = f"{shared_dir(spark)}/shelfmark/sink-customer-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    files.write(fx.table(spark, sf, "customer").select("c_custkey", "c_name"), path, "json", compression="gzip")
    return files.json_lines(spark, path, "c_custkey bigint, c_name string")
