"""Queries: windows, splits, profiles, co-occurrence, retrieval, ranking and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import days_between, title_key
from shelfmark.functions.vectors import cosine, norm, unit, without_axes
from shelfmark.operators import cooc, habits, knn, metrics, rank, retrieve, shelf, temporal, users, windows
from shelfmark.operators import curation as C
from shelfmark.plans import fixtures as fx
from shelfmark.plans.q_curation import canonical as best
from shelfmark.store import written

Q: dict = {}
SQL: dict[str, str] = {}
FLAGS = [f"genre_{g}" for g in fx.GENRES]
CUT = "2000-01-01"
FLOOR = "1993-01-01"
#: Clusters that a reader's candidates are of.
CLUSTERS = rank.Config().clusters
BEST = fx.best_sql()
POS = BEST + ", pos AS (SELECT DISTINCT user_id, book_id FROM best WHERE is_read AND rating_clean >= 4)"
TRAIN = BEST + f", train AS (SELECT * FROM best WHERE date_added <= TIMESTAMP '{CUT}'), future AS (SELECT * FROM best WHERE date_added > TIMESTAMP '{CUT}')"
ALL = BEST + f", {fx.ITEMS_SQL}, {fx.VECTORS_SQL}"


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def at_cut():
    return F.lit(CUT).cast("timestamp")


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


def train(spark, sf):
    return best(spark, sf).where(F.col("date_added") <= at_cut())


def relevant(spark, sf):
    return users.positives(best(spark, sf).where(F.col("date_added") > at_cut()))


def catalog(spark, sf):
    return fx.items(spark, sf).join(fx.vectors(spark, sf), "book_id")


def taste_catalog(spark, sf):
    return fx.items(spark, sf).join(fx.taste(spark, sf), "book_id")


# windows, sorting


@query("win_positions", f"WITH {BEST} SELECT interaction_key, row_number() OVER (PARTITION BY user_id ORDER BY date_added, interaction_key) - 1 AS position, count(*) OVER (PARTITION BY user_id) AS total FROM best")
def win_positions(spark, sf):
    return windows.positions(best(spark, sf), "user_id", "date_added", [F.col("interaction_key")]).select("interaction_key", F.col("position").cast("long").alias("position"), "total")


@query("win_average_percentiles", f"WITH {BEST}, r AS (SELECT interaction_key, user_id, rating, count(*) OVER (PARTITION BY user_id) AS n, rank() OVER (PARTITION BY user_id ORDER BY rating) AS rk, count(*) OVER (PARTITION BY user_id, rating) AS same, min(rating) OVER (PARTITION BY user_id) = max(rating) OVER (PARTITION BY user_id) AS flat FROM best) SELECT interaction_key, round(CASE WHEN flat THEN 0.5 ELSE (rk + (same - 1) / 2.0 - 1) / (n - 1) END, 6) AS p FROM r")
def win_percentiles(spark, sf):
    return best(spark, sf).select("interaction_key", F.round(windows.average_percentile("rating", over=["user_id"]), 6).alias("p"))


@query("win_top_per_group", f"WITH {fx.ITEMS_SQL} SELECT author, book_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY num_pages DESC, book_id) AS rank FROM items) WHERE rank <= 3")
def win_top(spark, sf):
    return windows.top(fx.items(spark, sf), 3, [F.desc("num_pages"), F.col("book_id")], over=["author"]).select("author", "book_id", "rank")


@query("srt_global_top", f"WITH {fx.ITEMS_SQL} SELECT book_id, title, CAST(row_number() OVER (ORDER BY num_pages DESC, book_id) AS INTEGER) AS rank FROM items QUALIFY rank <= 10")
def srt_top(spark, sf):
    return windows.global_top(fx.items(spark, sf), 10, [F.desc("num_pages"), F.col("book_id")]).select("book_id", "title", "rank")


@query("srt_cohort_sample")
def srt_cohort(spark, sf):
    ids = best(spark, sf).select("user_id").distinct()
    return ids.orderBy(F.xxhash64(F.lit(42), "user_id"), "user_id").limit(50).orderBy("user_id")


@query("srt_title_fill", f"WITH {BEST}, {fx.ITEMS_SQL}, t AS (SELECT user_id, book_id, rating, lower(author) AS k, row_number() OVER (PARTITION BY user_id, lower(author) ORDER BY rating DESC, book_id, interaction_key) > 1 AS rep, interaction_key FROM best JOIN items USING (book_id)) SELECT user_id, book_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rep, rating DESC, book_id, interaction_key) AS rank FROM t) WHERE rank <= 5")
def srt_fill(spark, sf):
    b = best(spark, sf).join(fx.items(spark, sf).select("book_id", F.lower("author").alias("k")), "book_id")
    return windows.title_fill(b, "user_id", [F.desc("rating"), F.col("book_id"), F.col("interaction_key")], "k", 5).select("user_id", "book_id", "rank")


_POP = "pop AS (SELECT book_id, count(rating_clean) AS n, avg(rating_clean) AS mean_rating FROM best GROUP BY 1)"


@query("win_popularity_segments", f"WITH {BEST}, {_POP}, c AS (SELECT quantile_cont(n, 0.25) AS lo, quantile_cont(n, 0.9) AS hi FROM pop) SELECT book_id, n, CASE WHEN n >= hi THEN 'head' WHEN n <= lo THEN 'tail' ELSE 'mid' END AS segment FROM pop, c")
def win_segments(spark, sf):
    return windows.popularity_segments(popularity(best(spark, sf)), "n").select("book_id", "n", "segment")


def popularity(df):
    return df.groupBy("book_id").agg(F.count("rating_clean").alias("n"), F.avg("rating_clean").alias("mean_rating"))


@query("win_tertiles", f"WITH {BEST}, u AS (SELECT user_id, count(*) AS n FROM best GROUP BY 1), c AS (SELECT quantile_cont(n, 1 / 3.0::DOUBLE) AS a, quantile_cont(n, 2 / 3.0::DOUBLE) AS b FROM u) SELECT user_id, n, CASE WHEN n <= a THEN 'low' WHEN n > b THEN 'high' ELSE 'mid' END AS activity FROM u, c")
def win_tertiles(spark, sf):
    return windows.tertiles(best(spark, sf).groupBy("user_id").agg(F.count("*").alias("n")), "n")


# time


@query("tmp_user_split", f"WITH {BEST}, w AS (SELECT interaction_key, row_number() OVER (PARTITION BY user_id ORDER BY date_added, interaction_key) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM best) SELECT interaction_key, CASE WHEN n > 1 AND rn <= greatest(1, least(n - 1, floor(n * 0.8))) THEN 'train' ELSE 'future' END AS part FROM w")
def tmp_user(spark, sf):
    return temporal.per_user_split(best(spark, sf), 0.8, [F.col("interaction_key")]).select("interaction_key", "part")


@query("tmp_global_split", f"WITH {BEST} SELECT interaction_key, CASE WHEN date_added <= TIMESTAMP '{CUT}' THEN 'train' ELSE 'future' END AS part FROM best WHERE date_added >= TIMESTAMP '{FLOOR}'")
def tmp_split(spark, sf):
    return temporal.split_at(best(spark, sf), at_cut(), floor=FLOOR).select("interaction_key", "part")


@query("tmp_cutoff", f"WITH {BEST} SELECT CAST(floor(quantile_cont(epoch_us(date_added), 0.8)) AS BIGINT) // 1000000 AS cutoff_s FROM best WHERE date_added >= TIMESTAMP '{FLOOR}'")
def tmp_cutoff(spark, sf):
    return temporal.global_cutoff(best(spark, sf), 0.8, floor=FLOOR).select(F.floor(F.unix_micros("cutoff") / 1_000_000).alias("cutoff_s"))


_SNAP = f"snap AS (SELECT book_id, count(*) FILTER (ok AND rating_clean IS NOT NULL) AS n, avg(rating_clean) FILTER (ok) AS mean_rating, count(*) FILTER (ok AND has_review_text) AS n_reviews, min(date_added) FILTER (valid) AS first_seen, count(*) FILTER (NOT valid) AS n_invalid FROM (SELECT *, date_added >= TIMESTAMP '{FLOOR}' AS valid, date_added >= TIMESTAMP '{FLOOR}' AND date_added <= TIMESTAMP '{CUT}' AS ok FROM best) GROUP BY 1)"


@query("tmp_popularity_as_of", f"WITH {BEST}, {_SNAP} SELECT book_id, n, round(mean_rating, 6) AS mean_rating, n_reviews, first_seen, n_invalid FROM snap")
def tmp_popularity(spark, sf):
    p = temporal.popularity_as_of(best(spark, sf), at_cut(), FLOOR)
    return p.select("book_id", "n", r6("mean_rating"), "n_reviews", "first_seen", "n_invalid")


@query("tmp_available", f"WITH {BEST}, {fx.ITEMS_SQL}, {_SNAP} SELECT book_id, CASE WHEN book_id = '7' THEN coalesce(first_seen <= TIMESTAMP '{CUT}', false) ELSE publication_year <= 2000 END AS available FROM items LEFT JOIN snap USING (book_id)")
def tmp_available(spark, sf):
    i = fx.items(spark, sf).withColumn("publication_year", F.when(F.col("book_id") != "7", F.col("publication_year")))
    return temporal.available(i, temporal.popularity_as_of(best(spark, sf), at_cut(), FLOOR), at_cut()).select("book_id", "available")


@query("tmp_historical_master", f"WITH {BEST}, {fx.ITEMS_SQL}, {_SNAP} SELECT book_id, title, coalesce(n, 0) AS ratings_count, round(CASE WHEN n > 0 THEN mean_rating END, 6) AS average_rating, coalesce(n_reviews, 0) AS reviews FROM items LEFT JOIN snap USING (book_id)")
def tmp_master(spark, sf):
    p = temporal.popularity_as_of(best(spark, sf), at_cut(), FLOOR)
    return fx.items(spark, sf).join(p, "book_id", "left").select("book_id", "title", F.coalesce("n", F.lit(0)).alias("ratings_count"), F.round(F.when(F.col("n") > 0, F.col("mean_rating")), 6).alias("average_rating"), F.coalesce("n_reviews", F.lit(0)).alias("reviews"))


@query("tmp_user_stats_as_of", f"WITH {TRAIN} SELECT user_id, count(rating_clean) AS n, round(avg(rating_clean) - (SELECT avg(rating_clean) FROM train), 6) AS bias, count(*) FILTER (NOT is_read AND rating_clean IS NULL) AS want_to_read FROM train GROUP BY 1")
def tmp_stats(spark, sf):
    t = train(spark, sf)
    f = C.user_features(t).select("user_id", "user_rating_bias", "user_rating_count")
    want = t.groupBy("user_id").agg(F.count_if(~F.col("is_read") & F.col("rating_clean").isNull()).alias("want_to_read"))
    return f.join(want, "user_id").select("user_id", F.col("user_rating_count").alias("n"), F.when(F.col("user_rating_count") > 0, F.round("user_rating_bias", 6)).alias("bias"), "want_to_read")


# vectors and profiles


@query("arr_vector_math", f"WITH {fx.VECTORS_SQL} SELECT a.book_id, round(list_cosine_similarity(a.vec, b.vec), 6) AS cos, round(sqrt(list_inner_product(a.vec, a.vec)), 6) AS len, round(sqrt(list_inner_product(a.vec[7:], a.vec[7:])), 6) AS tail_len, 1.0::DOUBLE AS unit_len FROM vectors a, vectors b WHERE b.book_id = '0'")
def arr_vectors(spark, sf):
    v = fx.vectors(spark, sf)
    one = v.where("book_id = '0'").select(F.col("vec").alias("o"))
    return v.join(F.broadcast(one)).select("book_id", r6(cosine(F.col("vec"), F.col("o")), "cos"), r6(norm(F.col("vec")), "len"), r6(norm(without_axes(F.col("vec"), 6)), "tail_len"), r6(norm(unit(F.col("vec"))), "unit_len"))


@query("usr_taste_vectors", f"WITH {POS}, {fx.VECTORS_SQL}, l AS (SELECT user_id, vec, unnest(range(1, 65)) AS axis FROM pos JOIN vectors USING (book_id)) SELECT user_id, CAST(axis - 1 AS INTEGER) AS axis, round(avg(vec[axis]), 5) AS x FROM l GROUP BY 1, 2")
def usr_taste(spark, sf):
    p = best(spark, sf).dropDuplicates(["user_id", "book_id", "is_read", "rating_clean"])
    pos = users.positives(p).select("user_id", "book_id", "is_read", "rating_clean").dropDuplicates(["user_id", "book_id"])
    t = users.taste_vectors(pos, fx.vectors(spark, sf))
    return t.select("user_id", F.posexplode("vec").alias("axis", "x")).select("user_id", "axis", F.round("x", 5).alias("x"))


@query("usr_meta", f"WITH {BEST}, {fx.ITEMS_SQL}, g AS (SELECT b.*, {', '.join(FLAGS)}, (is_read AND coalesce(rating_clean >= 4, false)) AS p FROM best b LEFT JOIN items USING (book_id)) SELECT user_id, count(*) AS n_interactions, count(*) FILTER (p) AS n_positives, count(*) FILTER (has_review_text) AS n_reviews, count(*) FILTER (engagement_mode = 'want_to_read') AS n_want_to_read, max(date_added) AS last_date, {' + '.join(f'coalesce(max({f}) FILTER (p), 0)' for f in FLAGS)} AS genre_breadth, round(coalesce(avg(rating_clean) - (SELECT avg(rating_clean) FROM best), 0), 6) AS bias, count(*) FILTER (p) < 3 AS cold_start FROM g GROUP BY 1")
def usr_meta(spark, sf):
    b = best(spark, sf)
    return users.user_meta(b, fx.items(spark, sf), FLAGS, C.user_features(b)).withColumn("bias", F.round("bias", 6))


@query("usr_diagnostics", f"WITH {POS}, {fx.VECTORS_SQL} SELECT (SELECT count(*) FROM best WHERE is_read AND rating_clean >= 4 AND book_id NOT IN (SELECT book_id FROM vectors)) AS n")
def usr_diagnostics(spark, sf):
    return users.dropped_positives(best(spark, sf), fx.vectors(spark, sf))


@query("usr_mode_count", f"WITH {BEST} SELECT user_id, CAST(CASE WHEN count(*) < 6 THEN 1 ELSE least(4, count(*) // 3) END AS INTEGER) AS m FROM best WHERE is_read AND rating_clean >= 4 GROUP BY 1")
def usr_modes_n(spark, sf):
    return users.positives(best(spark, sf)).groupBy("user_id").agg(users.mode_count(F.count("*")).alias("m"))


def with_duration(df):
    return df.withColumn("reading_duration_days", days_between("date_updated", "date_added"))


@query("usr_taste_modes")
def usr_modes(spark, sf):
    m = users.taste_modes(with_duration(best(spark, sf)), fx.vectors(spark, sf))
    return m.select("user_id", "mode", "n_books", r6("weight"), r6("centroid_weight"))


def single_modes(spark, sf, df=None):
    """One mode a reader, from what was known at the cut."""
    t = users.taste_vectors(train(spark, sf) if df is None else df, fx.taste(spark, sf))
    return t.select("user_id", F.lit(0).alias("mode"), F.lit(1.0).alias("weight"), "vec")


_TASTE = TRAIN + f""", {fx.ITEMS_SQL}, {fx.TASTE_SQL}, tp AS (SELECT user_id, vec FROM train JOIN vectors USING (book_id) WHERE is_read AND rating_clean >= 4),
taste AS (SELECT user_id, list(x ORDER BY axis) AS vec FROM (SELECT user_id, axis, avg(vec[axis]) AS x FROM tp, (SELECT unnest(range(1, 59)) AS axis) GROUP BY 1, 2) GROUP BY 1),
centre AS (SELECT cluster, list(x ORDER BY axis) AS vec FROM (SELECT cluster, axis, avg(vec[axis]) AS x FROM vectors, (SELECT unnest(range(1, 59)) AS axis) GROUP BY 1, 2) GROUP BY 1),
near AS (SELECT user_id, cluster, list_cosine_similarity(t.vec, c.vec) AS score FROM taste t, centre c),
picked AS (SELECT user_id, cluster, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, cluster) AS rank FROM near) WHERE rank <= 5),
consumed AS (SELECT DISTINCT user_id, book_id FROM train WHERE is_read),
cand AS (SELECT user_id, book_id FROM picked JOIN vectors USING (cluster) ANTI JOIN consumed USING (user_id, book_id)),
rel AS (SELECT user_id, book_id, list_cosine_similarity(t.vec, v.vec) AS relevance FROM cand JOIN taste t USING (user_id) JOIN vectors v USING (book_id))"""


@query("usr_sparse_shrinkage", f"WITH {_TASTE}, m AS (SELECT user_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, cluster) AS r FROM near) WHERE r = 1) SELECT user_id, cluster, CAST(axis - 1 AS INTEGER) AS axis, round((tv[axis] + cv[axis]) / 2, 5) AS x FROM (SELECT user_id, cluster, t.vec AS tv, c.vec AS cv, unnest(range(1, 59)) AS axis FROM m JOIN taste t USING (user_id) JOIN centre c USING (cluster))")
def usr_shrunk(spark, sf):
    s = users.shrunk(single_modes(spark, sf), retrieve.centroids(fx.taste(spark, sf)))
    return s.select("user_id", "cluster", F.posexplode("vec").alias("axis", "x")).withColumn("x", F.round("x", 5))


@query("usr_seed_profile", f"WITH {fx.VECTORS_SQL} SELECT CAST(axis - 1 AS INTEGER) AS axis, round(avg(vec[axis]), 6) AS x FROM (SELECT vec, unnest(range(1, 65)) AS axis FROM vectors WHERE book_id IN ('3', '14', '159')) GROUP BY 1")
def usr_seed(spark, sf):
    from shelfmark.functions.vectors import mean_by

    m = mean_by(fx.vectors(spark, sf).where("book_id in ('3', '14', '159')").withColumn("g", F.lit(1)), ["g"], "vec")
    return m.select(F.posexplode("vec").alias("axis", "x")).select("axis", r6("x"))


# co-occurrence


_PAIRS = """, marg AS (SELECT book_id, count(*) AS c FROM pos GROUP BY 1), capped AS (SELECT user_id, book_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY book_id) AS rn FROM pos) WHERE rn <= 200),
co AS (SELECT a.book_id AS a, b.book_id AS b, count(*) AS co_count FROM capped a JOIN capped b ON a.user_id = b.user_id AND a.book_id < b.book_id GROUP BY 1, 2 HAVING count(*) >= 3),
pmi AS (SELECT a AS book_id_a, b AS book_id_b, co_count, greatest(0, ln(co_count * (SELECT count(DISTINCT user_id) FROM pos) / (x.c * y.c)::DOUBLE)) AS pmi FROM co JOIN marg x ON x.book_id = a JOIN marg y ON y.book_id = b)"""


@query("coo_pmi_pairs", f"WITH {POS}{_PAIRS} SELECT book_id_a, book_id_b, co_count, round(pmi, 6) AS pmi FROM pmi")
def coo_pairs(spark, sf):
    return cooc.pairs(users.positives(best(spark, sf))).select("book_id_a", "book_id_b", "co_count", r6("pmi"))


@query("coo_pairs_before", f"WITH {BEST}, pos AS (SELECT DISTINCT user_id, book_id FROM best WHERE is_read AND rating_clean >= 4 AND date_added <= TIMESTAMP '{CUT}'){_PAIRS} SELECT book_id_a, book_id_b, co_count, round(pmi, 6) AS pmi FROM pmi")
def coo_before(spark, sf):
    return cooc.pairs_before(users.positives(best(spark, sf)), at_cut()).select("book_id_a", "book_id_b", "co_count", r6("pmi"))


_COLLAB = _TASTE + """, pos AS (SELECT DISTINCT user_id, book_id FROM train WHERE is_read AND rating_clean >= 4)""" + _PAIRS + """, both_ways AS (SELECT book_id_a AS book_id, book_id_b AS other, pmi FROM pmi UNION ALL SELECT book_id_b, book_id_a, pmi FROM pmi),
collab AS (SELECT user_id, book_id, coalesce(max(pmi), 0) AS score FROM cand LEFT JOIN (SELECT p.user_id, w.book_id, w.pmi FROM pos p JOIN both_ways w ON w.other = p.book_id) USING (user_id, book_id) GROUP BY 1, 2)"""


def cands(spark, sf):
    t = train(spark, sf)
    modes = single_modes(spark, sf, t)
    cl = retrieve.pooled_clusters(modes, retrieve.centroids(fx.taste(spark, sf)))
    return retrieve.candidates(cl, fx.taste(spark, sf), t.where("is_read")), modes


def picked(spark, sf, df=None):
    """(user_id, cluster, rank) as `cands` picks them, written once; None where the items do not fit a shelf."""
    s = shelf.shelved(fx.taste(spark, sf))
    return s and written(shelf.picked_clusters(shelf.histories(train(spark, sf) if df is None else df), s, CLUSTERS), "picked")


def collaborative(spark, sf):
    c, modes = cands(spark, sf)
    pos = users.positives(train(spark, sf))
    return c, modes, cooc.max_pmi(c, pos, cooc.pairs(pos))


def collaborative_readers(spark, sf, readers=None):
    """(shelf, readers with their co-occurrence scores); None where the items do not fit a shelf. `readers`: as `shelf.grouped` has them."""
    s = shelf.shelved(fx.taste(spark, sf))
    if s is None:
        return None
    readers = shelf.grouped(train(spark, sf)) if readers is None else readers
    liked = shelf.liked_of(readers)
    edges = written(cooc.pairs_of(liked), "pairs")
    return s, shelf.with_values(shelf.reads_of(readers), cooc.scores_of(liked, edges), "score")


def blended(spark, sf):
    """(user_id, book_id, c, o): the percentiles of content and co-occurrence; None where the items do not fit a shelf."""
    found = collaborative_readers(spark, sf)
    return found and shelf.answered(found[1], found[0], shelf.percentiles(CLUSTERS, "score"), "c double, o double")


@query("coo_max_pmi", f"WITH {_COLLAB} SELECT user_id, book_id, round(score, 6) AS score FROM collab")
def coo_max(spark, sf):
    found = collaborative_readers(spark, sf)
    if found is not None:
        return shelf.answered(found[1], found[0], shelf.scored(CLUSTERS, "score"), "score double", relevance=False).select("user_id", "book_id", r6("score"))
    return collaborative(spark, sf)[2].select("user_id", "book_id", r6("score"))


@query("coo_candidates", f"WITH {_COLLAB} SELECT user_id, book_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, book_id) AS rank FROM collab) WHERE m > 0 AND rank <= 25")
def coo_candidates(spark, sf):
    found = collaborative_readers(spark, sf)
    if found is not None:
        return shelf.answered(found[1], found[0], shelf.best_scored(CLUSTERS, "score", 25), "rank int", relevance=False)
    return cooc.collaborative_candidates(collaborative(spark, sf)[2], 25)


def _pct(c: str) -> str:
    return f"(CASE WHEN min({c}) OVER (PARTITION BY user_id) = max({c}) OVER (PARTITION BY user_id) THEN 0.5 ELSE (rank() OVER (PARTITION BY user_id ORDER BY {c}) + (count(*) OVER (PARTITION BY user_id, {c}) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY user_id) - 1) END)"


@query("coo_percentile_blend", f"WITH {_COLLAB}, j AS (SELECT user_id, book_id, round(relevance, 7) AS content, round(score, 7) AS collaborative FROM rel JOIN collab USING (user_id, book_id)) SELECT user_id, book_id, round(0.7 * {_pct('content')} + 0.3 * {_pct('collaborative')} + 1e-9, 5) AS blend FROM j")
def coo_blend(spark, sf):
    p = blended(spark, sf)
    if p is not None:
        return p.select("user_id", "book_id", F.round(F.col("c") * 0.7 + F.col("o") * (1 - 0.7) + 1e-9, 5).alias("blend"))
    c, modes, score = collaborative(spark, sf)
    rel = retrieve.relevance(c, modes, fx.taste(spark, sf))
    pool = rel.join(score, ["user_id", "book_id"]).select("user_id", "book_id", F.round("relevance", 7).alias("content"), F.round("score", 7).alias("collaborative"))
    return rank.blend(pool, 0.7).select("user_id", "book_id", F.round(F.col("blend") + 1e-9, 5).alias("blend"))


# neighbours


_KNN = _TASTE + """, nn AS (SELECT * FROM (SELECT q.user_id, t.user_id AS neighbour, list_cosine_similarity(q.vec, t.vec) AS s, row_number() OVER (PARTITION BY q.user_id ORDER BY round(list_cosine_similarity(q.vec, t.vec), 12) DESC, t.user_id) AS rank FROM taste q JOIN taste t ON t.user_id <> q.user_id WHERE CAST(q.user_id AS BIGINT) % 20 = 0) WHERE rank <= 10)"""


def near(spark, sf):
    t = single_modes(spark, sf).select("user_id", "vec")
    return knn.neighbours(t.where(F.col("user_id").cast("long") % 20 == 0), t, 10)


@query("knn_neighbours", f"WITH {_KNN} SELECT user_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS similarity FROM nn")
def knn_neighbours(spark, sf):
    return near(spark, sf).select("user_id", "rank", r6("similarity"))


@query("knn_book_scores", f"WITH {_KNN}, reads AS (SELECT DISTINCT user_id, book_id FROM train WHERE is_read) SELECT n.user_id, r.book_id, round(sum(s), 5) AS score FROM nn n JOIN reads r ON r.user_id = n.neighbour WHERE s > 0 AND NOT EXISTS (SELECT 1 FROM reads o WHERE o.user_id = n.user_id AND o.book_id = r.book_id) GROUP BY 1, 2")
def knn_scores(spark, sf):
    return knn.neighbour_scores(near(spark, sf), best(spark, sf), at_cut()).select("user_id", "book_id", F.round("score", 5).alias("score"))


# retrieval and ranking


@query("ret_pooled_clusters", f"WITH {_TASTE} SELECT user_id, cluster, rank FROM picked")
def ret_pooled(spark, sf):
    return retrieve.pooled_clusters(single_modes(spark, sf), retrieve.centroids(fx.taste(spark, sf))).select("user_id", "cluster", "rank")


def two_modes(spark, sf):
    """Two modes a reader: the taste of all positives, and of those that it wrote about."""
    t = train(spark, sf)
    low = users.taste_vectors(t.where("has_review_text"), fx.taste(spark, sf))
    both = single_modes(spark, sf, t).select("user_id", "mode", F.lit(0.6).alias("weight"), "vec")
    return both.unionByName(low.select("user_id", F.lit(1).alias("mode"), F.lit(0.4).alias("weight"), "vec"))


@query("ret_interleaved_clusters", f"""WITH {_TASTE}, lp AS (SELECT user_id, vec FROM train JOIN vectors USING (book_id) WHERE is_read AND rating_clean >= 4 AND has_review_text),
low AS (SELECT user_id, list(x ORDER BY axis) AS vec FROM (SELECT user_id, axis, avg(vec[axis]) AS x FROM lp, (SELECT unnest(range(1, 59)) AS axis) GROUP BY 1, 2) GROUP BY 1),
lanes AS (SELECT user_id, 0 AS lane, cluster, 0.6 * list_cosine_similarity(t.vec, c.vec) AS s FROM taste t, centre c UNION ALL SELECT user_id, 1, cluster, 0.4 * list_cosine_similarity(t.vec, c.vec) FROM low t, centre c),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lane ORDER BY round(s, 9) DESC, cluster) AS rk FROM lanes) WHERE rk <= 4),
sp AS (SELECT user_id, cluster, min(spot) AS spot FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rk, lane) AS spot FROM r) GROUP BY 1, 2)
SELECT user_id, cluster, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY spot) AS rank FROM sp) WHERE rank <= 4""")
def ret_interleaved(spark, sf):
    return retrieve.interleaved_clusters(two_modes(spark, sf), retrieve.centroids(fx.taste(spark, sf)), 4).select("user_id", "cluster", "rank")


@query("ret_candidates", f"WITH {_TASTE} SELECT user_id, count(*) AS n FROM cand GROUP BY 1")
def ret_candidates(spark, sf):
    picks = picked(spark, sf)
    if picks is not None:
        return retrieve.candidate_counts(picks, fx.taste(spark, sf), train(spark, sf).where("is_read"))
    return cands(spark, sf)[0].groupBy("user_id").agg(F.count("*").alias("n"))


@query("ret_consumed", f"WITH {TRAIN} SELECT DISTINCT user_id, book_id FROM train WHERE is_read")
def ret_consumed(spark, sf):
    return train(spark, sf).where("is_read").select("user_id", "book_id").distinct()


@query("rnk_relevance", f"WITH {_TASTE} SELECT user_id, book_id, round(relevance, 6) AS relevance FROM rel")
def rnk_relevance(spark, sf):
    s = shelf.shelved(fx.taste(spark, sf))
    if s is not None:
        return shelf.answered(shelf.histories(train(spark, sf)), s, shelf.relevant(CLUSTERS), "relevance double").select("user_id", "book_id", r6("relevance"))
    c, modes = cands(spark, sf)
    return retrieve.relevance(c, modes, fx.taste(spark, sf)).select("user_id", "book_id", r6("relevance"))


@query("rnk_access", f"WITH {fx.ITEMS_SQL}, x AS (SELECT author, book_id, num_pages >= 50 AS ok, CASE WHEN num_pages >= 50 THEN ln(1 + num_pages) END AS l FROM items) SELECT book_id, round(CASE WHEN NOT ok THEN 0 WHEN min(l) OVER (PARTITION BY author) = max(l) OVER (PARTITION BY author) THEN 1 ELSE (max(l) OVER (PARTITION BY author) - l) / (max(l) OVER (PARTITION BY author) - min(l) OVER (PARTITION BY author)) END, 6) AS access FROM x")
def rnk_access(spark, sf):
    return fx.items(spark, sf).select("book_id", r6(rank.access_score(F.col("num_pages"), 50, over=["author"]), "access"))


def pool(spark, sf, clusters=None):
    """Each reader's candidates with all that ranking needs; of other clusters where given."""
    c, modes = cands(spark, sf)
    if clusters is not None:
        c = retrieve.candidates(clusters, fx.taste(spark, sf), train(spark, sf).where("is_read"))
    rel = retrieve.relevance(c, modes, fx.taste(spark, sf))
    seg = windows.popularity_segments(popularity(train(spark, sf)), "n").select("book_id", "segment")
    i = taste_catalog(spark, sf).join(seg, "book_id", "left").select("book_id", "vec", "cluster", "macro", F.coalesce("segment", F.lit("unknown")).alias("segment"), F.array(*[F.col(f) == 1 for f in FLAGS]).alias("genres"))
    return rel.join(i, "book_id")


def shop(spark, sf):
    """A shelf of all items, those listed with genres, segment and macro; None where they do not fit one."""
    seg = windows.popularity_segments(popularity(train(spark, sf)), "n").select("book_id", "segment")
    i = fx.items(spark, sf).select("book_id", F.array(*[F.col(f) == 1 for f in FLAGS]).alias("genres"), F.lit(True).alias("listed"))
    every = fx.taste(spark, sf).join(i, "book_id", "left").join(seg, "book_id", "left")
    genres = F.coalesce("genres", F.array(*[F.lit(False) for _ in FLAGS])).alias("genres")
    told = every.select("book_id", "vec", "cluster", "macro", genres, F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("segment", F.lit("unknown")).alias("segment"))
    return shelf.shelved(told, "macro", "genres", "listed", "segment")


@query("rnk_mmr")
def rnk_mmr(spark, sf):
    s = shop(spark, sf)
    if s is not None:
        return shelf.answered(shelf.histories(train(spark, sf)), s, shelf.mmr(CLUSTERS, 10), "rank int")
    return rank.mmr(pool(spark, sf), 10)


@query("rnk_slots")
def rnk_slots(spark, sf):
    conf, s = rank.Config(), shop(spark, sf)
    if s is not None:
        return shelf.answered(shelf.histories(train(spark, sf)), s, shelf.slots(conf), "slot string, rank int")
    p = pool(spark, sf)
    picks = rank.mmr(p, conf.k)
    first = picks.where(F.col("rank") <= conf.k - conf.explore)
    return rank.slots(picks, rank.exploration(p, first, conf), conf.k, conf.explore)


@query("rnk_cold_start", f"WITH {ALL} SELECT macro, book_id FROM (SELECT macro, book_id, row_number() OVER (PARTITION BY macro ORDER BY CASE WHEN num_pages >= 50 THEN 0 ELSE 1 END, CASE WHEN num_pages >= 50 THEN num_pages END, book_id) AS r FROM items JOIN vectors USING (book_id)) WHERE r = 1")
def rnk_cold(spark, sf):
    return rank.cold_start(catalog(spark, sf))


_BAS = TRAIN + f""", {fx.ITEMS_SQL}, pop AS (SELECT i.book_id, ln(1 + coalesce(n, 0)) * coalesce(mean_rating, 0) AS score, {' + '.join(f'genre_{g} * {1 << i}' for i, g in enumerate(fx.GENRES))} AS mask FROM items i LEFT JOIN (SELECT book_id, count(rating_clean) AS n, avg(rating_clean) AS mean_rating FROM train GROUP BY 1) USING (book_id)),
us AS (SELECT user_id, bit_or(CASE WHEN p THEN mask ELSE 0 END) AS umask FROM (SELECT user_id, mask, is_read AND coalesce(rating_clean >= 4, false) AS p FROM train JOIN pop USING (book_id)) GROUP BY 1)"""


def popular_items(spark, sf, t=None):
    t = train(spark, sf) if t is None else t
    mask = sum((F.col(f) * (1 << i) for i, f in enumerate(FLAGS)), F.lit(0))
    return fx.items(spark, sf).withColumn("mask", mask.cast("int")).join(popularity(t), "book_id", "left").select("book_id", "mask", F.coalesce("n", F.lit(0)).alias("n"), "mean_rating", "title")


def user_masks(spark, sf, t=None, items=None):
    t = train(spark, sf) if t is None else t
    items = popular_items(spark, sf, t) if items is None else items
    pos = F.coalesce("is_read", F.lit(False)) & F.coalesce(F.col("rating_clean") >= 4, F.lit(False))
    j = t.join(items.select("book_id", "mask"), "book_id")
    return j.groupBy("user_id").agg(F.bit_or(F.when(pos, F.col("mask")).otherwise(F.lit(0))).alias("mask"))


def read(spark, sf):
    return train(spark, sf).where("is_read")


@query("bas_popularity", f"WITH {_BAS} SELECT user_id, book_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT u.user_id, p.book_id, p.score, row_number() OVER (PARTITION BY u.user_id ORDER BY round(p.score, 9) DESC, p.book_id) AS rank FROM us u, pop p WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.is_read AND t.user_id = u.user_id AND t.book_id = p.book_id)) WHERE rank <= 10")
def bas_popularity(spark, sf):
    return rank.popularity_top(user_masks(spark, sf), popular_items(spark, sf), read(spark, sf), 10).select("user_id", "book_id", r6("score"), "rank")


@query("bas_genre_popularity", f"WITH {_BAS} SELECT user_id, book_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT u.user_id, p.book_id, p.score, row_number() OVER (PARTITION BY u.user_id ORDER BY round(p.score, 9) DESC, p.book_id) AS rank FROM us u, pop p WHERE (umask = 0 OR (umask & mask) <> 0) AND NOT EXISTS (SELECT 1 FROM train t WHERE t.is_read AND t.user_id = u.user_id AND t.book_id = p.book_id)) WHERE rank <= 10")
def bas_genre(spark, sf):
    return rank.genre_popularity_top(user_masks(spark, sf), popular_items(spark, sf), read(spark, sf), 10).select("user_id", "book_id", r6("score"), "rank")


@query("bas_random")
def bas_random(spark, sf):
    return rank.random_top(user_masks(spark, sf), popular_items(spark, sf), read(spark, sf), 10)


_LIMIT = rank.SOURCE_LIMIT
_HYBRID = _KNN + _PAIRS.replace("FROM pos", "FROM tpos") + f""", ask AS (SELECT DISTINCT user_id FROM taste WHERE CAST(user_id AS BIGINT) % 20 = 0),
pop AS (SELECT book_id, ln(1 + coalesce(n, 0)) * coalesce(mean_rating, 0) AS p, {' + '.join(f'genre_{g} * {1 << i}' for i, g in enumerate(fx.GENRES))} AS mask, title FROM items SEMI JOIN vectors USING (book_id) LEFT JOIN (SELECT book_id, count(rating_clean) AS n, avg(rating_clean) AS mean_rating FROM train GROUP BY 1) USING (book_id)),
um AS (SELECT user_id, bit_or(CASE WHEN is_read AND coalesce(rating_clean >= 4, false) THEN mask ELSE 0 END) AS umask FROM train JOIN pop USING (book_id) GROUP BY 1),
unread AS (SELECT user_id, book_id, p, mask, umask FROM ask JOIN um USING (user_id), pop WHERE NOT EXISTS (SELECT 1 FROM consumed c WHERE c.user_id = ask.user_id AND c.book_id = pop.book_id)),
both_ways AS (SELECT book_id_a AS book_id, book_id_b AS other, pmi FROM pmi UNION ALL SELECT book_id_b, book_id_a, pmi FROM pmi),
score AS (SELECT user_id, w.book_id, max(w.pmi) AS score FROM tpos p JOIN both_ways w ON w.other = p.book_id SEMI JOIN ask USING (user_id) GROUP BY 1, 2),
kn AS (SELECT n.user_id, r.book_id, sum(s) AS s FROM nn n JOIN consumed r ON r.user_id = n.neighbour WHERE s > 0 GROUP BY 1, 2),
pool AS (SELECT user_id, book_id FROM cand SEMI JOIN ask USING (user_id) SEMI JOIN pop USING (book_id)
 UNION SELECT user_id, book_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(p, 9) DESC, book_id) AS r FROM unread) WHERE r <= {_LIMIT}
 UNION SELECT user_id, book_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(p, 9) DESC, book_id) AS r FROM unread WHERE umask = 0 OR (mask & umask) <> 0) WHERE r <= {_LIMIT}
 UNION SELECT user_id, book_id FROM (SELECT user_id, book_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, book_id) AS r FROM score SEMI JOIN unread USING (user_id, book_id) WHERE score > 0) WHERE r <= {_LIMIT}),
sig AS (SELECT user_id, book_id, title, round(list_cosine_similarity(t.vec, v.vec), 7) AS content, round(coalesce(score, 0), 7) AS cooccurrence, round(p, 7) AS popularity, CASE WHEN (mask & umask) <> 0 THEN round(p, 7) ELSE 0 END AS genre, round(coalesce(kn.s, 0), 7) AS neighbours
 FROM pool JOIN pop USING (book_id) JOIN um USING (user_id) JOIN taste t USING (user_id) JOIN vectors v USING (book_id) LEFT JOIN score USING (user_id, book_id) LEFT JOIN kn USING (user_id, book_id))"""


def _hybrid_sql(content: float, popularity: float, genre: float, cooccurrence: float, neighbours: float) -> str:
    """CTEs sc and ranked: the pool's scores under these weights, and each reader's list."""
    return f"""sc AS (SELECT user_id, book_id, title, round({_pct('content')} * {content} + {_pct('popularity')} * {popularity} + {_pct('genre')} * {genre} + {_pct('cooccurrence')} * {cooccurrence} + {_pct('neighbours')} * {neighbours}, 9) AS score FROM sig),
rep AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(title) ORDER BY score DESC, book_id) > 1 AS rp FROM sc),
ranked AS (SELECT user_id, book_id, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rp, score DESC, book_id) AS INTEGER) AS rank FROM rep QUALIFY rank <= 10)"""


_HYBRID = _HYBRID.replace(", marg AS", ", tpos AS (SELECT DISTINCT user_id, book_id FROM train WHERE is_read AND rating_clean >= 4), marg AS", 1)


@query("rnk_hybrid", f"WITH {_HYBRID}, {_hybrid_sql(0.35, 0.30, 0.20, 0.10, 0.05)} SELECT user_id, book_id, score, rank FROM ranked")
def rnk_hybrid(spark, sf):
    lists = hybrid_lists(spark, sf, {"": rank.Weights()})
    if lists is not None:
        return lists.select("user_id", "book_id", "score", "rank")
    sig, titles = signals(spark, sf)
    return rank.hybrid(sig, rank.Weights(), titles, 10).select("user_id", "book_id", "score", "rank")


def hybrid_lists(spark, sf, runs: dict[str, rank.Weights], readers=None):
    """(user_id, book_id, score, rank, system): ten items a reader under each named set of weights, over the pools of `signals`.

    Pools are worked out beside the reader; None where the items do not fit a shelf. `readers`: as `shelf.grouped` has them.
    """
    t, is_asked = train(spark, sf), F.col("user_id").cast("long") % 20 == 0
    popular = popular_items(spark, sf, t)
    score = temporal.popularity_score(F.col("n"), F.col("mean_rating"))
    told = popular.select("book_id", "mask", F.round(score, 9).alias("order"), F.round(score, 7).alias("popularity"), title_key("title").alias("title"), F.lit(True).alias("listed"))
    blank = {"mask": 0, "order": 0.0, "popularity": 0.0, "title": "", "listed": False}
    s = shelf.shelved(fx.taste(spark, sf).join(told, "book_id", "left").fillna(blank), *blank)
    if s is None:
        return None
    items = written(popular.join(fx.vectors(spark, sf).select("book_id"), "book_id", "left_semi").select("book_id", "mask"), "hybrid-items")
    readers = shelf.grouped(t) if readers is None else readers
    asked, reads, liked = readers.where(is_asked), shelf.reads_of(readers), shelf.liked_of(readers)
    queries = written(shelf.tastes(shelf.reads_of(asked), s), "hybrid-queries")
    # few tasks, each of which holds the best of all queries: what they have to merge grows with their number
    table = reads.coalesce(max(1, spark.sparkContext.defaultParallelism))
    near = knn.neighbours(queries, table, 10, through=shelf.tasting(s))
    edges = written(cooc.pairs_of(liked), "pairs")
    told = shelf.with_values(shelf.reads_of(asked), cooc.scores_of(liked.where(is_asked), edges), "score")
    told = shelf.with_values(told, knn.read_by_lists(near, reads), "score", "neighbours")
    told = told.join(user_masks(spark, sf, t.where(is_asked), items), "user_id", "left")
    return shelf.answered(told, s, shelf.hybrids(CLUSTERS, rank.SOURCE_LIMIT, 10, runs), "score double, rank int, system string")


def signals(spark, sf):
    """(the five signals of each asked reader's pool, title keys).

    The readers asked are those whose id 20 divides, against all items and all readers. A pool is the union of the unread
    items of their clusters and the best unread ones by popularity, by popularity in their genres, and by co-occurrence.
    History is read once; all five signals come from it.
    """
    t = written(train(spark, sf), "hybrid-train")
    v = written(fx.taste(spark, sf), "hybrid-vectors")
    items = written(popular_items(spark, sf, t).join(v.select("book_id"), "book_id", "left_semi"), "hybrid-items")
    profiles = written(single_modes(spark, sf, t), "hybrid-profiles")
    modes = profiles.where(F.col("user_id").cast("long") % 20 == 0)
    reads = t.where("is_read").select("user_id", "book_id").distinct()
    masks = written(user_masks(spark, sf, t, items).join(modes.select("user_id"), "user_id", "left_semi"), "hybrid-masks")
    own = reads.join(modes.select("user_id"), "user_id", "left_semi")
    clusters = retrieve.pooled_clusters(modes, retrieve.centroids(v))
    content = retrieve.candidates(clusters, v.join(items.select("book_id"), "book_id", "left_semi"), own)
    edges = written(cooc.pairs(users.positives(t)), "hybrid-pairs")
    history = users.positives(t).join(modes.select("user_id"), "user_id", "left_semi")
    scores = cooc.history_scores(history, edges).join(items.select("book_id"), "book_id", "left_semi")
    unread = scores.join(own, ["user_id", "book_id"], "left_anti")
    sources = [
        content,
        rank.popularity_top(masks, items, own, rank.SOURCE_LIMIT),
        rank.genre_popularity_top(masks, items, own, rank.SOURCE_LIMIT),
        cooc.collaborative_candidates(unread.where("score > 0"), rank.SOURCE_LIMIT),
    ]
    candidates = written(reduce(DataFrame.unionByName, [s.select("user_id", "book_id") for s in sources]).distinct(), "hybrid-pool")
    rel = retrieve.relevance(candidates, modes, v).select("user_id", "book_id", F.round("relevance", 7).alias("content"))
    near_reads = knn.neighbour_scores(knn.neighbours(modes, profiles, 10), t).select("user_id", "book_id", F.round("score", 7).alias("neighbours"))
    pop = items.select("book_id", F.col("mask").alias("_m"), F.round(temporal.popularity_score(F.col("n"), F.col("mean_rating")), 7).alias("popularity"))
    sig = rel.join(pop, "book_id").join(masks, "user_id")
    sig = sig.join(scores.select("user_id", "book_id", F.round("score", 7).alias("cooccurrence")), ["user_id", "book_id"], "left").join(near_reads, ["user_id", "book_id"], "left")
    sig = sig.withColumn("genre", F.when(F.col("_m").bitwiseAND(F.col("mask")) != 0, F.col("popularity")).otherwise(F.lit(0.0)))
    return sig, items.select("book_id", title_key("title").alias("title_key"))


# evaluation


_RECS = _BAS + """, recs AS (SELECT user_id, 'popularity' AS system, k, CAST(rank AS INTEGER) AS rank, book_id FROM (SELECT u.user_id, p.book_id, row_number() OVER (PARTITION BY u.user_id ORDER BY round(p.score, 9) DESC, p.book_id) AS rank FROM us u, pop p WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.is_read AND t.user_id = u.user_id AND t.book_id = p.book_id)), (VALUES (5), (10)) AS ks(k) WHERE rank <= k
UNION ALL SELECT user_id, 'genre', k, CAST(rank AS INTEGER), book_id FROM (SELECT u.user_id, p.book_id, row_number() OVER (PARTITION BY u.user_id ORDER BY round(p.score, 9) DESC, p.book_id) AS rank FROM us u, pop p WHERE (umask = 0 OR (umask & mask) <> 0) AND NOT EXISTS (SELECT 1 FROM train t WHERE t.is_read AND t.user_id = u.user_id AND t.book_id = p.book_id)), (VALUES (5), (10)) AS ks(k) WHERE rank <= k),
relv AS (SELECT DISTINCT user_id, book_id FROM future WHERE is_read AND rating_clean >= 4), nrel AS (SELECT user_id, count(*) AS nr FROM relv GROUP BY 1),
hits AS (SELECT r.*, CAST(v.book_id IS NOT NULL AS INTEGER) AS hit FROM recs r LEFT JOIN relv v ON v.user_id = r.user_id AND v.book_id = r.book_id),
per AS (SELECT user_id, system, k, sum(hit) / k::DOUBLE AS "precision", sum(hit) / nr::DOUBLE AS recall, sum(hit / log2(rank + 1)) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(nr, k) + 1)]) AS ndcg, sum(hit * cum / rank::DOUBLE) / least(nr, k) AS average_precision FROM (SELECT *, sum(hit) OVER (PARTITION BY user_id, system, k ORDER BY rank) AS cum FROM hits) JOIN nrel USING (user_id) GROUP BY user_id, system, k, nr)"""


def recs(spark, sf):
    t = written(train(spark, sf), "train")
    i = written(popular_items(spark, sf, t), "items")
    m, c = user_masks(spark, sf, t, i), t.where("is_read")
    one = rank.popularity_top(m, i, c, 10).withColumn("system", F.lit("popularity")).unionByName(rank.genre_popularity_top(m, i, c, 10).withColumn("system", F.lit("genre")))
    return one.withColumn("k", F.explode(F.array(F.lit(5), F.lit(10)))).where(F.col("rank") <= F.col("k")).select("user_id", "system", "k", "rank", "book_id")


def per_user(spark, sf):
    return metrics.ranking(recs(spark, sf), relevant(spark, sf))


METRICS = ["precision", "recall", "ndcg", "average_precision"]


@query("eva_ranking_metrics", f"WITH {_RECS} SELECT user_id, system, k, {', '.join(f'round({chr(34)}{m}{chr(34)}, 6) AS {chr(34)}{m}{chr(34)}' for m in METRICS)} FROM per")
def eva_metrics(spark, sf):
    return per_user(spark, sf).select("user_id", "system", "k", *[r6(m) for m in METRICS])


@query("eva_by_system", f"WITH {_RECS} SELECT system, k, count(DISTINCT user_id) AS users, {', '.join(f'round(avg({chr(34)}{m}{chr(34)}), 6) AS {chr(34)}{m}{chr(34)}' for m in METRICS)} FROM per GROUP BY 1, 2")
def eva_system(spark, sf):
    return metrics.by_system(per_user(spark, sf), METRICS).select("system", "k", "users", *[r6(m) for m in METRICS])


@query("rep_verdict", f"WITH {_RECS}, s AS (SELECT system, k, avg(recall) AS r, avg(ndcg) AS n FROM per GROUP BY 1, 2) SELECT g.k, round(g.r - p.r, 6) AS recall_gain, round(g.n - p.n, 6) AS ndcg_gain, g.r > p.r AND g.n > p.n AS wins FROM s g JOIN s p ON g.k = p.k AND g.system = 'genre' AND p.system = 'popularity'")
def rep_verdict(spark, sf):
    v = metrics.verdict(metrics.by_system(per_user(spark, sf), METRICS), "genre", "popularity")
    return v.select("k", r6("recall_gain"), r6("ndcg_gain"), "wins")


@query("eva_candidate_recall", f"WITH {_TASTE}, relv AS (SELECT DISTINCT user_id, book_id FROM future WHERE is_read AND rating_clean >= 4) SELECT user_id, round(count(c.book_id) / count(*)::DOUBLE, 6) AS candidate_recall FROM relv LEFT JOIN (SELECT DISTINCT user_id, book_id FROM cand) c USING (user_id, book_id) GROUP BY 1")
def eva_candidates(spark, sf):
    picks, rel = picked(spark, sf), relevant(spark, sf)
    if picks is not None:
        met = retrieve.candidates_among(rel, picks, fx.taste(spark, sf), train(spark, sf).where("is_read"))
        return metrics.candidate_recall(met, rel).select("user_id", r6("candidate_recall"))
    return metrics.candidate_recall(cands(spark, sf)[0], relevant(spark, sf)).select("user_id", r6("candidate_recall"))


@query("eva_diversity", f"WITH {_RECS}, {fx.TASTE_SQL}, rv AS (SELECT * FROM recs JOIN vectors USING (book_id)), d AS (SELECT a.user_id, a.system, a.k, avg(1 - greatest(-1, least(1, list_cosine_similarity(a.vec, b.vec)))) AS dv FROM rv a JOIN rv b ON a.user_id = b.user_id AND a.system = b.system AND a.k = b.k AND a.rank < b.rank GROUP BY 1, 2, 3) SELECT DISTINCT user_id, system, k, round(coalesce(dv, 0), 6) AS diversity FROM rv LEFT JOIN d USING (user_id, system, k)")
def eva_diversity(spark, sf):
    return metrics.diversity(recs(spark, sf), fx.taste(spark, sf)).select("user_id", "system", "k", r6("diversity"))


_SEG = ", seg AS (SELECT book_id, n, CASE WHEN n >= hi THEN 'head' WHEN n <= lo THEN 'tail' ELSE 'mid' END AS segment FROM (SELECT i.book_id, coalesce(n, 0) AS n FROM items i LEFT JOIN (SELECT book_id, count(rating_clean) AS n FROM train GROUP BY 1) USING (book_id)), (SELECT quantile_cont(n, 0.25) AS lo, quantile_cont(n, 0.9) AS hi FROM (SELECT coalesce(n, 0) AS n FROM items LEFT JOIN (SELECT book_id, count(rating_clean) AS n FROM train GROUP BY 1) USING (book_id))))"


def segmented(spark, sf):
    return windows.popularity_segments(popular_items(spark, sf).select("book_id", "n"), "n")


@query("eva_novelty", f"WITH {_RECS}{_SEG} SELECT system, k, round(avg(-log2((n + 1) / (SELECT (sum(n) + count(*))::DOUBLE FROM seg))), 6) AS novelty, round(avg(ln(1 + n)), 6) AS mean_log_popularity, round(avg(CAST(segment = 'tail' AS INTEGER)), 6) AS tail_share, round(avg(CAST(segment = 'head' AS INTEGER)), 6) AS head_share FROM recs JOIN seg USING (book_id) GROUP BY 1, 2")
def eva_novelty(spark, sf):
    n = metrics.novelty(recs(spark, sf), segmented(spark, sf))
    return n.select("system", "k", *[r6(c) for c in ("novelty", "mean_log_popularity", "tail_share", "head_share")])


@query("eva_coverage", f"WITH {_RECS}{_SEG}, x AS (SELECT DISTINCT system, k, book_id FROM recs) SELECT system, k, round(count(*) / (SELECT count(*) FROM seg)::DOUBLE, 6) AS coverage, round(count(*) FILTER (segment = 'tail') / (SELECT count(*) FROM seg WHERE segment = 'tail')::DOUBLE, 6) AS tail_coverage FROM x JOIN seg USING (book_id) GROUP BY 1, 2")
def eva_coverage(spark, sf):
    return metrics.coverage(recs(spark, sf), segmented(spark, sf)).select("system", "k", r6("coverage"), r6("tail_coverage"))


@query("eva_slot_metrics")
def eva_slots(spark, sf):
    s = written(rnk_slots(spark, sf), "slots").withColumn("system", F.lit("model")).withColumn("k", F.lit(10))
    return metrics.slot_metrics(s, relevant(spark, sf))


@query("eva_bootstrap")
def eva_bootstrap(spark, sf):
    return metrics.bootstrap(per_user(spark, sf), "recall", 1000)


# habits


def _habit_sql(where: str, at: str, name: str) -> str:
    breadth = " + ".join(f"coalesce(max(CASE WHEN is_read THEN {f} END), 0)" for f in FLAGS)
    return f"{name} AS (SELECT user_id, count(*) FILTER (is_read) AS n_reads, date_diff('microsecond', min(date_added), max(date_added)) / 86400e6 AS span_days, count(*) FILTER (is_read) * 30.4375 / greatest(date_diff('microsecond', min(date_added), max(date_added)) / 86400e6, 1) AS monthly, greatest(0, date_diff('microsecond', max(date_added), TIMESTAMP '{at}') / 86400e6) AS recency_days, count(*) FILTER (is_read) / count(*)::DOUBLE AS completion, {breadth} AS breadth FROM best LEFT JOIN items USING (book_id) WHERE {where} GROUP BY 1)"


_HABITS = ["span_days", "monthly", "recency_days", "completion"]



def shifted(spark, sf):
    """The interactions twelve years later, so that the fixed floor of valid dates lies within them."""
    return best(spark, sf).withColumn("date_added", F.timestamp_micros(F.unix_micros("date_added") + 12 * 365 * 86_400_000_000))


_SHIFT = BEST.replace("best AS (SELECT * EXCLUDE (rn)", "best AS (SELECT * EXCLUDE (rn, date_added), make_timestamp(epoch_us(date_added) + 378432000000000) AS date_added")
_H_AT = "2012-01-01"


@query("eva_habit_proxies", f"WITH {_SHIFT}, {fx.ITEMS_SQL}, {_habit_sql(f'''date_added >= TIMESTAMP '2006-01-01' AND date_added <= TIMESTAMP '{_H_AT}' ''', _H_AT, 'h')} SELECT user_id, n_reads, {', '.join(f'round({c}, 5) AS {c}' for c in _HABITS)}, breadth FROM h")
def eva_habits(spark, sf):
    h = habits.proxies(shifted(spark, sf), fx.items(spark, sf), FLAGS, F.lit(_H_AT).cast("timestamp"))
    return h.select("user_id", "n_reads", *[F.round(c, 5).alias(c) for c in _HABITS], "breadth")


@query("joi_habit_table", f"WITH {_SHIFT}, {fx.ITEMS_SQL}, {_habit_sql(f'''date_added >= TIMESTAMP '2006-01-01' AND date_added <= TIMESTAMP '{_H_AT}' ''', _H_AT, 'h')}, {_habit_sql(f'''date_added > TIMESTAMP '{_H_AT}' ''', '2015-01-01', 'f')}, j AS (SELECT user_id, coalesce(h.n_reads, 0) AS n_reads_train, coalesce(f.n_reads, 0) AS n_reads_future FROM h FULL JOIN f USING (user_id)), c AS (SELECT quantile_cont(n_reads_train, 1 / 3.0::DOUBLE) AS a, quantile_cont(n_reads_train, 2 / 3.0::DOUBLE) AS b FROM j) SELECT user_id, n_reads_train, n_reads_future, CASE WHEN n_reads_train <= a THEN 'low' WHEN n_reads_train > b THEN 'high' ELSE 'mid' END AS activity FROM j, c")
def joi_habits(spark, sf):
    s = shifted(spark, sf)
    at, end = F.lit(_H_AT).cast("timestamp"), F.lit("2015-01-01").cast("timestamp")
    i = fx.items(spark, sf)
    t = habits.habit_table(habits.proxies(s, i, FLAGS, at), habits.proxies(s.where(F.col("date_added") > at), i, FLAGS, end))
    return t.select("user_id", "n_reads_train", "n_reads_future", "activity")
