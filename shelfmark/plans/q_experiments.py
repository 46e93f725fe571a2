"""Queries: sweeps over ranking settings, winner rules, backtests, reports.

A sweep is one table of lists, a system for each setting, under one evaluation; no setting is state.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import cluster, features, lists as lists_, metrics, rank, recommend, retrieve, shelf, temporal, users, windows
from shelfmark.plans import fixtures as fx
from shelfmark.plans.q_curation import canonical as best
from shelfmark.plans.q_ranking import _COLLAB, _HYBRID, _RECS, _SEG, CLUSTERS, FLAGS, FLOOR, _hybrid_sql, _pct, cands, collaborative, collaborative_readers, hybrid_lists, pool, popularity, popular_items, read, recs, relevant, segmented, shop, signals, single_modes, train, user_masks, with_duration
from shelfmark.store import written

Q: dict = {}
SQL: dict[str, str] = {}
#: The weight sets of the grid, the blend shares, the settings of the ablation.
GRID = tuple(rank.Weights(content=c, popularity=p, genre=0.20, cooccurrence=0.10, neighbours=0.0) for c, p in ((0.35, 0.35), (0.25, 0.45), (0.20, 0.50), (0.15, 0.55)))
ALPHAS = (0.5, 0.7, 0.9)
ABLATION = (
    {},
    {"clusters": 10},
    {"clusters": 15},
    {"clusters": 20},
    {"trade": 0.5},
    {"trade": 0.9},
    {"explore": 0},
    {"explore": 4},
    {"clusters": 15, "explore": 0},
)
PER_MODE = ((5, 20, 2), (8, 20, 2), (5, 20, 0))


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def at_ks(df: DataFrame, system: str, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    each = df.withColumn("system", F.lit(system)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return each.where(F.col("rank") <= F.col("k")).select("user_id", "system", "k", "rank", "book_id")


def label(over: dict) -> str:
    return ",".join(f"{k}={v}" for k, v in over.items()) or "baseline"


def baseline(spark, sf, readers=None):
    """`readers`: as `shelf.grouped` has them, which spares the exchanges."""
    lists = None if readers is None else shelf.popular_unread(readers, popular_items(spark, sf), 10)
    if lists is not None:
        return at_ks(lists, "B1_popularity")
    return at_ks(rank.popularity_top(user_masks(spark, sf), popular_items(spark, sf), read(spark, sf), 10), "B1_popularity")


def content(spark, sf, readers=None):
    s = shelf.shelved(fx.taste(spark, sf))
    if s is not None:
        return at_ks(shelf.answered(shelf.histories(train(spark, sf)) if readers is None else shelf.reads_of(readers), s, shelf.most_relevant(CLUSTERS, 10), "rank int"), "content_only")
    c, modes = cands(spark, sf)
    rel = retrieve.relevance(c, modes, fx.taste(spark, sf))
    return at_ks(windows.top(rel, 10, [F.desc(F.round("relevance", 9)), F.col("book_id")], over=["user_id"]), "content_only")


def grid(spark, sf):
    names = {f"content={w.content},popularity={w.popularity}": w for w in GRID}
    readers = shelf.grouped(train(spark, sf))
    lists = hybrid_lists(spark, sf, names, readers)
    if lists is not None:
        lists = written(lists.drop("score"), "grid-lists")
        runs = [at_ks(lists.where(F.col("system") == n), n) for n in names]
    else:
        sig, titles = signals(spark, sf)
        sig = written(sig, "grid-signals")
        runs = [at_ks(rank.hybrid(sig, w, titles, 10), n) for n, w in names.items()]
    return metrics.full_summary(written(union([baseline(spark, sf, readers), content(spark, sf, readers), *runs]), "lists"), relevant(spark, sf), segmented(spark, sf))


_MEANS = ("precision", "recall", "ndcg", "average_precision")
_SHOWN = (*_MEANS, "novelty", "mean_log_popularity", "tail_share", "head_share", "coverage", "tail_coverage")
_PER = _RECS[_RECS.index("relv AS") :]


def _summary_sql(before: str, runs: dict[str, str]) -> str:
    """CTEs up to `summary`: the baseline, the content list and the given runs, CTEs of (user_id, book_id, rank), evaluated together."""
    ks = "(VALUES (5), (10)) AS ks(k) WHERE rank <= k"
    lists = {"B1_popularity": "base", "content_only": "cont", **runs}
    return f"""{before},
bpop AS (SELECT i.book_id, ln(1 + coalesce(n, 0)) * coalesce(mean_rating, 0) AS score FROM items i LEFT JOIN (SELECT book_id, count(rating_clean) AS n, avg(rating_clean) AS mean_rating FROM train GROUP BY 1) USING (book_id)),
bus AS (SELECT DISTINCT user_id FROM train JOIN bpop USING (book_id)),
base AS (SELECT * FROM (SELECT u.user_id, p.book_id, row_number() OVER (PARTITION BY u.user_id ORDER BY round(p.score, 9) DESC, p.book_id) AS rank FROM bus u, bpop p WHERE NOT EXISTS (SELECT 1 FROM consumed c WHERE c.user_id = u.user_id AND c.book_id = p.book_id)) WHERE rank <= 10),
cont AS (SELECT * FROM (SELECT user_id, book_id, row_number() OVER (PARTITION BY user_id ORDER BY round(relevance, 9) DESC, book_id) AS rank FROM rel) WHERE rank <= 10),
recs AS ({' UNION ALL '.join(f"SELECT user_id, '{name}' AS system, k, CAST(rank AS INTEGER) AS rank, book_id FROM {cte}, {ks}" for name, cte in lists.items())}),
{_PER}{_SEG},
m AS (SELECT system, k, count(DISTINCT user_id) AS users, {', '.join(f'avg("{c}") AS "{c}"' for c in _MEANS)} FROM per GROUP BY 1, 2),
nv AS (SELECT system, k, avg(-log2((n + 1) / (SELECT (sum(n) + count(*))::DOUBLE FROM seg))) AS novelty, avg(ln(1 + n)) AS mean_log_popularity, avg(CAST(segment = 'tail' AS INTEGER)) AS tail_share, avg(CAST(segment = 'head' AS INTEGER)) AS head_share FROM recs JOIN seg USING (book_id) GROUP BY 1, 2),
cv AS (SELECT system, k, count(*) / (SELECT count(*) FROM seg)::DOUBLE AS coverage, count(*) FILTER (segment = 'tail') / (SELECT count(*) FROM seg WHERE segment = 'tail')::DOUBLE AS tail_coverage FROM (SELECT DISTINCT system, k, book_id FROM recs) JOIN seg USING (book_id) GROUP BY 1, 2),
summary AS (SELECT * FROM m JOIN nv USING (system, k) JOIN cv USING (system, k))"""


_ROUNDED = f"SELECT system, k, users, {', '.join(f'round({chr(34)}{c}{chr(34)}, 6) AS {chr(34)}{c}{chr(34)}' for c in _SHOWN)} FROM summary"
_BEATS = "s.recall > b.recall AND s.ndcg > b.ndcg AND s.coverage >= b.coverage AND s.novelty >= b.novelty AND s.tail_coverage >= b.tail_coverage"


def rounded(summary: DataFrame) -> DataFrame:
    return summary.select("system", "k", "users", *[F.round(c, 6).alias(c) for c in _SHOWN])


def _grid_sql() -> str:
    steps, runs = [_HYBRID], {}
    for i, w in enumerate(GRID):
        ctes = _hybrid_sql(w.content, w.popularity, w.genre, w.cooccurrence, w.neighbours)
        for name in ("sc AS", "rep AS", "ranked AS"):
            ctes = ctes.replace(name, name.replace(" AS", f"{i} AS"))
        steps.append(ctes.replace("FROM sc)", f"FROM sc{i})").replace("FROM rep ", f"FROM rep{i} "))
        runs[f"content={w.content},popularity={w.popularity}"] = f"ranked{i}"
    return _summary_sql(", ".join(steps), runs)


_GRID_SQL = _grid_sql()


@query("exp_ranker_grid", f"WITH {_GRID_SQL} {_ROUNDED}")
def exp_grid(spark, sf):
    return rounded(grid(spark, sf))


@query("exp_grid_winner", f"WITH {_GRID_SQL}, good AS (SELECT s.system FROM summary s JOIN summary b ON b.k = s.k AND b.system = 'B1_popularity' WHERE s.system NOT IN ('B1_popularity', 'content_only') GROUP BY 1 HAVING count(*) FILTER ({_BEATS}) = 2) SELECT coalesce((SELECT system FROM summary SEMI JOIN good USING (system) WHERE k = 10 ORDER BY ndcg DESC, recall DESC, coverage DESC, novelty DESC, system LIMIT 1), 'content_only') AS winner")
def exp_grid_winner(spark, sf):
    return metrics.grid_winner(written(grid(spark, sf), "grid"), "B1_popularity", "content_only")


def collaborative_ab(spark, sf):
    name = "cooccurrence_alpha={:.1f}".format
    readers = shelf.grouped(train(spark, sf))
    found = collaborative_readers(spark, sf, readers)
    if found is not None:
        lists = written(shelf.answered(found[1], found[0], shelf.blends(CLUSTERS, "score", 10, {name(a): a for a in ALPHAS}), "rank int, system string"), "ab-lists")
        runs = [at_ks(lists.where(F.col("system") == name(a)), name(a)) for a in ALPHAS]
    else:
        c, modes, score = collaborative(spark, sf)
        rel = retrieve.relevance(c, modes, fx.taste(spark, sf)).select("user_id", "book_id", F.round("relevance", 7).alias("content"))
        both = written(rel.join(score.select("user_id", "book_id", F.round("score", 7).alias("collaborative")), ["user_id", "book_id"]), "ab-pool")
        runs = [at_ks(windows.top(rank.blend(both, a), 10, [F.desc(F.round("blend", 9)), F.col("book_id")], over=["user_id"]), name(a)) for a in ALPHAS]
    return metrics.full_summary(written(union([baseline(spark, sf, readers), content(spark, sf, readers), *runs]), "lists"), relevant(spark, sf), segmented(spark, sf))


def _ab_sql() -> str:
    steps, runs = [_COLLAB, "j AS (SELECT user_id, book_id, round(relevance, 7) AS content, round(score, 7) AS collaborative FROM rel JOIN collab USING (user_id, book_id))"], {}
    steps.append(f"pct AS (SELECT user_id, book_id, {_pct('content')} AS c, {_pct('collaborative')} AS o FROM j)")
    for i, a in enumerate(ALPHAS):
        steps.append(f"ranked{i} AS (SELECT * FROM (SELECT user_id, book_id, row_number() OVER (PARTITION BY user_id ORDER BY round({a} * c + (1 - {a}) * o, 9) DESC, book_id) AS rank FROM pct) WHERE rank <= 10)")
        runs[f"cooccurrence_alpha={a:.1f}"] = f"ranked{i}"
    return _summary_sql(", ".join(steps), runs)


_AB_SQL = _ab_sql()


@query("exp_collaborative_ab", f"WITH {_AB_SQL} {_ROUNDED}")
def exp_ab(spark, sf):
    return rounded(collaborative_ab(spark, sf))


@query("exp_collaborative_winner", f"WITH {_AB_SQL}, ten AS (SELECT * FROM summary WHERE k = 10) SELECT coalesce((SELECT s.system FROM ten s, ten b, ten c WHERE b.system = 'B1_popularity' AND c.system = 'content_only' AND s.system NOT IN (b.system, c.system) AND {_BEATS} AND s.recall >= c.recall AND s.ndcg >= c.ndcg ORDER BY s.ndcg DESC, s.recall DESC, s.system LIMIT 1), 'content_only') AS winner")
def exp_ab_winner(spark, sf):
    return metrics.ab_winner(written(collaborative_ab(spark, sf), "ab"), "B1_popularity", "content_only")


@query("exp_ablation")
def exp_ablation(spark, sf):
    """Twelve settings: one at a time from the default, some crossed, and retrieval for each mode."""
    s, default = shop(spark, sf), rank.Config()
    if s is not None:
        settings = {label(o): (replace(default, **o), replace(default, **o).clusters) for o in ABLATION}
        # with one mode a reader, its best clusters in turns are its best clusters
        settings |= {f"per_mode={each},budget={budget},explore={explore}": (replace(default, explore=explore), min(each, budget)) for each, budget, explore in PER_MODE}
        lists = written(shelf.answered(shelf.histories(train(spark, sf)), s, lists_.sweep(settings), "rank int, system string", blocks=True), "ablation-lists")
        return metrics.full_summary(lists.withColumn("k", F.lit(default.k)), relevant(spark, sf), segmented(spark, sf))
    modes = single_modes(spark, sf)
    centres = retrieve.centroids(fx.taste(spark, sf))
    wide = retrieve.pooled_clusters(modes, centres, 20).withColumnRenamed("rank", "cluster_rank")
    full = written(pool(spark, sf, wide), "ablation-pool")
    ranks = written(wide.select("user_id", "cluster", "cluster_rank"), "ablation-clusters")

    def run(name: str, conf: rank.Config, clusters: DataFrame) -> DataFrame:
        p = full.join(clusters, ["user_id", "cluster"], "left_semi")
        picks = rank.mmr(p, conf.k, conf.trade, conf.genre_penalty)
        first = picks.where(F.col("rank") <= conf.k - conf.explore)
        return at_ks(rank.slots(picks, rank.exploration(p, first, conf), conf.k, conf.explore), name, (conf.k,))

    runs = [run(label(o), replace(default, **o), ranks.where(F.col("cluster_rank") <= replace(default, **o).clusters)) for o in ABLATION]
    for each, budget, explore in PER_MODE:
        lanes = retrieve.interleaved_clusters(modes, centres, each)
        runs.append(run(f"per_mode={each},budget={budget},explore={explore}", replace(default, explore=explore), lanes.where(F.col("rank") <= budget).select("user_id", "cluster")))
    return metrics.full_summary(written(union(runs), "lists"), relevant(spark, sf), segmented(spark, sf))


SNAPSHOTS = ("1996-01-01", "1998-01-01", "2000-01-01")


def refitted(spark, sf, known: DataFrame, at, clusters: int = 10, macros: int = 4) -> DataFrame:
    """Ten items a reader by the model as it would have stood at one date.

    Features, components, clusters, macros, segments and profiles are all fitted to the items available then and to
    `known`, the interactions up to then; nothing later is read.
    """
    seen = temporal.popularity_as_of(known, at, FLOOR)
    then = temporal.available(fx.items(spark, sf), seen, at).where("available").drop("available", "first_seen")
    counted = seen.select("book_id", F.col("n").alias("ratings_count"), F.col("mean_rating").alias("average_rating"), F.col("n_reviews").alias("reviews_count"))
    texts = fx.vectors(spark, sf).select("book_id", F.col("vec").alias("text_vec"))
    items = written(then.join(counted, "book_id", "left").join(texts, "book_id").withColumn("author_count", F.lit(1)), "snapshot-items")
    blocks = written(features.joined_blocks([(features.numeric_block(items, FLAGS), "num"), (features.binary_block(items, FLAGS, "language", 3), "bin"), (items.select("book_id", "text_vec"), "text_vec")]), "snapshot-blocks")
    components, _ = features.fit_pca(blocks)
    v = written(features.project(blocks, components).select("book_id", "vec"), "snapshot-vectors")
    centres = cluster.centres_of(spark, cluster.fit_kmeans(v, clusters))
    labels = cluster.assign(v, centres).select("book_id", "cluster").join(F.broadcast(cluster.macros(centres, macros)), "cluster")
    placed = items.drop("text_vec").join(v, "book_id").join(labels, "book_id").withColumn("genres", F.array(*[F.col(f) == 1 for f in FLAGS]))
    catalogue = written(recommend.with_segments(placed, popularity(known)), "snapshot-catalogue")
    modes = written(recommend.profiles(with_duration(known), v, centres), "snapshot-profiles")
    return recommend.from_modes(modes, catalogue, known.where("is_read"), rank.Config())


@query("exp_backtest")
def exp_backtest(spark, sf):
    """Popularity and the model refitted at three cutoffs, each evaluated on what came after it; aggregates alone are compared."""
    b, out = best(spark, sf), []
    for cut in SNAPSHOTS:
        at = F.lit(cut).cast("timestamp")
        known = written(b.where(F.col("date_added") <= at), "snapshot-known")
        items = fx.items(spark, sf).join(temporal.popularity_as_of(known, at, FLOOR), "book_id", "left").select("book_id", F.coalesce("n", F.lit(0)).alias("n"), "mean_rating")
        lists = at_ks(rank.popularity_top(known, items, known.where("is_read"), 10), "B1_popularity", (10,))
        model = at_ks(refitted(spark, sf, known, at), "model", (10,))
        rel = users.positives(b.where(F.col("date_added") > at))
        both = written(lists.unionByName(model), "snapshot-lists")
        out.append(metrics.by_system(metrics.ranking(both, rel), ["recall", "ndcg"]).withColumn("cutoff", F.lit(cut)))
    return union(out)


@query("eva_full_summary", f"WITH {_RECS}{_SEG}, m AS (SELECT system, k, count(DISTINCT user_id) AS users, avg(recall) AS recall, avg(ndcg) AS ndcg FROM per GROUP BY 1, 2), nv AS (SELECT system, k, avg(-log2((n + 1) / (SELECT (sum(n) + count(*))::DOUBLE FROM seg))) AS novelty FROM recs JOIN seg USING (book_id) GROUP BY 1, 2), cv AS (SELECT system, k, count(DISTINCT book_id) / (SELECT count(*) FROM seg)::DOUBLE AS coverage FROM recs JOIN seg USING (book_id) GROUP BY 1, 2) SELECT system, k, users, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(novelty, 6) AS novelty, round(coverage, 6) AS coverage FROM m JOIN nv USING (system, k) JOIN cv USING (system, k)")
def eva_full(spark, sf):
    s = metrics.full_summary(recs(spark, sf), relevant(spark, sf), segmented(spark, sf))
    return s.select("system", "k", "users", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "novelty", "coverage")])


_SMALL = "(VALUES ('B1', 5, 0.1, 0.1, 0.2, 3.0, 0.1), ('B1', 10, 0.2, 0.2, 0.2, 3.0, 0.1), ('content_only', 5, 0.1, 0.1, 0.4, 9.0, 0.3), ('content_only', 10, 0.1, 0.1, 0.4, 9.0, 0.3), ('x', 5, 0.2, 0.2, 0.3, 4.0, 0.1), ('x', 10, 0.3, 0.3, 0.3, 4.0, 0.1), ('y', 5, 0.2, 0.2, 0.3, 4.0, 0.1), ('y', 10, 0.2, 0.4, 0.3, 4.0, 0.1), ('z', 5, 0.3, 0.3, 0.3, 4.0, 0.2), ('z', 10, 0.3, 0.35, 0.3, 4.0, 0.2)) AS t(system, k, recall, ndcg, coverage, novelty, tail_coverage)"


@query("exp_winner_rule", f"WITH s AS (SELECT * FROM {_SMALL}), b AS (SELECT * FROM s WHERE system = 'B1'), g AS (SELECT s.system FROM s JOIN b USING (k) WHERE s.system NOT IN ('B1', 'content_only') GROUP BY 1 HAVING bool_and(s.recall > b.recall AND s.ndcg > b.ndcg AND s.coverage >= b.coverage AND s.novelty >= b.novelty AND s.tail_coverage >= b.tail_coverage)) SELECT coalesce((SELECT system FROM s SEMI JOIN g USING (system) WHERE k = 10 ORDER BY ndcg DESC, recall DESC LIMIT 1), 'content_only') AS winner")
def exp_rule(spark, sf):
    return metrics.grid_winner(spark.sql(f"SELECT * FROM {_SMALL}"), "B1", "content_only")


# the recommender, end to end


def _items(spark, sf):
    from shelfmark.operators.recommend import with_segments
    from shelfmark.plans.q_ranking import FLAGS, taste_catalog

    return with_segments(taste_catalog(spark, sf).withColumn("genres", F.array(*[F.col(f) == 1 for f in FLAGS])), popularity(train(spark, sf)))


def _profiles(spark, sf, asked=None):
    """Profiles of all readers, or of those for whom `asked` holds."""
    from shelfmark.operators.recommend import profiles
    from shelfmark.plans.q_ranking import with_duration

    v, t = fx.taste(spark, sf), train(spark, sf)
    return profiles(with_duration(t if asked is None else t.where(asked)), v, retrieve.centroids(v))


@query("rec_profiles")
def rec_profiles(spark, sf):
    return _profiles(spark, sf).select("user_id", "mode", F.round("weight", 6).alias("weight"))


def _routed(spark, sf):
    from shelfmark.operators.recommend import routed, routed_beside

    guests = spark.createDataFrame([("seeded", "3"), ("seeded", "14"), ("cold", None)], "user_id string, book_id string")
    beside = routed_beside(train(spark, sf), guests, guests.dropna(), _items(spark, sf), fx.taste(spark, sf), rank.Config())
    if beside is not None:
        return beside
    known = written(_profiles(spark, sf), "profiles")
    readers = known.select("user_id").unionByName(guests.select("user_id"))
    return routed(readers, known, guests.dropna(), _items(spark, sf), fx.taste(spark, sf), read(spark, sf), rank.Config())


@query("rec_routed")
def rec_routed(spark, sf):
    return _routed(spark, sf)


@query("rec_explained")
def rec_explained(spark, sf):
    from shelfmark.operators.recommend import explained

    return explained(_routed(spark, sf), _items(spark, sf), {g: F.col(f"genre_{g}") for g in fx.GENRES})


@query("eva_by_activity", f"WITH {_RECS}, u AS (SELECT user_id, count(*) FILTER (is_read) AS n FROM train GROUP BY 1), c AS (SELECT quantile_cont(n, 1 / 3.0::DOUBLE) AS a, quantile_cont(n, 2 / 3.0::DOUBLE) AS b FROM u), t AS (SELECT user_id, CASE WHEN n <= a THEN 'low' WHEN n > b THEN 'high' ELSE 'mid' END AS activity FROM u, c) SELECT activity, system, k, count(DISTINCT user_id) AS users, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM per JOIN t USING (user_id) GROUP BY 1, 2, 3")
def eva_activity(spark, sf):
    u = train(spark, sf).groupBy("user_id").agg(F.count_if("is_read").alias("n"))
    per = metrics.ranking(recs(spark, sf), relevant(spark, sf)).join(windows.tertiles(u, "n").select("user_id", "activity"), "user_id")
    return per.groupBy("activity", "system", "k").agg(F.countDistinct("user_id").alias("users"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query("eva_cohort", f"WITH {fx.best_sql()}, c AS (SELECT user_id FROM best GROUP BY 1 HAVING count(*) FILTER (is_read OR rating_clean IS NOT NULL) >= 40) SELECT interaction_key, user_id FROM best SEMI JOIN c USING (user_id)")
def eva_cohort(spark, sf):
    """The whole histories of readers with forty events and more."""
    from shelfmark.operators.curation import user_features

    b = best(spark, sf)
    return b.join(user_features(b, 40).where("valid").select("user_id"), "user_id", "left_semi").select("interaction_key", "user_id")


@query("eda_series_profile", f"SELECT CAST(n AS INTEGER) AS n_series, count(*) AS books, median(size) AS median_size FROM (SELECT p_partkey % {fx.WORKS_SQL} AS g, count(DISTINCT p_type) AS n, CAST(sum(p_size) AS DOUBLE) AS size FROM part GROUP BY 1) GROUP BY 1")
def eda_series(spark, sf):
    g = fx.table(spark, sf, "part").groupBy(fx.work_of(spark, sf, "p_partkey")).agg(F.size(F.collect_set("p_type")).alias("n_series"), F.sum("p_size").cast("double").alias("size"))
    return g.groupBy("n_series").agg(F.count("*").alias("books"), F.percentile("size", F.lit(0.5)).alias("median_size"))
