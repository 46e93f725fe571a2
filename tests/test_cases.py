"""Closed-form cases, one operator each."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import nested as N
from shelfmark.functions import text as X
from shelfmark.functions.vectors import cosine, mean_by, unit, without_axes
from shelfmark.operators import cluster, contracts, cooc, curation, features, graph, habits, knn, metrics, profile, rank, retrieve, temporal, users, windows
from shelfmark.operators.components import connected_components

ts = lambda s: datetime.fromisoformat(s)


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("raw,want", [("Wed Aug 30 00:00:26 -0700 2017", ts("2017-08-30 07:00:26")), ("nonsense", None), (None, None)])
def test_weekday_dates(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "v string").select(F.date_format(X.weekday_timestamp("v"), "yyyy-MM-dd HH:mm:ss").alias("o")).first().o
    assert got == (want.strftime("%Y-%m-%d %H:%M:%S") if want else None)


@pytest.mark.parametrize("raw,want", [("TRUE", True), ("0", False), ("yes", None), (None, None)])
def test_booleans(spark, raw, want):
    assert one(spark, raw, "string", X.boolean) is want


@pytest.mark.parametrize("raw,want", [("  &lt;b&gt;Hi&lt;/b&gt; &amp; <i>you</i>\n", "Hi & you"), ("<p> </p>", None), (None, None)])
def test_review_text(spark, raw, want):
    assert one(spark, raw, "string", X.review_text) == want
    assert one(spark, raw, "string", lambda c: X.review_text(c, every_entity=True)) == want


def test_every_entity_table(spark):
    assert one(spark, "caf&eacute; &hellip;", "string", lambda c: X.review_text(c, every_entity=True)) == "café …"


def test_blank_strings_and_bins(spark):
    df = X.blank_to_null(spark.createDataFrame([(" ", 1, "x"), (None, 2, "")], "a string, b int, c string"))
    assert [tuple(r) for r in df.collect()] == [(None, 1, "x"), (None, 2, None)]
    e = [-1, 0, 9, 49, float("inf")]
    names = ["none", "low", "medium", "high"]
    got = [one(spark, float(v), "double", lambda c: X.binned(c, e, names, right=True)) for v in (0, 1, 9, 10, 49, 50)]
    assert got == ["none", "low", "low", "medium", "medium", "high"]


def test_dates_of_parts(spark):
    df = spark.createDataFrame([("2001", "2", "31"), ("2001", None, None), ("x", "1", "1"), ("2001", "99", "5")], "y string, m string, d string")
    assert [str(r.o) for r in df.select(X.date_of_parts("y", "m", "d").alias("o")).collect()] == ["None", "2001-01-01", "None", "2001-12-05"]


AUTHORS = "array<struct<author_id:string,role:string>>"
SHELVES = "array<struct<name:string,count:long>>"


def test_nested_summaries(spark):
    a = [("", "x"), ("7", "Editor"), ("3", ""), None, ("9", None)]
    assert one(spark, a, AUTHORS, N.author_ids) == "7|3|9"
    assert one(spark, a, AUTHORS, N.main_author) == "3"
    assert one(spark, a, AUTHORS, N.other_roles) == 1
    assert one(spark, None, AUTHORS, N.author_count) == 0
    s = [("to-read", 5), ("Dark Fantasy", 2), ("to-read", 8), ("To-Read", 9)]
    assert one(spark, s, SHELVES, lambda c: N.to_read_count(c, 10)) == 8
    assert one(spark, s, SHELVES, lambda c: N.to_read_count(c, 10, any_case=True)) == 9
    assert one(spark, s, SHELVES, lambda c: N.theme_flag(N.shelf_names(c, 30), ["fantas"])) is True
    assert [tuple(p) for p in one(spark, ["b", "a", "b", "c"], "array<string>", lambda c: N.name_pairs(c, 4))] == [("a", "b"), ("a", "c"), ("b", "c")]
    assert one(spark, 1, "int", lambda c: N.dominant({"a": c, "b": c})) == "multi"


def test_vectors(spark):
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [3.0, 4.0])], "a array<double>, z array<double>, b array<double>")
    r = v.select(cosine(F.col("a"), F.col("b")).alias("c"), cosine(F.col("a"), F.col("z")).alias("n"), unit(F.col("b")).alias("u"), unit(F.col("z")).alias("uz"), without_axes(F.col("b"), 1).alias("w")).first()
    assert (r.c, r.n, r.u, r.uz, r.w) == (0.6, 0.0, [0.6, 0.8], [0.0, 0.0], [4.0])
    m = mean_by(spark.createDataFrame([("u", [1.0, 0.0]), ("u", [0.0, 1.0])], "k string, v array<double>"), ["k"], "v").first()
    assert m.vec == [0.5, 0.5]


RAW = "user_id string, book_id string, review_id string, rating int, is_read boolean, date_added timestamp, date_updated timestamp, category int"


def raw(spark, *rows):
    return spark.createDataFrame([(u, b, r, n, read, ts("2015-01-01"), ts(d), c) for u, b, r, n, read, d, c in rows], RAW)


def test_keep_best(spark):
    df = raw(spark, ("u", "b", None, 0, False, "2016-01-01", 0), ("u", "b", None, 4, True, "2015-01-01", 1), ("u", "b", None, 4, True, "2015-01-02", 2), ("u", "c", "r1", 7, None, "2015-01-01", 0), ("v", "b", None, 0, None, "2015-01-01", 0))
    best = {r.interaction_key: r for r in curation.keep_best(curation.clean(df), [F.col("category")]).collect()}
    assert best["u|b"].category == 2 and best["u|b"].engagement_mode == "rating_only"
    assert best["r1"].rating_clean is None and best["r1"].rating_missing is False and best["r1"].engagement_mode == "review"
    assert best["v|b"].engagement_mode == "want_to_read" and best["v|b"].engagement_weight == 0.3


def test_user_features(spark):
    df = curation.clean(raw(spark, ("u", "1", None, 5, True, "2015-01-01", 0), ("u", "2", None, 3, True, "2015-01-01", 0), ("u", "3", None, 0, True, "2015-01-01", 0), ("w", "1", None, 1, True, "2015-01-01", 0), ("x", "9", None, 0, False, "2015-01-01", 0)))
    f = {r.user_id: r for r in curation.user_features(df).collect()}
    assert f["u"].user_mean_rating == 4 and f["u"].user_rating_std == pytest.approx(math.sqrt(2)) and f["u"].user_rating_bias == 1.0 and f["u"].valid
    assert f["w"].user_rating_std == 0 and not f["w"].valid and f["x"].user_mean_rating is None and f["x"].user_rating_bias == 0


def test_k_core_and_views(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "2"), ("c", "3")], "user_id string, book_id string")
    assert sorted(map(tuple, curation.k_core(df, 2, 2).collect())) == [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")]
    flags = spark.createDataFrame([("1", 1, 1), ("2", 0, 1)], "book_id string, f int, g int")
    v = curation.category_views(df, flags, ["f", "g"])
    assert v["f"].count() == 2 and v["g"].count() == 5


def test_merge_master(spark):
    b = spark.createDataFrame([("1", 0, None, "x", 2), ("1", 1, "T", None, 1), ("2", 0, None, "y", 1)], "book_id string, g int, title string, author string, source_ord int")
    assert [tuple(r) for r in curation.merge_master(b, ["g"]).collect()] == [("1", 1, "T", "x")]


def test_ranks_and_segments(spark):
    df = spark.createDataFrame([("u", 20.0), ("u", 10.0), ("u", 20.0), ("v", 1.0), ("v", 1.0)], "u string, x double")
    got = [r.p for r in df.select("u", windows.average_percentile("x", over=["u"]).alias("p")).orderBy("u", "p").collect()]
    assert got == [0.0, 0.75, 0.75, 0.5, 0.5]
    s = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)] + [(None,)], "n double")
    assert [r.segment for r in windows.popularity_segments(s, "n", 0.25, 0.8).orderBy(F.asc_nulls_last("n")).collect()] == ["tail", "tail", "mid", "mid", "head", "unknown"]
    t = spark.createDataFrame([(x,) for x in (1, 1, 1, 2, 3, 3)], "n int")
    assert [r.activity for r in windows.tertiles(t, "n").orderBy("n").collect()] == ["low"] * 3 + ["mid"] + ["high"] * 2
    rr = spark.createDataFrame([("u", 0, 1, "a"), ("u", 0, 2, "b"), ("u", 1, 1, "a"), ("u", 1, 2, "c")], "u string, lane int, r int, item string")
    assert [r["item"] for r in windows.round_robin(rr, "u", "lane", "r", "item", 2).orderBy("rank").collect()] == ["a", "b"]


def test_title_fill(spark):
    df = spark.createDataFrame([("u", 1, "t"), ("u", 2, "t"), ("u", 3, ""), ("u", 4, ""), ("u", 5, "s")], "user_id string, o int, title string")
    assert [r.o for r in windows.title_fill(df, "user_id", [F.col("o")], "title", 5).orderBy("rank").collect()] == [1, 3, 4, 5, 2]


def test_cutoff_split_and_availability(spark):
    df = spark.createDataFrame([("u", "b", ts("2020-01-01")), ("u", "c", ts("2020-03-01")), ("u", "d", None), ("u", "e", ts("1012-01-01"))], "user_id string, book_id string, date_added timestamp")
    assert temporal.global_cutoff(df, 0.5).select(F.date_format("cutoff", "yyyy-MM-dd").alias("c")).first().c == "2020-01-31"
    assert sorted((r.book_id, r.part) for r in temporal.split_at(df, F.lit("2020-02-01").cast("timestamp")).collect()) == [("b", "train"), ("c", "future")]
    with pytest.raises(ValueError):
        temporal.global_cutoff(df, 1.0)
    per = temporal.per_user_split(spark.createDataFrame([("u", i) for i in range(5)] + [("v", 0)], "user_id string, date_added int"), 0.8, [])
    assert sorted((r.user_id, r.date_added, r.part) for r in per.collect())[-2:] == [("u", 4, "future"), ("v", 0, "future")]


def test_popularity_snapshot(spark):
    df = spark.createDataFrame([("a", 5.0, True, ts("2010-01-01")), ("a", 4.0, False, ts("2010-01-02")), ("a", 1.0, True, ts("2030-01-01")), ("b", 3.0, False, None)], "book_id string, rating_clean double, has_review_text boolean, date_added timestamp")
    p = {r.book_id: r for r in temporal.popularity_as_of(df, F.lit("2020-01-01").cast("timestamp")).collect()}
    assert (p["a"].n, p["a"].mean_rating, p["a"].n_reviews) == (2, 4.5, 1) and (p["b"].n, p["b"].mean_rating, p["b"].n_invalid) == (0, None, 1)


def test_pmi(spark):
    seen = {"1": "ab", "2": "ab", "3": "ab", "4": "a", "5": "b", "6": "c"}
    df = spark.createDataFrame([(u, b) for u, bs in seen.items() for b in bs], "user_id string, book_id string")
    rows = cooc.pairs(df).collect()
    assert [(r.book_id_a, r.book_id_b, r.co_count) for r in rows] == [("a", "b", 3)]
    assert rows[0].pmi == pytest.approx(math.log(18 / 16))
    assert cooc.pairs(df, cap=1).count() == 0
    c = spark.createDataFrame([("9", "a"), ("9", "z")], "user_id string, book_id string")
    h = spark.createDataFrame([("9", "b")], "user_id string, book_id string")
    assert sorted((r.book_id, round(r.score, 4)) for r in cooc.max_pmi(c, h, cooc.pairs(df)).collect()) == [("a", 0.1178), ("z", 0.0)]


@pytest.mark.parametrize("n,m", [(5, 1), (6, 2), (9, 3), (12, 4), (100, 4)])
def test_mode_counts(spark, n, m):
    assert one(spark, n, "int", users.mode_count) == m


def test_taste_modes(spark):
    rows = [("u", str(i), True, 5.0, i % 2 == 0, 10.0) for i in range(8)] + [("v", "0", True, 4.0, False, None)]
    df = spark.createDataFrame(rows, "user_id string, book_id string, is_read boolean, rating_clean double, has_review_text boolean, reading_duration_days double")
    vec = spark.createDataFrame([(str(i), [float(i >= 4) * 9, float(i % 2) / 10]) for i in range(8)], "book_id string, vec array<double>")
    got = users.taste_modes(df, vec).collect()
    u = [r for r in got if r.user_id == "u"]
    assert len(u) == 2 and sorted(r.n_books for r in u) == [4, 4]
    assert sum(r.weight for r in u) == pytest.approx(1) and sum(r.centroid_weight for r in u) == pytest.approx(1)
    assert [r.vec for r in got if r.user_id == "v"] == [[0.0, 0.0]]


def test_neighbours(spark):
    angle = [0, 10, 20, 35, 90, 140, 200, 260]
    t = spark.createDataFrame([(f"u{a}", [math.cos(math.radians(a)), math.sin(math.radians(a))]) for a in angle], "user_id string, vec array<double>").repartition(3)
    near = knn.neighbours(t.where("user_id in ('u0', 'u90')"), t, 2)
    got = {(r.user_id, r["rank"]): r.neighbour for r in near.collect()}
    assert got == {("u0", 1): "u10", ("u0", 2): "u20", ("u90", 1): "u140", ("u90", 2): "u35"}
    h = spark.createDataFrame([("u10", "a", True), ("u20", "a", True), ("u20", "b", True), ("u0", "b", True)], "user_id string, book_id string, is_read boolean")
    s = {(r.user_id, r.book_id): r.score for r in knn.neighbour_scores(near, h).collect()}
    assert s[("u0", "a")] == pytest.approx(math.cos(math.radians(10)) + math.cos(math.radians(20))) and ("u0", "b") not in s


def star(spark):
    v = spark.createDataFrame([(x,) for x in "habcz"], "id string")
    e = spark.createDataFrame([("a", "h", 1.0, 3), ("b", "h", 1.0, 5), ("c", "h", 1.0, 9)], "a string, b string, w double, co_count int")
    return v, e


def test_graph(spark):
    v, e = star(spark)
    d = {r.id: r.degree for r in graph.degrees(v, e).collect()}
    assert d == {"h": 3, "a": 1, "b": 1, "c": 1, "z": 0}
    pr = {r.id: r["rank"] for r in graph.pagerank(v, e).collect()}
    assert sum(pr.values()) == pytest.approx(1) and max(pr, key=pr.get) == "h" and pr["a"] == pytest.approx(pr["c"])
    s = graph.summary(v, e).first()
    assert (s.nodes, s.edges, s.isolated, s.components) == (5, 3, 1, 2) and s.largest_fraction == 0.8 and s.density == pytest.approx(0.3)
    left = graph.sensitivity(v, e, [2, 5, 10]).orderBy("threshold").collect()
    assert [(r.edges, r.connected_nodes, r.components, r.largest_fraction) for r in left] == [(3, 4, 2, 0.8), (2, 3, 3, 0.6), (0, 0, 5, 0.2)]
    assert [(r.components, r.largest_fraction) for r in graph.sensitivity(v.where("false"), e.where("false"), [2]).collect()] == [(0, 0.0)]
    bt = {r.id: r.betweenness for r in graph.betweenness(v, e).collect()}
    assert bt["h"] == pytest.approx(0.5) and bt["a"] == 0
    uniform = graph.pagerank(v, e.where("false"))
    assert {round(r["rank"], 9) for r in uniform.collect()} == {0.2}


def test_components_of_paths_and_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (95, 95), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == got[90] == 90 and len(got) == 44
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mmr_never_rewards_and_penalises_genres():
    import pandas as pd

    rows = pd.DataFrame({"relevance": [1.0, 0.9, 0.5], "vec": [[1.0, 0.0], [1.0, 0.0], [-1.0, 0.0]], "genres": [[True, False], [True, False], [False, True]]})
    assert rank.diversify(rows, 3, 0.7, 0.15) == [0, 2, 1]
    rows["genres"] = [[True, False], [True, False], [True, False]]
    rows["relevance"] = [1.0, 0.99, 0.1]
    assert rank.diversify(rows, 2, 1.0, 0.0) == [0, 1]


def test_exploration_and_slots(spark):
    scored = spark.createDataFrame([("u", "a", 0, "head", 1.0), ("u", "b", 1, "mid", 0.9), ("u", "c", 2, "tail", 0.8), ("u", "d", 3, "tail", 0.2)], "user_id string, book_id string, macro int, segment string, relevance double")
    picked = spark.createDataFrame([("u", "a", 1)], "user_id string, book_id string, rank int")
    ex = rank.exploration(scored, picked, rank.Config())
    assert [r.book_id for r in ex.orderBy("rank").collect()] == ["c", "b"]
    got = rank.slots(picked, ex, 3, 2).orderBy("rank").collect()
    assert [(r.book_id, r.slot) for r in got] == [("a", "interest"), ("c", "exploration"), ("b", "exploration")]


def test_access_and_weights(spark):
    df = spark.createDataFrame([("p", 100), ("p", 400), ("p", 10), ("p", None)], "g string, n int")
    assert [r.s for r in df.select("n", rank.access_score(F.col("n"), 50, over=["g"]).alias("s")).collect()] == [1.0, 0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        rank.Weights.of(nothing=1.0)
    with pytest.raises(ValueError):
        rank.blend(df, 1.5)


def test_popularity_ties_and_consumed(spark):
    items = spark.createDataFrame([(f"b{i}", 3, 4.0, 1 << i) for i in range(4)], "book_id string, n int, mean_rating double, mask int")
    u = spark.createDataFrame([("u", 4), ("v", 0)], "user_id string, mask int")
    c = spark.createDataFrame([("u", "b0")], "user_id string, book_id string")
    got = rank.popularity_top(u, items, c, 2).orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.book_id) for r in got] == [("u", "b1"), ("u", "b2"), ("v", "b0"), ("v", "b1")]
    g = rank.genre_popularity_top(u, items, c, 2).orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.book_id) for r in g] == [("u", "b2"), ("v", "b0"), ("v", "b1")]
    assert rank.random_top(u, items, c, 9).count() == 7


def test_metrics(spark):
    recs = spark.createDataFrame([("u", "s", 3, 1, "x"), ("u", "s", 3, 2, "a"), ("u", "s", 3, 3, "b")], "user_id string, system string, k int, rank int, book_id string")
    rel = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "a")], "user_id string, book_id string")
    m = metrics.ranking(recs, rel).first()
    assert m.average_precision == pytest.approx((1 / 2 + 2 / 3) / 2) and m.recall == 1 and m.precision == pytest.approx(2 / 3)
    assert m.ndcg == pytest.approx((1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3)))
    per = spark.createDataFrame([(f"u{i}", "s", 5, x) for i, x in enumerate([0.0, 1.0, 0.5, float("nan")])], "user_id string, system string, k int, recall double")
    assert metrics.by_system(per, ["recall"]).first().recall == 0.5
    a, b = (metrics.bootstrap(per, "recall", 200).first() for _ in range(2))
    assert a == b and a.low <= a["mean"] <= a.high


def test_verdict(spark):
    s = spark.createDataFrame([("m", 5, 0.2, 0.2), ("b", 5, 0.1, 0.1), ("m", 10, 0.1, 0.3), ("b", 10, 0.2, 0.1)], "system string, k int, recall double, ndcg double")
    assert {r.k: r.wins for r in metrics.verdict(s, "m", "b").collect()} == {5: True, 10: False}


def test_winner_rules(spark):
    cols = "system string, k int, recall double, ndcg double, coverage double, novelty double, tail_coverage double"
    base = [("B1", k, 0.1, 0.1, 0.2, 3.0, 0.1) for k in (5, 10)] + [("content_only", k, 0.05, 0.05, 0.5, 9.0, 0.3) for k in (5, 10)]
    good = [("x", k, 0.2, 0.2, 0.2, 3.0, 0.1) for k in (5, 10)] + [("y", 5, 0.1, 0.3, 0.2, 3.0, 0.1), ("y", 10, 0.2, 0.3, 0.2, 3.0, 0.1)]
    s = spark.createDataFrame(base + good, cols)
    assert metrics.grid_winner(s, "B1", "content_only").first().winner == "x"
    assert metrics.ab_winner(s, "B1", "content_only").first().winner == "y"
    tied = spark.createDataFrame([(*r, c) for r, c in zip(base, (0.5,) * 4)] + [("x", 10, 0.2, 0.2, 0.2, 3.0, 0.1, 0.4), ("z", 10, 0.2, 0.2, 0.2, 3.0, 0.1, 0.6)], f"{cols}, candidate_recall double")
    assert metrics.ab_winner(tied, "B1", "content_only").first().winner == "z"
    none = spark.createDataFrame(base, cols)
    assert metrics.grid_winner(none, "B1", "content_only").first().winner == metrics.ab_winner(none, "B1", "content_only").first().winner == "content_only"


def test_profiles(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in [(1, 2), (2, 2), (2, 3), (4, 9)]], "a double, b double")
    assert profile.spearman(df, "a", "b").first().rho == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [1.5, 1.5, 3, 4])[0, 1])
    assert profile.concentration(df, "b", [0.25]).first().share == pytest.approx(9 / 16)
    d = {r.key: r.n_duplicates for r in profile.duplicate_counts(spark.createDataFrame([(None, 1), (None, 1), (1, 1)], "x int, y int"), {"x": ["x"], "xy": ["x", "y"]}).collect()}
    assert d == {"x": 1, "xy": 1}
    m = {r.column: (r.n_null, r.n_empty) for r in profile.missing_summary(spark.createDataFrame([("", 1), (None, 2), ("a", None)], "s string, n int")).collect()}
    assert m == {"s": (1, 1), "n": (1, 0)}


def test_contracts(spark):
    a = spark.createDataFrame([("1",), ("2",)], "k string")
    twice = spark.createDataFrame([("1", 5), ("1", 6)], "k string, x int")
    with pytest.raises(contracts.ContractError):
        contracts.joined_one_to_one(a, twice, "k")
    with pytest.raises(contracts.ContractError):
        contracts.joined_many_to_one(a, twice.limit(1), "k")
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(a, ["zz"])
    assert tuple(contracts.id_difference(a, twice.select("k"), "k").first()) == (1, 0)


def test_blocks_and_pca(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 2))
    x = np.hstack([base, base @ rng.normal(size=(2, 3)), rng.normal(size=(60, 1)) * 0.01])
    df = spark.createDataFrame([(str(i), v.tolist(), [1.0, float(i % 2)]) for i, v in enumerate(x)], "book_id string, v array<double>, w array<double>")
    joined = features.joined_blocks([(df.select("book_id", "v"), "v"), (df.select("book_id", "w"), "w")])
    z = np.array([r.features for r in joined.collect()])
    assert z.shape == (60, 8) and np.allclose(z.mean(0), 0, atol=1e-9)
    assert np.allclose(z[:, :6].std(0), 1 / math.sqrt(6)) and np.allclose(z[:, 6], 0)
    c, ratios = features.fit_pca(joined)
    assert ratios.sum() >= 0.95 and ratios[:-1].sum() < 0.95 and np.allclose(c.T @ c, np.eye(c.shape[1]), atol=1e-8)
    assert np.allclose(features.block_shares(c, [6, 2]).sum(1), 1)
    assert features.project(joined, c).first().vec.__len__() == c.shape[1]
    assert 0 <= features.dominated(c, [6, 2], 1) <= 5 and features.importance(c, ratios).shape == (8,)
    assert len(features.interpret(c, ratios, list("abcdefgh"))) == c.shape[1]
    with pytest.raises(ValueError):
        features.fit_pca(joined, threshold=1.0)


def test_ward_and_cuts():
    x = np.array([[0.0], [0.1], [5.0], [5.2], [20.0]])
    merges = cluster.ward(x)
    assert merges[0][:2] == (0, 1) and merges[1][:2] == (2, 3) and [m[2] for m in merges] == sorted(m[2] for m in merges)
    assert cluster.cut(merges, 5, 3) == [0, 0, 1, 1, 2] and cluster.cut(merges, 5, 5) == [0, 1, 2, 3, 4]
    q = cluster.cut_quality(x, [2, 3])
    assert q[1]["silhouette"] > 0.5 and q[1]["davies_bouldin"] < 0.1


def test_kmeans_model_is_kept(spark, tmp_path):
    v = spark.createDataFrame([(str(i), [float(i % 2) * 10, float(i) / 100]) for i in range(20)], "book_id string, vec array<double>")
    a = cluster.fit_or_load(v, 2, f"file://{tmp_path}")
    b = cluster.fit_or_load(v.limit(0), 2, f"file://{tmp_path}")
    assert np.allclose(a.clusterCenters(), b.clusterCenters())
    got = cluster.assign(v, cluster.centres_of(spark, a))
    assert sorted(r["count"] for r in got.groupBy("cluster").count().collect()) == [10, 10]
    assert cluster.silhouette(got, v) > 0.9
    assert cluster.size_stats(got).first().clusters == 2 and cluster.quality_flags(got).count() == 2


def test_retrieval(spark):
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "cluster int, vec array<double>")
    modes = spark.createDataFrame([("u", 0, 0.8, [1.0, 0.1]), ("u", 1, 0.2, [0.0, 1.0])], "user_id string, mode int, weight double, vec array<double>")
    assert [r.cluster for r in retrieve.pooled_clusters(modes, c, 2).orderBy("rank").collect()] == [0, 1]
    assert [r.cluster for r in retrieve.interleaved_clusters(modes, c, 2).orderBy("rank").collect()] == [0, 1]
    bad = spark.createDataFrame([("1", "t", [1.0], 0), ("2", " ", [1.0], 0), ("3", "t", [float("nan")], 0), ("4", "t", [1.0], 7)], "book_id string, title string, vec array<double>, cluster int")
    assert [r.book_id for r in retrieve.eligible(bad, 5).collect()] == ["1"]


def test_habits(spark):
    df = spark.createDataFrame([("u", "a", True, ts("2010-01-01")), ("u", "b", False, ts("2010-01-11")), ("u", "a", True, ts("1012-01-01")), ("w", "a", True, ts("2010-01-01"))], "user_id string, book_id string, is_read boolean, date_added timestamp")
    g = spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "book_id string, f int, g int")
    h = {r.user_id: r for r in habits.proxies(df, g, ["f", "g"], F.lit("2010-01-21").cast("timestamp")).collect()}
    assert (h["u"].n_reads, h["u"].span_days, h["u"].recency_days, h["u"].completion, h["u"].breadth) == (1, 10.0, 10.0, 0.5, 1)
    assert h["u"].monthly == pytest.approx(3.04375) and h["w"].monthly == pytest.approx(30.4375)
