"""Queries over all candidates of a reader: pairs of reader and item are neither joined nor exchanged, and both ways agree."""

import time

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from shelfmark import store
from shelfmark.operators import cooc, features, knn, lists, metrics, rank, recommend, retrieve, shelf, users
from shelfmark.plans import fixtures, q_curation, registry
from tests.oracle import rows

SF = "/root/testdata/sf0.001"
BESIDE = [
    "rnk_relevance",
    "coo_percentile_blend",
    "rnk_mmr",
    "rnk_slots",
    "eva_slot_metrics",
    "ret_candidates",
    "eva_candidate_recall",
    "coo_candidates",
    "coo_max_pmi",
    "exp_collaborative_ab",
    "exp_collaborative_winner",
    "exp_ablation",
    "rec_routed",
    "rec_explained",
    "rec_sample",
    "rnk_hybrid",
    "exp_ranker_grid",
    "exp_grid_winner",
]


def refuse(*_, **__):
    raise AssertionError("pairs of readers and items were joined")


@pytest.mark.parametrize("name", BESIDE)
def test_no_pairs_are_joined(spark, monkeypatch, name):
    joined = shelf.CELLS
    monkeypatch.setattr(shelf, "CELLS", 0)
    want = rows(r.asDict() for r in registry.QUERIES[name](spark, SF).collect())
    monkeypatch.setattr(shelf, "CELLS", joined)
    monkeypatch.setattr(retrieve, "candidates", refuse)
    monkeypatch.setattr(retrieve, "relevance", refuse)
    assert rows(r.asDict() for r in registry.QUERIES[name](spark, SF).collect()) == want


@pytest.mark.parametrize("trade", [0.5, 0.7, 0.9])
def test_picks_among_the_most_relevant_hold_for_all(trade):
    rng = np.random.default_rng(1)
    for narrow in (1.0, 0.01):
        vec, rel, genres = rng.normal(size=(3000, 8)), 0.5 + narrow * rng.random(3000), rng.random((3000, 5)) < 0.3
        vec[100:900], rel[100:900] = vec[100], rel[100]
        s = shelf.Shelf(pa.array([str(i) for i in range(3000)]), vec, np.arange(1), np.zeros(3000, int), vec[:1], {"genres": genres})
        rows = np.arange(3000)
        want = rank.greedy(np.round(rel, 12), s.units(rows), genres, 10, trade, 0.15)[0]
        assert list(shelf.diverse(s, rows, rel, 10, trade, 0.15)) == want


def test_picks_start_once(monkeypatch):
    rng = np.random.default_rng(3)
    vec, rel, genres = rng.normal(size=(2000, 8)), 0.5 + 0.01 * rng.random(2000), rng.random((2000, 5)) < 0.3
    s = shelf.Shelf(pa.array([str(i) for i in range(2000)]), vec, np.arange(1), np.zeros(2000, int), vec[:1], {"genres": genres})
    want = rank.greedy(np.round(rel, 12), s.units(np.arange(2000)), genres, 10, 0.7, 0.15)[0]
    monkeypatch.setattr(rank, "greedy", refuse)
    assert list(shelf.diverse(s, np.arange(2000), rel, 10, 0.7, 0.15)) == want
    assert list(shelf.diverse(s, np.arange(5), rel[:5], 10, 0.7, 0.15))[0] == int(rel[:5].argmax())


def test_lloyd_keeps_its_starts_and_rounds():
    def plain(x, k, seed, starts=10):
        rng, best = np.random.default_rng(seed), None
        for _ in range(starts):
            c = x[[rng.integers(len(x))]]
            while len(c) < k:
                d = ((x[:, None] - c[None]) ** 2).sum(-1).min(1)
                c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() else rng.integers(len(x))]])
            for _ in range(100):
                d = ((x[:, None] - c[None]) ** 2).sum(-1)
                new = np.array([x[d.argmin(1) == j].mean(0) if (d.argmin(1) == j).any() else x[d.min(1).argmax()] for j in range(k)])
                if np.allclose(new, c):
                    break
                c = new
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            if best is None or d.min(1).sum() < best[0]:
                best = d.min(1).sum(), c, d.argmin(1)
        return best[1:]

    rng = np.random.default_rng(4)
    for i in range(30):
        x = rng.normal(size=(6 + i, 7)) if i % 3 else rng.integers(0, 2, size=(6 + i, 2)).astype(float)
        for got, want in zip(users.lloyd(x, 2 + i % 3, 42), plain(x, 2 + i % 3, 42), strict=True):
            assert np.array_equal(got, want)


def test_projection_takes_no_call_a_number(spark, monkeypatch):
    c = np.array([[1.0, -2.5e-7], [0.1, 1e22], [-3.0, 0.0]])
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [0.5, 0.0, -1.0])], "book_id string, features array<double>")
    real, calls = F.lit, []
    monkeypatch.setattr(features.F, "lit", lambda x: calls.append(x) or real(x))
    got = {r.book_id: r.vec for r in features.project(df, c).collect()}
    assert len(calls) <= c.shape[1]
    assert np.allclose([got["a"], got["b"]], np.array([[1.0, 2.0, 3.0], [0.5, 0.0, -1.0]]) @ c, rtol=1e-12)


def test_first_titles_and_ties():
    titles = np.array(["a", "a", "", "", "b", "a", None, "b"], dtype=object)
    assert shelf.first_titles(np.arange(8), titles, 4) == [0, 2, 3, 4]
    assert shelf.first_titles(np.arange(8), titles, 7) == [0, 2, 3, 4, 6, 1, 5]
    assert list(shelf.half_up(np.array([0.0001953125, -0.5, 2.5]), 9)) == [0.000195313, -0.5, 2.5]
    x = np.array([3.0, 0.0, 0.0, 7.0, 3.0])
    found, at = np.unique(x, return_inverse=True)
    assert list(shelf.percentile_of(at, len(found) + 2)) == list(shelf.percentile(x))


def test_neighbours_of_many_batches_are_those_of_one(spark):
    rng = np.random.default_rng(2)
    vec = rng.integers(-2, 3, size=(400, 3)).astype(float)  # many ties
    t = spark.createDataFrame([(f"u{i}", v.tolist()) for i, v in enumerate(vec)], "user_id string, vec array<double>").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    ask = lambda: sorted(map(tuple, knn.neighbours(t.where("user_id like '%7'"), t, 5).collect()))
    one = ask()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert ask() == one and len(one) == 200
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|")
    return {f for f in files.split("|") if "shuffle_" in f}


def test_written_tables_leave_no_exchange_on_disk(spark):
    before, setting = shuffle_files(spark), spark.conf.get(store._CLEANUP, None)
    t = store.written(spark.range(5000).groupBy((F.col("id") % 7).alias("g")).count(), "t")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert t.count() == 7 and spark.conf.get(store._CLEANUP, None) == setting


def test_canonical_rows_travel_as_numbers(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = q_curation.best(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange hashpartitioning") == 3
    below = plan[plan.index("REPARTITION_BY_COL") :]
    assert "engagement_mode" not in below and "AS user_id" not in below


def test_dates_are_whole_again(spark):
    told = ["1969-12-31 23:59:59.999999", "1995-06-17 00:00:00", "2300-01-02 03:04:05.678901", "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"]
    df = spark.createDataFrame([(x,) for x in told], "s string").select(F.col("s").cast("timestamp").alias("t"))
    for date in (df, df.select(F.col("t").cast("timestamp_ntz").alias("t")), spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS t")):
        got = date.select(F.col("t").cast("timestamp").alias("t"), *fixtures._parted("t", "x")).select("t", fixtures._whole("x").alias("u"))
        assert got.where("not (t <=> u)").count() == 0


HISTORY = [("a", "x", True, 5.0), ("a", "y", True, 4.0), ("a", "y", True, 5.0), ("a", "z", False, None), ("b", "y", False, 4.0), ("c", "none", True, 5.0), ("d", None, True, 4.0), ("d", "z", True, 1.0), (None, "x", True, 5.0), ("e", "x", None, 2.0)] + [(f"u{i}", b, True, 5.0) for i in range(4) for b in "xyz"]


def test_popularity_beside_the_reader(spark):
    h = spark.createDataFrame(HISTORY, "user_id string, book_id string, is_read boolean, rating_clean double")
    items = spark.createDataFrame([(b, n, m) for b, n, m in (("x", 3, 4.0), ("y", 5, None), ("z", 3, 4.0), ("w", 0, None), ("v", 9, 5.0))], "book_id string, n long, mean_rating double")
    met = h.join(items.select("book_id"), "book_id").select("user_id")
    for k in (1, 2, 10):
        want = rows(r.asDict() for r in rank.popularity_top(met, items, h.where("is_read"), k).select("user_id", "book_id", "rank").collect())
        assert rows(r.asDict() for r in shelf.popular_unread(shelf.grouped(h), items, k).collect()) == want
    assert shelf.popular_unread(shelf.grouped(h), items.union(items), 2) is None


def test_pairs_of_lists(spark):
    h = spark.createDataFrame(HISTORY, "user_id string, book_id string, is_read boolean, rating_clean double")
    for cap in (200, 2):
        want = rows(r.asDict() for r in cooc.pairs(users.positives(h), cap, order=F.col("book_id")).collect())
        assert rows(r.asDict() for r in cooc.pairs(users.positives(h), cap).collect()) == want
        assert rows(r.asDict() for r in cooc.pairs_of(shelf.liked_of(shelf.grouped(h)), cap).collect()) == want


def test_lists_are_dealt_by_reader_once(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        recs = spark.createDataFrame([("a", "s", 2, 1, "x"), ("a", "s", 2, 2, "y"), ("b", "s", 2, 1, "x"), ("q", "s", 2, 1, None)], "user_id string, system string, k int, rank int, book_id string")
        rel = spark.createDataFrame([("a", "y"), ("a", "y"), ("a", "z"), ("b", "w"), ("q", None), (None, "x")], "user_id string, book_id string")
        got = metrics.ranking(recs, rel)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") - plan.count("Exchange hashpartitioning(user_id") == 0
        assert [(r.user_id, r.precision, r.recall, round(r.ndcg, 6), r.average_precision) for r in got.orderBy("user_id").collect()] == [("a", 0.5, 0.5, 0.386853, 0.25), ("b", 0.0, 0.0, 0.0, 0.0), ("q", 0.0, 0.0, 0.0, 0.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("name", ["exp_collaborative_winner", "exp_grid_winner"])
def test_baselines_meet_no_order_by_joins(spark, monkeypatch, name):
    monkeypatch.setattr(rank, "popularity_top", refuse)
    assert registry.QUERIES[name](spark, SF).count() == 1


def test_profiles_of_recommendations_are_made_beside_the_reader(spark, monkeypatch):
    monkeypatch.setattr(recommend, "profiles", refuse)
    monkeypatch.setattr(users, "taste_modes", refuse)
    assert registry.QUERIES["rec_explained"](spark, SF).count() > 0


def test_reads_of_neighbours_stay_where_they_are(spark):
    near = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.25), ("b", "c", -0.5), ("c", "a", 1.0)], "user_id string, neighbour string, similarity double")
    h = spark.createDataFrame([("b", "x", True, 5.0), ("b", "x", True, 1.0), ("c", "x", True, 3.0), ("c", "y", True, 3.0), ("a", "z", False, 3.0)], "user_id string, book_id string, is_read boolean, rating_clean double")
    want = rows(r.asDict() for r in knn.read_by(near, h.where("is_read").select("user_id", "book_id").distinct()).collect())
    assert rows(r.asDict() for r in knn.read_by_lists(near, shelf.reads_of(shelf.grouped(h))).collect()) == want


def test_hybrid_neighbours_take_one_python_step(spark, monkeypatch):
    plans, real = [], knn.read_by_lists
    monkeypatch.setattr(knn, "read_by_lists", lambda near, reads: plans.append(near._jdf.queryExecution().executedPlan().toString()) or real(near, reads))
    registry.QUERIES["rnk_hybrid"](spark, SF)
    assert len(plans) == 1 and plans[0].count("MapInArrow") + plans[0].count("MapInPandas") == 1


def a_shelf(n, seed, places):
    """A shelf with many equal vectors and some of length zero; `places`: digits that are kept."""
    rng = np.random.default_rng(seed)
    vec = np.round(rng.normal(size=(n, 10)), places)
    vec[n // 4 : n // 3], vec[n // 2 : n // 2 + 40], vec[3] = vec[: n // 3 - n // 4], vec[n // 2], 0
    code = rng.integers(0, 10, n)
    centres = np.array([vec[code == i].mean(0) for i in range(10)])
    pages = (rng.integers(1, 12, n) * 20).astype(float)
    pages[::50] = np.nan
    more = {"genres": rng.random((n, 5)) < 0.4, "segment": rng.choice(["tail", "mid", "head", "unknown"], n), "macro": code // 2, "listed": rng.random(n) > 0.01, "num_pages": pages}
    return rng, shelf.Shelf(pa.array([f"{i:05d}" for i in range(n)]), vec, np.arange(10), code, centres / np.linalg.norm(centres, axis=1)[:, None], more)


@pytest.mark.parametrize("places", [1, 9])
def test_lists_by_blocks_are_those_of_each_reader(places):
    rng, s = a_shelf(2500, 7, places)
    profile, readers = shelf.profiled(0.5), []
    for i in range(60):
        own = np.sort(rng.integers(0, 2500, 1 + i % 13))
        weight, vec = profile(s, own)
        readers.append(shelf.Reader(f"u{i}", np.append(own, rng.integers(0, 2500, 14)), weight, vec / shelf._lengths(vec)[:, None], {}))
    few, tiny = shelf.Reader("few", np.arange(2480), np.ones(1), s.vec[:1] / s.length[0], {}), rank.Config(k=3, explore=1)
    readers += [few, shelf.Reader("all", np.arange(2500), np.ones(1), few.unit, {}), shelf.Reader("zero", few.read, np.ones(1), few.unit * 0, {})]
    settings = {"a": (rank.Config(), 5), "b": (rank.Config(trade=0.5), 5), "c": (rank.Config(explore=4), 15), "d": (rank.Config(explore=0), 8), "e": (tiny, 1), "f": (rank.Config(trade=1.0), 5), "g": (rank.Config(trade=0.0), 5)}
    for of in (lambda m: m.recommended(rank.Config()), lambda m: m.recommended(tiny), lambda m: m.sweep(settings)):
        got = {r.user: told for block in shelf._blocks(s, iter(readers)) for r, told in of(lists)(s, block)}
        for r, x in shelf._relevance(s, readers):
            want = of(shelf)(s, r, x)
            assert [list(c) for c in got[r.user]] == [list(c) for c in want]


@pytest.mark.parametrize("name", ["rec_routed", "rec_explained", "exp_ablation", "exp_backtest"])
def test_lists_are_made_by_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(shelf, "diverse", refuse)
    monkeypatch.setattr(shelf, "recommended", refuse)
    monkeypatch.setattr(shelf, "sweep", refuse)
    assert registry.QUERIES[name](spark, SF).count() > 0
