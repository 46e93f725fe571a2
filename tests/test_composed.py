"""Closed-form cases of the composed operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import contracts, curation, features, graph, metrics, profile, rank, recommend
from shelfmark.sources import files


def test_drop_list(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert contracts.without(df, ["b", "zz"]).columns == ["a", "c"]
    with pytest.raises(contracts.ContractError):
        contracts.without(df, ["a", "b", "c"])


def test_logs_and_caps_keep_nulls(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)] + [(None,), (-5.0,)], "x double")
    rows = curation.logged_and_capped(df, ["x"], 0.5).collect()
    by = {r.x: r for r in rows}
    assert by[None].x_log1p is None and by[None].x_p99_capped is None
    assert by[-5.0].x_log1p == 0 and by[-5.0].x_p99_capped == -5
    assert by[100.0].x_p99_capped == 49.5 and by[3.0].x_p99_capped == 3


def test_books_without_rows_or_activity(spark):
    schema = "book_id string, title string, language_code string, format string, publisher string, is_ebook string, publication_year string, num_pages string, ratings_count string, authors array<struct<author_id:string,role:string>>, shelves array<struct<name:string,count:long>>, source_ord long"
    rows = [("1", " A ", " ", "PDF ", None, "True", "1800", "x", "7", None, None, 2), ("1", "later", None, None, None, None, None, None, None, None, None, 3), ("2", "B", "EN", None, "P", "0", "2030", "50", None, [("9", "")], [("Dragons", 4), ("to-read", 6)], 1)]
    active = spark.createDataFrame([("2", 3, 1, 0, 0, 2, 4.0)], "book_id string, interaction_count long, explicit_rating_count long, review_count long, shelf_only_count long, read_count long, mean_user_rating double")
    got = {r.book_id: r for r in curation.curated_books(spark.createDataFrame(rows, schema), active, {"dragon": ["dragon"]}).collect()}
    one, two = got["1"], got["2"]
    assert (one.title, one.language_code_clean, one.format_clean, one.is_ebook, one.publication_period, one.num_pages) == ("A", None, "pdf", True, "1800-1899", None)
    assert (one.interaction_count, one.mean_user_rating, one.is_cold_start_all_books, one.is_cold_start_interacted_books, one.interaction_confidence_bucket) == (0, None, True, False, "none")
    assert (two.publication_year_clean, two.main_author_id, two.to_read_count, two.theme_dragon, two.theme_count, two.interaction_confidence_bucket) == (None, "9", 6, True, 1, "low")
    assert curation.curated_books(spark.createDataFrame([], schema), active, {"dragon": ["dragon"]}).count() == 0


def test_hashed_vectors(spark):
    df = spark.createDataFrame([("a", "Red red fox"), ("b", "fox RED red!"), ("c", ""), ("d", None)], "id string, t string")
    got = {r.id: np.array(r.vec) for r in features.hashed_vectors(df, "id", "t", 32).collect()}
    assert (got["a"] == got["b"]).all() and len(got["a"]) == 32
    assert sorted(np.abs(got["a"][got["a"] != 0])) in ([1, 2], [1], [3])
    assert not got["c"].any() and not got["d"].any()


def test_component_report():
    c = np.array([[0.9, 0.0], [-0.3, 0.1], [0.1, 0.0], [0.2, 0.9]])
    rows = features.component_report(c, np.array([0.7, 0.2]), ["pop", "year", "flag"], {"named": 3, "text": 1}, "text", {"popularity": {"pop"}, "recency": {"year"}})
    assert (rows[0]["title"], rows[0]["pattern"], rows[0]["semantic"], rows[0]["high"], rows[0]["low"]) == ("pop / year", "popularity", False, ["pop", "flag"], ["year"])
    assert (rows[1]["title"], rows[1]["pattern"], rows[1]["semantic"]) == ("year / - (semantic)", "recency", True)


def test_rank_shift():
    c = np.array([[1.0, 0.0], [0.5, 3.0]])
    assert features.rank_shift(c, np.array([0.6, 0.4]), ["a", "b"], first=1) == [("b", pytest.approx(1.5), 1, 2, -1), ("a", pytest.approx(0.6), 2, 1, 1)]


def test_graph_view(spark):
    items = spark.createDataFrame([("1", 1), ("2", 1), ("3", 0)], "book_id string, g int")
    edges = spark.createDataFrame([("1", "2", 0.5), ("1", "3", 0.9), ("2", "1", 0.1)], "a string, b string, w double")
    assert [tuple(r) for r in graph.view(items, edges, 0.5, F.col("g") == 1).collect()] == [("1", "2", 0.5)]
    assert graph.view(items, edges, 0.5).count() == 2


def test_signal_rows(spark):
    df = spark.createDataFrame([("m", 5, 0.1, 0.2, "cooccurrence"), ("b", 5, 0.1, 0.2, "none")], "system string, k int, recall double, ndcg double, collaborative_signal string")
    assert [tuple(r) for r in metrics.signal_rows(df).collect()] == [("m", 5, 0.1, 0.2)]
    assert metrics.signal_rows(df.drop("collaborative_signal")) is None


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a, "b"\nc', 1.5), (2, None, None)], "i int, t string, x double")
    files.write_csv(df, f"file://{tmp_path}/t")
    assert sorted(map(tuple, files.csv_table(spark, f"file://{tmp_path}/t", "i int, t string, x double").collect())) == [(1, 'a, "b"\nc', 1.5), (2, None, None)]


def test_chart(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    told = json.loads(files.chart(df, "name", "n"))
    assert told["encoding"]["x"]["type"] == "nominal" and told["encoding"]["y"]["type"] == "quantitative" and len(told["data"]["values"]) == 2
    with pytest.raises(ValueError):
        files.chart(df, "name", "n", limit=1)


def test_full_profile_names(spark):
    books = spark.createDataFrame([("1", 5), ("2", 7)], "book_id string, pages int")
    acts = spark.createDataFrame([("u", "1", 4.0), ("u", "1", None)], "user_id string, book_id string, rating_clean double")
    got = profile.full(books, books, acts, acts, {"book": ("books", ["book_id"]), "pair": ("interactions", ["user_id", "book_id"])}, ["pages"], ["rating_clean"], {})
    assert {r.metric: r.value for r in got["summary"].collect()} == {"books_raw_rows": 2, "interactions_raw_rows": 2, "books_clean_rows": 2, "interactions_clean_rows": 2, "explicit_rating_pct": 0.5, "books_columns": 2, "interactions_columns": 3}
    assert {r.key: r.n_duplicates for r in got["duplicates"].collect()} == {"book": 0, "pair": 1}
    assert {r.column: r.n_present for r in got["interactions_schema"].collect()} == {"user_id": 2, "book_id": 2, "rating_clean": 1}
    with pytest.raises(ValueError):
        profile.full(books, books, acts, acts, {"book": ("books", ["book_id"])}, ["pages"], ["rating_clean"], {"summary": books})


def test_sample_has_the_demo(spark):
    vec = lambda *x: [float(v) for v in x]
    items = spark.createDataFrame([("1", "A", vec(1, 0), 0, 0, 100, "head", [True]), ("2", "B", vec(0, 1), 1, 1, 60, "tail", [False]), ("3", "C", vec(1, 0.1), 0, 0, 40, "mid", [True])], "book_id string, title string, vec array<double>, cluster int, macro int, num_pages int, segment string, genres array<boolean>")
    known = spark.createDataFrame([("u", 0, 1.0, vec(1, 0)), ("v", 0, 1.0, vec(0, 1))], "user_id string, mode int, weight double, vec array<double>")
    read = spark.createDataFrame([("u", "1")], "user_id string, book_id string")
    got = recommend.sample(spark.createDataFrame([("u",)], "user_id string"), known, items, items.select("book_id", "vec"), read, rank.Config()).collect()
    assert {r.user_id for r in got} == {"u", recommend.DEMO}
    assert "1" not in {r.book_id for r in got if r.user_id == "u"}
    assert [(r.book_id, r.slot) for r in sorted(got, key=lambda r: r.rank) if r.user_id == recommend.DEMO] == [("1", "cold_start"), ("2", "cold_start")]
