"""Queries without an SQL twin read whole tables."""

from shelfmark.operators import cluster
from shelfmark.plans import fixtures as fx
from shelfmark.plans import registry

SF = "/root/testdata/sf0.01"


def test_clusters_are_of_every_embedding(spark, monkeypatch):
    n = fx.table(spark, SF, "embeddings").count()
    assert n == fx.works(spark, SF) == fx.vectors(spark, SF).count() == fx.items(spark, SF).count()
    assert fx.items(spark, SF).agg({"editions": "sum"}).first()[0] == fx.table(spark, SF, "part").count()
    assert registry.QUERIES["clu_kmeans"](spark, SF).count() == n
    seen = []
    monkeypatch.setattr(cluster, "compare_k", lambda items, *_: seen.append(items.count()))
    registry.QUERIES["clu_compare_k"](spark, SF)
    monkeypatch.setattr(cluster, "macros", lambda *_: None)
    monkeypatch.setattr("shelfmark.operators.retrieve.centroids", lambda items: seen.append(items.count()))
    registry.QUERIES["clu_ward_macros"](spark, SF)
    assert seen == [n, n]


def test_betweenness_takes_every_edge_and_source(spark, monkeypatch):
    from shelfmark.operators import graph, metrics
    from shelfmark.plans import q_profile, q_ranking

    v = spark.createDataFrame([(f"v{i}",) for i in range(80)], "id string")
    e = spark.createDataFrame([(f"v{i}", f"v{i + 1}", 0.1, 3) for i in range(60)], "a string, b string, w double, co_count long")
    monkeypatch.setattr(q_profile, "graph_of", lambda *_: (v, e))
    got = {r.id: r.betweenness for r in q_profile.gra_betweenness(spark, SF).collect()}
    # on a path of 61 vertices, i lies between i earlier ones and 60 - i later ones
    want = {f"v{i}": 2 * i * (60 - i) / (79 * 78) if i <= 60 else 0 for i in range(80)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # isolated vertices take no source from the others
    few = {r.id: r.betweenness for r in graph.betweenness(v, e, sources=61).collect()}
    assert all(abs(few[k] - want[k]) < 1e-9 for k in want)
    seen = []
    monkeypatch.setattr(q_ranking, "per_user", lambda *_: None)
    monkeypatch.setattr(metrics, "bootstrap", lambda *a: seen.append(a[2]))
    q_ranking.eva_bootstrap(spark, SF)
    assert seen == [1000]
