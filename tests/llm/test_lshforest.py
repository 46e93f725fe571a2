import random
from collections import defaultdict

import numpy as np
import pytest

from shelfmark.llm import lshforest
from shelfmark.llm.common import PY_WORD
from shelfmark.llm.lshforest import deduplicated, intersections, near_duplicates, prefix_depth
from shelfmark.llm.shingles import shingle_set


def grams(text):
    w = PY_WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 5 * n >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[root(i)].append(k)
    return sorted((k, min(x for x in least[root(i)]), links[i]) for i, (k, _) in enumerate(rows))


def corpus(seed=3, bases=25, copies=8):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = rng.choices(words, k=40)
    texts = []
    for _ in range(bases):
        base = rng.choices(words, k=rng.randint(3, 200))
        texts.append(base)
        for _ in range(rng.randint(0, copies)):
            x = list(base)
            for _ in range(rng.randint(0, 5)):
                x[rng.randrange(len(x))] = rng.choice(words)
            texts.append(x)
    texts += [shared + rng.choices(words, k=30) for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(1000, rows[0][1]), (1001, rows[0][1].replace(" ", "\n\n")), (1002, "a b"), (1003, "a b"), (1004, "a"), (1005, "")]


def test_same_links_and_classes_as_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(df, block=4).collect())
    assert got == brute(rows)


def test_nulls_repeats_and_an_empty_table(spark):
    same = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(1, same), (1, same), (None, same), (2, None), (3, " \n"), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 2), (1, 1, 2), (None, 1, 2), (2, 2, 0), (3, 3, 0), (4, 4, 0)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in deduplicated(df).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("shared", [7, None])
def test_unlike_texts_of_one_key_stay(spark, shared):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices([f"v{i}" for i in range(500)], k=60))
    near, unique = text(), [text() for _ in range(8)]
    # a near copy of row 3, and texts of their own, all at one key
    rows = [(3, near), (shared, near + " more"), *[(shared, t) for t in unique], (shared, unique[0]), (9, unique[1])]
    kept = deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    least = 9 if shared is None else shared
    assert sorted((r.text, r.doc_id) for r in kept) == sorted([(near, 3), (unique[1], least), *[(t, shared) for t in unique if t != unique[1]]])


def test_prefixes_are_shortened_to_the_target():
    d = prefix_depth(0.8, 32, 0.9999, 12)
    assert 1 - (1 - 0.8**d) ** 32 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 32
    assert prefix_depth(0.8, 1, 0.9999, 12) == 1


def crowd(n=5000, planted=200, seed=8):
    """Pages that share three fifths of all their shingles with each other, and copies of some at 0.8 and more."""
    rng = random.Random(seed)
    common = " ".join(f"c{i}" for i in range(154))
    own = lambda k: [f"u{k}x{i}" for i in range(50)]
    rows = [(k, f"{common} {' '.join(own(k))}") for k in range(n)]
    for p in range(planted):
        changed = own(p)
        for i in range(50 - rng.randint(1, 16), 50):
            changed[i] = f"v{p}x{i}"
        rows.append((n + p, f"{common} {' '.join(changed)}"))
    return rows


@pytest.mark.parametrize("lane", [4096, 50])
def test_planted_pairs_are_found_among_thousands_of_similar_pages(spark, monkeypatch, lane):
    monkeypatch.setattr(lshforest, "LANE", lane)
    rows = crowd()
    assert 0.58 < len(grams(rows[0][1]) & grams(rows[1][1])) / len(grams(rows[0][1]) | grams(rows[1][1])) < 0.62
    made = lshforest.forest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text")
    named = made.nodes.select("node", "first")
    linked = {r.first: r.links for r in made.links.groupBy("node").agg({"links": "sum"}).join(named, "node").toDF("node", "links", "first").collect()}
    assert linked == {k: 1 for p in range(200) for k in (p, 5000 + p)}  # all planted pairs, and no others
    work = made.verified().agg({"pairs": "sum", "nodes": "max"}).first()
    assert work["sum(pairs)"] < 2000 and work["max(nodes)"] < 20, work  # of 13 million pairs


def test_a_chain_of_crowded_nodes_is_one_class(spark, monkeypatch):
    monkeypatch.setattr(lshforest, "LANE", 8)
    rows = [(k, " ".join([f"c{i}" for i in range(150)] + [f"u{(k + i) // 4}" for i in range(12)])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(df, block=8).collect()) == brute(rows)


def test_intersections_in_runs(monkeypatch):
    monkeypatch.setattr(lshforest, "COLUMNS", 64)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 900, n).astype(np.uint64)) for n in (1, 5, 300, 600, 600)]
    got = intersections(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))


@pytest.mark.parametrize("text,n", [(None, 0), (" ", 0), ("a", 1), ("a b c d e", 1), ("a b c d e f", 2), ("a " * 99, 1)])
def test_shingle_counts(text, n):
    assert len(shingle_set(text)) == n


def test_sql_finds_the_same_links(spark):
    from shelfmark.llm import queries
    from tests.oracle import assert_matches

    sf = "/root/testdata/sf0.001"
    assert assert_matches(queries.QUERIES["op10_lsh_forest_join"](spark, sf), queries.ORACLES["op10_lsh_forest_join"], sf) == 200
