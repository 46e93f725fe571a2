import hashlib

from shelfmark.llm import queries
from shelfmark.llm.merkle import audit, bounds, differing, leaves, tree
from shelfmark.llm.q_merkle import OP2_SQL
from tests.oracle import assert_matches

SCHEMA = "id long, content string, node string"


def records(n):
    return [(i, f"record {i} " * (1 + i % 5), "clash") for i in range(n)]


def test_damage_is_located(spark):
    a = records(9000)
    b = [(i, c + "!" if i == 17 else c[:-1] if i == 5000 else c, x) for i, c, x in a if i not in (4096, 8999)] + [(9100, "new", "x")]
    got = {r.number: r for r in audit(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "id", "content").collect()}
    assert {k: r.kind for k, r in got.items()} == {17: "corrupt", 5000: "corrupt", 4096: "missing", 8999: "missing", 9100: "extra"}
    file = lambda i: (i + 1) // 4096
    for k, r in got.items():
        assert r.file == file(k)
        if r.hash_a:
            assert r.hash_a == hashlib.sha256(a[k][1].encode()).hexdigest()
            assert r.offset_a == sum(len(c) for i, c, _ in a if file(i) == file(k) and i < k)
        if r.hash_b:
            assert r.offset_b == sum(len(c) for i, c, _ in b if file(i) == file(k) and i < k)
    assert got[4096].hash_b is None and got[4096].offset_b is None


def test_only_differing_branches_are_descended(spark):
    a = records(5000)
    b = [(i, c + "?" if i == 4321 else c, x) for i, c, x in a]
    la, lb = (leaves(spark.createDataFrame(x, SCHEMA), "id", "content") for x in (a, b))
    first, last = bounds(la, lb)
    found, counts = differing(tree(la, first, last), tree(lb, first, last))
    assert counts == [1] * len(counts) and [r.number_a for r in found.collect()] == [4321]
    same, counts = differing(tree(la, first, last), tree(la, first, last))
    assert counts == [0] and same.count() == 0


def test_nulls_repeats_and_empty_replicas(spark):
    a = [(1, "x", ""), (1, "x", ""), (1, "y", ""), (2, None, ""), (None, "n", ""), (-7, "", ""), (3, None, "")]
    df = spark.createDataFrame(a, SCHEMA)
    assert audit(df, df.repartition(3), "id", "content").count() == 0
    b = spark.createDataFrame([(1, "y", ""), (1, "x", ""), (1, "y", ""), (2, "", ""), (None, "m", ""), (-7, "", ""), (3, None, "")], SCHEMA)
    assert sorted((r.number or 0, r.kind) for r in audit(df, b, "id", "content").collect()) == [(0, "corrupt"), (1, "corrupt"), (2, "corrupt")]
    none = df.limit(0)
    assert audit(none, none, "id", "content").count() == 0
    assert {r.kind for r in audit(df, none, "id", "content").collect()} == {"missing"}


def test_sql_says_the_same(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert_matches(queries.QUERIES["op2_merkle_audit"](spark, sf), OP2_SQL, sf)
