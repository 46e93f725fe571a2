import zlib
from collections import Counter, defaultdict

from shelfmark.llm import queries
from shelfmark.llm.sharding import external_shuffle, write_shards

SCHEMA = "doc_id long, text string, lang string, _slot string"


def made(n):
    return [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 40), None if i % 5 else "en", "clash") for i in range(n)]


def test_counts_slots_and_rows(spark):
    rows = made(1003)
    out = external_shuffle(spark.createDataFrame(rows, SCHEMA).repartition(7), 16, bucket_bytes=4000).collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in out if r.lang) == sorted((a, b, c) for a, b, c, _ in rows if c)
    shards = defaultdict(list)
    for r in out:
        shards[r._shard].append(r._slot)
    assert set(shards) == set(range(16)) and {len(v) for v in shards.values()} == {62, 63}
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    hot = Counter(r._shard for r in out if r.text == "same text")
    assert max(hot.values()) < 2 * 335 / 16  # copies spread like any rows


def test_reruns_and_layouts_agree_and_seeds_differ(spark):
    df = spark.createDataFrame(made(300), SCHEMA)
    place = lambda d, **o: {r.doc_id: (r._shard, r._slot) for r in external_shuffle(d, 4, bucket_bytes=3000, **o).collect()}
    a = place(df)
    assert a == place(df.repartition(5)) and a != place(df, seed=18)
    order = [k for k, _ in sorted(a.items(), key=lambda x: x[1])]
    assert order != sorted(order)
    neighbours = sum(abs(x - y) == 1 for x, y in zip(order, order[1:], strict=False))
    assert neighbours < 15


def test_nulls_repeats_and_an_empty_table(spark):
    df = spark.createDataFrame([(None, None, None, None)] * 3 + [(1, "a", "x", "y")] * 4 + [(2, "b" * 100_000, None, "")], SCHEMA)
    out = external_shuffle(df, 3).collect()
    assert len(out) == 8 and sorted(Counter(r._shard for r in out).values()) == [2, 3, 3]
    assert external_shuffle(df.limit(0), 3).count() == 0
    assert Counter(r._shard for r in external_shuffle(df.limit(1), 16).collect()) == {0: 1}


def test_rows_alike_are_split_over_buckets(spark):
    rows = [(None, "hot", None, None)] * 2000 + [(i % 2, f"t{i}", "en", "") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    place = lambda d: sorted((r._shard, r._slot, str(r.doc_id), r.text) for r in external_shuffle(d, 5, bucket_bytes=2000, piece_rows=50).collect())
    out = place(df)
    assert out == place(df.repartition(9))
    assert sorted((k, t) for _, _, k, t in out) == sorted((str(r[0]), r[1]) for r in rows)
    assert [(s, k) for s, k, _, _ in out] == [(s, k) for s in range(5) for k in range(500)]
    hot = Counter(s for s, _, _, t in out if t == "hot")
    assert all(300 < hot[s] < 480 for s in range(5))


def shuffled_by_hand(spark, rows, shards, buckets, seed):
    """The law of the query worked out row by row: buckets by hash, in order of hash, each one shuffled, laid end to end."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    hashed = df.select("doc_id", F.xxhash64(*df.columns).alias("h")).select("doc_id", "h", F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(buckets)).alias("b")).collect()
    at, out = 0, {}
    for b in range(buckets):
        mine = [r.doc_id for r in sorted((r for r in hashed if r.b == b), key=lambda r: r.h)]
        # a one-row table in partition b of as many as there are buckets
        parts = spark.range(0, buckets, 1, buckets).where(F.col("id") == b).select(F.shuffle(F.lit(mine) if mine else F.array().cast("array<long>"), F.lit(seed)).alias("x"))
        for doc in parts.first().x:
            shard = at * shards // len(rows)
            out[doc] = (shard, at - -(-shard * len(rows) // shards))
            at += 1
    return out


def test_query_places_rows_by_the_law(spark, monkeypatch):
    from shelfmark.llm import q_sharding

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    monkeypatch.setattr(q_sharding, "external_shuffle", lambda d: external_shuffle(d, bucket_bytes=50_000))
    got = {r.doc_id: (r.shard, r.slot) for r in q_sharding.op9_external_shuffle(spark, sf).collect()}
    width = sum(16 + sum(len(x.encode()) for x in r[1:] if x) for r in docs.collect())
    assert got == shuffled_by_hand(spark, [tuple(r) for r in docs.collect()], 16, -(-width // 50_000), 17)


def test_written_shards(spark, tmp_path):
    df = external_shuffle(spark.createDataFrame(made(100), SCHEMA), 4)
    write_shards(df, f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert sorted((r._shard, r._slot, r.doc_id) for r in back.collect()) == sorted((r._shard, r._slot, r.doc_id) for r in df.collect())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.QUERIES["op9_external_shuffle"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
