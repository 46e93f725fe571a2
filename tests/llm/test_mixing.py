from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import queries
from shelfmark.llm.common import PY_WORD
from shelfmark.llm.mixing import mix, mixed_documents, permuted, quota, taken, targets


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_permutation_and_inverse(n, key):
    x = permuted(np.arange(n), np.array(n), np.array(key, dtype=np.uint64))
    assert sorted(x) == list(range(n))
    assert (permuted(x, np.array(n), np.array(key, dtype=np.uint64), inverse=True) == np.arange(n)).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 10_000), max_size=9))
def test_targets_are_shared_and_capped(sizes):
    t = targets(sizes)
    assert all(x <= 2 * n + 1e-6 for x, n in zip(t, sizes, strict=True))
    assert sum(t) == pytest.approx(1.5 * sum(sizes))
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    level = [x / w for x, w, n in zip(t, weights, sizes, strict=True) if x < 2 * n - 1e-6]
    assert max(level, default=0) == pytest.approx(min(level, default=0))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5000), st.floats(0, 2), st.integers(1, 300), st.integers(0, 9))
def test_a_quotas_draws_add_up_to_its_target(size, part, block, source):
    from shelfmark.llm.mixing import pass_key

    q = quota(source, size, part * size, block, 3)
    lengths = np.full(q.blocks, block)
    lengths[-1] = size - (q.blocks - 1) * block
    total = 0
    for j in range(q.draws):
        turn, at = divmod(j, q.blocks)
        b = permuted(np.array([at]), np.array([q.blocks]), pass_key(3, [source], [turn]))[0]
        total += min(lengths[b], q.last_words if j == q.draws - 1 else block)
    assert total == int(part * size + 0.5)


def rows(spark):
    data = [(i, " ".join(f"w{i}_{k}" for k in range(1 + 37 * i % 400)), f"s{i % 4}" if i % 11 else None, i, "x") for i in range(80)]
    data += [(100, None, "s1", None, None), (101, "", "s2", 0, ""), (102, " \t\n", None, 0, ""), (None, "a b c", "s0", 1, "n"), data[5], data[5]]
    return spark.createDataFrame(data, "doc_id long, text string, source string, size long, off string")


def test_sources_meet_their_targets_and_spans_are_real(spark):
    df = rows(spark)
    plan = mix(df, block_words=16, shard_slots=32)
    out = taken(plan).collect()
    assert len(out) == df.count()
    got = defaultdict(int)
    for r in out:
        got[r.src] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for q in plan.quotas:
        assert got[q.source] == int(q.target + 0.5)
    assert [q.size for q in plan.quotas][-1] == sum(len(PY_WORD.findall(r.text or "")) for r in df.collect() if r.source is None)
    again = {(r.key, r.off): r.taken for r in taken(mix(df.repartition(7), block_words=16, shard_slots=32)).collect()}
    assert again == {(r.key, r.off): r.taken for r in out}
    slots = plan.slots.collect()
    by_shard = defaultdict(list)
    for s in slots:
        by_shard[s.shard].append(s.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_documents_of_the_mix_hold_the_words_taken(spark):
    df = rows(spark).dropDuplicates(["doc_id"]).where("doc_id is not null")
    plan = mix(df, block_words=16, shard_slots=32)
    words = defaultdict(int)
    texts = {r.doc_id: PY_WORD.findall(r.text or "") for r in df.collect()}
    out = mixed_documents(df, plan)
    assert out.columns == df.columns
    for r in out.collect():
        w = PY_WORD.findall(r.text)
        words[r.doc_id] += len(w)
        assert set(w) <= set(texts[r.doc_id])
    for r in taken(plan).collect():
        assert words[r.key] == r.taken


def permuted_by_hand(x, n, key):
    """One value under a source's permutation, in whole numbers."""
    mask64 = (1 << 64) - 1

    def mix64(v):
        v = ((v ^ (v >> 30)) * 0xBF58476D1CE4E5B9) & mask64
        v = ((v ^ (v >> 27)) * 0x94D049BB133111EB) & mask64
        return v ^ (v >> 31)

    bits = 1
    while (1 << 2 * bits) < n:
        bits += 1
    while True:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for r in range(6):
            left, right = right, left ^ (mix64((right + key + (r + 1) * 0x9E3779B97F4A7C15) & mask64) & ((1 << bits) - 1))
        x = (left << bits) | right
        if x < n:
            return x


def key_by_hand(seed, source, turn):
    v = (source * 1_000_003 + turn + seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
    v = ((v ^ (v >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    v = ((v ^ (v >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
    return v ^ (v >> 31)


def test_query_takes_the_words_of_its_draws(spark):
    """Each source's draws laid over its stream one by one, each word counted for the document that holds it."""
    sf, block, seed = "/root/testdata/sf0.001", 128, 29
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mix(docs.select("doc_id", "text", "source"))
    size = {r.doc_id: len(PY_WORD.findall(r.text or "")) for r in docs.collect()}
    streams = defaultdict(list)
    for r in sorted((r for r in plan.documents.collect() if r.size), key=lambda r: (r.src, r.off)):
        assert r.size == size[r.key] and r.off == len(streams[r.src])  # the stream is gapless
        streams[r.src] += [r.key] * r.size
    sources = sorted({r.source for r in docs.collect()}, key=lambda s: (s is None, s or ""))
    goal = targets([sum(size[r.doc_id] for r in docs.collect() if r.source == s) for s in sources])
    want = defaultdict(int)
    for src, words in streams.items():
        left, j, blocks = int(goal[src] + 0.5), 0, -(-len(words) // block)
        while left:
            turn, at = divmod(j, blocks)
            b = permuted_by_hand(at, blocks, key_by_hand(seed, src, turn))
            got = words[b * block : (b + 1) * block][:left]
            for k in got:
                want[k] += 1
            left -= len(got)
            j += 1
    rows = queries.QUERIES["op7_block_mixing"](spark, sf).collect()
    assert {r.doc_id: r.taken for r in rows} == {k: want[k] for k in size}
    by_source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert r.size == size[r.doc_id] and abs(r.target - goal[sources.index(by_source[r.doc_id])]) < 1e-6


def test_rows_of_one_key_are_told_apart(spark):
    text = lambda k: " ".join(f"w{k}_{i}" for i in range(200))
    data = [("k", text(1), "a", "x"), ("k", text(2), "a", "x"), ("k", text(1), "b", "x"), (None, text(3), None, "x"), (None, text(4), None, "x")]
    df = spark.createDataFrame(data, "doc_id string, text string, source string, _k string")
    plan = mix(df, block_words=16, shard_slots=32)
    out = mixed_documents(df, plan).collect()
    got = defaultdict(int)
    for r in out:
        got[r.text.split("_")[0], r.source] += len(r.text.split())
    assert set(got) == {("w1", "a"), ("w2", "a"), ("w1", "b"), ("w3", None), ("w4", None)}
    assert sum(got.values()) == sum(r.taken for r in taken(plan).collect())


def test_empty_table(spark):
    df = rows(spark).limit(0)
    plan = mix(df)
    assert taken(plan).count() == 0 and plan.pieces.count() == 0
    assert mixed_documents(df, plan).count() == 0
