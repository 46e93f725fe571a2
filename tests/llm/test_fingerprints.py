import hashlib
import random
import struct

import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import queries
from shelfmark.llm.common import PY_WORD, words_of
from shelfmark.llm.fingerprints import as_text, edited, fingerprinted, likeness, with_next
from shelfmark.llm.shingles import shingle_set


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(2000)]
    return [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 5, 9, 60, 400, 900]))) for _ in range(n)]


def jaccard(a, b):
    x, y = set(shingle_set(a).tolist()), set(shingle_set(b).tolist())
    return 1.0 if not x and not y else len(x & y) / max(1, len(x | y))


def test_likeness_tells_the_jaccard_similarity(spark):
    rng = random.Random(2)
    rows, errors = [], []
    for i in range(150):
        a = [f"w{rng.randrange(9999)}" for _ in range(500)]
        cut = rng.randrange(501)
        rows.append((i, " ".join(a), " ".join(a[:cut] + [f"v{rng.randrange(9999)}" for _ in range(500 - cut)])))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    x = fingerprinted(df.select("i", "a"), "a").withColumnRenamed("packed", "pa")
    y = fingerprinted(df.select("i", "b"), "b").withColumnRenamed("packed", "pb")
    got = {r.i: r.n for r in x.join(y, "i").select("i", likeness(F.col("pa"), F.col("pb")).alias("n")).collect()}
    for i, a, b in rows:
        errors.append(got[i] - jaccard(a, b))
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.012
    assert sum(map(abs, errors)) / len(errors) < 0.05


def test_short_texts_fill_all_bins_and_equal_texts_agree(spark):
    t = [None, "", " ", "a", "a b", "a b c d", "a b c d e", "a b c d e f", "a b", "x " * 300]
    out = [r for r in fingerprinted(spark.createDataFrame([(i, x, "clash") for i, x in enumerate(t)], "doc_id long, text string, packed string")).select("doc_id", as_text(F.col("packed")).alias("f")).orderBy("doc_id").collect()]
    f = [r.f for r in out]
    assert f[0] == f[1] == f[2] == "" and f[4] == f[8] and all(len(x) == 128 for x in f[3:])
    assert len(set(f[3:8])) == 5


def test_next_rows_across_ranges(spark):
    t = texts(60)
    ids = random.Random(4).sample(range(-50, 10_000), 60)
    df = spark.createDataFrame(list(zip(ids, t, strict=True)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in with_next(df, ["doc_id", "text"], range_bytes=4000).collect()}
    order = sorted(ids)
    text = dict(zip(ids, t, strict=True))
    assert len(got) == 60
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        assert got[a].next_doc_id == b and got[a].next_text == text[b]


def test_edited_texts(spark):
    t = ["", "é", "abc", "ünï", "a" * 9]
    df = spark.createDataFrame([(a, b) for a in t for b in t], "a string, b string")
    for r in df.select("a", "b", edited(F.col("a"), F.length("a"), F.col("b")).alias("e")).collect():
        half = len(r.a) // 2
        assert r.e == r.a[: len(r.a) - half] + r.b[:half]
        assert hashlib.sha256(r.e.encode()).hexdigest()


def test_one_row_null_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert with_next(df, ["text"]).first().next_text == "a b"
    assert with_next(df.limit(0), ["text"]).count() == 0
    two = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    assert sorted(r.next_text for r in with_next(two, ["text"], range_bytes=1).collect()) == ["a", "a", "b", "c"]


def fingerprint_by_hand(text):
    """Bins, filled bins and packed bits worked out one by one; XXH64 is the one thing shared with the operator."""
    words = PY_WORD.findall(text)
    if not words:
        return ""
    hashes = []
    for i in range(max(1, len(words) - 4)):
        seed = 42
        for w in words[i : i + 5]:
            seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
        hashes.append(seed >> 1)
    bins = {}
    for h in hashes:
        bins[h >> 56] = min(h, bins.get(h >> 56, h))
    out = ""
    for b in range(128):
        probe = [x for x in range(128) if x != b]
        random.Random(23 * 1000 + b).shuffle(probe)
        value = next(bins[x] for x in [b, *probe] if x in bins)
        low = xxhash.xxh64_intdigest(struct.pack("<i", b), seed=xxhash.xxh64_intdigest(struct.pack("<q", value), seed=42))
        out += f"{low & 15:x}"
    return out


def likeness_by_hand(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 128
    return min(1.0, max(0.0, (same - 1 / 16) / (1 - 1 / 16)))


def test_query_against_fingerprints_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.QUERIES["op8_oph_fingerprints"](spark, sf).collect()}
    assert len(got) == len(rows)
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r, f, e = got[key], fingerprint_by_hand(text), fingerprint_by_hand(new)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(new.encode()).hexdigest(), f, e)
        assert abs(r.near_edited - likeness_by_hand(f, e)) < 1e-9 and abs(r.near_next - likeness_by_hand(f, fingerprint_by_hand(after))) < 1e-9


def test_names_that_clash_and_keys_of_one_value(spark):
    n = 40
    df = spark.createDataFrame([(None, f"t{i % 7} x", "a", "b", "c", "d") for i in range(n)], "doc_id string, text string, place string, r string, next_text string, _words string").repartition(3)
    out = with_next(fingerprinted(df), ["text", "packed"], range_bytes=20).collect()
    assert len(out) == n and all((r.place, r.r, r._words) == ("a", "b", "d") for r in out)
    after = {}
    for r in out:
        after.setdefault(r.text, set()).add(r.next_text)
    # rows of one text follow each other, and the texts are one ring
    ring, at = [], "t0 x"
    for _ in range(7):
        ring.append(at)
        assert at in after[at]
        (at,) = after[at] - {at}
    assert at == "t0 x" and len(set(ring)) == 7


def test_words_at_the_ends(spark):
    df = spark.createDataFrame([(t,) for t in ("", " ", " a", "a ", "\n\ta  b \x0b", "a")], "t string").select("t", words_of("t").alias("w"))
    for r in df.collect():
        assert r.w == r.t.split()
