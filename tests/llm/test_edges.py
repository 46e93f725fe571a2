"""Every query and pipeline stage over awkward documents: nulls in any column, empty and long texts, repeats, clashing names, no rows."""

import pytest

import corpus_pipeline as P
from shelfmark.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, size string, packed string, _words string, class_id int, `key` string, `row` string"
PROSE = " ".join(f"the river{i} of stone{i} and the light{i}" for i in range(20))
TEXTS = [None, "", " \n\t", "a", PROSE, PROSE, PROSE + " more", "x" * 200_000, "Ein Wort. " * 300, "12 34", "\u0000 é漢", " ".join(f"w{i}" for i in range(30_000))]


def rows():
    out = []
    for i, t in enumerate(TEXTS):
        out.append((i, t, None if i % 4 == 1 else ("en", "de")[i % 2], None if i % 3 == 2 else f"s{i % 2}", None if t is None else len(t), "kept", None, "7", "p", "w", 3, "k", "r"))
    return out + [(None, PROSE, "en", "s0", 1, None, None, None, None, None, None, None, None)] + out[4:5]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("awkward")
    df = spark.createDataFrame(rows(), SCHEMA)
    df.coalesce(2).write.parquet(f"file://{d}/full/documents.parquet")
    df.limit(0).coalesce(1).write.parquet(f"file://{d}/none/documents.parquet")
    pages = spark.createDataFrame([(1, "u", "h"), (1, "u", "h"), (None, None, None), (3, None, ""), (900_000, "u", "é" * 1000)], "page_id long, url string, html string")
    pages.write.parquet(f"file://{d}/full/pages.parquet")
    pages.limit(0).coalesce(1).write.parquet(f"file://{d}/none/pages.parquet")
    return f"file://{d}"


PER_ROW = ["op1_license_digests", "op3_quality_rules", "op5_word_backoff_langid", "op6_edit_aware_counts", "op7_block_mixing", "op8_oph_fingerprints", "op9_external_shuffle", "op10_lsh_forest_join"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_over_awkward_documents(spark, awkward, name):
    out = queries.QUERIES[name](spark, f"{awkward}/full").collect()
    if name in PER_ROW:
        assert len(out) == len(rows())
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows())
    assert queries.QUERIES[name](spark, f"{awkward}/none").count() == 0


def test_stages_over_awkward_documents(spark, awkward):
    raw = spark.read.parquet(f"{awkward}/full/documents.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, raw, awkward)
        assert out.count() > 0, name
        assert name == "packing" or out.columns == P.COLUMNS
        assert stage(spark, raw.limit(0), awkward).count() == 0
    kept = P.near_duplicates(spark, raw, awkward).collect()
    texts = [r.text for r in kept]
    assert texts.count(PROSE) == 1 and len(kept) == len(TEXTS) - 2


def test_the_whole_pipeline(spark, awkward):
    assert P.run(spark, f"{awkward}/full").count() > 0
    assert P.run(spark, f"{awkward}/none").count() == 0
