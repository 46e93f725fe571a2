"""The pipeline's stages against brute force on the smallest table."""

from collections import defaultdict

import pytest

import corpus_pipeline as P
from shelfmark.llm.common import PY_WORD
from shelfmark.llm.tokens import default_path, encode
from tests.llm.test_lshforest import brute
from tests.llm.test_rules import want

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from shelfmark.store import written

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs
    return {k: v.collect() for k, v in out.items()}


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "quality_rules", "near_duplicates", "mixing", "packing"]
    for name, _ in P.STAGES[:-1]:
        assert list(stages[name][0].asDict()) == P.COLUMNS


def test_language_id_keeps_told_texts(stages):
    kept = {r.doc_id: r.lang for r in stages["language_id"]}
    truth = {r.doc_id: r.lang for r in stages["documents"]}
    assert len(kept) > 0.98 * len(truth)
    assert sum(kept[k] == truth[k] for k in kept) > 0.98 * len(kept)


def test_quality_rules_reject_what_the_base_fails(stages):
    kept = {r.doc_id for r in stages["quality_rules"]}
    for r in stages["language_id"]:
        if want(r.text)[-1]:
            assert r.doc_id not in kept


def test_one_document_of_each_class_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["quality_rules"]]
    assert sorted(r.doc_id for r in stages["near_duplicates"]) == sorted(k for k, c, _ in brute(rows) if k == c)


def test_mixing_takes_words_to_target(stages):
    size = {r.doc_id: len(PY_WORD.findall(r.text)) for r in stages["near_duplicates"]}
    got = defaultdict(int)
    for r in stages["mixing"]:
        got[r.doc_id] += len(PY_WORD.findall(r.text))
    assert all(n <= 2 * size[k] for k, n in got.items())
    assert sum(got.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.001)


def test_packing_places_every_token_of_the_mix(stages):
    assert sum(r.length for r in stages["packing"]) == sum(len(encode(default_path(), r.text)) + 1 for r in stages["mixing"])
    at = defaultdict(int)
    for r in sorted(stages["packing"], key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 1024


def test_run_gives_the_last_stages_rows(spark, stages):
    assert P.run(spark, SF).count() == len(stages["packing"])
