from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import queries
from shelfmark.llm.common import PY_WORD
from shelfmark.llm.rules import judged, rules_sql
from tests.oracle import assert_matches, expected

TEXTS = [None, "", " ", "a", "a b", "a b c a b c", "x y z x y z x", "the " * 60, "word\n" * 70, "# $ %", "café naïve straße", "é" * 5000, "a\x0bb\x0cc\r\nd", "line one\nline one\n\n \nline two\nline one", " ".join(f"w{i}" for i in range(300)), "a a a a", " a b", "|" * 50 + " |" * 60]


def repeats(words):
    g = Counter(zip(words, words[1:], words[2:], strict=False))
    return len({i + k for i in range(len(words) - 2) if g[tuple(words[i : i + 3])] > 1 for k in range(3)})


def want(text):
    t = text or ""
    w = PY_WORD.findall(t)
    lines = [x for x in t.split("\n") if PY_WORD.search(x)]
    n = repeats(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w))


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words int")
    for r in judged(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed and not r.failed)


def test_measures(spark):
    check(spark, TEXTS)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#", max_size=60), min_size=1, max_size=30))
def test_measures_of_any_text(spark, texts):
    check(spark, texts)


def test_rules_reject_junk_and_keep_prose(spark):
    prose = " ".join(f"the river{i} of stone{i} and light{i}" for i in range(40))
    junk = " ".join(f"river{i}### stone{i}$$$" for i in range(100))
    table = " ".join(f"cell{i} | value{i}" for i in range(100))
    out = {r.doc_id: r for r in judged(spark.createDataFrame([(1, prose), (2, junk), (3, table), (4, prose)], "doc_id long, text string")).collect()}
    assert out[1].kept and out[4].kept and not out[2].kept and not out[3].kept
    assert "symbols" in out[2].failed
    assert judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_is_one_scan_without_exchange(spark):
    df = judged(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_sql_says_the_same(spark):
    sf = "/root/testdata/sf0.001"
    assert assert_matches(queries.QUERIES["op3_quality_rules"](spark, sf), rules_sql(), sf) == len(expected("SELECT 1 FROM documents", sf))
