import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import queries
from shelfmark.llm.tokencounts import Counter, Tree, apply_edit, built, counted, recounted
from shelfmark.llm.tokens import default_path

PATH = default_path()
COUNTER = Counter(PATH)
TOKENIZER = Tokenizer.from_file(PATH)
ALPHABET = "ab'sre  \n\n1.é漢! \t"
#: Edits that make and break the special string, too.
TEXT = st.lists(st.one_of(st.text(ALPHABET, max_size=30), st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "<", "|>"])), max_size=6).map("".join)


def full(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def sound(tree):
    for i in range(1, tree.size):
        assert tree.chars[i] == tree.chars[2 * i] + tree.chars[2 * i + 1]
        assert tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1]


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-5, 130), st.integers(-5, 130), TEXT), max_size=4), st.sampled_from([1, 2, 5, 64]))
def test_counts_after_edits_are_those_of_a_full_encoding(text, edits, leaf):
    tree = built(text, COUNTER, leaf)
    assert tree.tokens[1] == full(text) and tree.chars[1] == len(text)
    for start, end, new in edits:
        s = max(0, min(start, len(text)))
        want = text[:s] + new + text[max(s, min(end, len(text))) :]
        text, tree, done = apply_edit(text, tree, start, end, new, COUNTER, leaf)
        assert text == want
        sound(tree)
        assert tree.chars[1] == len(text) and tree.tokens[1] == full(text)


def test_only_the_touched_region_is_encoded():
    text = " ".join(f"word{i} is, here" for i in range(5000))
    tree = built(text, COUNTER)
    after, tree, done = apply_edit(text, tree, 40_000, 40_003, "xyz it's", COUNTER)
    assert tree.tokens[1] == full(after) and done < 2000


def test_rows(spark):
    edit = "array<struct<start:long,end:long,new:string>>"
    data = [(1, "Hello there, it's 12", [(0, 5, "Bye"), (100, 200, " end")]), (1, "Hello there, it's 12", None), (2, None, [(0, 0, "new")]), (None, "a", [None, (None, None, None)]), (3, "x" * 5000 + " y" * 9000, [(10, 4000, "")])]
    df = spark.createDataFrame(data, f"doc_id long, text string, edits {edit}").coalesce(1)
    trees = counted(df)
    assert [r.tokens[1] for r in trees.collect()] == [full(t or "") for _, t, _ in data]
    withs = spark.createDataFrame([(r.key, r.text, r.chars, r.tokens, e) for r, (_, _, e) in zip(trees.collect(), data, strict=True)], f"key long, text string, chars array<int>, tokens array<int>, edits {edit}")
    out = recounted(withs.coalesce(1)).collect()
    assert [r.text for r in out][:4] == ["Bye there, it's 12 end", "Hello there, it's 12", "new", "a"]
    assert [r.tokens[1] for r in out] == [full(r.text) for r in out]
    assert counted(df.limit(0)).count() == 0


def test_query_against_a_full_encoding(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_edit_aware_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert r.n_tokens == full(t)
        n = len(t)
        a, b, c = n // 3, n // 2, 4 * n // 5
        t = t[:a] + f" see also no. {r.doc_id},\n" + t[a:]
        t = t[:b] + t[b + 5 :]
        t = t[:c] + "It's" + t[c + 7 :]
        assert (r.edited_chars, r.edited_crc32, r.edited_tokens) == (len(t), zlib.crc32(t.encode()), full(t))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 9])
def test_tree_shapes(n):
    tree = Tree.over([(i + 1, 2 * i) for i in range(n)])
    sound(tree)
    assert tree.chars[1] == n * (n + 1) // 2
