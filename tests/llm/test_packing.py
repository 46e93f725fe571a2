import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from shelfmark.llm.packing import Packer, pack, step_groups
from shelfmark.llm.tokens import default_path, encode


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=80))
def test_every_token_is_placed_once_and_windows_are_full(lengths):
    p = Packer()
    for d, n in enumerate(lengths):
        p.add(d, n)
    p.pack()
    rest = p.rest()
    seen = defaultdict(list)
    for tier, parts in p.windows:
        assert sum(x[0] for x in parts) == tier
    for n, d, start in [x for _, parts in p.windows for x in parts] + rest:
        seen[d].append((start, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, m in sorted(seen[d]):
            assert start == at
            at += m
        assert at == n
    assert sum(x[0] for x in rest) < 256


def test_step_groups_are_balanced():
    windows = [(1024, [(1024, i, 0)]) for i in range(64)] + [(256, [(128, i, 0), (128, i, 128)]) for i in range(128)]
    groups = step_groups(windows, 16_384)
    tokens = defaultdict(int)
    for (t, _), g in zip(windows, groups, strict=True):
        tokens[g] += t
    assert set(tokens.values()) == {16_384}


def test_ids_are_those_of_the_tokenizer_file_and_rows_repeat(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    texts = {1: "Hello  world.\n\tIt's 12 o'clock", 2: None, 3: "", 4: "é<|endoftext|>漢字 " * 900, 7: "a <|endoftext|> b \n<|endoftext|><|endoftext|", 8: "<|endoftext|>", 5: " ", 6: "x" * 3000}
    df = spark.createDataFrame([Row(doc_id=k, text=v, start="clash", length=None) for k, v in texts.items()] + [Row(doc_id=1, text=texts[1], start="c", length=None)], "doc_id long, text string, start string, length string")
    rows = pack(df.coalesce(1)).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for k, v in texts.items():
        want = t.encode(v or "", add_special_tokens=False).ids + [0]
        copies = 2 if k == 1 else 1
        got = sorted(pieces[k], key=lambda r: r.start)
        assert sum(r.length for r in got) == copies * len(want)
        for r in got:
            ids = np.array(want[r.start : r.start + r.length], dtype="<u4")
            assert bytes(r.ids) == ids.tobytes() and r.doc_tokens == len(want)
            assert zlib.crc32(ids.tobytes()) == zlib.crc32(bytes(r.ids))
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    short = 0
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
        short += at & (at - 1) != 0
    assert short <= 1
    assert pack(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|", "endoftext", "|>", " ", "  \n", "'s", "\x1c", "\x85", "\u200b", "\u3000", "½", "٣", "e\u0301"]), st.text(max_size=6)), max_size=12))
def test_ids_are_those_of_the_tokenizer_at_its_defaults(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert encode(default_path(), text).tolist() == tokenizer().encode(text, add_special_tokens=False).ids


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())
