"""Word-first language identification with backoff to character n-grams.

A known word scores its log frequency in each language. An unseen word scores by its character n-grams: those
of the greatest length of which any is known, else the next shorter, down to single letters. The languages'
scores of all words of a text are summed; the highest wins.

Counting runs on the cluster and covers a bounded sample of labelled text: for each language, documents picked
by a hash of their id until about `train_chars` characters are expected, and at most `total_chars` in all. So
the model's size is bounded whatever the corpus's, and it is this model alone that is sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of labelled text for each language, in expectation.
TRAIN_CHARS = 4_000_000
#: Characters of labelled text in all, in expectation; where there are many languages, each has an equal part of it.
TOTAL_CHARS = 64_000_000
#: The most frequent words kept as known words, for each language.
KNOWN_WORDS = 40_000
#: Least count of a known word; rarer ones score by their n-grams.
LEAST = 2
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
#: The posterior is taken as of a text of at most so many words, so long texts do not all score 1 alike.
EVIDENCE_WORDS = 30
UNKNOWN = "und"
#: Letters of any script; numerals and symbols such as ½, Ⅷ or ① are none.
LETTERS = r"\p{L}+"
_LETTERS = regex.compile(LETTERS)
#: Words that a Python worker remembers beyond the model's.
MEMO = 200_000


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: list[dict[str, int]]
    gram_scores: list[np.ndarray]

    def unseen(self, word: str) -> np.ndarray:
        padded = f"<{word}>"
        for n, known, scores in zip(ORDERS, self.grams, self.gram_scores, strict=True):
            hits = [r for i in range(len(padded) - n + 1) if (r := known.get(padded[i : i + n])) is not None]
            if hits:
                return scores[hits].mean(axis=0)
        return np.zeros(len(self.languages), dtype=np.float32)


def _counts(found: pd.DataFrame, names: list[str]) -> tuple[list[str], np.ndarray]:
    """The keys in code point order and a row of counts by language for each, of (lang, key, count)."""
    codes, keys = pd.factorize(found["key"], sort=True)
    table = np.zeros((len(keys), len(names)))
    np.add.at(table, (codes, found["lang"].map({k: i for i, k in enumerate(names)}).to_numpy(dtype=np.int64)), found["count"].to_numpy(dtype=np.float64))
    return list(keys), table


def _log_share(keys: list[str], table: np.ndarray, total: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    shares = np.log((table + SMOOTHING) / (total + SMOOTHING * max(1, len(keys))))
    return {k: i for i, k in enumerate(keys)}, shares.astype(np.float32)


def _grams(padded: Column, n: int) -> Column:
    """The runs of n characters of a word between its marks, each with n."""
    last = F.length(padded) - (n - 1)
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.lit(n).alias("n"), F.substring(padded, i, F.lit(n)).alias("key")))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<struct<n:int,key:string>>"))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_chars: int = TRAIN_CHARS, total_chars: int = TOTAL_CHARS, known_words: int = KNOWN_WORDS, seed: int = 5) -> Model:
    """A model of the rows of `labelled`; rows with a null text, key or language teach nothing. No rows give a model without languages.

    Words and their grams are counted on the cluster, in one job; what comes to the driver is counts of at most `total_chars` characters.
    """
    rows = labelled.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).dropna()
    # one small row for each language
    volume = {r["lang"]: r["chars"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).collect()}
    names = sorted(volume)
    if not names:
        return Model([], {}, np.zeros((0, 0), np.float32), [{} for _ in ORDERS], [np.zeros((0, 0), np.float32) for _ in ORDERS])
    each = min(train_chars, total_chars // len(names))
    rates = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, each / max(1, volume[k]))))])
    drawn = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) / float(1 << 30) < F.try_element_at(rates, F.col("lang"))
    words = rows.where(drawn).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), 0)).alias("key"))
    counted = words.groupBy("lang", "key").agg(F.count("*").alias("count"))
    marked = F.concat(F.lit("<"), F.col("key"), F.lit(">"))
    whole = F.array(F.struct(F.lit(0).alias("n"), F.col("key").alias("key")))  # a word itself, beside its grams
    parts = counted.select("lang", "count", F.inline(F.concat(whole, *[_grams(marked, n) for n in ORDERS])))
    found = parts.groupBy("lang", "n", "key").agg(F.sum("count").alias("count")).toArrow().to_pandas()
    keys, table = _counts(found[found["n"] == 0], names)
    total = table.sum(axis=0)
    top: set[int] = set()
    for i in range(len(names)):  # the keys are in order already, so ties go to the first
        ranked = np.argsort(-table[:, i], kind="stable")[:known_words]
        top |= set(ranked[table[ranked, i] >= LEAST].tolist())
    known = sorted(top)
    ids, scores = _log_share([keys[k] for k in known], table[known], total)
    pairs = []
    for n in ORDERS:
        of, counts = _counts(found[found["n"] == n], names)
        pairs.append(_log_share(of, counts, counts.sum(axis=0)))
    return Model(names, ids, scores, [p[0] for p in pairs], [p[1] for p in pairs])


class Scorer:
    """Scores texts in one worker; unseen words are remembered up to a bound."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.known = len(model.words)
        self.table = np.zeros((self.known + MEMO, max(1, len(model.languages))), np.float32)
        self.table[: self.known] = model.word_scores if self.known else 0
        self.rows = dict(model.words)

    def _learn(self, word: str) -> int:
        if len(self.rows) >= len(self.table):
            self.rows = dict(self.m.words)
        self.table[len(self.rows)] = self.m.unseen(word)
        self.rows[word] = len(self.rows)
        return self.rows[word]

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = _LETTERS.findall(text.lower()) if text else []
        if not words or not self.m.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.m.languages))
        for i in range(0, len(words), MEMO // 2):
            get, rows = self.rows.get, []
            for w in words[i : i + MEMO // 2]:
                r = get(w)
                if r is None:
                    if len(self.rows) >= len(self.table):  # sum what is gathered before its rows are used anew
                        total += self.table[rows].sum(axis=0, dtype=np.float64)
                        rows = []
                    r = self._learn(w)
                    get = self.rows.get
                rows.append(r)
            total += self.table[rows].sum(axis=0, dtype=np.float64) if rows else 0
        best = int(total.argmax())
        scaled = (total - total[best]) * min(1.0, EVIDENCE_WORDS / len(words))
        return self.m.languages[best], float(1 / np.exp(scaled).sum())


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with `lang_pred` and `score` (0 to 1, the posterior of that language).

    `und` with score 0 where the text is null or has no letters, or the model has no languages. A tie goes to the
    language that is first by name. A text of any length counts as a whole. Columns of df named lang_pred or score are replaced; repeated rows stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c not in ("lang_pred", "score")]

    @F.pandas_udf("lang_pred string, score double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for part in parts:
            yield pd.DataFrame([scorer(t) for t in part], columns=["lang_pred", "score"])

    # so declared, a filter on the result does not run it a second time
    scored = scored.asNondeterministic()
    out = df.select(*[F.col(f"`{c}`") for c in names], scored(F.col(f"`{text}`")).alias("_lang"))
    return out.select(*[F.col(f"`{c}`") for c in names], "_lang.lang_pred", "_lang.score")


def held_out(key: Column | str) -> Column:
    """True for the quarter of the keys that teaches nothing: crc32 of the key as text, mod 4, is 2; a null key does not."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
