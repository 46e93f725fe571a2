"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every measure is an array or string function of the one row's text, so the plan is scan and projection: no
exchange, no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import bind, unused, WORD, words_of

#: What counts as a symbol.
SYMBOLS = "[#*$%&|<>]"
#: Common function words of the languages handled; a text in another language fails no other rule by them.
STOP_WORDS = (
    "a and are as at be by for from in is it of on that the this to was with "
    "au avec dans de des du en est et la le les par pas pour que qui sur un une "
    "als auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "al con de del el en es la las lo los no para por que se su un una y"
)


@dataclass(frozen=True)
class Rule:
    """A measure's allowed range, ends included; None is open. `least_words`: shorter texts are not judged by it."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


RULES = (
    Rule("words_short", "mean_word_chars", low=3.0),
    Rule("words_long", "mean_word_chars", high=10.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.02, least_words=50),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)


def covered_words(words: Column | str) -> Column:
    """How many words lie in a 3-word window that occurs twice or more; windows are compared by a 64-bit hash.

    Where any hash repeats, the windows are sorted by hash, those equal to a neighbour keep their positions, and
    the union of the kept windows is summed from one position to the next: n log n in the text's length. The
    last two entries hash fewer than three words and so equal no window.
    """
    w = F.col(words) if isinstance(words, str) else words
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))

    def union(h: Column) -> Column:
        kept = bind(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)
        at = F.sort_array(F.transform(kept, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), union(h)).otherwise(F.lit(0).cast("long")))


def stop_forms() -> list[str]:
    """Stop words in lower case, with a capital and in capitals, as whole words of a text."""
    return sorted({f for w in STOP_WORDS.split() for f in (w, w.capitalize(), w.upper())})


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `n_words`, `word_chars`, `n_symbols`, `n_lines`, `n_dup_lines`, `n_repeat_words`, `n_stop_words` (long).

    A null text is an empty one; a text of any length counts as a whole; columns of df with these names are replaced, and
    others may have any names; repeated rows stay.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words, parted = unused(df, "_words"), unused(df, "_lines")
    w, found = F.col(words), F.col(parted)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    stops = F.filter(w, lambda x: x.isin(*stop_forms()))
    long = lambda c: c.cast("long")
    new = {
        "n_words": long(F.size(w)),
        "word_chars": long(F.length(F.array_join(w, ""))),
        "n_symbols": long(F.regexp_count(t, F.lit(SYMBOLS))),
        "n_lines": long(F.size(found)),
        "n_dup_lines": long(F.size(found) - F.size(F.array_distinct(found))),
        "n_repeat_words": covered_words(w),
        "n_stop_words": long(F.size(stops)),
    }
    keep = [c for c in df.columns if c not in new]
    base = df.select(*[F.col(f"`{c}`") for c in keep], words_of(t).alias(words), lines.alias(parted))
    # generated rather than projected: a filter on a measure stays above, and does not repeat what makes it
    return base.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct(*[v.alias(k) for k, v in new.items()]))))


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with its measures, the ratios that `rules` name, `base_failed`, `failed` (names of rules) and `kept`.

    The base fails a text of fewer than 50 words, or one with over half its words in repeated 3-word windows.
    A null text is an empty one (no words: the base fails it). Ratios over nothing are 0. Columns of df with a
    name used here are replaced; repeated rows are judged each alike.
    """
    m = measured(df, text)
    ratios = {
        "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
        "stop_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
    }
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def broken(r: Rule) -> Column:
        x = ratios[r.measure]
        low = x < r.low if r.low is not None else F.lit(False)
        high = x > r.high if r.high is not None else F.lit(False)
        return (low | high) & (F.col("n_words") >= r.least_words)

    failed = F.concat_ws(",", *[F.when(broken(r), F.lit(r.name)) for r in rules])
    drop = {*ratios, "base_failed", "failed", "kept"}
    keep = [F.col(f"`{c}`") for c in m.columns if c not in drop]
    any_failed = F.lit(False)
    for r in rules:
        any_failed = any_failed | broken(r)
    return m.select(*keep, *[v.alias(k) for k, v in ratios.items()], base.alias("base_failed"), failed.alias("failed"), (~base & ~any_failed).alias("kept"))


def rules_sql(source: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """The same verdicts as DuckDB SQL."""

    def broken(r: Rule) -> str:
        parts = ([f"{r.measure} < {r.low}"] if r.low is not None else []) + ([f"{r.measure} > {r.high}"] if r.high is not None else [])
        return f"(({' OR '.join(parts)}) AND n_words >= {r.least_words})"

    stops = ", ".join(f"'{w}'" for w in stop_forms())
    names = " || ".join(f"CASE WHEN {broken(r)} THEN ',{r.name}' ELSE '' END" for r in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {source}),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(list_filter(w, lambda x: x IN ({stops}))) AS BIGINT) AS n_stop_words
      FROM w LEFT JOIN c USING (rid)),
r AS (SELECT *, CASE WHEN n_words = 0 THEN 0.0 ELSE CAST(word_chars AS DOUBLE) / n_words END AS mean_word_chars,
        CASE WHEN n_words = 0 THEN 0.0 ELSE CAST(n_symbols AS DOUBLE) / n_words END AS symbol_ratio,
        CASE WHEN n_words = 0 THEN 0.0 ELSE CAST(n_stop_words AS DOUBLE) / n_words END AS stop_ratio,
        CASE WHEN n_lines = 0 THEN 0.0 ELSE CAST(n_dup_lines AS DOUBLE) / n_lines END AS dup_line_ratio,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({' OR '.join(broken(r) for r in rules)}) AS kept, n_stop_words, ltrim({names}, ',') AS failed FROM r
"""
