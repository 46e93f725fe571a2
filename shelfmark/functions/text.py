"""Cleaning expressions for strings, numbers, booleans and dates."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty and white-space strings become null in every string column."""
    return df.select(*[F.when(~F.col(f.name).rlike(r"^\s*$"), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def number(c: Column | str) -> Column:
    """A double, or null where the text is no number."""
    return col(c).try_cast("double")


def boolean(c: Column | str) -> Column:
    """true/1 and false/0 in any case; anything else is null."""
    low = F.lower(col(c))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def weekday_timestamp(c: Column | str) -> Column:
    """`Wed Aug 30 00:00:26 -0700 2017` as a timestamp; the weekday is not parsed, a bad text is null."""
    return F.try_to_timestamp(F.substring(col(c), 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))


#: Entities decoded without Python; a text with any other goes through the full table.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if x is not None else None)


def review_text(c: Column | str, every_entity: bool = False) -> Column:
    """Entities decoded, then tags stripped, white space collapsed, ends trimmed; an empty text is null.

    Decoding comes first, so `&lt;b&gt;` is stripped too. The common entities are decoded by built-in functions;
    `every_entity` takes the full HTML table, in Arrow batches.
    """
    out = col(c)
    if every_entity:
        out = F.pandas_udf(_unescaped, "string")(out)  # made here: a declared type needs a session
    else:
        for a, b in ENTITIES:
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), r"[\s ]+", " ")), F.lit(""))


def trimmed(c: Column | str, lower: bool = False) -> Column:
    out = F.trim(col(c))
    return F.nullif(F.lower(out) if lower else out, F.lit(""))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Fractional days, negative where the order is reversed."""
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(86_400e6)


def date_of_parts(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """A date of number parts; a missing month or day is 1, parts are clipped to their ranges, an impossible date is null."""
    part = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(number(c), F.lit(1.0)))).cast("int")
    return F.try_to_date(F.concat_ws("-", number(year).cast("int").cast("string"), F.lpad(part(month, 1, 12).cast("string"), 2, "0"), F.lpad(part(day, 1, 31).cast("string"), 2, "0")))


def log_clipped(c: Column | str) -> Column:
    return F.log1p(F.greatest(col(c).cast("double"), F.lit(0.0)))


def label_of(c: Column | str) -> Column:
    """A column-name-safe label: lower case, runs of other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.lower(F.trim(col(c))), "[^0-9a-z]+", "_")


def title_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(c))), r"\s+", " ")


def first_text(*cs: Column | str, default: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in cs], F.lit(default))


def binned(c: Column | str, edges: list[float], labels: list[str], right: bool = False) -> Column:
    """The label of the interval that holds c: closed on the left, or on the right; outside all, null."""
    x, out = col(c), None
    for low, high, name in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (x > low) & (x <= high) if right else (x >= low) & (x < high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def title_terms(df: DataFrame, group: str, title: str, stop: list[str], n: int) -> DataFrame:
    """(group, term, n, rank): the n most frequent words of three letters and more, ties by the word."""
    from pyspark.sql import Window

    words = df.select(F.col(group), F.explode(F.regexp_extract_all(F.lower(F.col(title)), F.lit("([a-z]{3,})"), 1)).alias("term"))
    counts = words.where(~F.col("term").isin(*stop)).groupBy(group, "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
