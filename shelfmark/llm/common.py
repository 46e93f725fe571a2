"""What the corpus operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
PY_WORD = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column | str) -> Column:
    """The words of a text in order; none for a null text."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    # white space at an end leaves an empty part there, and only there
    return bind(parts, lambda p: F.when((F.get(p, F.lit(0)) == "") | (F.element_at(p, -1) == ""), F.array_remove(p, "")).otherwise(p))


def bind(value: Column, body) -> Column:
    """body(value), with value evaluated once: a let expression inside one projection."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
