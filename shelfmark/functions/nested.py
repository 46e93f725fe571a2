"""Expressions over arrays of structs: contributors, shelves, series, pairs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ids(authors: Column) -> Column:
    return F.filter(F.coalesce(authors, F.array()), lambda a: a.isNotNull() & a["author_id"].isNotNull() & (a["author_id"] != ""))


def author_ids(authors: Column) -> Column:
    """The ids in order, joined by a bar; null without any."""
    return F.nullif(F.array_join(F.transform(_ids(authors), lambda a: a["author_id"]), "|"), F.lit(""))


def first_author(authors: Column) -> Column:
    return F.get(_ids(authors), F.lit(0))["author_id"]


def first_role(authors: Column) -> Column:
    return F.get(_ids(authors), F.lit(0))["role"]


def author_count(authors: Column) -> Column:
    return F.size(_ids(authors))


def main_author(authors: Column) -> Column:
    """The first id without a role, or else the first id."""
    plain = F.filter(_ids(authors), lambda a: F.coalesce(a["role"], F.lit("")) == "")
    return F.coalesce(F.get(plain, F.lit(0))["author_id"], first_author(authors))


def other_roles(authors: Column) -> Column:
    """How many carry a role."""
    return F.size(F.filter(_ids(authors), lambda a: F.coalesce(a["role"], F.lit("")) != ""))


def shelf_names(shelves: Column, n: int) -> Column:
    return F.transform(F.slice(F.coalesce(shelves, F.array()), 1, n), lambda s: s["name"])


def shelf_json(shelves: Column, n: int) -> Column:
    return F.to_json(F.slice(F.coalesce(shelves, F.array()), 1, n))


def to_read_count(shelves: Column, n: int, any_case: bool = False) -> Column:
    """The count of the last `to-read` among the first n shelves; 0 without one."""
    name = lambda s: F.lower(s["name"]) if any_case else s["name"]
    hits = F.filter(F.slice(F.coalesce(shelves, F.array()), 1, n), lambda s: name(s) == "to-read")
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["count"], F.lit(0).cast("long"))


def theme_flag(names: Column, keywords: list[str]) -> Column:
    """True if any keyword is part of any name."""
    pattern = "|".join(re.escape(k) for k in keywords)
    return F.coalesce(F.exists(names, lambda n: F.lower(n).rlike(pattern)), F.lit(False))


def list_count(items: Column) -> Column:
    return F.coalesce(F.size(F.filter(items, lambda x: x.isNotNull())), F.lit(0))


def name_pairs(names: Column, n: int) -> Column:
    """All pairs a < b of the distinct names among the first n, in order."""
    chosen = F.sort_array(F.array_distinct(F.filter(F.slice(names, 1, n), lambda x: x.isNotNull())))
    return F.flatten(F.transform(chosen, lambda a, i: F.transform(F.slice(chosen, i + 2, F.size(chosen)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def flag_names(flags: dict[str, Column]) -> Column:
    """The names of the flags that are set, joined by a bar; empty without any."""
    return F.concat_ws("|", *[F.when(v.cast("boolean"), F.lit(k)) for k, v in flags.items()])


def dominant(flags: dict[str, Column]) -> Column:
    """The one flag's name, `multi` for several, `other` for none."""
    total = sum((F.coalesce(v.cast("int"), F.lit(0)) for v in flags.values()), F.lit(0))
    out = F.when(total > 1, F.lit("multi"))
    for k, v in flags.items():
        out = out.when(v.cast("int") == 1, F.lit(k))
    return out.otherwise(F.lit("other"))
