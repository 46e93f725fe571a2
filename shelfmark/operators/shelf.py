"""Readers against a shelf: what is said of a reader and all items of its clusters is worked out beside the reader.

No pair of reader and item is exchanged or stored. A reader is one row: what it read, and its modes where they are given.
The shelf (ids, vectors, clusters and some columns of all items) goes to the executors whole, behind a check of its size;
for a larger one, or one that has repeated ids or missing vectors or clusters, `shelved` gives None, and callers join instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import rank
from shelfmark.operators.temporal import popularity_score
from shelfmark.operators.users import COLD_BELOW, MODES_FROM, MODES_MOST, PER_MODE, POSITIVE, lloyd
from shelfmark.store import written

#: Numbers in the vectors of a shelf: 128 MB in a Python worker.
CELLS = 16_000_000
#: Similarities of a block of readers held at once.
HELD = 4_000_000
#: Items that picks are first made among.
FEW = 128
#: Items of an order that goes to the executors whole.
ORDERED = 2_000_000


@dataclass
class Shelf:
    """Items in the order of their ids; `clusters` ascend and `code` says which of them an item is of."""

    ids: pa.Array
    vec: np.ndarray
    clusters: np.ndarray
    code: np.ndarray
    centres: np.ndarray
    more: dict[str, np.ndarray]
    length: np.ndarray = field(init=False)

    def __post_init__(self):
        self.length = _lengths(self.vec)

    def units(self, rows: np.ndarray) -> np.ndarray:
        return self.vec[rows] / self.length[rows, None]

    def means(self) -> np.ndarray:
        """The mean of each cluster's items, of all of them."""
        if "_means" not in self.more:
            self.more["_means"] = np.array([self.vec[self.code == i].mean(0) for i in range(len(self.clusters))])
        return self.more["_means"]

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """(the sets of genres there are, which of them each item has)."""
        if "_kinds" not in self.more:
            sets, at = np.unique(self.more["genres"].astype(bool), axis=0, return_inverse=True)
            self.more["_kinds"] = sets, at.reshape(-1)
        return self.more["_kinds"]

    def popular(self, mask: int | None = None) -> np.ndarray:
        """Places of the listed items, most popular first, ties to the lower id; of those alone that share a genre with a mask."""
        if ("_popular", mask) not in self.more:
            if mask is None:
                some = np.flatnonzero(self.more["listed"].astype(bool))
                self.more["_popular", mask] = some[np.argsort(-self.more["order"][some], kind="stable")]
            else:
                every = self.popular()
                self.more["_popular", mask] = every[(self.more["mask"][every] & mask) != 0]
        return self.more["_popular", mask]

    def popularities(self) -> tuple[np.ndarray, int, int]:
        """(which of the distinct values of popularity, 0 among them, each item has; how many there are; which of them 0 is)."""
        if "_popularities" not in self.more:
            found, at = np.unique(np.append(self.more["popularity"], 0.0), return_inverse=True)
            self.more["_popularities"] = at[:-1], len(found), int(at[-1])
        return self.more["_popularities"]

    def segments(self) -> np.ndarray:
        """0 for the tail, 1 for the middle, 2 for the rest."""
        if "_segments" not in self.more:
            told = self.more["segment"]
            self.more["_segments"] = np.where(told == "tail", 0, np.where(told == "mid", 1, 2))
        return self.more["_segments"]

    def rows_of(self, ids: pa.Array) -> np.ndarray:
        """The place of each id; -1 for one that is not here."""
        return pc.fill_null(pc.index_in(ids, value_set=self.ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Reader:
    user: str
    read: np.ndarray
    weight: np.ndarray
    unit: np.ndarray
    more: dict

    def near(self, shelf: Shelf) -> np.ndarray:
        """Each mode's weighted cosine with each cluster."""
        return np.round(self.weight[:, None] * (self.unit @ shelf.centres.T), 9)

    def picked(self, shelf: Shelf, n: int) -> np.ndarray:
        """Codes of the n clusters of greatest weighted cosine, best first, ties to the lower."""
        return np.argsort(-self.near(shelf).max(0), kind="stable")[:n]

    def unread(self, shelf: Shelf, codes: np.ndarray) -> np.ndarray:
        """Places of the items of these clusters that the reader has not read."""
        some = np.zeros(len(shelf.clusters), bool)
        some[codes] = True
        met = some[shelf.code]
        met[self.read] = False
        return np.flatnonzero(met)


def _lengths(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))
    return np.where(n == 0, 1.0, n)


def shelved(items: DataFrame, *more: str, centres_of: str | None = None):
    """The items (book_id, vec, cluster and `more`) as a broadcast shelf; None where they do not fit one.

    Centres are the means of the clusters' items, of those where the boolean `centres_of` holds if it is given.
    """
    table = items.select("book_id", "vec", "cluster", *more)
    wide = table.agg(F.count("*"), F.max(F.size("vec")), F.min(F.coalesce(F.size("vec"), F.lit(-1))), F.count("book_id"), F.count("cluster"), F.countDistinct("book_id"), F.count_if(~F.forall("vec", lambda x: x.isNotNull()))).first()
    n, most, least, *whole, holes = wide
    if not n or n * most > CELLS or most != least or set(whole) != {n} or holes:
        return None
    got = table.toArrow().combine_chunks().sort_by("book_id")
    vec = got["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, most)
    clusters, code = np.unique(got["cluster"].to_numpy(), return_inverse=True)
    columns = {c: np.array(got[c].to_pylist()) if pa.types.is_list(got[c].type) else got[c].to_numpy() for c in more}
    of = np.ones(n, bool) if centres_of is None else columns[centres_of].astype(bool)
    means = np.array([vec[of & (code == i)].mean(0) if (of & (code == i)).any() else np.full(most, np.nan) for i in range(len(clusters))])
    known = ~np.isnan(means).any(1)
    if not known.all():  # a cluster without a centre is never picked
        means = np.where(known[:, None], means, 0.0)
    ids = got["book_id"].combine_chunks()
    return items.sparkSession.sparkContext.broadcast(Shelf(ids, vec, clusters, code, means / _lengths(means)[:, None], columns)) if known.all() else None


def _dealt(df: DataFrame) -> DataFrame:
    """By reader, over as many tasks as the session has for an exchange: the rows are small and the work on them is not."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "user_id")


def histories(history: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(user_id, read): each reader's read items with whether it liked them, a list. Seeds (user_id, book_id) are items without that."""
    liked = F.coalesce(F.col("rating_clean") >= POSITIVE, F.lit(False))
    rows = history.where(F.col("is_read") & F.col("user_id").isNotNull()).select("user_id", F.struct("book_id", liked.alias("liked")).alias("_r"))
    if seeds is not None:
        rows = rows.unionByName(seeds.where("user_id is not null").select("user_id", F.struct("book_id", F.lit(None).cast("boolean").alias("liked")).alias("_r")))
    return _dealt(rows).groupBy("user_id").agg(F.collect_list("_r").alias("read"))


def grouped(history: DataFrame) -> DataFrame:
    """(user_id, rows): each reader's interactions (book_id, read, liked), a list. Written once: passes over readers exchange nothing."""
    liked = F.coalesce(F.col("rating_clean") >= POSITIVE, F.lit(False))
    rows = history.select("user_id", F.struct("book_id", F.coalesce("is_read", F.lit(False)).alias("read"), liked.alias("liked")).alias("_r"))
    return written(_dealt(rows).groupBy("user_id").agg(F.collect_list("_r").alias("rows")), "readers")


def reads_of(readers: DataFrame) -> DataFrame:
    """`histories` of grouped readers."""
    return readers.where("user_id is not null").select("user_id", F.filter("rows", lambda r: r["read"]).alias("read")).where(F.size("read") > 0)


def liked_of(readers: DataFrame) -> DataFrame:
    """(user_id, b): the distinct items that each of grouped readers liked, in order, as `cooc.pairs_of` takes them."""
    liked = F.filter("rows", lambda r: r["read"] & r["liked"])
    b = F.sort_array(F.array_compact(F.array_distinct(F.transform("_l", lambda r: r["book_id"]))))
    return readers.select("user_id", liked.alias("_l")).where(F.size("_l") > 0).select("user_id", b.alias("b"))


def popular_unread(readers: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    """(user_id, book_id, rank): `rank.popularity_top` for those of grouped readers that met any of the items.

    The one order of all items goes to the executors; None where there are more than ORDERED, or an id repeats or is missing.
    """
    score = F.round(popularity_score(F.col("n"), F.col("mean_rating")), 9)
    order = items.select("book_id", score.alias("_s")).orderBy(F.desc("_s"), "book_id").limit(ORDERED + 1).select("book_id").toArrow()["book_id"].combine_chunks()
    if len(order) > ORDERED or order.null_count or len(order.unique()) != len(order):
        return None
    shared = items.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            users, column = batch.column("user_id").to_pylist(), batch.column("rows")
            at, rows = column.offsets.to_numpy(), column.values
            place = pc.fill_null(pc.index_in(rows.field("book_id"), value_set=order), -1).to_numpy(zero_copy_only=False)
            read = rows.field("read").to_numpy(zero_copy_only=False).astype(bool)
            got = []
            for i, user in enumerate(users):
                part = slice(at[i], at[i + 1])
                own = place[part]
                if not (own >= 0).any():
                    continue
                seen = own[read[part] & (own >= 0)] if user is not None else own[:0]
                new = np.ones(min(len(order), len(seen) + k), bool)
                new[seen[seen < len(new)]] = False
                got.append((user, np.flatnonzero(new)[:k]))
            sizes = [len(x) for _, x in got]
            names = pa.array([u for u, _ in got], pa.string()).take(pa.array(np.repeat(np.arange(len(got)), sizes), pa.int64()))
            places = np.concatenate([x for _, x in got]) if got else np.array([], dtype=np.int64)
            ranks = np.concatenate([np.arange(1, n + 1) for n in sizes]) if got else places
            yield pa.RecordBatch.from_arrays([names, order.take(pa.array(places, pa.int64())), pa.array(ranks, pa.int32())], names=["user_id", "book_id", "rank"])

    return readers.select("user_id", "rows").mapInArrow(run, "user_id string, book_id string, rank int")


def with_modes(modes: DataFrame, consumed: DataFrame) -> DataFrame:
    """(user_id, modes, read): readers of given modes, each with what it read."""
    of = _dealt(modes.where("user_id is not null")).groupBy("user_id").agg(F.collect_list(F.struct("weight", "vec")).alias("modes"))
    read = consumed.groupBy("user_id").agg(F.collect_set(F.struct("book_id")).alias("read"))
    return of.join(read, "user_id", "left")


def with_values(readers: DataFrame, values: DataFrame, value: str, name: str | None = None) -> DataFrame:
    """readers and `value`, or `name`: the list of (book_id, value) that `values` has for each."""
    lists = values.groupBy("user_id").agg(F.collect_list(F.struct("book_id", F.col(value).cast("double").alias("x"))).alias(name or value))
    return readers.join(lists, "user_id", "left")


def _readers(shelf: Shelf, batch: pa.RecordBatch, profile: Callable | None = None) -> Iterator[Reader]:
    """The readers of a batch that have a mode: the given ones, or those that `profile` makes of the liked items that are on the shelf.

    Without `profile` that is their mean; for a reader that liked none it is the mean of its seeds.
    """
    names = batch.schema.names
    users = batch.column("user_id").to_pylist()
    lists = {c: batch.column(c) for c in names if c not in ("user_id", "modes") and pa.types.is_list(batch.schema.field(c).type)}
    told = {c: batch.column(c).to_pylist() for c in names if c not in ("user_id", "modes", *lists)}
    at = {c: col.offsets.to_numpy() for c, col in lists.items()}
    rows = {c: shelf.rows_of(col.values.field("book_id")) for c, col in lists.items()}
    if "modes" not in names:
        told_liked = lists["read"].values.field("liked")
        liked, seed = (x.to_numpy(zero_copy_only=False).astype(bool) for x in (pc.fill_null(told_liked, False), pc.is_null(told_liked)))
    values = {c: col.values.field("x").to_numpy(zero_copy_only=False) for c, col in lists.items() if c != "read"}
    modes = batch.column("modes").to_pylist() if "modes" in names else None
    for i, user in enumerate(users):
        part = {c: slice(at[c][i], at[c][i + 1]) for c in lists}
        read = rows["read"][part["read"]]
        if modes is None:
            own = np.sort(read[(read >= 0) & liked[part["read"]]])
            if len(own) and profile is not None:
                weight, vec = profile(shelf, own)
            else:
                own = own if len(own) else read[(read >= 0) & seed[part["read"]]]
                if not len(own):
                    continue
                weight, vec = np.ones(1), shelf.vec[own].mean(0)[None]
        else:
            weight, vec = np.array([m["weight"] for m in modes[i]]), np.array([m["vec"] for m in modes[i]], dtype=float)
        more = {}
        for c, x in values.items():
            there = rows[c][part[c]]
            more[c] = there[there >= 0], x[part[c]][there >= 0]
        more |= {c: x[i] for c, x in told.items()}
        yield Reader(user, read[read >= 0], weight, vec / _lengths(vec)[:, None], more)


def _blocks(shelf: Shelf, readers: Iterator[Reader], most: int = HELD) -> Iterator[list[Reader]]:
    block, held = [], 0
    for r in readers:
        if block and (held + len(r.weight)) * len(shelf.vec) > most:
            yield block
            block, held = [], 0
        block.append(r)
        held += len(r.weight)
    if block:
        yield block


def _relevance(shelf: Shelf, block: list[Reader]) -> Iterator[tuple[Reader, np.ndarray]]:
    """Each reader with its greatest weighted cosine with each item, to twelve places, so that like vectors tie."""
    near = np.concatenate([r.unit for r in block]) @ shelf.vec.T
    near /= shelf.length
    at = 0
    for r in block:
        mine = near[at : at + len(r.weight)] * r.weight[:, None]
        at += len(r.weight)
        yield r, mine[0] if len(mine) == 1 else mine.max(0)


def _table(shelf: Shelf, schema: pa.Schema, got: list[tuple[str, tuple]]) -> pa.RecordBatch:
    sizes = [len(x[0]) for _, x in got]
    users = pa.array([u for u, _ in got], pa.string()).take(pa.array(np.repeat(np.arange(len(got)), sizes)))
    columns = [np.concatenate([x[j] for _, x in got]) for j in range(len(got[0][1]))]
    rest = [pa.array(c, f.type) for c, f in zip(columns[1:], list(schema)[2:], strict=True)]
    return pa.RecordBatch.from_arrays([users, shelf.ids.take(pa.array(columns[0])), *rest], schema=schema)


_TYPES = {"double": pa.float64(), "int": pa.int32(), "string": pa.string()}


def answered(readers: DataFrame, shared, each: Callable, columns: str, relevance: bool = True, profile: Callable | None = None, blocks: bool = False) -> DataFrame:
    """(user_id, book_id, *columns): what `each` says of every reader, of the modes that `profile` makes if it is given.

    each(shelf, reader, relevance of every item) gives places on the shelf and the values of `columns`, all of one length.
    With `blocks`, each(shelf, readers) gives every reader with these.
    """
    names = [c.split() for c in columns.split(", ")] if columns else []
    schema = pa.schema([("user_id", pa.string()), ("book_id", pa.string()), *[(n, _TYPES[t]) for n, t in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = shared.value
        for batch in batches:
            for block in _blocks(shelf, _readers(shelf, batch, profile), HELD * 3 if blocks else HELD):
                if blocks:
                    yield _table(shelf, schema, [(r.user, told) for r, told in each(shelf, block)])
                    continue
                got = [(r.user, each(shelf, r, x)) for r, x in (_relevance(shelf, block) if relevance else ((r, None) for r in block))]
                yield _table(shelf, schema, got)

    return readers.mapInArrow(run, ", ".join(["user_id string", "book_id string", *[f"{n} {t}" for n, t in names]]))


def tastes(readers: DataFrame, shared) -> DataFrame:
    """(user_id, vec): the mean of each reader's liked items, as `users.taste_vectors`; directions alone, at length one."""

    return readers.mapInArrow(tasting(shared), "user_id string, vec array<double>")


def tasting(shared) -> Callable:
    """What `tastes` does with the batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(r.user, r.unit[0]) for r in _readers(shared.value, batch)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in got], pa.string()), pa.array([v for _, v in got], pa.list_(pa.float64()))], names=["user_id", "vec"])

    return run


def picked_clusters(readers: DataFrame, shared, n: int = 5) -> DataFrame:
    """(user_id, cluster, rank): as `retrieve.pooled_clusters`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = shared.value
        for batch in batches:
            got = [(r.user, shelf.clusters[r.picked(shelf, n)]) for r in _readers(shelf, batch)]
            rows = [(u, int(c), i + 1) for u, cs in got for i, c in enumerate(cs)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int32()))], names=["user_id", "cluster", "rank"])

    return readers.mapInArrow(run, "user_id string, cluster long, rank int")


def profiled(share: float, seed: int = 42) -> Callable:
    """(weights, vectors): the modes of `recommend.profiles`, of the places of a reader's liked items in their order."""

    def of(shelf: Shelf, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = shelf.vec[own]
        if len(own) < COLD_BELOW:
            mean, centres = x.mean(0), shelf.means()
            near = centres @ mean / (_lengths(centres) * _lengths(mean[None]))
            return np.ones(1), (mean * share + centres[int(np.argmax(near))] * (1 - share))[None]
        m = 1 if len(own) < MODES_FROM else min(MODES_MOST, len(own) // PER_MODE)
        if m == 1:
            return np.ones(1), x.mean(0)[None]
        centres, label = lloyd(x, m, seed)
        of_each = [j for j in range(len(centres)) if (label == j).any()]
        return np.array([(label == j).mean() for j in of_each]), centres[of_each]

    return of


# what is said of a reader: functions for `answered`


def relevant(n: int) -> Callable:
    """Every candidate of the reader's n clusters with its relevance."""

    def each(shelf, reader, relevance):
        rows = reader.unread(shelf, reader.picked(shelf, n))
        return rows, relevance[rows]

    return each


def best_rows(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest, best first, ties to the earlier."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.argsort(-score[some], kind="stable")][:k]


def most_relevant(n: int, k: int) -> Callable:
    """The k most relevant candidates; ties, at nine places, to the lower id."""

    def each(shelf, reader, relevance):
        rows = reader.unread(shelf, reader.picked(shelf, n))
        best = rows[best_rows(np.round(relevance[rows], 9), k)]
        return best, np.arange(1, len(best) + 1)

    return each


def valued(shelf: Shelf, values: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The greatest value that each of these items has; 0 without one."""
    at, x = values
    whole = np.full(len(shelf.vec), -np.inf)
    np.maximum.at(whole, at, x)
    out = whole[rows]
    return np.where(np.isneginf(out), 0.0, out)


def scored(n: int, value: str) -> Callable:
    """Every candidate with its value."""

    def each(shelf, reader, _):
        rows = reader.unread(shelf, reader.picked(shelf, n))
        return rows, valued(shelf, reader.more[value], rows)

    return each


def best_scored(n: int, value: str, k: int) -> Callable:
    """The k candidates of greatest value, ties, at nine places, to the lower id; none where no value is positive."""

    def each(shelf, reader, _):
        rows = reader.unread(shelf, reader.picked(shelf, n))
        x = valued(shelf, reader.more[value], rows)
        best = rows[best_rows(np.round(x, 9), k)] if (x > 0).any() else rows[:0]
        return best, np.arange(1, len(best) + 1)

    return each


def percentile(x: np.ndarray) -> np.ndarray:
    """As `windows.average_percentile`, of one group."""
    if not len(x) or x.min() == x.max():
        return np.full(len(x), 0.5)
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return ((np.cumsum(n) - n + 1) + (n - 1) / 2.0 - 1)[at] / (len(x) - 1)


def percentile_of(code: np.ndarray, n: int) -> np.ndarray:
    """`percentile` of values told by their place among n ascending ones."""
    count = np.bincount(code, minlength=n)
    if not len(code) or count.max() == len(code):
        return np.full(len(code), 0.5)
    return ((np.cumsum(count) - count + 1) + (count - 1) / 2.0 - 1)[code] / (len(code) - 1)


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """Rounded as SQL does, halves away from zero."""
    y = x * 10.0**places
    return np.trunc(y + np.copysign(0.5, y)) / 10.0**places


def first_titles(order: np.ndarray, titles: np.ndarray, k: int) -> list[int]:
    """k of these in their order, first titles first; repeats of a title fill up at the end, empty ones never repeat."""
    seen, first, again = set(), [], []
    for i in order:
        if titles[i] and titles[i] in seen:
            again.append(i)
        else:
            seen.add(titles[i])
            first.append(i)
            if len(first) == k:
                break
    return (first + again)[:k]


def united(shelf: Shelf, reader: Reader, n: int, limit: int) -> np.ndarray:
    """Places of the listed, unread items of n clusters and of the best by popularity, popularity in genres and `score`."""
    there = np.zeros(len(shelf.vec), bool)
    there[shown(shelf, reader, reader.picked(shelf, n))] = True
    new = np.ones(len(shelf.vec), bool)
    new[reader.read] = False
    for order in (shelf.popular(), shelf.popular(reader.more["mask"] or None)):
        some = order[: limit + len(reader.read)]
        there[some[new[some]][:limit]] = True
    at, x = reader.more["score"]
    ok = new[at] & shelf.more["listed"][at].astype(bool) & (x > 0)
    at, x = at[ok], x[ok]
    there[at[np.lexsort((at, -half_up(x, 9)))][:limit]] = True
    return np.flatnonzero(there)


def hybrids(n: int, limit: int, k: int, runs: dict[str, rank.Weights]) -> Callable:
    """The lists of `rank.hybrid` over the united pool under each named set of weights: places, scores, ranks, names.

    The shelf has `listed`, `order` and `popularity` (at nine and seven places), `mask` and `title`; a reader `score`,
    `neighbours` and `mask`, the last without a value if no item that it met is listed: it gets no list then.
    """

    def each(shelf, reader, relevance):
        if reader.more["mask"] is None:
            none = np.array([], dtype=int)
            return none, none.astype(float), none, none.astype(object)
        rows = united(shelf, reader, n, limit)
        level, levels, zero = shelf.popularities()
        level = level[rows]
        parts = {
            "content": percentile(half_up(relevance[rows], 7)),
            "popularity": percentile_of(level, levels),
            "genre": percentile_of(np.where((shelf.more["mask"][rows] & reader.more["mask"]) != 0, level, zero), levels),
            "cooccurrence": percentile(half_up(valued(shelf, reader.more["score"], rows), 7)),
            "neighbours": percentile(half_up(valued(shelf, reader.more["neighbours"], rows), 7)),
        }
        titles, out = shelf.more["title"][rows], []
        for weights in runs.values():
            total = sum(parts[f.name] * getattr(weights, f.name) for f in fields(weights))
            score, m = half_up(total, 9), 8 * k
            while True:
                some = best_rows(score, m)
                at = np.array(first_titles(some, titles, k), dtype=int)
                # the list holds for all if it is made of first titles, or nothing was left out
                if m >= len(score) or len({titles[i] or i for i in at}) == k:
                    break
                m *= 8
            out.append((rows[at], score[at], np.arange(1, len(at) + 1)))
        names = np.repeat(np.array(list(runs), dtype=object), [len(o[0]) for o in out])
        return (*(np.concatenate([o[j] for o in out]) for j in range(3)), names)

    return each


def percentiles(n: int, value: str) -> Callable:
    """Every candidate with the percentiles of its relevance and of its value, both at seven places."""

    def each(shelf, reader, relevance):
        rows = reader.unread(shelf, reader.picked(shelf, n))
        return rows, percentile(np.round(relevance[rows], 7)), percentile(np.round(valued(shelf, reader.more[value], rows), 7))

    return each


def blends(n: int, value: str, k: int, shares: dict[str, float]) -> Callable:
    """The k best by each named blend of the two percentiles; ties, at nine places, to the lower id."""
    both = percentiles(n, value)

    def each(shelf, reader, relevance):
        rows, content, other = both(shelf, reader, relevance)
        best = [best_rows(np.round(content * a + other * (1 - a), 9), k) for a in shares.values()]
        return rows[np.concatenate(best)], np.concatenate([np.arange(1, len(b) + 1) for b in best]), np.repeat(np.array(list(shares), dtype=object), [len(b) for b in best])

    return each


def diverse(shelf: Shelf, rows: np.ndarray, relevance: np.ndarray, k: int, trade: float, penalty: float) -> np.ndarray:
    """Places in `rows` of the picks of `rank.greedy` over all of them, in order.

    An item's score is at most trade times its relevance less its genre penalty. So each pick is made among some of the
    most relevant items, and holds for all once every item whose bound reaches it has been let in.
    """
    relevance, (sets, kind) = np.round(relevance, 12), shelf.kinds()
    kind, width, most = kind[rows], np.maximum(sets.sum(1), 1), trade * relevance
    picks, covered, aside = [int(np.argmax(relevance))], np.zeros(sets.shape[1], bool), np.ones(len(rows), bool)
    left = aside.copy()
    some, unit, near = np.array([], dtype=int), shelf.units(rows[:0]), np.array([])
    new = np.arange(len(rows)) if len(rows) <= FEW or not 0 <= trade <= 1 else np.argpartition(-relevance, FEW - 1)[:FEW]
    while len(picks) < min(k, len(rows)):
        last = picks[-1]
        left[last], covered = False, covered | sets[kind[last]]
        lost = (penalty * ((sets & covered).sum(1) / width))[kind]
        near = np.maximum(near, unit @ shelf.units(rows[last : last + 1])[0])
        while True:
            if len(new):
                aside[new] = False
                more, met = shelf.units(rows[new]), np.zeros(len(new))
                for u in shelf.units(rows[picks]):
                    met = np.maximum(met, more @ u)
                some, unit, near = np.append(some, new), np.concatenate([unit, more]), np.append(near, met)
            score = np.where(left[some], np.round(most[some] - (1 - trade) * near - lost[some], 12), -np.inf)
            best = score.max()
            new = np.flatnonzero(aside & left & (most - lost >= best - 1e-9))
            if not len(new):
                break
        picks.append(int(some[score == best].min()))
    return np.array(picks[:k], dtype=int)


def explored(shelf: Shelf, rows: np.ndarray, relevance: np.ndarray, first: np.ndarray, config: rank.Config) -> np.ndarray:
    """Places in `rows`, as `rank.exploration`; `first` are the places of the picks that are shown anyway."""
    best = relevance.max() if len(rows) else 0.0
    segment, macro = shelf.segments()[rows], shelf.more["macro"][rows]
    some = np.flatnonzero((relevance >= (best * config.floor if best > 0 else best)) & (segment < 2))
    some = some[~np.isin(macro[some], macro[first])]
    some = some[np.lexsort((some, -relevance[some], segment[some]))]
    _, one = np.unique(macro[some], return_index=True)
    return some[np.sort(one)][: config.explore]


def slotted(shelf: Shelf, rows: np.ndarray, relevance: np.ndarray, eased: np.ndarray, config: rank.Config, picks: np.ndarray | None = None) -> tuple:
    """(places on the shelf, slot, rank), as `rank.slots` over `rank.mmr` and `rank.exploration`."""
    if not len(rows):
        return rows, np.array([], dtype=object), np.array([], dtype=int)
    if picks is None:
        picks = diverse(shelf, rows, eased, config.k, config.trade, config.genre_penalty)
    n = config.k - config.explore
    seen = explored(shelf, rows, np.round(relevance, 12), picks[:n], config)
    rest = picks[n:][~np.isin(picks[n:], seen)]
    at = np.concatenate([picks[:n], seen, rest])[: config.k]
    kind = np.array(["interest"] * len(picks[:n]) + ["exploration"] * len(seen) + ["interest"] * len(rest), dtype=object)[: config.k]
    return rows[at], kind, np.arange(1, len(at) + 1)


def shown(shelf: Shelf, reader: Reader, codes: np.ndarray) -> np.ndarray:
    """Unread items of these clusters that are listed."""
    rows = reader.unread(shelf, codes)
    return rows[shelf.more["listed"][rows].astype(bool)]


def mmr(n: int, k: int, trade: float = 0.7, penalty: float = 0.15) -> Callable:
    """The diversity ranker's picks, in order."""

    def each(shelf, reader, relevance):
        rows = shown(shelf, reader, reader.picked(shelf, n))
        picks = rows[diverse(shelf, rows, relevance[rows], k, trade, penalty)] if len(rows) else rows
        return picks, np.arange(1, len(picks) + 1)

    return each


def slots(config: rank.Config) -> Callable:
    """The diversity ranker's list with exploration."""

    def each(shelf, reader, relevance):
        rows = shown(shelf, reader, reader.picked(shelf, config.clusters))
        return slotted(shelf, rows, relevance[rows], relevance[rows], config)

    return each


def sweep(settings: dict[str, tuple[rank.Config, int]]) -> Callable:
    """The lists of several named settings, each a configuration and a number of clusters."""

    def each(shelf, reader, relevance):
        order, pools, lists, out = reader.picked(shelf, len(shelf.clusters)), {}, {}, []
        for config, n in settings.values():
            n = min(n, len(order))
            if n not in pools:
                pools[n] = shown(shelf, reader, order[:n])
            rows, ask = pools[n], (n, config.k, config.trade, config.genre_penalty)
            if ask not in lists:  # exploration takes no part in the picks
                lists[ask] = diverse(shelf, rows, relevance[rows], *ask[1:]) if len(rows) else rows
            out.append(slotted(shelf, rows, relevance[rows], relevance[rows], config, lists[ask]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[2] for o in out]), np.repeat(np.array(list(settings), dtype=object), [len(o[0]) for o in out])

    return each


def access(pages: np.ndarray, least: int) -> np.ndarray:
    """As `rank.access_score`, of one pool."""
    x = np.asarray(pages, dtype=float)
    ok = ~np.isnan(x) & (np.nan_to_num(x) >= least)
    out = np.zeros(len(x))
    if ok.any():
        logs = np.log1p(x[ok])
        low, high = logs.min(), logs.max()
        out[ok] = 1.0 if low == high else (high - logs) / (high - low)
    return out


def recommended(config: rank.Config) -> Callable:
    """The same with accessibility in the relevance that picks go by."""

    def each(shelf, reader, relevance):
        rows = shown(shelf, reader, reader.picked(shelf, config.clusters))
        return slotted(shelf, rows, relevance[rows], relevance[rows] + config.access * access(shelf.more["num_pages"][rows], config.least_pages), config)

    return each
