"""Exact nearest readers by cosine, and what they read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.windows import top
from shelfmark.store import written

#: Queries multiplied with a batch of the table at a time; a task holds this block's similarities with one batch.
BLOCK = 1024
#: Rows of a batch that they are multiplied with at a time.
ROWS = 2048
#: Queries sent to the executors at once; more are asked in several passes over the table.
PASS_QUERIES = 50_000


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _best(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row, ties to the lower id; -inf is none."""
    if sim.shape[1] <= k:
        return np.nonzero(np.isfinite(sim))
    least = np.partition(sim, sim.shape[1] - k, axis=1)[:, -k]
    rows, columns = np.nonzero((sim >= least[:, None]) & np.isfinite(sim))
    tied = np.bincount(rows, minlength=len(sim)) > k
    if tied.any():  # only rows with ties at the edge are put in order
        free = ~tied[rows]
        rows, columns = [rows[free]], [columns[free]]
        for i in np.nonzero(tied)[0]:
            order = np.lexsort((ids, -sim[i]))[:k]
            rows.append(np.full(len(order), i))
            columns.append(order)
        rows, columns = np.concatenate(rows), np.concatenate(columns)
    return rows, columns


def _merged(held: tuple | None, sim: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """(rows, ids, similarities, least similarity that a row still takes): the k best of what is held and of a new batch."""
    if held is None:
        sim = np.round(sim, 12)
        i, j = _best(sim, ids, k)
        rows, names, s = i, ids[j], sim[i, j]
    else:
        i, j = np.divmod(np.flatnonzero(sim >= held[3][:, None]), sim.shape[1])
        s = np.round(sim[i, j], 12)
        fine = np.isfinite(s)
        rows, names, s = (np.concatenate([a, b[fine]]) for a, b in zip(held[:3], (i, ids[j], s), strict=True))
    order = np.lexsort((names.astype(str), -s, rows))
    rows, names, s = rows[order], names[order], s[order]
    n = np.bincount(rows, minlength=len(sim))
    place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    rows, names, s, place = (x[place < k] for x in (rows, names, s, place))
    least = np.full(len(sim), -np.inf)
    least[rows[place == k - 1]] = s[place == k - 1] - 1e-11  # below it by more than rounding can lift
    return rows, names, s, least


def neighbours(queries: DataFrame, table: DataFrame, k: int = 50, pass_queries: int = PASS_QUERIES, through: Callable | None = None) -> DataFrame:
    """(user_id, neighbour, similarity, rank): the k nearest others of each query by cosine; ties by id.

    The queries are a stated set (an evaluation cohort). They are multiplied in blocks with the batches of the table, each
    of which a task keeps the k best so far, and a window merges what tasks have: partial top-k, then final. At most about `pass_queries` of
    them are held at once, whatever their number: more are parted by a hash and asked in as many passes over the table.
    `through` makes batches of (user_id, vec) of the table's, in the same Python workers, where it has no vectors itself.
    """
    n = queries.count()
    parts = max(1, -(-n // pass_queries))
    found = [_pass(queries.where(F.pmod(F.xxhash64("user_id"), F.lit(parts)) == i) if parts > 1 else queries, table, k, through) for i in range(parts)]
    return top(reduce(DataFrame.unionByName, found), k, [F.desc("similarity"), F.col("neighbour")], over=["user_id"])


def _pass(queries: DataFrame, table: DataFrame, k: int, through: Callable | None) -> DataFrame:
    rows = queries.select("user_id", "vec").collect()
    blocks = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
    shared = table.sparkSession.sparkContext.broadcast([(np.array([r[0] for r in b], dtype=object), _unit(np.array([r[1] for r in b], dtype=float))) for b in blocks])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.iloc[start : start + ROWS]
                ids = part["user_id"].to_numpy()
                at = {name: i for i, name in enumerate(ids)}
                y = _unit(np.array(part["vec"].tolist(), dtype=float))
                for b, (names, x) in enumerate(shared.value):
                    sim = x @ y.T
                    own = [(i, at[name]) for i, name in enumerate(names) if name in at]
                    if own:
                        sim[tuple(np.array(own).T)] = -np.inf
                    held[b] = _merged(held.get(b), sim, ids, k)
        for b, (i, neighbour, similarity, _) in held.items():
            yield pd.DataFrame({"user_id": shared.value[b][0][i], "neighbour": neighbour, "similarity": similarity})

    told = "user_id string, neighbour string, similarity double"
    if through is None:
        return table.select("user_id", "vec").mapInPandas(run, told)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in run(batch.to_pandas() for batch in through(batches)):
            yield pa.RecordBatch.from_pandas(found, pa.schema([("user_id", pa.string()), ("neighbour", pa.string()), ("similarity", pa.float64())]), preserve_index=False)

    return table.mapInArrow(made, told)


def neighbour_scores(near: DataFrame, history: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """(user_id, book_id, score): for each item read by neighbours, the sum of their positive similarities; own reads are out."""
    reads = history.where("is_read") if cutoff is None else history.where(F.col("is_read") & F.col("date_added").isNotNull() & (F.col("date_added") <= cutoff))
    reads = reads.select("user_id", "book_id").distinct()
    return read_by(near, reads).join(reads, ["user_id", "book_id"], "left_anti")


def read_by(near: DataFrame, reads: DataFrame) -> DataFrame:
    """(user_id, book_id, score): the same from distinct reads, own reads included."""
    theirs = near.where("similarity > 0").join(reads.select(F.col("user_id").alias("neighbour"), "book_id"), "neighbour")
    return theirs.groupBy("user_id", "book_id").agg(F.sum("similarity").alias("score"))


#: Rows of (query, neighbour) that go to the readers; more are joined with them.
SENT = 500_000


def read_by_lists(near: DataFrame, lists: DataFrame) -> DataFrame:
    """`read_by` from readers with the list of their reads: what neighbours found goes to the readers, not the reads to it."""
    near = written(near.where("similarity > 0").select("user_id", "neighbour", "similarity"), "near")
    sent = F.broadcast(near) if near.count() <= SENT else near
    theirs = lists.select(F.col("user_id").alias("neighbour"), F.array_distinct(F.transform("read", lambda r: r["book_id"])).alias("_b")).join(sent, "neighbour")
    # dealt by reader, so that the sums and the reader's list of them need no further exchange
    each = theirs.select("user_id", "similarity", F.explode("_b").alias("book_id")).repartition("user_id")
    return each.groupBy("user_id", "book_id").agg(F.sum("similarity").alias("score"))
