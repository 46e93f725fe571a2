"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash; pass two gathers one bucket at
a time, puts it in the order of its rows' hashes and Fisher-Yates shuffles it (Spark's seeded `shuffle`
function is a Fisher-Yates). The buckets laid end to end are one uniform permutation of the table, which is
cut into shards whose row counts differ by one at most. Everything is DataFrame functions.

The rows cross the network once. A bucket's place in the permutation comes with its rows, as one marker row
for each bucket that is dealt like they are, so no join meets the gathered rows. Each bucket is one partition
of its own, made by passing the bucket's number through as the partition's, so the shuffle's generator,
seeded by seed and partition, starts anew in each bucket and a repeated task draws the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.store import written

#: Bytes of text and fields that a bucket holds on average; a task holds a few times as much.
BUCKET_BYTES = 32 << 20
#: Rows alike in all columns are scattered in pieces of so many, once there are more of them.
PIECE_ROWS = 1024
#: At most so many kinds of repeated rows are told apart for that; a kind has one part in so many of all rows at least.
MOST_KINDS = 100_000
#: Buckets whose places are summed in one task.
RUN = 1024


def _starts(tally: DataFrame) -> DataFrame:
    """(b, first): the rows in the buckets before b, summed in runs of buckets and then over the runs."""
    before = Window.unboundedPreceding, -1
    run = tally.withColumn("g", F.expr(f"b div {RUN}"))
    heads = run.groupBy("g").agg(F.sum("n").alias("t"))
    heads = heads.select("g", F.coalesce(F.sum("t").over(Window.orderBy("g").rowsBetween(*before)), F.lit(0)).alias("head"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("b").rowsBetween(*before)), F.lit(0))
    return run.select("b", "g", inside.alias("inside")).join(heads, "g").select("b", (F.col("head") + F.col("inside")).alias("first"))


def external_shuffle(df: DataFrame, shards: int = 16, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """df's rows and columns with `_shard` (0 to shards-1) and `_slot` (gapless from 0 in each shard).

    The law is `rows`: counts of shards are at most one apart. A row's bucket follows from a hash of all its
    columns, so rows of one key or of one text are scattered like any others. Rows alike in all columns, once
    there are more than `piece_rows` and one part in MOST_KINDS of the table, cross the network as counts and are
    scattered in pieces, so no bucket grows with them. The bucket count follows the measured bytes of the
    table. Nulls are values like others; repeated rows are all kept; an empty table gives no rows; a text of any
    length is one row of its bucket; columns of df may have any names, and a `_shard` or `_slot` there is replaced.
    Column types must be ordered ones (no maps), as a bucket's rows are put in order. Neither the order of the
    input's rows nor their partitions play a part.
    """
    names = [c for c in df.columns if c not in ("_shard", "_slot")]
    columns = [F.col(f"`{c}`") for c in names]
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind == "string" and c in names), F.lit(16))
    kinds = written(df.groupBy(F.xxhash64(*columns).alias("h")).agg(F.count("*").alias("n"), F.sum(width.cast("long")).alias("bytes")), "shuffle-kinds")
    total, volume = (x or 0 for x in kinds.agg(F.sum("n"), F.sum("bytes")).first())
    many = max(piece_rows, total // MOST_KINDS)
    hot = kinds.where(F.col("n") > many).select("h")
    split = not hot.isEmpty()
    buckets = max(1, -(-volume // bucket_bytes))

    def bucket(*of: Column | str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(buckets)).cast("int").alias("b")

    rows = df.select(F.struct(F.xxhash64(*columns).alias("h"), F.struct(*columns).alias("row")).alias("r"))
    tally = kinds.where(F.col("n") <= many).select(bucket("h"), "n")
    none = F.lit(None).cast("long")
    if split:
        repeated = F.broadcast(hot)  # MOST_KINDS rows at most
        alike = rows.join(repeated, F.col("r.h") == hot["h"], "left_semi").groupBy("r").count()
        piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {piece_rows}"))).alias("piece")
        pieces = alike.select("r", "count", piece).select("r", F.least(F.lit(piece_rows), F.col("count") - F.col("piece") * piece_rows).alias("n"), bucket("r.h", "piece"))
        pieces = written(pieces, "shuffle-pieces")
        tally = tally.unionByName(pieces.select("b", "n"))
        rows = rows.join(repeated, F.col("r.h") == hot["h"], "left_anti")
    rows = rows.select("r", F.lit(1).cast("long").alias("n"), bucket("r.h"))
    if split:
        rows = rows.unionByName(pieces)
    tally = written(tally.groupBy("b").agg(F.sum("n").alias("n")), "shuffle-buckets")
    markers = _starts(tally).select(F.lit(None).cast(rows.schema["r"].dataType).alias("r"), none.alias("n"), "b", "first")
    dealt = rows.withColumn("first", none).unionByName(markers).repartitionById(buckets, F.col("b"))
    gathered = dealt.groupBy("b").agg(F.sort_array(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "n") if split else F.col("r")))).alias("rs"), F.max("first").alias("first"))
    rs = F.flatten(F.transform("rs", lambda x: F.array_repeat(x["r"], x["n"].cast("int")))) if split else F.col("rs")
    placed = gathered.select("first", F.posexplode(F.shuffle(rs, F.lit(seed))).alias("pos", "r")).select("r.row", (F.col("first") + F.col("pos")).alias("at"))
    # shard s holds positions ceil(s * total / shards) up to the next shard's first
    placed = placed.withColumn("shard", F.expr(f"cast(at * {shards} div {max(1, total)} as int)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("shard").alias("_shard"), (F.col("at") - first).alias("_slot"))


def write_shards(shuffled: DataFrame, path: str, shard: str = "_shard", slot: str = "_slot") -> None:
    """One folder for each shard, its rows in slot order; a range exchange keeps a large shard in several tasks."""
    shuffled.repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
