"""Keep-best deduplication of a stream of interactions, batch by batch.

The blueprint's flows are batch; this applies the same priority to increments. Keys are dealt over hash buckets. Batch n
reads the rows of the buckets that it touches, and writes these buckets, merged, as version n; every other bucket stays
where it was written last. A batch reads versions before its own alone, so a repeated batch gives the same table. Each
`WHOLE_EVERY`-th version holds all buckets, and the batch after it removes what is older, so listings and disk stay bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.curation import clean, keep_best
from shelfmark.sources.files import folders, remove

BUCKETS = 64
#: Versions from one that holds all buckets to the next.
WHOLE_EVERY = 32


def bucket_of(key: str = "interaction_key"):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def merged(current: DataFrame | None, batch: DataFrame, tie: list) -> DataFrame:
    """The best row of each key among the current winners and a raw batch."""
    new = clean(batch).withColumn("bucket", bucket_of())
    return keep_best(new if current is None else current.unionByName(new, allowMissingColumns=True), tie)


def latest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, tuple[int, str]]:
    """For each bucket the last whole version that holds it, of those earlier than `before`, and its folder."""
    out: dict[int, tuple[int, str]] = {}
    done = {int(p.split("/")[-2][1:]) for p in folders(spark, f"{path}/v*/_SUCCESS")}
    for p in folders(spark, f"{path}/v*/bucket=*"):
        v, b = int(p.split("/")[-2][1:]), int(p.rsplit("=", 1)[1])
        if v in done and (before is None or v < before) and v >= out.get(b, (-1, ""))[0]:
            out[b] = (v, p)
    return out


def current(spark: SparkSession, path: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The winners so far, of some buckets or of all; None before the first row."""
    found = [p for b, (_, p) in latest(spark, path, before).items() if buckets is None or b in buckets]
    return spark.read.parquet(*found).withColumn("bucket", bucket_of()) if found else None


def keep_best_stream(stream: DataFrame, path: str, checkpoint: str, tie: list, once: bool = True) -> StreamingQuery:
    """Starts the stream into versions under `path`; batch n makes version n."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        whole = n % WHOLE_EVERY == 0
        touched = None if whole else [r[0] for r in clean(batch).select(bucket_of()).distinct().collect()]  # at most BUCKETS numbers
        merged(current(spark, path, n, touched), batch, tie).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{n}")
        if n % WHOLE_EVERY == 1 and n > 1:  # the whole version before this one is committed, and no batch reads behind it again
            for p in folders(spark, f"{path}/v*"):
                if int(p.rsplit("/v", 1)[1]) < n - 1:
                    remove(spark, p)

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
