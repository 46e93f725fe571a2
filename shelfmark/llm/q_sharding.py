"""op9: all documents dealt into 16 shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import table
from shelfmark.llm.sharding import external_shuffle


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's shard and slot under the law `rows`; a null text has size 1, repeated rows are placed each by themselves."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    return external_shuffle(docs.select("doc_id", "text", "lang", "source")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
