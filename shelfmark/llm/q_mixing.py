"""op7: all documents mixed to source weights 5, 2, 1 at 150 % of their words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import table
from shelfmark.llm.mixing import mix, taken


def op7_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's size and words taken; a null text has none, a null source is the last, repeated rows are taken each by themselves."""
    plan = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    goals = spark.createDataFrame([(q.source, q.size, q.target) for q in plan.quotas], "src long, source_size long, target double")
    return taken(plan).join(goals, "src").select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")
