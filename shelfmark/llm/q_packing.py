"""op4: all documents packed into windows of 256, 512 and 1024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import table
from shelfmark.llm.packing import pack


def op4_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a piece; a null text has the end id alone, a null id stays null, repeated rows are packed each by themselves."""
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group")
