"""op6: tokens of every document before and after three edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import table
from shelfmark.llm.tokencounts import counted, recounted


def op6_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text gets an insertion at a third, loses five characters at the half, and has seven near its end replaced."""
    trees = counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    edit = lambda at, out, new: F.struct(at.cast("long").alias("start"), (at + out).cast("long").alias("end"), new.alias("new"))
    edits = F.array(
        edit(F.floor(n / 3), F.lit(0), F.concat(F.lit(" see also no. "), F.coalesce(F.col("key").cast("string"), F.lit("?")), F.lit(",\n"))),
        edit(F.floor(n / 2), F.lit(5), F.lit("")),
        edit(F.floor(4 * n / 5), F.lit(7), F.lit("It's")),
    )
    after = recounted(trees.withColumn("edits", edits))
    return after.select(
        F.col("key").alias("doc_id"),
        F.col("tokens_before").alias("n_tokens"),
        F.get("tokens", F.lit(1)).cast("long").alias("edited_tokens"),
        F.length("text").cast("long").alias("edited_chars"),
        F.crc32("text").alias("edited_crc32"),
        "reencoded",
    )
