"""op8: the fingerprints of every document and of its edited text, with their likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import table, words_of
from shelfmark.llm.fingerprints import as_text, edited, fingerprinted, likeness, packed_fingerprint, with_next


def op8_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's fingerprints; a null text is an empty one, null ids come first, rows of one id follow each other by a hash of their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(fingerprinted(docs), ["text", "packed"])
    n = F.length("text")
    new = led.select("doc_id", n.cast("long").alias("n_chars"), "packed", "next_packed", edited(F.col("text"), n, F.col("next_text")).alias("edited"))
    new = new.withColumn("words", words_of("edited"))
    out = new.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "packed", "next_packed", packed_fingerprint(F.col("words")).alias("edited_packed"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("packed")).alias("fingerprint"),
        as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
