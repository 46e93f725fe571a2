"""op5: the language of every document, learned from the documents that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.common import table
from shelfmark.llm.langid import fit, held_out, identify


def op5_word_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's language; `und` and 0 for a null text or one without letters. A null id is not held out and teaches nothing."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id")))
    return identify(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
