"""op3: every document measured and judged by the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.common import table
from shelfmark.llm.rules import judged, rules_sql


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's counts and verdict; a null text has no words, so the base fails it. Repeated rows stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "failed")


OP3_SQL = rules_sql()
