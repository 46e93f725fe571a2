"""op1: every document's canonical digest and the licence that it is, if it is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.common import table
from shelfmark.llm.license_texts import DIGESTS
from shelfmark.llm.licenses import known_licenses, scan_sql, scanned


def op1_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's digest and licence; a null text is an empty one, which is none. Repeated rows stay."""
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), known_licenses(spark, digests=DIGESTS)).select("doc_id", "canonical_chars", "digest", "license_id")


OP1_SQL = scan_sql()
