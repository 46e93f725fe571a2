"""op2: all pages as WARC records, audited against a replica with planted damage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import table
from shelfmark.llm.merkle import FANOUT, FILE_LEVELS, audit, warc_record

#: Of 1,000 records, by a checksum of their number: the first so many have a byte changed, then are cut short, then are lost.
CHANGED, CUT, LOST = 10, 14, 20


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records as written, and a replica with damage that a checksum of each number decides."""
    whole = pages.select("page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    draw = F.coalesce(F.crc32(F.col("page_id").cast("string").cast("binary")) % 1000, F.lit(999))
    n = F.length("record")
    changed = F.concat(F.substring(F.col("record"), F.lit(1), n - 10), F.lit("#"), F.substring(F.col("record"), n - 8, F.lit(9)))
    record = F.when(draw < CHANGED, changed).when(draw < CUT, F.substring(F.col("record"), F.lit(1), n - 7)).otherwise(F.col("record"))
    return whole, whole.where(~((draw >= CUT) & (draw < LOST))).withColumn("record", record)


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = replicas(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return audit(a, b, "page_id", "record").withColumnRenamed("number", "page_id")


OP2_SQL = f"""
WITH w AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS ra,
    CAST(page_id - min(page_id) OVER () + 1 AS BIGINT) // {FANOUT**FILE_LEVELS} AS file FROM pages),
h AS (SELECT CAST(page_id AS VARCHAR) AS s, page_id FROM pages),
bits AS (SELECT page_id, list_reduce([CAST(4294967295 AS UBIGINT)] || [CAST(ascii(c) AS UBIGINT) FOR c IN string_split(s, '')],
    lambda crc, x: list_reduce([xor(crc, x)] || [CAST(0 AS UBIGINT) FOR i IN range(8)], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, CAST(3988292384 AS UBIGINT)) ELSE y >> 1 END)) AS c FROM h),
d AS (SELECT w.*, CAST(xor(c, CAST(4294967295 AS UBIGINT)) AS BIGINT) % 1000 AS draw FROM w JOIN bits USING (page_id)),
r AS (SELECT page_id, file, ra, CASE WHEN draw < {CHANGED} THEN left(ra, length(ra) - 10) || '#' || right(ra, 9) WHEN draw < {CUT} THEN left(ra, length(ra) - 7)
    WHEN draw < {LOST} THEN NULL ELSE ra END AS rb FROM d),
o AS (SELECT *, CAST(coalesce(sum(strlen(ra)) OVER p, 0) AS BIGINT) AS offset_a, CAST(coalesce(sum(coalesce(strlen(rb), 0)) OVER p, 0) AS BIGINT) AS ob
    FROM r WINDOW p AS (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT page_id, file, CASE WHEN rb IS NULL THEN 'missing' ELSE 'corrupt' END AS kind, offset_a, CAST(strlen(ra) AS BIGINT) AS bytes_a, sha256(ra) AS hash_a,
    CASE WHEN rb IS NOT NULL THEN ob END AS offset_b, CAST(strlen(rb) AS BIGINT) AS bytes_b, sha256(rb) AS hash_b
FROM o WHERE ra IS DISTINCT FROM rb
"""
