"""op10: the near-duplicate class and number of links of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.common import table
from shelfmark.llm.lshforest import near_duplicates


def op10_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's class and links; a text without words has none, repeated rows count each other."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Exact all-pairs similarity through shared shingles, and classes by walking links.
OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(2, len(w) - 3))]) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * common >= 4 * (x.n + y.n - common)),
walk(doc_id, here) AS (SELECT doc_id, doc_id FROM w UNION SELECT walk.doc_id, l.b FROM walk JOIN l ON l.a = walk.here)
SELECT doc_id, (SELECT min(here) FROM walk k WHERE k.doc_id = w.doc_id) AS class_id, (SELECT count(*) FROM l WHERE a = w.doc_id) AS n_links FROM w
"""
