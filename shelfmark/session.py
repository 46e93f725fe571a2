"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans skewed joins and merges small partitions; UTC keeps epoch arithmetic exact.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[*]", name: str = "shelfmark", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench; on a cluster, spark-submit sets the resources."""
    b = SparkSession.builder.master(master).appName(name).config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in (SETTINGS | extra).items():
        b = b.config(k, v)
    return b.getOrCreate()
