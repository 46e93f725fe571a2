import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.curation import clean, keep_best
from shelfmark.sources import files
from shelfmark.streaming import dedup
from shelfmark.streaming.dedup import current, keep_best_stream
from tests.test_cases import RAW



def test_stream_equals_batch(spark, tmp_path):
    d = datetime(2015, 1, 1)
    rows = [(f"u{i % 5}", f"b{i % 3}", None, i % 6, i % 2 == 0, d, datetime(2015, 1, 1 + i % 20), i) for i in range(60)]
    src = f"file://{tmp_path}/in"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], RAW).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(src)
    keep_best_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", [F.col("category")]).awaitTermination()
    got = sorted((r.interaction_key, r.category) for r in current(spark, f"file://{tmp_path}/out").collect())
    want = sorted((r.interaction_key, r.category) for r in keep_best(clean(spark.createDataFrame(rows, RAW)), [F.col("category")]).collect())
    assert got == want


def test_stream_leaves_untouched_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "WHOLE_EVERY", 4)
    d = datetime(2015, 1, 1)
    rows = [(f"u{i % 7}", f"b{i % 5}", None, i % 6, i % 2 == 0, d, datetime(2015, 1, 1 + i % 20), i) for i in range(60)]
    for k in range(6):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], RAW).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(RAW).parquet(f"file://{tmp_path}/in")
        keep_best_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", [F.col("category")]).awaitTermination()
        all_ = clean(spark.createDataFrame(rows[: k * 10 + 10], RAW))
        want = sorted((r.interaction_key, r.category) for r in keep_best(all_, [F.col("category")]).collect())
        assert sorted((r.interaction_key, r.category) for r in current(spark, f"file://{tmp_path}/out").collect()) == want
        touched = len(list((tmp_path / "out" / f"v{k}").glob("bucket=*")))
        assert touched == len(dedup.latest(spark, f"file://{tmp_path}/out")) if k % 4 == 0 else touched <= 10
    assert sorted(p.name for p in (tmp_path / "out").glob("v*")) == ["v4", "v5"]


def test_json_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write("\n\n".join(json.dumps({"id": i, "x": {"y": [i]}}) for i in range(10)))
    df = files.json_lines(spark, f"file://{tmp_path}/a.json.gz", "id long, x struct<y:array<int>>", partitions=3)
    assert sorted(r.id for r in df.collect()) == list(range(10)) and df.rdd.getNumPartitions() == 3
    assert files.json_lines(spark, f"file://{tmp_path}/a.json.gz", "id long", limit=4).count() == 4


def test_build_once_and_schema_cast(spark, tmp_path):
    path, calls = f"file://{tmp_path}/t", []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, "2")], "a long, b string")

    assert [files.built_once(spark, path, build)[1], files.built_once(spark, path, build)[1], files.built_once(spark, path, build, force=True)[1]] == ["built", "cached", "built"]
    assert len(calls) == 2 and files.size_of(spark, path) > 0
    files.write(build(), f"{path}2", schema=T.StructType([T.StructField("b", T.IntegerType())]))
    assert spark.read.parquet(f"{path}2").first().b == 2
    assert files.first_existing(spark, f"{path}9", path) == path and files.remove(spark, path)
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, path)


def test_tagged_union_and_markdown(spark):
    df = files.tagged_union({"x": spark.range(5).toDF("a"), "y": spark.range(5).toDF("b")}, "tag", rows_per_source=2)
    assert df.groupBy("tag").count().count() == 2 and df.count() == 4
    assert files.markdown(spark.createDataFrame([("m", 0.5, None)], "a string, b double, c int")).splitlines()[2] == "| m | 0.5 |  |"
    with pytest.raises(ValueError):
        files.markdown(spark.range(300))


def test_scan_pushes_down(spark):
    df = files.scan(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey"], F.col("l_quantity") > 40)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan and "l_tax" not in plan


def test_reports(spark):
    from shelfmark.plans import reports

    s = spark.createDataFrame([("content_only", 5, 0.2), ("B1", 5, 0.1)], "system string, k int, recall double")
    v = spark.createDataFrame([(5, True)], "k int, wins boolean")
    assert reports.model_label(s) == "content_only"
    text = reports.status(s, v, {"items": 1200})
    assert "1,200" in text and "## Verdict: validated" in text
    g = reports.graph_report(spark.createDataFrame([(2, 1)], "nodes int, edges int"), spark.createDataFrame([(2, 1)], "threshold int, edges int"), spark.createDataFrame([("a", 0.7), ("b", 0.3)], "id string, rank double"), spark.createDataFrame([("a", "Title")], "book_id string, title string"))
    assert "| Title | 0.7 |" in g
