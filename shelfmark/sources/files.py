"""Readers and writers of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def size_of(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in order; listed by the driver."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(str(f.getPath().toString()) for f in found or [])


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of several paths that exists: the new place, else the legacy one."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def json_lines(spark: SparkSession, path: str | list[str], schema: str | T.StructType, limit: int | None = None, partitions: int | None = None) -> DataFrame:
    """JSON lines, gzip or not, by an explicit schema; blank lines are skipped, bad ones are null rows.

    A gzip file is one task's read; `partitions` spreads its rows before costly work.
    """
    df = spark.read.schema(schema).json(path)
    df = df.limit(limit) if limit is not None else df
    return df.repartition(partitions) if partitions else df


def scan(spark: SparkSession, path: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """A Parquet scan; columns and condition reach the reader."""
    df = spark.read.parquet(path)
    return (df if where is None else df.where(where)).select(*columns)


def tagged_union(parts: dict[str, DataFrame], tag: str, rows_per_source: int | None = None) -> DataFrame:
    """The parts one after another, each row with its part's name; optionally the first rows of each alone."""
    out = None
    for name, df in parts.items():
        one = (df.limit(rows_per_source) if rows_per_source is not None else df).withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write(df: DataFrame, path: str, form: str = "parquet", schema: T.StructType | None = None, partition_by: list[str] | None = None, **options: str) -> None:
    """A distributed overwrite; `schema` casts the columns to a contract first."""
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    w = df.write.mode("overwrite").options(**options).format(form)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def built_once(spark: SparkSession, path: str, build, force: bool = False) -> tuple[DataFrame, str]:
    """(table, status): the table under `path`, built only where it is not there yet, or by force."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        write(build(), path)
        return spark.read.parquet(path), "built"
    return spark.read.parquet(path), "cached"


def markdown(rows: DataFrame, limit: int = 200) -> str:
    """A small table as Markdown; beyond the limit it is refused."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"a report table has {limit} rows at most")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *["| " + " | ".join(cell(v) for v in r) + " |" for r in got]])


def csv_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header, by an explicit schema; a value that does not fit is null. Quotes are doubled within quotes."""
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True, enforceSchema=True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    write(df, path, "csv", header="true", escape='"')


def chart(rows: DataFrame, x: str, y: str, mark: str = "bar", limit: int = 1000) -> str:
    """A small table as a Vega-Lite description, data included; beyond the limit it is refused."""
    import json

    got = rows.select(x, y).limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"a chart has {limit} rows at most")
    kind = lambda c: "quantitative" if isinstance(rows.schema[c].dataType, T.NumericType) else "nominal"
    enc = {axis: {"field": c, "type": kind(c)} for axis, c in (("x", x), ("y", y))}
    return json.dumps({"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "mark": mark, "encoding": enc, "data": {"values": [r.asDict() for r in got]}}, default=str)
