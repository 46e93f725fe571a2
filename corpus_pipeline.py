"""Documents through five corpus stages, each over all that its predecessor kept.

Every stage takes documents with COLUMNS (a missing one is an error, others are left out) and any values: nulls in any
column, empty and very long texts, repeated rows and keys, no rows at all. What becomes of these is stated with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.langid import UNKNOWN, fit, held_out, identify
from shelfmark.llm.lshforest import deduplicated
from shelfmark.llm.mixing import mix, mixed_documents
from shelfmark.llm.packing import pack
from shelfmark.llm.rules import judged
from shelfmark.store import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose likeliest language has less than this share of the posterior is rejected.
LEAST_SCORE = 0.4


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; their `lang` is the one found. Texts without letters (null ones too) and undecided ones go.

    Rows with a null key, text or language teach nothing, but each row is told by its whole text; repeated rows are told alike.
    """
    model = fit(docs.where(~held_out("doc_id")))
    told = identify(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _documents(told.withColumn("lang", F.col("lang_pred")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and every rule of the threshold table; each row by its whole text, so a null text goes."""
    return _documents(judged(docs).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id, null last.

    Rows of one id and unlike texts are of several classes and stay; texts without words are near no others.
    """
    return _documents(deduplicated(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their targets: a row for each pass over a document, cut to the words taken.

    A null source is a source, the last; a text without words is never taken; rows of one id are told apart by text and source.
    """
    mixed = mixed_documents(docs, mix(docs))
    return _documents(mixed.withColumn("n_chars", F.length("text").cast("long")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 256, 512 and 1024 tokens; a null text has its end token alone, a null id stays null."""
    pieces = pack(docs.select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group")


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language models, signatures and multinomial draws are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`; each one's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
