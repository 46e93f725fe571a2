"""License scan by canonical digests.

A text is normalised (case, punctuation, white space, copyright lines, equivalent spellings) and its SHA-256 is
looked up, whole text against whole text, in a table of known licences' digests by a hash join. Everything is
built-in functions; the digest of a text is made once, where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.license_texts import DIGESTS, LICENSES

#: A line that states a copyright and no more; fixed by what such lines look like in licence files.
COPYRIGHT_LINE = r"(?m)^[^\w\n]*(copyright( \(c\)| ©|[ :]+[0-9<\[{]|s? by )|\(c\) |© ?[0-9a-z]|all rights reserved)[^\n]*$"
#: Spellings that count as one, in the order in which they are replaced.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authoris", "authoriz"),
    ("behaviour", "behavior"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalis", "capitaliz"),
    ("catalogue", "catalog"),
    ("categoris", "categoriz"),
    ("centre", "center"),
    ("colour", "color"),
    ("copyright owner", "copyright holder"),
    ("defence", "defense"),
    ("emphasise", "emphasize"),
    ("favour", "favor"),
    ("fulfill", "fulfil"),
    ("honour", "honor"),
    ("initialis", "initializ"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximis", "maximiz"),
    ("minimise", "minimize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("offence", "offense"),
    ("optimis", "optimiz"),
    ("organis", "organiz"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognis", "recogniz"),
    ("signalling", "signaling"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("http://", "https://"),
    ("&", " and "),
)
#: The known digests are broadcast while they weigh at most this.
BROADCAST_BYTES = 8 << 20


def canonical(text: Column) -> Column:
    """The normal form of a text; empty where nothing but punctuation and copyright lines is left."""
    out = F.regexp_replace(F.lower(F.regexp_replace(text, r"\r\n?", "\n")), COPYRIGHT_LINE, "")
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def known_licenses(spark: SparkSession, texts: dict[str, str] = LICENSES, digests: dict[str, str] | None = None) -> DataFrame:
    """(digest, license_id): the digest table of licence texts and of licences known by digest; of two ids with one digest, the first."""
    df = spark.createDataFrame(sorted(texts.items()), "license_id string, text string")
    made = df.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id")
    if digests:
        made = made.unionByName(spark.createDataFrame(sorted(digests.items()), "license_id string, digest string"))
    return made.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scanned(df: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """df with `canonical_chars` (long), `digest` (lower-case hex) and `license_id`, null where no licence is the whole text.

    A null or empty text has the digest of an empty one and no licence; a text of any length is normalised as a whole. Repeated rows stay; columns of df with these
    names are replaced; `known` has one row for each digest.
    """
    names = [c for c in df.columns if c not in ("canonical_chars", "digest", "license_id")]
    made = df.withColumn("_canonical", canonical(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    made = made.select(*[F.col(f"`{c}`") for c in names], F.length("_canonical").cast("long").alias("canonical_chars"), F.sha2("_canonical", 256).alias("digest"))
    table = known.where(F.col("digest") != F.sha2(F.lit(""), 256)).select("digest", "license_id")
    if table.count() * 100 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return made.join(table, "digest", "left").select(*[F.col(f"`{c}`") for c in names], "canonical_chars", "digest", "license_id")


def canonical_sql(text: str) -> str:
    """The same normal form in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower(regexp_replace({text}, '\\r\\n?', chr(10), 'g')), {quote(COPYRIGHT_LINE)}, '', 'g')"
    for a, b in EQUIVALENT:
        out = f"replace({out}, {quote(a)}, {quote(b)})"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def scan_sql(texts: dict[str, str] = LICENSES, digests: dict[str, str] = DIGESTS) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(texts.items()))
    ready = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(digests.items()))
    return f"""
WITH known AS (SELECT digest, min(id) AS license_id FROM (SELECT id, sha256({canonical_sql('t')}) AS digest FROM (VALUES {rows}) AS l(id, t) UNION ALL SELECT * FROM (VALUES {ready}) AS r(id, digest)) GROUP BY 1),
d AS (SELECT doc_id, {canonical_sql("coalesce(text, '')")} AS c FROM documents)
SELECT doc_id, CAST(length(c) AS BIGINT) AS canonical_chars, sha256(c) AS digest, license_id
FROM d LEFT JOIN known ON known.digest = sha256(c) AND c <> ''
"""
