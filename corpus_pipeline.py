"""The corpus pipeline: documents to packed sequences, stage by stage.

Each stage takes and returns a table with the columns of ``documents``; the last one returns the packing.  Stages
only drop rows, and each works on all rows that the one before it kept.  Other columns pass through, whatever their
names; null texts are empty ones, and null or repeated ids are kept apart by their texts.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import arrays, decontaminate, exact, jaccard, language, packing

#: Columns that stages use.
OWN = ("doc_id", "text", "lang", "source")


def _apart(stage):
    """The stage with all columns but its own under other names, so that none of the user's clashes with a working column."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        inner = [c if c in OWN and c not in names[:i] else f"__{i}" for i, c in enumerate(names)]
        return stage(spark, docs.toDF(*inner), sf_dir).toDF(*names)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a column ``_row``: their id, or for rows without one a number above the ids by a hash of the text."""
    other = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 62))
    return docs.withColumn("_row", F.coalesce(F.col("doc_id").cast("long"), other))


@_apart
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lie too far from all languages, or hold no letter, go."""
    return language.accepted(docs, language.fit(docs))


@_apart
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; of equal texts without any id one row stays."""
    kept = exact.exact_groups(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    kept = arrays.stored(kept)
    same = (F.col("doc_id") == F.col("_kept_id")) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("_kept_sha"))
    # a row without an id stays if no row with an id has its text
    without = docs.where("doc_id is null").withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["_sha"])
    without = without.join(kept, F.col("_sha") == F.col("_kept_sha"), "left_anti").drop("_sha")
    return docs.join(kept, same, "left_semi").unionByName(without)


@_apart
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared shingles the one with the smallest id stays; rows without an id come last."""
    rows = _numbered(docs)
    classes = jaccard.jaccard_classes(rows.select(F.col("_row").alias("doc_id"), "text"), n=5)
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


@_apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leaked benchmark item go, with or without an id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _numbered(docs)
    leaks = decontaminate.find_leaks(rows.select(F.col("_row").alias("doc_id"), "text"), items)
    leaked = leaks.where("contaminated").select(F.col("doc_id").alias("_row"))
    return rows.join(leaked, "_row", "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of 4096 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), 4096)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]
#: Models, tokenizers and templates are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = arrays.stored(docs)
    return docs
