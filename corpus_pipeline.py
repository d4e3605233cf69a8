"""From raw documents to packed training rows: quality rules, exact dedup, near-dedup, removal of repeated passages,
best-fit packing. Each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.cluster import ship
from corvane.llm import minhash, packing, quality, radix, suffixes
from corvane.llm.common import new_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null text has no word and goes, a null id stays; rows that repeat are judged alike; a table
    without rows, and columns of any name, pass through all stages but the last."""
    return quality.keep_quality(docs, quality.trusted_ids(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, of rows that repeat an id and a text one; a null text is empty, a null id
    the least."""
    return radix.keep_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five-word shingles, similarity of 0.8) the document with the smallest id stays; a null id is the
    largest. Texts without words, null ones too, are in no group."""
    ship(spark)
    return minhash.keep_near(docs, size=5)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of 400 bytes, that stand elsewhere too are cut out, every copy of them (op9's rule, so that no order
    of documents matters); n_chars follows the text. Null texts stay null."""
    ship(spark)
    out = suffixes.without_passages(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a bin; of documents whose rests are equal now, one a bin. Null and empty texts get bin -1, a
    null id and rows that repeat are packed like others, long texts fill bins of their own."""
    ship(spark)
    return packing.best_fit(docs, cluster=packing.cluster_of())


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("suffix_array_dedup", suffix_stage),
    ("best_fit_packing", packing_stage),
]

#: The near-duplicate, suffix and packing stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
