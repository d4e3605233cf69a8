"""Retrieval quality: evidence matches, metrics of each question, a run's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9一-鿿]", "")


def evidence_matches(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid, evidence_id, first_rank: results (qid, rank, stable_chunk_id, source, page, text) against evidence (qid, evidence_id,
    stable_chunk_id, source, page, terms). By id, or by source and page with all terms in the text (plain, or letters and
    digits only). Joined by question first."""
    e = evidence.select("qid", "evidence_id", F.col("stable_chunk_id").alias("e_id"), F.col("source").alias("e_source"), F.col("page").alias("e_page"), "terms")
    low = F.lower("text")
    tight = compact(F.col("text"))
    all_terms = F.forall("terms", lambda t: F.contains(low, F.lower(t)) | F.contains(tight, compact(t)))
    same = (F.col("stable_chunk_id") == F.col("e_id")) | ((F.col("source") == F.col("e_source")) & (F.col("page") == F.col("e_page")) & all_terms)
    return results.join(e, "qid").filter(F.coalesce(same, F.lit(False))).groupBy("qid", "evidence_id").agg(F.min("rank").alias("first_rank"))


def question_metrics(questions: DataFrame, results: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, hit, all_hit, recall, mrr, first_rank; null for questions without gold. results: qid, item, rank; gold: qid, item."""
    g = gold.select("qid", "item").distinct()
    first = results.groupBy("qid", "item").agg(F.min("rank").alias("r"))
    j = g.join(first, ["qid", "item"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count("r").alias("found"), F.min("r").alias("first_rank"))
    return questions.select("qid").join(j, "qid", "left").select(
        "qid",
        (F.col("found") > 0).alias("hit"),
        (F.col("found") == F.col("n")).alias("all_hit"),
        F.round(F.col("found") / F.col("n"), 9).alias("recall"),
        F.when(F.col("n").isNotNull(), F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 9)).alias("mrr"),
        "first_rank",
    )


def run_summary(metrics: DataFrame) -> DataFrame:
    """Means over the questions that have gold; 0 if none has."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return metrics.agg(F.count(F.lit(1)).alias("n_questions"), F.count("hit").alias("n_with_gold"), mean(F.col("hit").cast("double")).alias("hit_rate"), mean(F.col("all_hit").cast("double")).alias("all_hit_rate"), mean("recall").alias("avg_recall"), mean("mrr").alias("mrr"))
