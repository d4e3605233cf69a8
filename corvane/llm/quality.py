"""Quality rules: base rules on counts, then a hashed n-gram log-likelihood ratio. DataFrame functions only.

Words and pairs of neighbouring words are hashed to a fixed number of buckets. A trusted target (rows labelled good)
and the raw corpus (all rows) each give a multinomial over the buckets, with add-one smoothing. A bucket's weight is
the rounded whole number 1e6 * ln(p_target / p_raw), so that sums don't depend on their order. A document's verdict is
the sum of its weights, divided by its n-grams (length-normalised), against a fixed threshold: no sampling, no noise.

The weights are BUCKETS numbers whatever the corpus: they are the one thing that comes to the driver, and they go back
in the plan as a constant array. Nothing but bucket counts is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import SPACES, packed, table

BUCKETS = 10_000
#: Mean log ratio a document needs, in millionths.
LEAST = -100_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Ids of trusted rows are broadcast up to this many; beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _with_hashes(rows: DataFrame) -> DataFrame:
    """rows: _row, _id, _t. Adds _words and _h, a hash for each word."""
    return rows.withColumn("_words", F.filter(F.split("_t", SPACES), lambda w: w != "")).withColumn("_h", F.expr("transform(_words, w -> xxhash64(w))"))


#: Buckets of single words and of neighbouring pairs; the pairs' last index is -1 for fewer than two words.
GRAMS = f"concat(transform(_h, x -> int(pmod(x, {BUCKETS}))), transform(slice(_h, 2, greatest(size(_h) - 1, 0)), (x, i) -> int(pmod(xxhash64(_h[i], x, _h[i] + 1), {BUCKETS}))))"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return packed(docs).select("_row", F.col(f"_row.`{id_col}`").cast("bigint").alias("_id"), F.coalesce(F.col(f"_row.`{text_col}`"), F.lit("")).alias("_t"))


def bucket_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """trusted: a column of ids. Weights by bucket, from all of docs. With no trusted rows every weight is 0."""
    ids = trusted.select(F.col(trusted.columns[0]).cast("bigint").alias("_good")).dropna().distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = _rows(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col).join(ids, F.col("_id") == F.col("_good"), "left")
    grams = _with_hashes(rows.select("_t", F.col("_good").isNotNull().cast("int").alias("_g"))).select("_g", F.explode(F.expr(GRAMS)).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("_g").alias("good")).collect()  # BUCKETS rows at most
    raw, good = {r.b: r.raw for r in counts}, {r.b: r.good for r in counts}
    n_raw, n_good = sum(raw.values()), sum(good.values())
    if not n_good:
        return [0] * BUCKETS
    return [round(1e6 * (math.log((good.get(b, 0) + 1) / (n_good + BUCKETS)) - math.log((raw.get(b, 0) + 1) / (n_raw + BUCKETS)))) for b in range(BUCKETS)]


def judged(docs: DataFrame, weights: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row (the input row), the counts, base_failed, ratio (mean log ratio in millionths) and kept.

    A null text has no word, no symbol and no line. Repeated rows are judged alike, each. A null id is no reason to drop. Texts of any
    length are read whole; an empty table gives an empty one; a ratio equal to LEAST is kept; further columns of any name ride in _row.
    """
    w = _with_hashes(_rows(docs, id_col, text_col))
    w = w.select(
        "_row",
        "_id",
        "_h",
        "_words",
        F.expr(GRAMS).alias("_b"),
        F.size("_words").alias("_n"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    w = w.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")).drop("_lines")
    # A window of three words: its hash with the low bits replaced by its place, so that one sort of whole numbers brings equal windows together.
    w = w.withColumn("_m", F.expr("shiftleft(-1L, length(bin(_n)))"))
    w = w.withColumn("_s", F.expr("sort_array(transform(slice(_h, 3, greatest(_n - 2, 0)), (x, i) -> (xxhash64(_h[i], _h[i + 1], x) & _m) | i))")).drop("_h")
    w = w.withColumn("_p", F.expr("sort_array(filter(transform(_s, (x, i) -> if((i > 0 AND (_s[greatest(i - 1, 0)] & _m) = (x & _m)) OR (i < size(_s) - 1 AND (_s[least(i + 1, size(_s) - 1)] & _m) = (x & _m)), x & ~_m, -1L)), p -> p >= 0))")).drop("_s")
    # Hashes that share their high bits propose; the words themselves decide. Words hold no space, so a space joins them without doubt.
    w = w.withColumn("_q", F.expr("sort_array(transform(_p, p -> struct(concat_ws(' ', _words[int(p)], _words[int(p) + 1], _words[int(p) + 2]) AS w, p AS p)))")).drop("_p", "_words")
    w = w.withColumn("_p", F.expr("sort_array(filter(transform(_q, (x, i) -> if((i > 0 AND _q[greatest(i - 1, 0)].w = x.w) OR (i < size(_q) - 1 AND _q[least(i + 1, size(_q) - 1)].w = x.w), x.p, -1L)), p -> p >= 0))")).drop("_q")
    w = w.withColumn("n_repeat_words", F.expr("aggregate(transform(_p, (p, i) -> if(i = 0, 3L, least(3L, p - _p[greatest(i - 1, 0)]))), 0L, (a, x) -> a + x)")).drop("_p")
    constant = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    w = w.withColumn("_sum", F.aggregate("_b", F.lit(0).cast("bigint"), lambda a, b: a + F.get(constant, b)))
    w = w.withColumn("n_words", F.col("_n").cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return w.select(
        "_row",
        F.col("_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        # The row number, always true here, keeps a filter on the verdict above these steps: pushed below them, it would hold
        # all of their expressions inlined in one another, evaluated anew for each element.
        ((F.monotonically_increasing_id() >= 0) & ~failed & (F.col("_sum") >= LEAST * F.size("_b").cast("bigint"))).alias("kept"),
        F.expr("_sum div greatest(size(_b), 1)").alias("ratio"),
    )


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return judged(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), bucket_weights(docs, trusted, id_col, text_col), id_col, text_col).drop("_row")


def keep_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with docs' own columns."""
    return judged(docs, bucket_weights(docs, trusted, id_col, text_col), id_col, text_col).filter("kept").select("_row.*")
