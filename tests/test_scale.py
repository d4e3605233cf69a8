"""What grows with the input, on small tables."""

import numpy as np
from pyspark.sql import functions as F

from corvane import catalogue
from corvane.operators import graph, ranking as R
from corvane.plans import lexical, retrieval as P


def test_nearest_in_few_blocks_and_many_tiles(spark, monkeypatch):
    """Blocks grow with the rows, so that copies of them don't grow with their square; tiles and ties leave the result as brute force has it."""
    for name, value in (("BLOCK", 16), ("TILE", 8)):
        monkeypatch.setattr(graph, name, value)
    seen = {}
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: seen.setdefault(name, keep(df, name)))
    v = np.random.default_rng(1).integers(-2, 3, (700, 3)).astype(float)  # many ties
    v[~v.any(axis=1)] = 1.0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    np.fill_diagonal(s, -2)
    for k, threshold in ((4, -1.0), (7, 0.9), (1000, 0.9)):
        seen.clear()
        want = {(i, int(j), r + 1) for i in range(700) for r, j in enumerate(np.lexsort((np.arange(700), -s[i]))[:k]) if s[i, j] >= max(threshold, -1)}
        assert {(r.src, r.dst, r.rank) for r in graph.nearest(df, "id", "v", k, threshold).collect()} == want
        assert seen["vector-blocks"].count() <= graph.BLOCKS


def test_scan_reads_texts_once_and_writes_no_index(spark):
    """Copies, nulls, terms within words and with other letters; the same rows as by T.keyword_score, text by text."""
    words = "alpha alphabet beta-gamma betagamma delta overview step steps workflow mi-graph -x_ Émile".split()
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(words, 40)) for _ in range(60)] * 3 + ["y" * 118 + " alpha", "y" * 490 + " alpha", "y" * 600 + "alpha", None, ""]
    c = graph.written(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select("doc_id", F.lower("text").alias("searchable")).repartition(3), "chunks")
    asked = ["alpha delta migraph", "summary of the workflow steps: beta-gamma", "zzz", "", "pha lph overview steps"]
    q = graph.written(spark.createDataFrame(list(enumerate(asked)), "qid bigint, question string"), "questions")
    for k in (1, 7, 500):
        want = R.ranked(P.keyword_scores(c, q), ["qid"], [F.desc("keyword_score"), F.col("doc_id")], k, "keyword_rank")
        got = P.keyword_search(c, q, k)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    index = catalogue.index(spark, "/root/testdata/sf0.001")
    assert lexical.postings_of(index) is None and "searchable" in index.columns
