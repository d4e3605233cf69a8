"""The index of substrings against the scan, on texts that crowd its bounds."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans import lexical, retrieval as P
from corvane.tables import written


def chunks_of(spark, texts):
    c = spark.createDataFrame([(i, f"src{i % 3}", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string").repartition(3)
    return lexical.with_postings(written(lexical.numbered(c.withColumn("searchable", T.search_text(c.columns))), "chunks"), "postings")


QUESTIONS = ["alpha beta-gamma delta overview", "summary of the workflow: aba abab ababab", "zzz", "", "migraph mi_graph", "the of and", "alph lpha abcabcabc step"]


def both(spark, texts, k):
    c = chunks_of(spark, texts)
    q = spark.createDataFrame(list(enumerate(QUESTIONS)), "qid bigint, question string")
    found, seen = lexical.search(c, q, k)
    scan = P.keyword_search(c.select("doc_id", "searchable"), q, k)  # has no postings
    assert lexical.postings_of(c) is not None and lexical.postings_of(c.select("doc_id")) is None
    return sorted(map(tuple, found.collect())), sorted(map(tuple, scan.collect())), seen


@pytest.mark.parametrize("k", [1, 5, 400])
def test_index_equals_scan(spark, k):
    rng = random.Random(k)
    words = "alpha beta-gamma betagamma delta alph lpha abab aba bab ababab abcabc mi-graph migraph step steps summary é日本".split()
    texts = [(" " * rng.choice([0, 1])).join(rng.choice(["x" * rng.randint(0, 200), rng.choice(words), rng.choice(words)]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    got, want, _ = both(spark, [*texts, None, "", "al", *texts[:40]], k)
    assert got == want and len(got) > 3


def test_few_chunks_are_scored(spark):
    """A word that stands in few chunks, among many that hold its letters."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("alphbetg") for _ in range(rng.randint(3, 9))) for _ in range(60)) for _ in range(1500)]
    for i in range(0, 1500, 100):
        texts[i] += " alpha beta-gamma"
    got, want, seen = both(spark, texts, 5)
    assert got == want
    r = {x.qid: x for x in lexical.report(seen).collect()}[0]
    assert r.chunks_scored < 300 and r.blocks_read <= r.blocks


def test_first_places_of_pieces(monkeypatch):
    text = "abcdabcxyzabcd\U0001f600\U0001f601abc" * 5
    whole = lexical.first_places(text)
    monkeypatch.setattr(lexical, "PIECE", 7)
    part = lexical.first_places(text)
    assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()
    assert all(len(lexical.first_places(t)[0]) == n for t, n in (("", 0), ("ab", 0), ("abc", 1), ("abcd", 3)))


def test_ranges_hold_all_blocks(spark, monkeypatch):
    """More blocks than ranges: a scan reads ranges, the result is the same; more than BLOCKS: it reads all."""
    texts = [f"alpha {i}" + " beta-gamma" * (i % 50 == 0) for i in range(900)]
    monkeypatch.setattr(lexical, "RANGES", 2)
    got, want, _ = both(spark, texts, 10)
    assert got == want
    monkeypatch.setattr(lexical, "BLOCKS", 1)
    assert both(spark, texts, 10)[0] == want


def test_search_text_is_normalised(spark):
    rows = [(1, "Ｐ１.pdf", "dir/Ｐ１.pdf", 3, 7, "Ｔｒａｎｓ　ﬁnal\n x²"), (2, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, source_path string, page int, chunk_id bigint, text string")
    got = [r[0] for r in d.select(T.search_text(d.columns)).collect()]
    norm = lambda s: " ".join(unicodedata.normalize("NFKC", s).split())
    assert got == [norm("Ｐ１.pdf dir/Ｐ１.pdf 3 7").lower() + " " + norm(rows[0][-1]).lower(), " "]
    assert P.keyword_search(d, spark.createDataFrame([(1, "transformer trans final")], "qid bigint, question string"), 5).first().doc_id == 1


def test_keyword_score_by_hand(spark):
    d = spark.createDataFrame([("x" * 119 + "term",), ("x" * 120 + "term",), ("x" * 499 + "term step step step step",), ("x" * 500 + "term",), ("none",)], "s string")
    terms = F.expr("array(named_struct('term', 'term', 'weight', 8D, 'anchor', true), named_struct('term', 'step', 'weight', 1D, 'anchor', false))")
    got = [r[0] for r in d.withColumn("t", terms).select(F.round(T.keyword_score("s", "t"), 6)).collect()]
    ln = lambda n: __import__("math").log(1 + n)
    assert got == [round(x, 6) for x in (8 * (1 + ln(1)) + 8, 8 * (1 + ln(1)) + 4, 8 * (1 + ln(1)) + 4 + 1 + ln(3), 8 * (1 + ln(1)), 0)]
