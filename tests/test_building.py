"""What queries build and read, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import catalogue, catalogue_graph, catalogue_search
from corvane.functions import text as T
from corvane.operators import chunking, graph, kg, ranking as R
from corvane.plans import hierarchy as H, lexical, retrieval as P

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("k", "threshold"), [(3, -1.0), (60, 0.2), (5000, 0.9)])
def test_copies_of_vectors_are_compared_once(spark, monkeypatch, k, threshold):
    """products grow with the square of the different vectors, whatever copies there are; neighbours are those of all rows."""
    monkeypatch.setattr(graph, "BLOCK", 16)
    seen, keep = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: seen.setdefault(name, keep(df, name)))
    kinds = np.random.default_rng(3).standard_normal((40, 8))
    v = np.concatenate([kinds[:30], kinds[:30], kinds, np.repeat(kinds[:1], 150, axis=0), 2 * kinds[5:9], -kinds[:2]])[np.random.default_rng(4).permutation(256)]
    df = spark.createDataFrame([(7 * i % 256, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>").repartition(5)
    x = np.empty_like(v)
    x[[7 * i % 256 for i in range(256)]] = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    want = {(i, int(j), r + 1, s[i, j]) for i in range(256) for r, j in enumerate(np.lexsort((np.arange(256), -s[i]))[:k]) if s[i, j] >= threshold}
    assert {(r.src, r.dst, r["rank"], r.similarity) for r in graph.nearest(df, "id", "v", k, threshold).collect()} == want
    assert sum(len(r.ids) // 8 for r in seen["vector-blocks"].collect()) == 46


def test_single_precision_leaves_the_order_of_close_ones(spark):
    """similarities that differ by less than a float32 tells are ranked as in double, through several tiles."""
    rng = np.random.default_rng(5)
    v = np.array([1.0, 2.0, -1.0, 0.5]) + 1e-4 * rng.standard_normal((2100, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    some = range(0, 2100, 70)
    got = {(r.src, r["rank"]): r.dst for r in graph.nearest(df, "id", "v", 5).filter("src % 70 = 0").collect()}
    for i in some:
        s = np.round((x * x[i]).sum(axis=1), 9)
        s[i] = -2
        assert [got[i, r] for r in range(1, 6)] == np.lexsort((np.arange(2100), -s))[:5].tolist()


def test_evidence_of_the_hierarchy_needs_no_search_index(spark, monkeypatch):
    """of the documents, only those that found nodes cite are read on."""

    def never(*_):
        raise AssertionError("the search index holds every text")

    monkeypatch.setattr(catalogue_search, "index", never)
    for name in ("rerank_without_quotas", "archrag_rerank", "rerank_candidates"):
        assert getattr(catalogue_search, name)(spark, SF).count() > 0


def test_a_level_is_compared_once(spark, monkeypatch):
    """edges and links of a level read the same neighbours."""
    calls, keep = [], graph.nearest
    monkeypatch.setattr(graph, "nearest", lambda *a, **how: calls.append(a) or keep(*a, **how))
    monkeypatch.setattr(catalogue_graph, "_hierarchies", {})
    h = catalogue_graph.hierarchy(spark, SF)
    assert len(calls) == h.top() + 1
    rows = lambda df: sorted(map(tuple, df.collect()))
    for n in range(h.top() + 1):
        assert rows(h.intra_links.filter(f"level = {n}").select("src", "dst", "rank")) == rows(keep(h.level(n), "node_id", "embedding", H.NEIGHBOURS).select("src", "dst", "rank"))
    none = h.edges.filter("level = 0").select("src", "dst", "weight").limit(0)
    for threshold in (0.3, 0.0):
        assert rows(H.with_similar(none, h.level(0), threshold=threshold, near=h.near[0])) == rows(H.with_similar(none, h.level(0), threshold=threshold))


def test_papers_read_texts_once_for_both_signals(spark, monkeypatch):
    """the hybrid search's ranks are cut from one scan, as if each had been searched by itself."""
    c, q, k = catalogue.index(spark, SF), catalogue.questions(spark, SF), catalogue_graph.knowledge(spark, SF)
    calls, keep = [], lexical.scan
    monkeypatch.setattr(lexical, "scan", lambda *a: calls.append(a) or keep(*a))
    P.candidate_papers(c, q, 5, k.graph).collect()
    assert len(calls) == 1
    legs = P.hybrid_legs(c, q, 50)
    for n in (3, 50):
        assert sorted(map(tuple, P.hybrid_search(c, q, n, legs).collect())) == sorted(map(tuple, P.hybrid_search(c, q, n).collect()))


def test_scores_of_papers_chunks(spark):
    """as by T.keyword_score, text by text; only of the questions that look at a text, with few terms and with more than are sought one by one."""
    words = "alpha alphabet beta-gamma betagamma delta overview step steps workflow mi-graph -x_ Émile".split()
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(words, 30)) for _ in range(80)] + ["y" * 118 + " alpha", "y" * 499 + "alpha", None, ""]
    rows = [(i, f"s{i % 3}", t and t.lower(), [[1, 2], [2], [3, 1, 4]][i % 3]) for i, t in enumerate(texts)]
    c = spark.createDataFrame(rows, "doc_id bigint, source string, searchable string, qids array<bigint>").repartition(3)
    asked = [(1, "alpha delta migraph"), (2, "summary of the workflow steps: beta-gamma"), (3, ""), (4, "émile"), (9, "alpha")]
    for more in ("", " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100))):
        q = spark.createDataFrame([(i, f"{t} {more}") for i, t in asked], "qid bigint, question string").select("qid", T.query_terms(F.col("question")).alias("terms"))
        want = c.join(q, F.array_contains("qids", q.qid)).filter("exists(terms, t -> t.anchor AND contains(searchable, t.term))").select("qid", "source", "doc_id", F.round(T.keyword_score("searchable", "terms"), 9).alias("keyword_score"))
        got = lexical.scores(c, q)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_normalised_text_goes_to_python_only_if_it_may_change(spark):
    """the same as NFKC and one space for each run of white space, whatever the characters."""
    odd = ["", " ", "a  b", "a\t b", "\ta\n\nb ", "a b c", "Ünïcödé ß ÷×", "ﬁ ½ ª", "é", "Ａ　Ｂ", "x y  z", "a  b", "\x1f a\x0bb\x85c", "İ Ł ŉ ſ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    plain = F.btrim(F.regexp_replace(T.nfkc(F.coalesce("t", F.lit(""))), r"(?U)\s+", " "))
    assert all(a == b for a, b in df.select(T.normalised(F.col("t")), plain).collect())
    sent = df.select(T.normalised(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in sent


def test_graph_is_merged_once(spark, monkeypatch):
    """what is counted, cut into parts or sorted by range is a written table, so that nothing is merged or scored twice; the graph is that of the single steps."""
    kept, scans = catalogue_graph.kept, []

    def seen(df, name, *how):
        scans.append((name, "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()))
        return kept(df, name, *how)

    monkeypatch.setattr(catalogue_graph, "kept", seen)
    monkeypatch.setattr(catalogue_graph, "_built", {})
    g = catalogue_graph.knowledge(spark, SF).graph
    assert dict(scans) == dict.fromkeys(["kg-entities", "kg-relations", "kg-links", "kg-relation-links"], True)
    ranked, keep = [], R.ranked_whole
    monkeypatch.setattr(R, "ranked_whole", lambda df, *how: ranked.append("Join" not in df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, *how))
    P.graph_search(catalogue.index(spark, SF), catalogue.questions(spark, SF), g, 10).collect()
    assert ranked == [True]
    r = catalogue_graph.records(spark, SF)
    ent, rel = kg.entities_of(r), kg.relations_of(r)
    e = kg.merged_entities(ent)
    rows = lambda df: sorted(repr(tuple(x)) for x in df.collect())
    assert rows(g.entities.drop("embedding")) == rows(e)
    assert rows(g.relations) == rows(kg.merged_relations(rel, e)) and rows(g.links) == rows(catalogue_graph._doc(kg.links(ent), "entity_id"))
    assert rows(g.relation_links) == rows(catalogue_graph._doc(kg.relation_links(rel, e), "relation_id"))


def test_windows_of_odd_texts(spark):
    """the length is told once a text; windows are the same, of null, empty, short and long texts."""
    texts = [None, "", "a", "b" * 180, "c" * 181, "ü" * 1000, "d" * 1001, "é" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = [(i, s, t[s : s + 1000]) for i, t in enumerate(texts) if t for s in range(0, max(-(-(len(t) - 180) // 820), 1) * 820, 820)]
    windows = chunking.fixed_windows(df, ["i"])
    assert sorted(map(tuple, windows.collect())) == want
    assert "lambdafunction((length" not in windows._jdf.queryExecution().analyzed().toString()
