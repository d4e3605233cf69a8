"""Registered queries of graph, community, gated and hierarchical retrieval, of answers and of evaluation, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .catalogue import SQL_C, SQL_Q, SQL_QV, SQL_QVA, _carried, _classified, _cos, _hybrid, _keyword, _vector, all_questions, chunks, index, query, questions, tab, with_tables
from .catalogue_graph import LEVELS, SIZE, TABLES, _near, hierarchy, knowledge
from .functions import text as T, vectors as V
from .models import HashEmbedder
from .operators import chunking, metrics, ranking as R
from .plans import answers as A, hierarchy as H, retrieval as P, walk
from .tables import small, written

EMBEDDER = HashEmbedder(SIZE)


def _any(q: str, cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains({q}, '{c}')" for c in cues) + ")"


_INTENT = "CASE " + " ".join(f"WHEN lower(type) = '{n}' AND {_any('q', cues)} THEN {s}::DOUBLE" for n, (s, cues) in T.ENTITY_INTENTS.items()) + " ELSE 0::DOUBLE END"
_PINTENT = "CASE " + " ".join(f"WHEN predicate = '{n}' AND {_any('q', cues)} THEN {4 if n in T.STRONG_PREDICATES else 2}::DOUBLE" for n, cues in T.PREDICATE_INTENTS.items()) + " ELSE 0::DOUBLE END"
_OVERLAP = "list_sum(list_transform(terms, lambda t: CASE WHEN contains(searchable, t) THEN CASE WHEN length(t) >= 6 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END ELSE 0::DOUBLE END))"
SEARCH = TABLES | {
    "x_c": SQL_C,
    "x_qv": SQL_QV,
    "x_q": f"SELECT qid, lower(question) AS q, list_distinct(list_filter(list_transform(regexp_extract_all(lower(question), '[a-z][a-z0-9_-]+'), lambda w: trim(w, '-_')), lambda w: length(w) >= 3 AND w NOT IN {tuple(T.GRAPH_STOPWORDS)!r})) AS terms FROM ({SQL_Q})",
    "x_esearch": "SELECT entity_id, type, canonical_name, lower(concat_ws(' ', name, canonical_name, type, description, array_to_string(aliases, ' '), array_to_string(observed_types, ' '))) AS searchable FROM x_entities",
    "x_rsearch": "SELECT relation_id, subject_id, object_id, predicate, lower(concat_ws(' ', predicate, r.description, s.name, o.name, array_to_string(evidence, ' '))) AS searchable FROM x_relations r JOIN x_entities s ON s.entity_id = subject_id JOIN x_entities o ON o.entity_id = object_id",
    "x_docs": _classified(_carried("SELECT source, doc_id AS chunk_id, 2 AS page, text FROM documents")),
}


def graph_sql(k: int) -> str:
    """Adds the tables of graph retrieval with k to SEARCH; the name of its ranking."""
    raw = max(8 * k, k + 30)
    SEARCH[f"x_b{k}"] = _hybrid(raw)
    SEARCH[f"x_s{k}"] = f"SELECT qid, doc_id, rank FROM x_b{k} WHERE rank <= {max(k, 8)}"
    SEARCH[f"x_ss{k}"] = f"SELECT DISTINCT qid, source FROM x_s{k} JOIN documents USING (doc_id) WHERE rank <= 5 AND source <> ''"
    SEARCH[f"x_et{k}"] = f"SELECT DISTINCT qid, entity_id FROM x_links JOIN documents USING (doc_id) JOIN x_ss{k} USING (source)"
    SEARCH[f"x_rt{k}"] = f"SELECT DISTINCT qid, relation_id FROM x_rlinks JOIN documents USING (doc_id) JOIN x_ss{k} USING (source)"
    SEARCH[f"x_em{k}"] = f"""SELECT * FROM (SELECT qid, entity_id, round(direct + CASE WHEN direct > 0 OR t.qid IS NOT NULL THEN intent ELSE 0 END, 9) AS score FROM (
        SELECT qid, entity_id, (CASE WHEN length(canonical_name) >= 3 AND contains(q, canonical_name) THEN 10 + least(length(canonical_name), 80) / 20 ELSE 0 END)::DOUBLE + {_OVERLAP} AS direct, {_INTENT} AS intent FROM x_esearch, x_q) LEFT JOIN x_et{k} t USING (qid, entity_id)) WHERE score > 0"""
    SEARCH[f"x_rm{k}"] = f"""SELECT * FROM (SELECT qid, relation_id, round(m + CASE WHEN m > 0 OR t.qid IS NOT NULL THEN intent ELSE 0 END, 9) AS score FROM (
        SELECT r.qid, relation_id, 0.25::DOUBLE * (coalesce(s.score, 0) + coalesce(o.score, 0)) + overlap AS m, intent FROM (SELECT qid, relation_id, subject_id, object_id, {_OVERLAP} AS overlap, {_PINTENT} AS intent FROM x_rsearch, x_q) r
        LEFT JOIN x_em{k} s ON s.qid = r.qid AND s.entity_id = subject_id LEFT JOIN x_em{k} o ON o.qid = r.qid AND o.entity_id = object_id) LEFT JOIN x_rt{k} t USING (qid, relation_id)) WHERE score > 0"""
    SEARCH[f"x_se{k}"] = f"SELECT qid, entity_id, sum(2.5::DOUBLE / sqrt(rank)) AS w FROM x_s{k} JOIN x_links USING (doc_id) GROUP BY 1, 2"
    SEARCH[f"x_ex{k}"] = f"""SELECT qid, doc_id, round(sum(w), 9) AS score FROM (SELECT qid, doc_id, w FROM x_se{k} JOIN x_links USING (entity_id)
        UNION ALL SELECT qid, doc_id, 0.6::DOUBLE * w FROM x_se{k} JOIN (SELECT subject_id AS entity_id, relation_id FROM x_relations UNION SELECT object_id, relation_id FROM x_relations) USING (entity_id) JOIN x_rlinks USING (relation_id)) GROUP BY 1, 2"""
    SEARCH[f"x_gs{k}"] = f"SELECT qid, doc_id, round(sum(score), 6) AS score FROM (SELECT qid, doc_id, score FROM x_em{k} JOIN x_links USING (entity_id) UNION ALL SELECT qid, doc_id, score FROM x_rm{k} JOIN x_rlinks USING (relation_id) UNION ALL SELECT qid, doc_id, score FROM x_ex{k}) GROUP BY 1, 2"
    SEARCH[f"x_g{k}"] = f"""SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, graph_rank NULLS LAST, base_rank NULLS LAST, doc_id) AS rank FROM (
        SELECT qid, doc_id, graph_rank, base_rank, round(coalesce(2.7::DOUBLE / (60 + graph_rank), 0) + coalesce(1.0::DOUBLE / (60 + base_rank), 0), 9) AS score FROM
        (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS graph_rank FROM x_gs{k}) g FULL JOIN (SELECT qid, doc_id, rank AS base_rank FROM x_b{k}) b USING (qid, doc_id))"""
    return f"x_g{k}"


_REFERENCE = f"""contains(lower({{t}})[1:500], 'references') OR (len(regexp_extract_all(lower({{t}}), '\\b(?:19|20)\\d{{{{2}}}}\\b')) >= 3 AND list_sum(list_transform({T.REFERENCE_MARKERS!r}, lambda m: contains(lower({{t}}), m)::INT)) >= 2)"""
SEARCH["x_isref"] = f"SELECT doc_id, {_REFERENCE.format(t='t')} AS is_reference FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)"


def refs_last(hits: str, k: int) -> str:
    """Rows of hits (qid, doc_id, rank) with kept_rank, references last."""
    return f"SELECT h.*, row_number() OVER (PARTITION BY qid ORDER BY is_reference, rank) AS kept_rank FROM ({hits}) h JOIN x_isref USING (doc_id) QUALIFY kept_rank <= {k}"


def search_query(final: str):
    return query(with_tables(final, SEARCH))


@search_query(f"SELECT qid, doc_id, score, kept_rank FROM ({refs_last(_hybrid(80), 10)})")
def hybrid_retrieve(spark, sf_dir):
    c, q = index(spark, sf_dir), questions(spark, sf_dir)
    hits = P.hybrid_search(c, q, 80)
    return P.references_last(hits, c, 10).select("qid", "doc_id", "score", "kept_rank")


graph_sql(10)


def _matched(spark, sf_dir, k=10):
    """Base hits, entity and relation matches."""
    c, q, g = index(spark, sf_dir), questions(spark, sf_dir), knowledge(spark, sf_dir).graph
    base = written(P.hybrid_search(c, q, max(8 * k, k + 30)), "base")
    sources = P.seeds_of(base, c, k)[1]
    m = written(P.entity_matches(q, g.entities, P.touching(g.links, "entity_id", c, sources)), "matches")
    return base, m, P.relation_matches(q, g.relations, g.entities, m, P.touching(g.relation_links, "relation_id", c, sources))


@search_query("SELECT * FROM x_em10")
def entity_match_scores(spark, sf_dir):
    return _matched(spark, sf_dir)[1]


@search_query("SELECT * FROM x_rm10")
def relation_match_scores(spark, sf_dir):
    return _matched(spark, sf_dir)[2]


@search_query("SELECT qid, doc_id, round(score, 6) AS score FROM x_ex10")
def graph_seed_expansion(spark, sf_dir):
    g = knowledge(spark, sf_dir).graph
    return P.seed_expansion(_matched(spark, sf_dir)[0], g.links, 10, g.relation_links, g.relations).withColumn("score", F.round("score", 6))


@search_query("SELECT qid, doc_id, graph_rank, base_rank, score, rank FROM x_g10 WHERE rank <= 10")
def graph_rrf(spark, sf_dir):
    return P.graph_search(index(spark, sf_dir), questions(spark, sf_dir), knowledge(spark, sf_dir).graph, 10).select("qid", "doc_id", "graph_rank", "base_rank", "score", "rank")


# Communities ----------------------------------------------------------------------------------------------------------
_CHITS = "SELECT qid, community_id, row_number() OVER (PARTITION BY qid ORDER BY distance, community_id) AS c_rank, distance FROM (SELECT qid, community_id, round(list_sum(list_transform(list_zip(embedding, qembed), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS distance FROM x_sumvec, x_qembed) QUALIFY c_rank <= {k}"
SEARCH["x_ch5"] = _CHITS.format(k=5)
SEARCH["x_ch3"] = _CHITS.format(k=3)
SEARCH["x_cs3"] = "SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + c_rank) / (1 + 0.04::DOUBLE * greatest(ref_rank - 1, 0))), 9) AS score, min(c_rank) AS community_rank, arg_min(community_id, c_rank) AS community_id FROM x_ch3 JOIN x_refs USING (community_id) GROUP BY 1, 2"
graph_sql(50)
SEARCH["x_aug"] = f"""SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, community_rank NULLS LAST, chunk_rank NULLS LAST, doc_id) AS rank FROM (
    SELECT qid, doc_id, chunk_rank, community_rank, community_id, round(coalesce(1.0::DOUBLE / (60 + chunk_rank), 0) + 2.0::DOUBLE * coalesce(c.score, 0), 9) AS score
    FROM (SELECT qid, doc_id, kept_rank AS chunk_rank FROM ({refs_last('SELECT * FROM x_g50 WHERE rank <= 400', 50)})) b FULL JOIN x_cs3 c USING (qid, doc_id)) QUALIFY rank <= 100"""


@search_query("SELECT qid, community_id, distance, c_rank FROM x_ch5")
def community_search(spark, sf_dir):
    return P.community_hits(questions(spark, sf_dir), knowledge(spark, sf_dir, True).communities["index"], EMBEDDER, 5)


@search_query("SELECT * FROM x_cs3")
def community_fusion(spark, sf_dir):
    c = knowledge(spark, sf_dir, True).communities
    return P.community_scores(P.community_hits(questions(spark, sf_dir), c["index"], EMBEDDER, 3), c["sources"])


def _augmented(spark, sf_dir):
    k = knowledge(spark, sf_dir, True)
    return P.community_augmented(index(spark, sf_dir), questions(spark, sf_dir), k.graph, k.communities["index"], k.communities["sources"], EMBEDDER, 10, 3)


@search_query(f"SELECT qid, doc_id, community_id, score, kept_rank FROM ({refs_last('SELECT * FROM x_aug', 10)})")
def community_augmented(spark, sf_dir):
    return _augmented(spark, sf_dir).select("qid", "doc_id", "community_id", "score", "kept_rank")


@search_query(f"""SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY part, r) AS place, kind, doc_id, community_id FROM (SELECT qid, 0 AS part, kept_rank AS r, 'chunk' AS kind, doc_id, NULL AS community_id FROM ({refs_last('SELECT * FROM x_aug', 10)}) WHERE kept_rank <= 8
    UNION ALL SELECT qid, 1, c_rank, 'community', NULL, community_id FROM x_ch3 WHERE c_rank <= 2) QUALIFY place <= 10""")
def community_documents(spark, sf_dir):
    found = P.community_hits(questions(spark, sf_dir), knowledge(spark, sf_dir, True).communities["index"], EMBEDDER, 3)
    return P.with_communities(_augmented(spark, sf_dir), found, 10)


# Papers ---------------------------------------------------------------------------------------------------------------
graph_sql(40)
SEARCH["x_cited"] = "SELECT community_id, source, row_number() OVER (PARTITION BY community_id ORDER BY min(ref_rank), source) AS s_rank FROM x_refs JOIN documents USING (doc_id) WHERE source <> '' GROUP BY 1, 2"
SEARCH["x_papers"] = f"""SELECT qid, source, score, signals, row_number() OVER (PARTITION BY qid ORDER BY score DESC, lower(source), source) AS rank FROM (
    SELECT qid, source, round(sum(w / (60 + r)), 9) AS score, string_agg(signal || ':' || ceil(r)::BIGINT, ',' ORDER BY signal || ':' || ceil(r)::BIGINT) AS signals FROM (
      SELECT qid, 'hybrid' AS signal, 1.0::DOUBLE AS w, source, min(rank)::DOUBLE AS r FROM ({_hybrid(40)}) JOIN (SELECT doc_id, source FROM documents WHERE source <> '') USING (doc_id) GROUP BY ALL
      UNION ALL SELECT qid, 'graph', 1.0::DOUBLE, source, min(rank)::DOUBLE FROM x_g40 JOIN (SELECT doc_id, source FROM documents WHERE source <> '') USING (doc_id) WHERE rank <= 40 GROUP BY ALL
      UNION ALL SELECT qid, 'community', 1.2::DOUBLE, source, round(arg_min(c_rank + 0.1::DOUBLE * (s_rank - 1), c_rank), 1) FROM x_ch5 JOIN x_cited USING (community_id) GROUP BY ALL) GROUP BY 1, 2) QUALIFY rank <= 5"""
SEARCH["x_cand"] = "SELECT qid, source, round(score, 6) AS paper_score, rank AS paper_rank FROM x_papers"
SEARCH["x_inp"] = f"""SELECT qid, source, doc_id, score, paper_score, paper_rank, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST, doc_id) AS in_paper_rank FROM (
    SELECT qid, source, doc_id, vr, kr, round(coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(2.0::DOUBLE / (60 + kr), 0), 9) AS score FROM
    (SELECT qid, source, doc_id, row_number() OVER (PARTITION BY qid, source ORDER BY distance, doc_id) AS vr FROM ({_vector(10**9)}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) JOIN x_cand USING (qid, source) QUALIFY vr <= {{raw}})
    FULL JOIN (SELECT qid, source, doc_id, row_number() OVER (PARTITION BY qid, source ORDER BY keyword_score DESC, doc_id) AS kr FROM ({_keyword(10**9)}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) JOIN x_cand USING (qid, source) QUALIFY kr <= {{raw}}) USING (qid, source, doc_id))
    JOIN x_cand USING (qid, source) QUALIFY in_paper_rank <= {{k}}""".replace("{raw}", str(R.over_fetch(12))).replace("{k}", "12")
_GTERMS = "list_distinct(list_filter(list_transform(regexp_extract_all(lower(question), '([a-z][a-z0-9_-]+)', 1), lambda w: trim(w, '-_')), lambda w: length(w) >= 3))"
SEARCH["x_feat"] = f"""SELECT *, least(1.0, list_sum(list_transform(gt, lambda t: CASE WHEN contains(s, t) THEN CASE WHEN length(t) >= 6 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END ELSE 0::DOUBLE END)) / len(gt)) AS keyword,
    (len(list_filter(gt, lambda t: contains(lower(section_title || ' ' || section_type), t))) > 0)::INT::DOUBLE AS section
    FROM (SELECT i.*, i.score AS relevance, section_title, section_type, lower(trim(regexp_replace(i.source || ' ' || section_title || ' ' || section_type || ' ' || text, '\\s+', ' ', 'g'))) AS s, gt
        FROM x_inp i JOIN x_docs d ON d.chunk_id = i.doc_id JOIN (SELECT qid, {_GTERMS} AS gt FROM ({SQL_Q})) USING (qid))"""
SEARCH["x_gate"] = """SELECT qid, doc_id, final, is_reference, candidate_rank, row_number() OVER (PARTITION BY qid ORDER BY is_reference, final DESC, candidate_rank DESC, doc_id) AS rank FROM (
    SELECT qid, doc_id, is_reference, candidate_rank, round(0.5::DOUBLE * least(greatest(relevance / max(relevance) OVER (PARTITION BY qid), 0), 1) + 0.25::DOUBLE * keyword + 0.15::DOUBLE * least(greatest(paper_score / max(paper_score) OVER (PARTITION BY qid), 0), 1)
        + 0.05::DOUBLE * section - 0.1::DOUBLE * is_reference::INT, 9) AS final
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY paper_rank, in_paper_rank) AS candidate_rank FROM x_feat QUALIFY candidate_rank <= 100) JOIN x_isref USING (doc_id))"""


def _with_sections(spark, sf_dir):
    c = index(spark, sf_dir)
    s = chunking.with_sections(c.select("source", F.col("doc_id").alias("chunk_id"), F.lit(2).alias("page"), "text"))
    return c.join(s.select(F.col("chunk_id").alias("doc_id"), "section_title", "section_type"), "doc_id")


def _candidates(spark, sf_dir):
    k = knowledge(spark, sf_dir, True)
    return P.candidate_papers(index(spark, sf_dir), questions(spark, sf_dir), 5, k.graph, k.communities["index"], k.communities["sources"], EMBEDDER)


@search_query("SELECT qid, source, score, signals, rank FROM x_papers")
def paper_votes(spark, sf_dir):
    return _candidates(spark, sf_dir)


@search_query("SELECT qid, source, doc_id, score, paper_score, paper_rank, in_paper_rank FROM x_inp")
def in_paper_topk(spark, sf_dir):
    return P.in_papers(index(spark, sf_dir), questions(spark, sf_dir), written(_candidates(spark, sf_dir), "papers"), 12)


@search_query("SELECT qid, doc_id, round(keyword, 6) AS keyword, section, is_reference FROM x_feat JOIN x_isref USING (doc_id)")
def gated_features(spark, sf_dir):
    q = questions(spark, sf_dir)
    cands = P.in_papers(index(spark, sf_dir), q, written(_candidates(spark, sf_dir), "papers"), 12)
    return P.gated_features(cands, _with_sections(spark, sf_dir), q).select("qid", "doc_id", F.round("keyword", 6).alias("keyword"), "section", "is_reference")


@search_query("SELECT qid, doc_id, final, rank FROM x_gate WHERE rank <= 10")
def gated_rerank(spark, sf_dir):
    """Gated retrieval from end to end."""
    k = knowledge(spark, sf_dir, True)
    return P.gated_search(_with_sections(spark, sf_dir), questions(spark, sf_dir), 10, 5, 4, k.graph, k.communities["index"], k.communities["sources"], EMBEDDER).select("qid", "doc_id", "final", "rank")


# Hierarchy ------------------------------------------------------------------------------------------------------------
_WIDTH = "CASE kind WHEN 'multi-hop' THEN 4 + {d} WHEN 'abstract' THEN 6 + {d} WHEN 'procedural' THEN 5 ELSE 2 END"
_KIND = f"CASE WHEN regexp_matches(lower(question), '{T.PROCEDURAL_PATTERN}') THEN 'procedural' WHEN regexp_matches(lower(question), '{T.SURVEY_PATTERN}') THEN 'abstract' WHEN regexp_matches(lower(question), '{T.MULTI_HOP_PATTERN}') THEN 'multi-hop' ELSE 'fact' END"
BEAM = LEVELS | {"x_qv": SQL_QV, "b_q": f"SELECT qid, question, qvec, {_KIND} AS kind FROM x_qv"}
BEAM["b_inter"] = f"SELECT level, parent, child FROM (SELECT c.level, parent, child, round({_cos('u.embedding', 'w.embedding')}, 6) AS similarity FROM h_children c JOIN h_nodes u ON u.level = c.level AND u.node_id = parent JOIN h_nodes w ON w.level + 1 = c.level AND w.node_id = child) QUALIFY row_number() OVER (PARTITION BY level, parent ORDER BY similarity DESC, child) = 1"
BEAM["b_2"] = f"SELECT qid, kind, 2::BIGINT AS level, node_id, local, local AS route, row_number() OVER (PARTITION BY qid ORDER BY local DESC, node_id) AS rank FROM (SELECT qid, kind, node_id, round({_cos('embedding', 'qvec')}, 6) AS local FROM h_n2, b_q) QUALIFY rank <= greatest(5, {_WIDTH.format(d=0)})"
for _n in (1, 0):
    BEAM[f"b_{_n}"] = f"""SELECT qid, kind, {_n}::BIGINT AS level, node_id, local, route, row_number() OVER (PARTITION BY qid ORDER BY route DESC, node_id) AS rank FROM (
        SELECT qid, kind, node_id, local, round(0.85::DOUBLE * local + 0.15::DOUBLE * pr, 6) AS route FROM (SELECT q.qid, q.kind, n.node_id, round({_cos('n.embedding', 'q.qvec')}, 6) AS local, pr
            FROM (SELECT b.qid, c.child, max(b.route) AS pr FROM b_{_n + 1} b JOIN h_p{_n} c ON c.parent = b.node_id WHERE b.rank <= {_WIDTH.format(d=1 - _n)} GROUP BY 1, 2) r JOIN h_n{_n} n ON n.node_id = r.child JOIN b_q q ON q.qid = r.qid)) QUALIFY rank <= greatest(5, {_WIDTH.format(d=2 - _n)})"""
BEAM["b_all"] = "SELECT qid, level, node_id, local, route, rank FROM b_2 UNION ALL SELECT qid, level, node_id, local, route, rank FROM b_1 UNION ALL SELECT qid, level, node_id, local, route, rank FROM b_0"
BEAM["b_refs"] = "SELECT 0::BIGINT AS level, node_id, node_id AS doc_id FROM h_n0 UNION ALL SELECT 1, parent, child FROM h_p0 UNION ALL SELECT 2, b.parent, a.child FROM h_p0 a JOIN h_p1 b ON b.child = a.parent"
BEAM["b_cited"] = "SELECT qid, doc_id, node_id, b.level AS node_level, route AS node_score FROM b_all b JOIN b_refs r ON r.level = b.level AND r.node_id = b.node_id QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY route DESC, b.level DESC, b.node_id) = 1".replace("SELECT qid, doc_id, node_id,", "SELECT qid, doc_id, b.node_id,")
_RTERMS = "list_distinct(regexp_extract_all(question, '([A-Za-z0-9][A-Za-z0-9_+\\-]+)', 1))"
BEAM["b_cand"] = f"""SELECT qid, doc_id, source, node_id, node_score, kind, similarity, round(list_sum(list_transform(rt, lambda t: CASE WHEN contains(tx, t) THEN 1.0::DOUBLE WHEN contains(lower(tx), lower(t)) THEN 0.5::DOUBLE ELSE 0::DOUBLE END)) / len(rt), 9) AS keyword
    FROM (SELECT c.qid, c.doc_id, d.source, c.node_id, c.node_score, q.kind, round({_cos('e.embedding', 'q.qvec')}, 9) AS similarity, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) AS tx, {_RTERMS} AS rt
        FROM b_cited c JOIN documents d USING (doc_id) JOIN embeddings e ON e.vec_id = c.doc_id JOIN b_q q ON q.qid = c.qid)"""
_UNIT = "least(greatest(({} + 1) / 2, 0), 1)"
BEAM["b_scored"] = f"""SELECT qid, doc_id, source, node_id::VARCHAR AS node_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source, doc_id) AS pos FROM (
    SELECT *, round(CASE kind {' '.join(f"WHEN '{k}' THEN {a}::DOUBLE * {_UNIT.format('similarity')} + {b}::DOUBLE * {_UNIT.format('node_score')} + {c}::DOUBLE * keyword" for k, (a, b, c) in P.POLICY.items())} END, 6) AS score FROM b_cand)"""


def beam_query(final: str):
    return query(with_tables(final, BEAM))


def _found(spark, sf_dir):
    return H.search(hierarchy(spark, sf_dir), questions(spark, sf_dir), beam=None)


#: The walk over links of the lowest level, pop by pop: each question carries what it has popped and what it has met.
BEAM["x_qva"] = SQL_QVA
BEAM["w_n"] = "SELECT count(*) AS n FROM h_n0"
BEAM["w_link"] = f"SELECT src, dst FROM ({_near('SELECT * FROM h_n0', 8, -1)})"
BEAM["w_sim"] = f"SELECT qid, node_id, round({_cos('embedding', 'qvec')}, 6) AS s FROM h_n0, x_qva"
BEAM["w_next"] = "SELECT qid, src AS node, list({'s': -s, 'n': node_id}) AS met FROM w_link JOIN w_sim ON node_id = dst GROUP BY 1, 2"
BEAM["w_entry"] = f"SELECT qid, b.node_id AS parent FROM (SELECT qid, node_id, round({_cos('embedding', 'qvec')}, 6) AS s FROM h_n1, x_qva QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, node_id) <= 3) b"
BEAM["w_start"] = "SELECT DISTINCT qid, child AS node_id FROM w_entry JOIN b_inter USING (parent) WHERE level = 1"
BEAM["w_first"] = "SELECT qid, [0][1:0]::BIGINT[] AS popped, list({'s': -s, 'n': node_id}) AS heap, greatest(32, 8 * 10, 8 * count(*)) AS most FROM w_start JOIN w_sim USING (qid, node_id) GROUP BY qid"
_WALK = """WITH RECURSIVE r AS (SELECT qid, popped, heap, most, [0.0::DOUBLE][1:0] AS scores FROM w_first UNION ALL
        SELECT x.qid, list_append(popped, top.n), list_filter(heap || coalesce(met, []), lambda h: h.n <> top.n AND NOT list_contains(popped, h.n)), most, list_append(scores, -top.s)
        FROM (SELECT *, list_min(heap) AS top FROM r WHERE len(heap) > 0 AND len(popped) < least(most, (SELECT n FROM w_n))) x LEFT JOIN w_next y ON y.qid = x.qid AND y.node = x.top.n)
    SELECT qid, unnest(popped) AS node_id, unnest(scores) AS local FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY len(popped) DESC) = 1)"""


@query(with_tables(f"SELECT qid, node_id, local, row_number() OVER (PARTITION BY qid ORDER BY local DESC, node_id) AS rank FROM ({_WALK}) QUALIFY rank <= 10", BEAM))
def layer_walk(spark, sf_dir):
    """From the children linked to the three best nodes of level 1, over the links of the lowest level."""
    h, q = hierarchy(spark, sf_dir), all_questions(spark, sf_dir)
    entry = R.ranked(P.past_questions(h.level(1), q).select("qid", "node_id", F.round(V.cosine(F.col("embedding"), F.col("qvec")), 6).alias("s")), ["qid"], [F.desc("s"), F.col("node_id")], 3)
    starts = entry.join(h.inter_links.filter("level = 1"), F.col("node_id") == F.col("parent")).select("qid", F.col("child").alias("node_id"))
    return walk.layer_search(h.level(0), h.intra_links.filter("level = 0"), q, starts, 10)


@beam_query("SELECT * FROM b_all")
def hierarchical_search(spark, sf_dir):
    """Three levels, beams by the questions' kinds, children and links."""
    return _found(spark, sf_dir)


def _hierarchy_candidates(spark, sf_dir):
    """Candidates of the rerank; of the documents only the cited ones are read on, without a search index."""
    h, found = hierarchy(spark, sf_dir), _found(spark, sf_dir)
    cited = small(written(found.select("level", "node_id").join(h.refs, ["level", "node_id"]).select("doc_id").distinct(), "cited"), 1_000_000)
    return P.rerank_candidates(found, h.refs, chunks(spark, sf_dir, cited), questions(spark, sf_dir))


@beam_query("SELECT qid, doc_id, source, node_id, round(similarity, 6) AS similarity, round(keyword, 6) AS keyword, kind FROM b_cand")
def rerank_candidates(spark, sf_dir):
    return _hierarchy_candidates(spark, sf_dir).select("qid", "doc_id", "source", "node_id", F.round("similarity", 6).alias("similarity"), F.round("keyword", 6).alias("keyword"), "kind")


#: The greedy choice under quotas, row by row: state is (chosen, counts by node, counts by paper) in the strings of what was chosen.
BEAM["b_list"] = "SELECT qid, list({'p': pos, 'n': node_id, 's': source, 'd': doc_id, 'x': score} ORDER BY pos) AS l FROM b_scored GROUP BY qid"
BEAM["b_greedy"] = f"""SELECT qid, l, list_reduce(list_prepend([]::STRUCT(p BIGINT, n VARCHAR, s VARCHAR, d BIGINT, x DOUBLE)[], list_transform(l, lambda r: [r])), lambda a, r: CASE WHEN len(a) >= 10 OR len(list_filter(a, lambda y: y.n = r[1].n)) >= {P.PER_NODE}
    OR len(list_filter(a, lambda y: y.s = r[1].s)) >= {P.PER_PAPER} THEN a ELSE list_concat(a, r) END) AS chosen FROM b_list"""


@beam_query("SELECT qid, r.d AS doc_id, r.s AS source, r.n AS node_id, r.x AS score, i AS rank FROM (SELECT qid, unnest(c) AS r, unnest(range(1, len(c) + 1)) AS i FROM (SELECT qid, list_concat(chosen, list_filter(l, lambda r: NOT list_contains(chosen, r)))[1:10] AS c FROM b_greedy))")
def archrag_rerank(spark, sf_dir):
    """Hierarchical evidence over the chunks that found nodes cite: weights by kind of question, quotas of nodes and papers."""
    return P.hierarchy_rerank(_hierarchy_candidates(spark, sf_dir), 10)


@beam_query("SELECT qid, pos, node_id AS node, source AS paper FROM b_scored WHERE pos <= 10")
def rerank_without_quotas(spark, sf_dir):
    return P.hierarchy_rerank(_hierarchy_candidates(spark, sf_dir), 10, per_node=10, per_paper=10).select("qid", F.col("rank").alias("pos"), F.col("node_id").alias("node"), F.col("source").alias("paper"))


BEAM["b_docs"] = "SELECT qid, doc_id, node_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id, doc_id) AS rank FROM (SELECT qid, doc_id, b.node_id, route AS score FROM b_all b JOIN b_refs r ON r.level = b.level AND r.node_id = b.node_id QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY route DESC, b.node_id) = 1) QUALIFY rank <= 20"


@beam_query("SELECT * FROM b_docs")
def level_documents(spark, sf_dir):
    return P.level_documents(_found(spark, sf_dir), hierarchy(spark, sf_dir).refs, 20)


@beam_query("SELECT b.qid, b.level, b.node_id, b.local, b.route, coalesce(parents, []) AS parents, row_number() OVER (PARTITION BY b.qid ORDER BY b.level DESC, b.rank) AS place FROM b_all b LEFT JOIN (SELECT u.qid, u.level - 1 AS level, c.child AS node_id, list_sort(list_distinct(list(u.node_id))) AS parents FROM b_all u JOIN h_children c ON c.level = u.level AND c.parent = u.node_id GROUP BY 1, 2, 3) p ON p.qid = b.qid AND p.level = b.level AND p.node_id = b.node_id")
def retrieval_paths(spark, sf_dir):
    h, found = hierarchy(spark, sf_dir), _found(spark, sf_dir)
    return P.retrieval_paths(found, h.children)


# Answers --------------------------------------------------------------------------------------------------------------
BEAM["b_sum"] = "SELECT level, node_id, 'd' || node_id AS summary FROM h_nodes WHERE level = 0"
BEAM["b_points"] = f"SELECT qid, level, node_id, score, description, row_number() OVER (PARTITION BY qid ORDER BY score DESC, level DESC, node_id) AS place FROM (SELECT qid, b.level, b.node_id, round(least(greatest(route * 100, 0), 100), 4) AS score, summary AS description FROM b_all b JOIN b_sum s ON s.level = b.level AND s.node_id = b.node_id) WHERE score >= {A.LEAST_SCORE} QUALIFY place <= {A.MOST_POINTS}"
BEAM["b_srcs"] = f"SELECT qid, doc_id, printf('%.1f', score) AS score, row_number() OVER (PARTITION BY qid ORDER BY place, doc_id) AS rank, 'S' || row_number() OVER (PARTITION BY qid ORDER BY place, doc_id) AS id FROM (SELECT qid, doc_id, place, score FROM b_points p JOIN b_refs r ON r.level = p.level AND r.node_id = p.node_id QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY place) = 1) QUALIFY rank <= {A.MOST_SOURCES}"


def _points(spark, sf_dir):
    return A.points(_found(spark, sf_dir).filter("level = 0"), hierarchy(spark, sf_dir).nodes)


@beam_query("SELECT qid, place, level, node_id, score, description FROM b_points")
def answer_points(spark, sf_dir):
    return _points(spark, sf_dir)


@beam_query("SELECT qid, rank, id, doc_id, score FROM b_srcs")
def answer_sources(spark, sf_dir):
    return A.point_sources(_points(spark, sf_dir), hierarchy(spark, sf_dir).refs)


SEARCH["x_rows"] = f"SELECT qid, rank, 'S' || rank AS id, source, '1' AS page, doc_id::VARCHAR AS chunk, printf('%.4f', score) AS score, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, {A.SNIPPET_CHARS}) AS snippet FROM ({_hybrid(5)}) JOIN (SELECT doc_id, source, text FROM documents) USING (doc_id)"


def _sources(spark, sf_dir):
    c = index(spark, sf_dir)
    return A.source_rows(P.hybrid_search(c, questions(spark, sf_dir), 5), c)


@search_query("SELECT * FROM x_rows")
def source_rows(spark, sf_dir):
    return _sources(spark, sf_dir)


@search_query("SELECT qid, string_agg('[' || id || '] ' || source || ' | page ' || page || ' | chunk ' || chunk || chr(10) || snippet, chr(10) || chr(10) ORDER BY rank) AS context, list(id ORDER BY rank) AS ids FROM x_rows GROUP BY qid")
def answer_contexts(spark, sf_dir):
    return A.contexts(_sources(spark, sf_dir))


@search_query("SELECT qid, first(snippet ORDER BY rank) || chr(10) || chr(10) || '主要依据：' || string_agg('[' || id || ']', ' ' ORDER BY rank) AS answer FROM x_rows GROUP BY qid")
def cited_answers(spark, sf_dir):
    return A.cited_answers(questions(spark, sf_dir), _sources(spark, sf_dir))


_TURNS = "SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE role = 'user'"
_DEDUPE = "list_filter({x}, lambda x, i: list_position(list_transform({x}, lambda y: lower(y)), lower(x)) = i)"
_WORDS = "regexp_extract_all(t, '([A-Za-z0-9][A-Za-z0-9_+\\-]{2,})', 1)"


@query(f"""SELECT conv_id, turn, kind AS query_type, {_DEDUPE.format(x="list_concat(k, CASE kind WHEN 'abstract' THEN " + repr(T.ABSTRACT_KEYWORDS) + " WHEN 'procedural' THEN " + repr(T.PROCEDURAL_KEYWORDS) + " ELSE []::VARCHAR[] END)")} AS keywords,
    CASE WHEN kind = 'multi-hop' THEN ['What are the key entities and claims in: ' || t, 'How are those entities or claims connected in: ' || t] ELSE [t] END AS sub_questions
    FROM (SELECT conv_id, turn, t, {_KIND.replace('question', 't')} AS kind, ({_DEDUPE.format(x=_WORDS)})[1:12] AS k FROM ({_TURNS}))""")
def query_rewrite(spark, sf_dir):
    u = tab(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", T.rewritten(F.col("text")).alias("r"))
    return u.select("conv_id", "turn", "r.query_type", "r.keywords", "r.sub_questions")


@query(f"SELECT conv_id, turn, list_distinct(regexp_extract_all(trim(regexp_replace(t, '\\s+', ' ', 'g')), '([A-Za-z0-9][A-Za-z0-9_+\\-]+)', 1)).len() AS n_terms, {_KIND.replace('question', 't')} AS kind FROM ({_TURNS})")
def query_terms(spark, sf_dir):
    u = tab(spark, sf_dir, "conversations").filter("role = 'user'")
    return u.select("conv_id", "turn", F.size(T.rerank_terms(F.col("text"))).cast("bigint").alias("n_terms"), T.query_kind(F.col("text")).alias("kind"))


# Evaluation -----------------------------------------------------------------------------------------------------------
EVAL = {
    "e_gold": "SELECT b.item_id AS qid, d.doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "e_dw": "SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)",
    "e_bits": "SELECT w, length(bin((SELECT count(*) FROM documents) // count(*))) - 1 AS bits FROM e_dw GROUP BY w",
    "e_qw": "SELECT DISTINCT qid, w FROM (SELECT item_id AS qid, unnest(string_split(text, ' ')) AS w FROM benchmark)",
    "e_run": "SELECT qid, doc_id AS item, sum(bits)::BIGINT AS score, row_number() OVER (PARTITION BY qid ORDER BY sum(bits) DESC, doc_id) AS rank FROM e_qw JOIN e_bits USING (w) JOIN e_dw USING (w) WHERE bits > 0 GROUP BY 1, 2 QUALIFY rank <= 10",
    "e_met": """SELECT b.item_id AS qid, found > 0 AS hit, found = n AS all_hit, round(found / n, 9) AS recall, CASE WHEN n IS NOT NULL THEN round(coalesce(1 / first_rank, 0), 9) END AS mrr, first_rank FROM benchmark b
        LEFT JOIN (SELECT qid, count(*) AS n, count(r) AS found, min(r) AS first_rank FROM (SELECT g.qid, g.item, r.rank AS r FROM (SELECT DISTINCT * FROM e_gold) g LEFT JOIN e_run r USING (qid, item)) GROUP BY qid) m ON m.qid = b.item_id""",
    "e_head": "SELECT item_id AS qid, string_split(text, ' ')[1] AS term FROM benchmark",
}


def eval_query(final: str):
    return query(with_tables(final, EVAL))


def _words(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.explode(F.array_distinct(F.split("text", " "))).alias("w"))


def _index(spark, sf_dir):
    """The documents' words (doc_id, w), and the bits that a word tells: the whole-number logarithm of documents by documents with it. Words of more than half of the documents
    tell 0 and are in no score, so nothing is lost by not joining them."""
    d = tab(spark, sf_dir, "documents")
    dw = _words(d, "doc_id")
    asked = _words(tab(spark, sf_dir, "benchmark"), "item_id").select("w").distinct()
    dw = written(dw.join(asked, "w", "left_semi"), "eval-words")
    bits = dw.groupBy("w").agg(F.count(F.lit(1)).alias("df")).withColumn("bits", F.length(F.bin(F.expr(f"{d.count()} div df"))) - 1)
    return dw, bits


def _run(spark, sf_dir, parts=None):
    """qid, item, score, rank: the ten documents that share most with a passage, by an equi-join on words."""
    dw, bits = parts or _index(spark, sf_dir)
    q = _words(tab(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "qid"), "qid").join(bits.filter("bits > 0"), "w")
    s = dw.join(q, "w").groupBy("qid", F.col("doc_id").alias("item")).agg(F.sum("bits").cast("bigint").alias("score"))
    return R.ranked(s, ["qid"], [F.desc("score"), F.col("item")], 10)


def _gold(spark, sf_dir, parts=None):
    """qid, item: documents that hold a passage. A passage's inner words are whole words there too: its rarest one leads to the candidates, whose texts are then compared.
    Passages of two words or fewer have none and are compared with all texts."""
    dw, bits = parts or _index(spark, sf_dir)
    b = tab(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    d = tab(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.split("passage", " ")
    inner = b.select("qid", "passage", F.explode(F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))).alias("w")).join(bits, "w", "left")
    lead = R.ranked(inner, ["qid"], [F.coalesce("df", F.lit(0)), F.col("w")], 1, "one").select("qid", "passage", "w")
    found = lead.join(dw, "w").select("qid", "passage", "doc_id").join(d, "doc_id")
    short = P.past_questions(d, b.filter(F.size(words) <= 2))
    return found.select("qid", "passage", "doc_id", "text").unionByName(short.select("qid", "passage", "doc_id", "text")).filter(F.contains("text", F.col("passage"))).select("qid", F.col("doc_id").alias("item"))


@eval_query("SELECT qid, item FROM e_gold")
def eval_gold(spark, sf_dir):
    return _gold(spark, sf_dir)


@eval_query("SELECT qid, item, score, rank FROM e_run")
def eval_run(spark, sf_dir):
    return _run(spark, sf_dir)


def _evidence(spark, sf_dir):
    """Gold evidence, told by the chunk's id for even documents, by source, page and the passage's first word for odd ones."""
    g = _gold(spark, sf_dir).join(tab(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source"), "item")
    head = tab(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array(F.get(F.split("text", " "), F.lit(0))).alias("terms"))
    return g.join(head, "qid").select("qid", F.col("item").alias("evidence_id"), F.when(F.col("item") % 2 == 0, F.col("item").cast("string")).otherwise("").alias("stable_chunk_id"), F.when(F.col("item") % 2 == 1, F.col("source")).otherwise("").alias("source"), F.lit(1).alias("page"), "terms")


@eval_query("""SELECT qid, evidence_id, min(rank) AS first_rank FROM (SELECT g.qid, g.item AS evidence_id, r.rank FROM e_gold g JOIN documents gd ON gd.doc_id = g.item JOIN e_run r ON r.qid = g.qid JOIN documents rd ON rd.doc_id = r.item JOIN e_head h ON h.qid = g.qid
    WHERE (g.item % 2 = 0 AND g.item = r.item) OR (g.item % 2 = 1 AND gd.source = rd.source AND (contains(lower(rd.text), lower(term)) OR contains(regexp_replace(lower(rd.text), '[^a-z0-9一-鿿]', '', 'g'), regexp_replace(lower(term), '[^a-z0-9一-鿿]', '', 'g'))))) GROUP BY 1, 2""")
def eval_evidence_match(spark, sf_dir):
    d = tab(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source", "text")
    rows = _run(spark, sf_dir).join(d, "item").select("qid", "rank", F.col("item").cast("string").alias("stable_chunk_id"), "source", F.lit(1).alias("page"), "text")
    return metrics.evidence_matches(rows, _evidence(spark, sf_dir))


def _metrics(spark, sf_dir):
    parts = _index(spark, sf_dir)
    return metrics.question_metrics(tab(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")), _run(spark, sf_dir, parts), _gold(spark, sf_dir, parts))


@eval_query("SELECT * FROM e_met")
def eval_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@eval_query("SELECT count(*) AS n_questions, count(hit) AS n_with_gold, round(coalesce(avg(hit::INT), 0), 6) AS hit_rate, round(coalesce(avg(all_hit::INT), 0), 6) AS all_hit_rate, round(coalesce(avg(recall), 0), 6) AS avg_recall, round(coalesce(avg(mrr), 0), 6) AS mrr FROM e_met")
def eval_summary(spark, sf_dir):
    return metrics.run_summary(_metrics(spark, sf_dir))


@eval_query("""SELECT r.qid, r.rank, r.item, g.item IS NOT NULL AS is_evidence, substring(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), 1, 280) AS snippet FROM e_run r JOIN documents d ON d.doc_id = r.item LEFT JOIN (SELECT DISTINCT * FROM e_gold) g ON g.qid = r.qid AND g.item = r.item""")
def eval_precision_label(spark, sf_dir):
    """Retrieved rows with their label and snippet, as reviewers see them."""
    g = _gold(spark, sf_dir).distinct().withColumn("is_evidence", F.lit(True))
    d = tab(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.substring(T.collapse(F.col("text")), 1, 280).alias("snippet"))
    return _run(spark, sf_dir).drop("score").join(g, ["qid", "item"], "left").join(d, "item").withColumn("is_evidence", F.coalesce("is_evidence", F.lit(False)))
