"""Registered queries on the knowledge graph of the documents' chunks: entities, relations, communities, hierarchies; and the SQL they are held against."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalogue import _WINDOWS, SQL_Q, _cos, _lpa, query, tab, with_tables
from .cluster import ship
from .functions import text as T
from .models import HashEmbedder
from .operators import chunking, graph, kg
from .plans import communities as C, hierarchy as H, retrieval as P
from .tables import kept, written

SIZE = 32
_HASHES = "list_transform(regexp_extract_all(lower({t}), '([a-z0-9]+)', 1), lambda w: ('0x' || substring(md5(w), 1, 7))::BIGINT)"
_PLACE = f"coalesce(list_sum(list_transform({_HASHES}, lambda h: CASE WHEN h % {SIZE} = d THEN CASE WHEN (h // {SIZE}) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ELSE 0.0::DOUBLE END)), 0.0)"


def sql_embedded(t: str) -> str:
    return f"list_transform(range(0, {SIZE}), lambda d: {_PLACE.format(t=t)})"


def sql_weight(p: str) -> str:
    return f"CASE {p} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in graph.PREDICATE_WEIGHTS.items()) + f" ELSE {graph.DEFAULT_WEIGHT}::DOUBLE END"


_KINDS = f"list_position({kg.ENTITY_TYPES!r}, type)"
#: Tables that the SQL of several queries reads.
TABLES = {
    "x_win": _WINDOWS,
    "x_ex": "SELECT doc_id, doc_id || ':' || start_index AS chunk_key, list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'p': list_position(w, x), 'x': x})), lambda s: s.x) AS n FROM (SELECT doc_id, start_index, regexp_extract_all(chunk, '([A-Z][a-z]{5,})', 1) AS w FROM x_win)",
    "x_ent": f"""SELECT chunk_key, doc_id, i - 1 AS pos, n[i] AS name, CASE WHEN length(n[i]) % 2 = 0 THEN 'Problem' WHEN length(n[i]) % 7 = 0 THEN 'Method' ELSE 'Concept' END AS type
        FROM (SELECT chunk_key, doc_id, n, unnest(range(1, least(len(n), {kg.MAX_ENTITIES}) + 1)) AS i FROM x_ex)""",
    "x_rel": f"""SELECT chunk_key, doc_id, i - 1 AS pos, lower(n[i]) AS subject, CASE WHEN length(n[i + 1]) % 3 = 0 THEN 'proposes' ELSE 'mentions' END AS predicate, lower(n[i + 1]) AS object,
        n[i] || ' before ' || n[i + 1] AS description, n[i] || ' ' || n[i + 1] AS evidence FROM (SELECT chunk_key, doc_id, n, unnest(range(1, least(len(n) - 1, {kg.MAX_RELATIONS}) + 1)) AS i FROM x_ex)""",
    "x_entities": """SELECT substring(sha1(lower(name)), 1, 16) AS entity_id, lower(name) AS canonical_name, first(name ORDER BY chunk_key, pos) AS name,
        CASE WHEN bool_or(type = 'Method') THEN 'Method' WHEN bool_or(type = 'Problem') THEN 'Problem' ELSE 'Concept' END AS type, list_sort(list_distinct(list(type))) AS observed_types,
        list_sort(list_distinct(list(upper(name)))) AS aliases, first(name || ' seen' ORDER BY chunk_key, pos) AS description, '{"letters":"' || min(length(name)) || '"}' AS attributes, count(DISTINCT chunk_key) AS n_chunks
        FROM x_ent GROUP BY lower(name)""",
    "x_resolved": """SELECT r.*, s.entity_id AS subject_id, o.entity_id AS object_id, substring(sha1(s.entity_id || '|' || predicate || '|' || o.entity_id), 1, 16) AS relation_id
        FROM x_rel r JOIN x_entities s ON s.canonical_name = subject JOIN x_entities o ON o.canonical_name = object WHERE s.entity_id <> o.entity_id""",
    "x_relations": """SELECT relation_id, subject_id, predicate, object_id, first(description ORDER BY -length(description), chunk_key, pos) AS description, list_sort(list_distinct(list(evidence))) AS evidence,
        count(DISTINCT chunk_key) AS n_chunks, count(*) AS n FROM x_resolved GROUP BY ALL""",
    "x_links": "SELECT DISTINCT substring(sha1(lower(name)), 1, 16) AS entity_id, doc_id FROM x_ent",
    "x_rlinks": "SELECT DISTINCT relation_id, doc_id FROM x_resolved",
    "x_texts": "SELECT *, 'Name: ' || name || chr(10) || 'Type: ' || type || chr(10) || 'Aliases: ' || array_to_string(aliases[1:8], ', ') || chr(10) || 'Description: ' || description || chr(10) || 'Attributes: ' || attributes AS entity_text FROM x_entities",
    "x_vec": f"SELECT entity_id, {sql_embedded('entity_text')} AS embedding FROM x_texts",
    "x_edges": f"""SELECT least(subject_id, object_id) AS src, greatest(subject_id, object_id) AS dst, round(sum({sql_weight('predicate')} + 0.25::DOUBLE * greatest(round({_cos('s.embedding', 'o.embedding')}, 9), 0)), 6) AS weight, count(*) AS n
        FROM x_relations JOIN x_vec s ON s.entity_id = subject_id JOIN x_vec o ON o.entity_id = object_id GROUP BY 1, 2""",
    "x_both": "SELECT src, dst, weight FROM x_edges UNION ALL SELECT dst, src, weight FROM x_edges",
    "x_deg": "SELECT src AS entity_id, count(*) AS degree, round(sum(weight), 6) AS weighted_degree FROM x_both GROUP BY src",
    "x_lab": _lpa(2, "SELECT * FROM x_both", "SELECT entity_id AS node FROM x_entities"),
    "x_com": "SELECT label, printf('c%04d', row_number() OVER (ORDER BY count(*) DESC, min(node))) AS community_id FROM x_lab GROUP BY label",
    "x_mem": "SELECT community_id, node AS entity_id FROM x_lab JOIN x_com USING (label)",
    "x_key": f"""SELECT community_id, entity_id, name, type, description, coalesce(degree, 0) AS degree, coalesce(weighted_degree, 0) AS weighted_degree,
        row_number() OVER (PARTITION BY community_id ORDER BY {_KINDS}, coalesce(weighted_degree, 0) DESC, lower(name), entity_id) AS rank FROM x_mem JOIN x_entities USING (entity_id) LEFT JOIN x_deg USING (entity_id) QUALIFY rank <= {C.KEY}""",
    "x_inner": "SELECT r.*, a.community_id FROM x_relations r JOIN x_mem a ON a.entity_id = subject_id JOIN x_mem b ON b.entity_id = object_id WHERE a.community_id = b.community_id",
    "x_krel": f"""SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY score DESC, predicate, subject, object, relation_id) AS rank FROM (
        SELECT community_id, relation_id, s.name AS subject, predicate, o.name AS object, i.description, round({sql_weight('predicate')} + 0.02::DOUBLE * ds.weighted_degree + 0.02::DOUBLE * d2.weighted_degree, 6) AS score
        FROM x_inner i JOIN x_entities s ON s.entity_id = subject_id JOIN x_entities o ON o.entity_id = object_id JOIN x_deg ds ON ds.entity_id = subject_id JOIN x_deg d2 ON d2.entity_id = object_id) QUALIFY rank <= {C.KEY}""",
    "x_refs": f"""SELECT community_id, doc_id, count(*) AS n, row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, doc_id) AS ref_rank
        FROM (SELECT community_id, doc_id FROM x_mem JOIN x_links USING (entity_id) UNION ALL SELECT community_id, doc_id FROM x_krel JOIN x_rlinks USING (relation_id)) GROUP BY 1, 2 QUALIFY ref_rank <= {C.SOURCES}""",
    "x_types": "SELECT community_id, string_agg(type || '=' || n, ', ' ORDER BY n DESC, type) AS types FROM (SELECT community_id, type, count(*) AS n FROM x_mem JOIN x_entities USING (entity_id) GROUP BY 1, 2) GROUP BY 1",
    "x_preds": f"SELECT community_id, string_agg(predicate || '=' || n, ', ' ORDER BY n DESC, predicate) AS predicates FROM (SELECT community_id, predicate, count(*) AS n FROM (SELECT community_id, predicate FROM x_inner) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, predicate) <= {C.COUNTS}) GROUP BY 1",
}


def _group(i: int) -> str:
    types = list(C.GROUPS.values())[i]
    five = f"SELECT *, row_number() OVER (PARTITION BY community_id, type ORDER BY weighted_degree DESC, lower(name), entity_id) AS r5 FROM x_key WHERE list_contains({types!r}, type) QUALIFY r5 <= 5"
    twelve = f"SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY list_position({types!r}, type), r5) AS r12 FROM ({five}) QUALIFY r12 <= 12"
    return f"SELECT community_id, string_agg(name, '; ' ORDER BY r12) AS g{i} FROM ({twelve}) GROUP BY 1"


_HEADS = " ".join(f"|| chr(10) || '{h}: ' || coalesce(g{i}, 'none')" for i, h in enumerate(C.GROUPS))
TABLES["x_sum"] = f"""SELECT community_id, member_count, 'Community ' || community_id || chr(10) || 'Theme: ' || coalesce(theme, 'mixed academic-paper concepts') || chr(10) || 'Entity type distribution: ' || coalesce(types, 'none')
    || chr(10) || 'Relation distribution: ' || coalesce(predicates, 'none') {_HEADS} || chr(10) || 'Key entities:' || coalesce(chr(10) || entities, '') || chr(10) || 'Key relations:' || coalesce(chr(10) || relations, '') || chr(10) || 'Source chunks:' || coalesce(chr(10) || refs, '') AS summary
    FROM (SELECT community_id, count(*) AS member_count FROM x_mem GROUP BY 1)
    LEFT JOIN (SELECT community_id, string_agg(name, '; ' ORDER BY rank) FILTER (rank <= 5) AS theme, string_agg('- ' || name || ' (' || type || '): ' || description, chr(10) ORDER BY rank) FILTER (rank <= 12) AS entities FROM x_key GROUP BY 1) USING (community_id)
    LEFT JOIN (SELECT community_id, string_agg('- ' || subject || ' --' || predicate || '--> ' || object || ': ' || description, chr(10) ORDER BY rank) AS relations FROM x_krel WHERE rank <= 12 GROUP BY 1) USING (community_id)
    LEFT JOIN (SELECT community_id, string_agg('- ' || doc_id, chr(10) ORDER BY ref_rank) AS refs FROM x_refs WHERE ref_rank <= 10 GROUP BY 1) USING (community_id)
    LEFT JOIN x_types USING (community_id) LEFT JOIN x_preds USING (community_id)
    """ + " ".join(f"LEFT JOIN ({_group(i)}) USING (community_id)" for i in range(len(C.GROUPS)))
TABLES["x_sumvec"] = f"SELECT community_id, {sql_embedded('summary')} AS embedding FROM x_sum"
TABLES["x_qembed"] = f"SELECT qid, question, {sql_embedded('question')} AS qembed FROM ({SQL_Q})"


def kg_query(final: str):
    return query(with_tables(final, TABLES))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction records of the documents' chunks: the caps on names and relations hold for a chunk."""
    w = chunking.fixed_windows(tab(spark, sf_dir, "documents"), ["doc_id"])
    return kg.PatternExtractor().records(w.withColumn("chunk_key", F.concat_ws(":", "doc_id", "start_index")), "chunk_key", "chunk")


def _doc(links: DataFrame, key: str) -> DataFrame:
    return links.select(key, F.substring_index("chunk_key", ":", 1).cast("bigint").alias("doc_id")).distinct()


@dataclass
class Knowledge:
    graph: P.Graph
    communities: dict[str, DataFrame] | None = None


_built: dict[tuple[str, str], Knowledge] = {}


def knowledge(spark: SparkSession, sf_dir: str, with_communities: bool = False) -> Knowledge:
    """The graph of all documents, and its communities: built once a session and kept as tables, as an index is. kg_* and community_* time the building."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _built:
        # Mentions are written, and what is merged from them before it is counted and cut into parts: names are cleaned, relations resolved and all merged once.
        r = records(spark, sf_dir)
        ent = written(kg.named(kg.entities_of(r)), "kg-mentions")
        e = kept(written(kg.merged_entities(ent), "kg-merged"), "kg-entities", "entity_id", lambda df: df.withColumn("embedding", HashEmbedder(SIZE).embed(kg.entity_text(df))))
        rel = written(kg.resolved_relations(kg.relations_of(r), e), "kg-resolved")
        links = _doc(ent, "canonical_name").select(F.substring(F.sha1("canonical_name"), 1, 16).alias("entity_id"), "doc_id")
        whole = lambda df, key, name: kept(written(df, name), name, key)
        g = P.Graph(e, whole(kg.merged_resolved(rel), "relation_id", "kg-relations"), whole(links, "entity_id", "kg-links"), whole(_doc(rel, "relation_id"), "relation_id", "kg-relation-links"))
        _built[at] = Knowledge(g)
    k = _built[at]
    if with_communities and k.communities is None:
        c = C.build(k.graph.entities, k.graph.relations, k.graph.links, k.graph.relation_links, embedder=HashEmbedder(SIZE))
        k.communities = c | {"sources": written(c["sources"], "community-sources"), "index": written(c["index"], "community-index")}
    return k


_FOLD = """WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_transform(list_filter(w, lambda x, j: list_position(w, x) = j)[1:3], lambda x: lower(x)) AS names, row_number() OVER (ORDER BY doc_id::VARCHAR) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '([A-Z][a-z]{5,})', 1) AS w FROM documents) WHERE len(w) > 0),
    r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, NULL::VARCHAR AS key, MAP {}::MAP(VARCHAR, VARCHAR) AS points UNION ALL
        SELECT x.i, x.doc_id, key, map_concat(points, map_from_entries(list_transform(names, lambda n: {'k': n, 'v': key})))
        FROM (SELECT d.i, d.doc_id, d.names, r.points, coalesce(list_filter(list_transform(d.names, lambda n: r.points[n]), lambda k: k IS NOT NULL)[1], d.names[1]) AS key FROM r JOIN d ON d.i = r.i + 1) x)
    SELECT doc_id, key FROM r WHERE i > 0"""


@query(_FOLD)
def kg_alias_keys(spark, sf_dir):
    """Every document as a record of one entity: its first capitalised word of six letters or more, with the next two as aliases."""
    names = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]{5,})"), F.lit(1))), 1, 3)
    d = tab(ship(spark), sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chunk_key"), F.lit(0).alias("pos"), names.alias("n")).filter("size(n) > 0")
    e = d.select("chunk_key", "pos", F.get("n", F.lit(0)).alias("name"), F.slice("n", 2, 2).alias("aliases"))
    return kg.entity_keys(e).select(F.col("chunk_key").cast("bigint").alias("doc_id"), "key")


@kg_query("SELECT entity_id, canonical_name, name, type, observed_types, aliases, description, attributes, n_chunks FROM x_entities")
def kg_entities(spark, sf_dir):
    return kg.merged_entities(kg.entities_of(records(spark, sf_dir))).withColumn("attributes", T.sorted_json(F.col("attributes")))


@kg_query("SELECT * FROM x_relations")
def kg_relations(spark, sf_dir):
    r = records(spark, sf_dir)
    return kg.merged_relations(kg.relations_of(r), kg.merged_entities(kg.entities_of(r)))


@kg_query("SELECT DISTINCT substring(sha1(lower(name)), 1, 16) AS entity_id, chunk_key FROM x_ent")
def kg_links(spark, sf_dir):
    return kg.links(kg.entities_of(records(spark, sf_dir)))


@kg_query("SELECT relation_id, doc_id FROM x_rlinks")
def kg_relation_links(spark, sf_dir):
    r = records(spark, sf_dir)
    return _doc(kg.relation_links(kg.relations_of(r), kg.merged_entities(kg.entities_of(r))), "relation_id")


@kg_query("SELECT entity_id, count(*) AS n_relations, min(relation_id) AS least FROM (SELECT subject_id AS entity_id, relation_id FROM x_relations UNION SELECT object_id, relation_id FROM x_relations) GROUP BY 1")
def kg_relations_by_entity(spark, sf_dir):
    return kg.relations_by_entity(knowledge(spark, sf_dir).graph.relations).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_relations"), F.min("relation_id").alias("least"))


@kg_query("SELECT entity_id, row_number() OVER (ORDER BY type, lower(name), entity_id) AS place FROM x_entities")
def kg_entity_order(spark, sf_dir):
    return kg.output_order(entities=knowledge(spark, sf_dir).graph.entities).select("entity_id", "place")


@kg_query("SELECT relation_id, row_number() OVER (ORDER BY predicate, subject_id, object_id) AS place FROM x_relations")
def kg_relation_order(spark, sf_dir):
    return kg.output_order(relations=knowledge(spark, sf_dir).graph.relations).select("relation_id", "place")


@kg_query("SELECT entity_id, entity_text, embedding FROM x_texts JOIN x_vec USING (entity_id)")
def entity_texts(spark, sf_dir):
    e = knowledge(spark, sf_dir).graph.entities
    return e.select("entity_id", kg.entity_text(e).alias("entity_text"), "embedding")


@kg_query("SELECT relation_id, lower(concat_ws(' ', predicate, r.description, s.name, o.name, array_to_string(evidence, ' '))) AS searchable FROM x_relations r LEFT JOIN x_entities s ON s.entity_id = subject_id LEFT JOIN x_entities o ON o.entity_id = object_id")
def relation_search_texts(spark, sf_dir):
    g = knowledge(spark, sf_dir).graph
    return kg.relation_search_text(g.relations, g.entities).select("relation_id", "searchable")


@kg_query("SELECT src, dst, weight, n FROM x_edges")
def kg_edge_weights(spark, sf_dir):
    g = knowledge(spark, sf_dir).graph
    return C.entity_edges(g.entities, g.relations)


@kg_query("SELECT community_id, entity_id FROM x_mem")
def community_members(spark, sf_dir):
    return knowledge(spark, sf_dir, True).communities["members"]


@kg_query("SELECT community_id, entity_id, type, degree, weighted_degree, rank FROM x_key")
def community_top_entities(spark, sf_dir):
    return knowledge(spark, sf_dir, True).communities["key_entities"].select("community_id", "entity_id", "type", "degree", "weighted_degree", "rank")


@kg_query("SELECT community_id, relation_id, subject, predicate, object, score, rank FROM x_krel")
def community_key_relations(spark, sf_dir):
    return knowledge(spark, sf_dir, True).communities["key_relations"].drop("description")


@kg_query("SELECT community_id, count(*) AS n_relations FROM x_inner GROUP BY 1")
def community_inner_relations(spark, sf_dir):
    return knowledge(spark, sf_dir, True).communities["inner"].groupBy("community_id").agg(F.count(F.lit(1)).alias("n_relations"))


@kg_query("SELECT community_id, types AS counts FROM x_types")
def community_type_counts(spark, sf_dir):
    k = knowledge(spark, sf_dir, True)
    return C.counted(k.communities["members"].join(k.graph.entities.select("entity_id", "type"), "entity_id"), "type")


@kg_query("SELECT community_id, predicates AS counts FROM x_preds")
def community_predicate_counts(spark, sf_dir):
    return C.counted(knowledge(spark, sf_dir, True).communities["inner"], "predicate")


@kg_query("SELECT community_id, doc_id, n, ref_rank FROM x_refs")
def community_sources(spark, sf_dir):
    return knowledge(spark, sf_dir, True).communities["sources"]


@kg_query("SELECT community_id, member_count, summary FROM x_sum")
def community_summaries(spark, sf_dir):
    return knowledge(spark, sf_dir, True).communities["index"].select("community_id", "member_count", "summary")


# Hierarchy over the embeddings table ------------------------------------------------------------------------------------
THRESHOLD = 0.3
_MEAN = "list_transform(range(1, 65), lambda i: list_sum(list_transform(v, lambda x: round(x[i]::DOUBLE * 1e9)::BIGINT))::DOUBLE / (len(v) * 1e9))"


def _near(nodes: str, k: int, least: float) -> str:
    return f"SELECT a.node_id AS src, b.node_id AS dst, round({_cos('a.embedding', 'b.embedding')}, 9) AS similarity FROM ({nodes}) a JOIN ({nodes}) b ON a.node_id <> b.node_id WHERE similarity >= {least} QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= {k}"


def _similar(edges: str, nodes: str) -> str:
    return f"SELECT src, dst, round(sum(weight), 6) AS weight FROM ({edges} UNION ALL SELECT least(src, dst), greatest(src, dst), similarity FROM ({_near(nodes, H.TOP_K, THRESHOLD)})) GROUP BY 1, 2"


_NEXT = "SELECT doc_id AS subject_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS object_id, CASE doc_id % 3 WHEN 0 THEN 'extends' WHEN 1 THEN 'uses' ELSE 'unlisted' END AS predicate FROM documents JOIN embeddings ON vec_id = doc_id"
LEVELS = {
    "h_n0": "SELECT vec_id AS node_id, embedding::DOUBLE[] AS embedding FROM embeddings",
    "h_r": f"SELECT * FROM ({_NEXT}) WHERE object_id IS NOT NULL",
    "h_rel": f"SELECT least(subject_id, object_id) AS src, greatest(subject_id, object_id) AS dst, round(sum({sql_weight('predicate')} + greatest(round({_cos('s.embedding', 'o.embedding')}, 9), 0)), 6) AS weight FROM h_r JOIN h_n0 s ON s.node_id = subject_id JOIN h_n0 o ON o.node_id = object_id GROUP BY 1, 2",
    "h_e0": _similar("SELECT * FROM h_rel", "SELECT * FROM h_n0"),
}
for _i in (0, 1):
    _both = f"SELECT src, dst, weight FROM h_e{_i} UNION ALL SELECT dst, src, weight FROM h_e{_i}"
    LEVELS |= {
        f"h_l{_i}": _lpa(2, _both, f"SELECT node_id AS node FROM h_n{_i}"),
        f"h_p{_i}": f"SELECT p.community AS parent, node AS child FROM h_l{_i} JOIN (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(node)) AS community FROM h_l{_i} GROUP BY label) p USING (label)",
        f"h_n{_i + 1}": f"SELECT parent AS node_id, {_MEAN} AS embedding FROM (SELECT parent, list(embedding) AS v FROM h_p{_i} JOIN h_n{_i} ON node_id = child GROUP BY parent)",
        f"h_e{_i + 1}": _similar(f"SELECT least(x.parent, y.parent) AS src, greatest(x.parent, y.parent) AS dst, round(sum(weight), 6) AS weight FROM h_e{_i} e JOIN h_p{_i} x ON x.child = e.src JOIN h_p{_i} y ON y.child = e.dst WHERE x.parent <> y.parent GROUP BY 1, 2", f"SELECT * FROM h_n{_i + 1}"),
    }
LEVELS["h_children"] = "SELECT 1::BIGINT AS level, parent, child FROM h_p0 UNION ALL SELECT 2, parent, child FROM h_p1"
LEVELS["h_nodes"] = "SELECT 0::BIGINT AS level, * FROM h_n0 UNION ALL SELECT 1, * FROM h_n1 UNION ALL SELECT 2, * FROM h_n2"

_hierarchies: dict[tuple[str, str], H.Hierarchy] = {}


def attributed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (documents that have a vector), edges (the next document of the same source as a relation, and nearest neighbours) and the neighbours."""
    from pyspark.sql import Window

    nodes = tab(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.concat(F.lit("d"), F.col("vec_id")).alias("name"), "embedding")
    d = tab(spark, sf_dir, "documents").select("doc_id", "source").join(nodes.select(F.col("node_id").alias("doc_id")), "doc_id", "left_semi")
    nxt = d.select(F.col("doc_id").alias("subject_id"), F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("object_id")).filter("object_id IS NOT NULL")
    r = nxt.withColumn("predicate", F.when(F.col("subject_id") % 3 == 0, "extends").when(F.col("subject_id") % 3 == 1, "uses").otherwise("unlisted"))
    e = C.entity_edges(nodes.select(F.col("node_id").alias("entity_id"), "embedding"), r, 1.0, 1.0)
    near = H.neighbours(nodes)
    return nodes, H.with_similar(e, nodes, threshold=THRESHOLD, near=near), near


def hierarchy(spark: SparkSession, sf_dir: str) -> H.Hierarchy:
    """Built once a session, as knowledge()."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _hierarchies:
        nodes, e, near = attributed(spark, sf_dir)
        refs = nodes.select("node_id", F.col("node_id").alias("doc_id"))
        _hierarchies[at] = H.linked(H.build(nodes, e, refs, threshold=THRESHOLD, near=near))
    return _hierarchies[at]


def level_query(final: str):
    return query(with_tables(final, LEVELS))


@level_query("SELECT src, dst, weight FROM h_e0")
def attributed_graph(spark, sf_dir):
    return attributed(spark, sf_dir)[1]


@level_query("SELECT level, parent, child FROM h_children")
def hierarchy_children(spark, sf_dir):
    return hierarchy(spark, sf_dir).children


@level_query("""SELECT n.level, n.node_id, CASE WHEN n.level > 0 THEN printf('l%d_c%04d_', n.level, n.node_id) || substring(sha1(least::VARCHAR), 1, 8) ELSE 'd' || n.node_id END AS name, coalesce(size, 1) AS size, embedding
    FROM h_nodes n LEFT JOIN (SELECT level, parent AS node_id, count(*) AS size, min(child) AS least FROM h_children GROUP BY 1, 2) c ON c.level = n.level AND c.node_id = n.node_id""")
def hierarchy_nodes(spark, sf_dir):
    return hierarchy(spark, sf_dir).nodes.select("level", "node_id", "name", "size", "embedding")


@level_query("SELECT 0::BIGINT AS level, * FROM h_e0 UNION ALL SELECT 1, * FROM h_e1")
def hierarchy_edges(spark, sf_dir):
    return hierarchy(spark, sf_dir).edges.filter("level <= 1")


@level_query(f"SELECT parent, src, dst, weight, row_number() OVER (PARTITION BY parent ORDER BY weight DESC, src, dst) AS rank FROM h_e0 JOIN h_p0 a ON a.child = src JOIN (SELECT parent AS p, child FROM h_p0) b ON b.child = dst WHERE a.parent = p QUALIFY rank <= {H.INNER}")
def hierarchy_inner_edges(spark, sf_dir):
    h = hierarchy(spark, sf_dir)
    return H.inner_edges(h.edges.filter("level = 0").drop("level"), h.children.filter("level = 1").drop("level"))


@level_query(f"SELECT level, src, dst, rank FROM (SELECT 0::BIGINT AS level, *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM ({_near('SELECT * FROM h_n0', 8, -1)}) UNION ALL SELECT 1, *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) FROM ({_near('SELECT * FROM h_n1', 8, -1)}))")
def hierarchy_intra_links(spark, sf_dir):
    return hierarchy(spark, sf_dir).intra_links.filter("level <= 1")


_INTER = f"SELECT c.level, parent, child, round({_cos('u.embedding', 'w.embedding')}, 6) AS similarity FROM h_children c JOIN h_nodes u ON u.level = c.level AND u.node_id = parent JOIN h_nodes w ON w.level + 1 = c.level AND w.node_id = child"


@level_query(f"SELECT * FROM ({_INTER}) QUALIFY row_number() OVER (PARTITION BY level, parent ORDER BY similarity DESC, child) = 1")
def hierarchy_inter_links(spark, sf_dir):
    return hierarchy(spark, sf_dir).inter_links


@level_query("SELECT level, count(*) AS n FROM h_nodes GROUP BY level")
def hierarchy_layer_counts(spark, sf_dir):
    return H.layer_counts(hierarchy(spark, sf_dir).nodes)


@level_query("SELECT 2::BIGINT AS level, parent AS node_id, count(*) AS n_children, sum(n)::BIGINT AS n_refs FROM h_p1 JOIN (SELECT parent AS child, count(*) AS n FROM h_p0 GROUP BY 1) USING (child) GROUP BY parent ORDER BY n_children DESC, n_refs DESC, node_id LIMIT 1")
def hierarchy_entry(spark, sf_dir):
    h = hierarchy(spark, sf_dir)
    return H.entry_node(h.nodes, h.children, h.refs)
