"""Communities of an entity graph: records with key entities, key relations, counts and sources; summaries and their index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, vectors as V
from ..models import Embedder, Generator, HashEmbedder, answered
from ..operators import graph, kg, ranking as R
from ..tables import written

#: Key entities, key relations, sources of a community; entries of a count's text.
KEY, SOURCES, COUNTS = 24, 30, 8
GROUPS = {
    "Core methods/models/modules": ["Method", "Model", "Module", "Contribution"],
    "Core problems/scenarios/tasks": ["Problem", "Scenario", "Task", "Application"],
    "Datasets and metrics": ["Dataset", "Metric"],
    "Findings/results/limitations/future work": ["Finding", "Result", "Limitation", "FutureWork"],
}


def entity_edges(entities: DataFrame, relations: DataFrame, alpha: float = 1.0, beta: float = 0.25) -> DataFrame:
    """src, dst, weight, n: for each relation alpha times its predicate's weight, and beta times the cosine of its ends' embeddings if that is
    positive. entities: entity_id, embedding."""
    v = entities.select("entity_id", "embedding")
    r = relations.join(v.select(F.col("entity_id").alias("subject_id"), F.col("embedding").alias("sv")), "subject_id").join(v.select(F.col("entity_id").alias("object_id"), F.col("embedding").alias("ov")), "object_id")
    weight = alpha * graph.predicate_weight(F.col("predicate")) + beta * F.greatest(F.round(V.cosine(F.col("sv"), F.col("ov")), 9), F.lit(0.0))
    return graph.edges(r.select("subject_id", "object_id", weight.alias("w")), "subject_id", "object_id", F.col("w"))


def members_of(labels: DataFrame) -> DataFrame:
    """community_id (c0001, ... by size, then the least member), entity_id."""
    ids = graph.communities(labels).select("label", F.format_string("c%04d", "community").alias("community_id"))
    return labels.join(ids, "label").select("community_id", F.col("node").alias("entity_id"))


def key_entities(members: DataFrame, entities: DataFrame, e: DataFrame, k: int = KEY) -> DataFrame:
    """community_id, entity_id, name, type, description, degree, weighted_degree, rank: by type, then weighted degree, then name."""
    kinds = F.array_position(F.array(*map(F.lit, kg.ENTITY_TYPES)), F.col("type"))
    rows = members.join(entities.select("entity_id", "name", "type", "description"), "entity_id").join(graph.degrees(e).withColumnRenamed("node", "entity_id"), "entity_id", "left")
    rows = rows.select("community_id", "entity_id", "name", "type", "description", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"), F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"))
    return R.ranked(rows, ["community_id"], [kinds, F.desc("weighted_degree"), F.lower("name"), F.col("entity_id")], k)


def inner_relations(members: DataFrame, relations: DataFrame) -> DataFrame:
    """relations with both ends in one community, and its community_id."""
    a = members.select(F.col("entity_id").alias("subject_id"), "community_id")
    b = members.select(F.col("entity_id").alias("object_id"), F.col("community_id").alias("_c"))
    return relations.join(a, "subject_id").join(b, "object_id").filter("community_id = _c").drop("_c")


def key_relations(inner: DataFrame, entities: DataFrame, e: DataFrame, k: int = KEY) -> DataFrame:
    """community_id, relation_id, subject, predicate, object, description, score, rank: predicate weight plus 0.02 for each unit of the ends' weighted
    degrees."""
    node = graph.degrees(e).join(entities.select(F.col("entity_id").alias("node"), "name"), "node")
    s = node.select(F.col("node").alias("subject_id"), F.col("name").alias("subject"), F.col("weighted_degree").alias("ws"))
    o = node.select(F.col("node").alias("object_id"), F.col("name").alias("object"), F.col("weighted_degree").alias("wo"))
    score = F.round(graph.predicate_weight(F.col("predicate")) + 0.02 * F.col("ws") + 0.02 * F.col("wo"), 6)
    rows = inner.join(s, "subject_id").join(o, "object_id").select("community_id", "relation_id", "subject", "predicate", "object", "description", score.alias("score"))
    return R.ranked(rows, ["community_id"], [F.desc("score"), F.col("predicate"), F.col("subject"), F.col("object"), F.col("relation_id")], k)


def counted(rows: DataFrame, by: str, k: int = COUNTS) -> DataFrame:
    """community_id, counts: 'value=number' of the k most frequent values, ties by name."""
    n = R.ranked(rows.groupBy("community_id", by).agg(F.count(F.lit(1)).alias("n")), ["community_id"], [F.desc("n"), F.col(by)], k)
    return n.groupBy("community_id").agg(_lines(F.concat(F.col(by), F.lit("="), F.col("n").cast("string")), ", ").alias("counts"))


def _lines(line: Column, sep: str, rank: str = "rank") -> Column:
    """A group's lines in order of rank; groups are cut to a few rows before."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("l")))), lambda x: x["l"]), sep)


def source_chunks(members: DataFrame, entity_links: DataFrame, key: DataFrame, relation_links: DataFrame, k: int = SOURCES) -> DataFrame:
    """community_id, doc_id, n, ref_rank: the chunks that most members and key relations stand in. Links: entity_id or relation_id, doc_id."""
    refs = members.join(entity_links, "entity_id").select("community_id", "doc_id").unionByName(key.select("community_id", "relation_id").join(relation_links, "relation_id").select("community_id", "doc_id"))
    return R.ranked(refs.groupBy("community_id", "doc_id").agg(F.count(F.lit(1)).alias("n")), ["community_id"], [F.desc("n"), F.col("doc_id")], k, "ref_rank")


def summaries(members: DataFrame, entities: DataFrame, top: DataFrame, inner: DataFrame, key: DataFrame, sources: DataFrame, generator: Generator | None = None) -> DataFrame:
    """community_id, member_count, summary: by rule from the facts, or by the generator from those; where it fails, the rule's."""
    kinds = members.join(entities.select("entity_id", "type"), "entity_id")
    size = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("member_count"))
    names = lambda n: F.coalesce(_lines(F.when(F.col("rank") <= n, F.col("name")), "; "), F.lit(""))
    by_group = []
    for i, types in enumerate(GROUPS.values()):
        rank = F.array_position(F.array(*map(F.lit, types)), F.col("type"))
        five = R.ranked(top.filter(F.col("type").isin(types)).drop("rank").withColumn("g", rank).withColumnRenamed("weighted_degree", "w"), ["community_id", "type"], [F.desc("w"), F.lower("name"), F.col("entity_id")], 5, "r5")
        twelve = R.ranked(five, ["community_id"], [F.col("g"), F.col("r5")], 12)
        by_group.append(twelve.groupBy("community_id").agg(_lines(F.col("name"), "; ").alias(f"g{i}")))
    theme = top.groupBy("community_id").agg(names(5).alias("theme"), _lines(F.when(F.col("rank") <= 12, F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit("): "), "description")), "\n").alias("entities"))
    said = key.filter("rank <= 12").groupBy("community_id").agg(_lines(F.concat(F.lit("- "), "subject", F.lit(" --"), "predicate", F.lit("--> "), "object", F.lit(": "), "description"), "\n").alias("relations"))
    refs = sources.filter("ref_rank <= 10").groupBy("community_id").agg(_lines(F.concat(F.lit("- "), F.col("doc_id").cast("string")), "\n", "ref_rank").alias("refs"))
    j = size.join(theme, "community_id", "left").join(said, "community_id", "left").join(refs, "community_id", "left")
    j = j.join(counted(kinds, "type").withColumnRenamed("counts", "types"), "community_id", "left").join(counted(inner, "predicate").withColumnRenamed("counts", "predicates"), "community_id", "left")
    for g in by_group:
        j = j.join(g, "community_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit("none"))
    lines = [F.concat(F.lit("Community "), "community_id"), F.concat(F.lit("Theme: "), F.coalesce("theme", F.lit("mixed academic-paper concepts"))), F.concat(F.lit("Entity type distribution: "), none("types")), F.concat(F.lit("Relation distribution: "), none("predicates"))]
    lines += [F.concat(F.lit(f"{head}: "), none(f"g{i}")) for i, head in enumerate(GROUPS)]
    lines += [F.lit("Key entities:"), F.col("entities"), F.lit("Key relations:"), F.col("relations"), F.lit("Source chunks:"), F.col("refs")]
    out = j.select("community_id", "member_count", F.concat_ws("\n", *lines).alias("facts"))
    better = answered(generator, F.concat(F.lit("Summarize this community of a knowledge graph for retrieval, from these facts only:\n"), F.substring("facts", 1, 6000)))
    return out.select("community_id", "member_count", F.coalesce(F.nullif(better, F.lit("")), F.col("facts")).alias("summary"))


def index(summary: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """summaries with their embeddings: what community_search reads."""
    return summary.withColumn("embedding", (embedder or HashEmbedder()).embed(F.col("summary")))


def build(entities: DataFrame, relations: DataFrame, entity_links: DataFrame, relation_links: DataFrame, algorithm: str = "label", rounds: int = 2, generator: Generator | None = None, embedder: Embedder | None = None) -> dict[str, DataFrame]:
    """edges, members, key_entities, key_relations, inner, sources and index (summary and embedding) of the graph's communities; the first four are
    written, for the others read them several times. entities: with embedding, else it is made of their texts."""
    embedder = embedder or HashEmbedder()
    if "embedding" not in entities.columns:
        entities = entities.withColumn("embedding", embedder.embed(kg.entity_text(entities)))
    e = written(entity_edges(entities, relations), "entity-edges")
    members = written(members_of(graph.detect(entities.select(F.col("entity_id").alias("node")), e, algorithm, rounds=rounds)), "community-members")
    top = written(key_entities(members, entities, e), "community-entities")
    inner = inner_relations(members, relations)
    key = written(key_relations(inner, entities, e), "community-relations")
    sources = source_chunks(members, entity_links, key, relation_links)
    made = index(summaries(members, entities, top, inner, key, sources, generator), embedder)
    return {"edges": e, "members": members, "key_entities": top, "inner": inner, "key_relations": key, "sources": sources, "index": made}
