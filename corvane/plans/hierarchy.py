"""A hierarchy of communities: attributed graph, levels, links within and between them, saved and loaded as tables.

A node is (level, node_id): at level 0 the id is the entity's number, above it the number of the community in its level's order. Upper nodes are
embedded by their text, or as the mean of their children if no embedder is given.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, vectors as V
from ..models import Embedder, Generator, answered
from ..operators import graph, ranking as R
from ..tables import written

TOP_K, THRESHOLD, NEIGHBOURS, INNER, SHOWN, REFS = 5, 0.65, 8, 60, 12, 80


@dataclass
class Hierarchy:
    """nodes (level, node_id, name, size, summary, embedding), children (level, parent, child; level is the parent's), edges (level, src, dst, weight),
    refs (level, node_id, doc_id), intra_links (level, src, dst, rank), inter_links (level, parent, child)."""

    nodes: DataFrame
    children: DataFrame
    edges: DataFrame
    refs: DataFrame
    intra_links: DataFrame | None = None
    inter_links: DataFrame | None = None
    config: dict = field(default_factory=dict)
    #: neighbours() of levels, as far as building has found them; not saved.
    near: dict[int, DataFrame] = field(default_factory=dict)

    TABLES = ("nodes", "children", "edges", "refs", "intra_links", "inter_links")

    def level(self, n: int) -> DataFrame:
        return self.nodes.filter(F.col("level") == n).select("node_id", "embedding")

    def top(self) -> int:
        return self.nodes.agg(F.max("level")).first()[0]

    def levels(self) -> list[DataFrame]:
        """From the top down."""
        return [self.level(n) for n in range(self.top(), -1, -1)]

    def find(self, node_id: int, level: int) -> DataFrame:
        return self.nodes.filter((F.col("node_id") == node_id) & (F.col("level") == level))

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        for name in self.TABLES:
            table = getattr(self, name)
            if table is not None:
                table.write.mode("overwrite").partitionBy("level").parquet(f"{path}/{name}")
        counts = {str(r.level): r.n for r in layer_counts(self.nodes).collect()}
        spark.createDataFrame([(k, str(v)) for k, v in {**self.config, "levels": len(counts), **{f"layer_{k}": v for k, v in counts.items()}}.items()], "key string, value string").write.mode("overwrite").json(f"{path}/build_config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Hierarchy:
        def table(name):
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
                return None
            return spark.read.parquet(f"{path}/{name}").withColumn("level", F.col("level").cast("bigint"))

        config = {r.key: r.value for r in spark.read.schema("key string, value string").json(f"{path}/build_config").collect()}
        return cls(**{n: table(n) for n in cls.TABLES}, config=config)


def layer_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def entry_node(nodes: DataFrame, children: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: the top level's node with the most children, then the most sources, then the least id."""
    top = nodes.agg(F.max("level")).first()[0]
    n = nodes.filter(F.col("level") == top).select("level", "node_id")
    c = children.filter(F.col("level") == top).groupBy(F.col("parent").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"))
    r = refs.filter(F.col("level") == top).groupBy("node_id").agg(F.countDistinct("doc_id").alias("n_refs"))
    return n.join(c, "node_id", "left").join(r, "node_id", "left").na.fill(0, ["n_children", "n_refs"]).orderBy(F.desc("n_children"), F.desc("n_refs"), "node_id").limit(1)


def neighbours(nodes: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """src, dst, similarity, rank: a level's nearest neighbours, as many as its edges or its links take; both read them, so that a level's vectors are compared once."""
    return written(graph.nearest(nodes, "node_id", "embedding", max(top_k, NEIGHBOURS)), "neighbours")


def with_similar(e: DataFrame, nodes: DataFrame, top_k: int = TOP_K, threshold: float = THRESHOLD, beta: float = 1.0, near: DataFrame | None = None) -> DataFrame:
    """src, dst, weight: edges, and beta times the similarity of each node's nearest neighbours at or over the threshold. Two nodes that are
    each among the other's nearest count twice. near: neighbours(nodes, top_k), if they are known."""
    near = graph.nearest(nodes, "node_id", "embedding", top_k, threshold) if near is None else near.filter((F.col("rank") <= top_k) & (F.col("similarity") >= threshold))
    near = near.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (beta * F.col("similarity")).alias("weight"))
    return e.select("src", "dst", "weight").unionByName(near).groupBy("src", "dst").agg(F.round(F.sum("weight"), 6).alias("weight"))


def inner_edges(e: DataFrame, parents: DataFrame, k: int = INNER) -> DataFrame:
    """parent, src, dst, weight, rank: each community's strongest edges. parents: parent, child."""
    a, b = parents.select(F.col("child").alias("src"), "parent"), parents.select(F.col("child").alias("dst"), F.col("parent").alias("p"))
    return R.ranked(e.join(a, "src").join(b, "dst").filter("parent = p").select("parent", "src", "dst", "weight"), ["parent"], [F.desc("weight"), F.col("src"), F.col("dst")], k)


def _joined(rows: DataFrame, by: str, order: str, text, sep: str, name: str) -> DataFrame:
    line = F.struct(F.col(order).alias("o"), text.alias("t"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), sep).alias(name))


def described(level: int, parents: DataFrame, nodes: DataFrame, e: DataFrame, refs: DataFrame, generator: Generator | None = None) -> DataFrame:
    """node_id, name, size, summary of the communities (parent, child): the first members by id, the strongest edges between members, sources."""
    named = R.ranked(parents.join(nodes.select(F.col("node_id").alias("child"), "name"), "child"), ["parent"], [F.col("child")], SHOWN)
    size = parents.groupBy("parent").agg(F.count(F.lit(1)).alias("size"), F.min("child").alias("least"))
    names = _joined(named, "parent", "rank", F.col("name"), ", ", "names")
    theme = _joined(named.filter("rank <= 5"), "parent", "rank", F.col("name"), ", ", "theme")
    s = nodes.select(F.col("node_id").alias("src"), F.col("name").alias("sn"))
    d = nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("dn"))
    lines = inner_edges(e, parents, SHOWN).join(s, "src").join(d, "dst")
    lines = _joined(lines, "parent", "rank", F.concat(F.lit("- "), "sn", F.lit(" -- "), "dn", F.lit(" (weight="), F.format_string("%.3f", "weight"), F.lit(")")), "\n", "lines")
    cited = R.ranked(parents.join(refs.select(F.col("node_id").alias("child"), "doc_id"), "child").select("parent", "doc_id").distinct(), ["parent"], [F.col("doc_id")], 20)
    cited = _joined(cited, "parent", "rank", F.col("doc_id").cast("string"), ", ", "cited")
    j = size.join(names, "parent").join(theme, "parent").join(lines, "parent", "left").join(cited, "parent", "left")
    name = F.format_string(f"l{level}_c%04d_%s", "parent", F.substring(F.sha1(F.col("least").cast("string")), 1, 8))
    rule = F.concat_ws("\n", F.concat(F.lit("Community theme: "), "theme"), F.concat(F.lit("Key entities: "), "names"), F.lit("Key relations:"), F.col("lines"), F.concat(F.lit("Source chunk ids: "), F.coalesce("cited", F.lit("none"))))
    out = j.select(F.col("parent").alias("node_id"), name.alias("name"), "size", rule.alias("rule"))
    better = answered(generator, F.concat(F.lit("Summarize this community from these facts only:\n"), "rule"))
    return out.select("node_id", "name", "size", F.coalesce(F.nullif(better, F.lit("")), F.col("rule")).alias("summary"))


def means(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, embedding: the mean of the children's vectors, place by place (partial sums, so a large community is no task of its own). They are
    added up as whole numbers of billionths, so that no order of the rows changes the result."""
    x = parents.join(nodes.select(F.col("node_id").alias("child"), F.posexplode("embedding").alias("i", "x")), "child")
    m = x.groupBy("parent", "i").agg((F.sum(F.round(F.col("x").cast("double") * 1e9).cast("bigint")) / (F.count(F.lit(1)) * 1e9)).alias("m"))
    return m.groupBy(F.col("parent").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


def build(nodes: DataFrame, e: DataFrame, refs: DataFrame, max_levels: int = 3, min_nodes: int = 5, top_k: int = TOP_K, threshold: float = THRESHOLD, algorithm: str = "label", rounds: int = 2, embedder: Embedder | None = None, generator: Generator | None = None, near: DataFrame | None = None) -> Hierarchy:
    """nodes: node_id, name, embedding (summary if there is one); e: src, dst, weight of level 0, nearest neighbours included; refs: node_id, doc_id; near: neighbours of
    level 0, if they are known. One pass a level, each written: at most max_levels of them."""
    summary = F.col("summary") if "summary" in nodes.columns else F.col("name")
    now = written(nodes.select("node_id", "name", F.lit(1).cast("bigint").alias("size"), summary.alias("summary"), F.col("embedding").cast("array<double>").alias("embedding")), "level-nodes")
    e, refs = written(e.select("src", "dst", "weight"), "level-edges"), written(refs.select("node_id", "doc_id").distinct(), "level-refs")
    leveled = lambda df, n: df.select(F.lit(n).cast("bigint").alias("level"), *df.columns)
    known = {} if near is None else {0: near}
    out = {"nodes": [leveled(now, 0)], "children": [], "edges": [leveled(e, 0)], "refs": [leveled(refs, 0)]}
    for level in range(1, max(1, max_levels)):
        n = now.count()
        if n < max(2, min_nodes):
            break
        labels = graph.detect(now.select(F.col("node_id").alias("node")), e, algorithm, rounds=rounds)
        found = written(graph.communities(labels), "level-communities")
        alone = found.count() == n and n > min_nodes  # nothing was joined: one community of all
        parents = labels.join(found, "label").select(F.lit(1).cast("bigint").alias("parent") if alone else F.col("community").alias("parent"), F.col("node").alias("child"))
        parents = written(parents, "level-children")
        text = described(level, parents, now, e, refs, generator)
        vectors = text.select("node_id", embedder.embed(F.col("summary")).alias("embedding")) if embedder else means(parents, now)
        up = written(text.join(vectors, "node_id").select("node_id", "name", "size", "summary", "embedding"), "level-nodes")
        refs = written(parents.join(refs.withColumnRenamed("node_id", "child"), "child").select(F.col("parent").alias("node_id"), "doc_id").distinct(), "level-refs")
        out["nodes"].append(leveled(up, level))
        out["children"].append(leveled(parents, level))
        out["refs"].append(leveled(refs, level))
        if alone or up.count() == 1:
            break
        known[level] = neighbours(up, top_k)
        e = written(with_similar(graph.roll_up(e, parents), up, top_k, threshold, near=known[level]), "level-edges")
        out["edges"].append(leveled(e, level))
        now = up

    def union(name):
        tables = out[name]
        if not tables:
            return nodes.sparkSession.createDataFrame([], "level bigint, parent bigint, child bigint")
        r = tables[0]
        for t in tables[1:]:
            r = r.unionByName(t)
        return r

    return Hierarchy(*[union(n) for n in ("nodes", "children", "edges", "refs")], config={"algorithm": algorithm, "hierarchy_kind": "hierarchical_attributed_communities"}, near=known)


def linked(h: Hierarchy, m: int = NEIGHBOURS) -> Hierarchy:
    """h with its links: each node's m nearest in its level, and from each node with children to the one nearest to it."""
    intra = None
    for n in range(h.top() + 1):
        near = h.near[n].filter(F.col("rank") <= m) if n in h.near and m <= NEIGHBOURS else graph.nearest(h.level(n), "node_id", "embedding", m)
        near = near.select(F.lit(n).cast("bigint").alias("level"), "src", "dst", "rank")
        intra = near if intra is None else intra.unionByName(near)
    up = h.nodes.select("level", F.col("node_id").alias("parent"), F.col("embedding").alias("pe"))
    low = h.nodes.select((F.col("level") + 1).alias("level"), F.col("node_id").alias("child"), F.col("embedding").alias("ce"))
    j = h.children.join(up, ["level", "parent"]).join(low, ["level", "child"]).select("level", "parent", "child", F.round(V.cosine(F.col("pe"), F.col("ce")), 6).alias("similarity"))
    inter = R.ranked(j, ["level", "parent"], [F.desc("similarity"), F.col("child")], 1).drop("rank")
    return Hierarchy(h.nodes, h.children, h.edges, h.refs, written(intra, "intra-links"), written(inter, "inter-links"), {**h.config, "m_neighbors": str(m)}, h.near)


def search(h: Hierarchy, questions: DataFrame, **how) -> DataFrame:
    from .retrieval import beam_search

    return beam_search(h.levels(), h.children, questions, inter_links=h.inter_links, intra_links=h.intra_links, **how)
