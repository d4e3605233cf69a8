"""One object for a collection: its index, graph, communities, hierarchy and conversations under one folder, and questions to them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as T
from .models import Embedder, Extractor, Generator, HashEmbedder, answered
from .operators import chunking, kg, metrics
from .plans import answers as A, communities as C, hierarchy as H, retrieval as P
from .settings import Settings
from .sources import io
from .tables import written

HISTORY = 8


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, embedder: Embedder | None = None, generator: Generator | None = None, extractor: Extractor | None = None):
        self.spark, self.settings = spark, settings or Settings.from_env()
        self.embedder = embedder or HashEmbedder(self.settings.embedding_size)
        self.generator, self.extractor = generator, extractor or kg.PatternExtractor()

    def path(self, name: str) -> str:
        return f"{self.settings.root}/{name}"

    # Building ---------------------------------------------------------------------------------------------------------
    def chunks_of(self, pages: DataFrame) -> DataFrame:
        """Pages (source, source_path, paper_id, page, text) cut and embedded."""
        w = chunking.fixed_windows(pages, ["source", "source_path", "paper_id", "page"], size=self.settings.chunk_size, overlap=self.settings.chunk_overlap).withColumnRenamed("chunk", "text")
        w = w.withColumn("stable_chunk_id", T.stable_chunk_id(F.col("source"), F.col("page"), F.col("start_index"), F.col("text")))
        return w.withColumn("embedding", self.embedder.embed(F.col("text")))

    def build_index(self, pages: DataFrame, force: bool = False) -> int:
        """Numbers of chunks; an index that is there stays unless forced."""
        if force or not io.exists(self.spark, self.path("chunks")):
            c = chunking.with_sections(chunking.numbered(self.chunks_of(pages), ["source", "page", "start_index"]))
            io.build_index(c, self.path("chunks"), force)
        return self.spark.read.parquet(self.path("chunks")).count()

    def append(self, pages: DataFrame) -> DataFrame:
        have = io.load_index(self.spark, self.path("chunks"))
        c = self.chunks_of(pages)
        fresh = chunking.with_sections(c.withColumn("chunk_id", F.col("start_index")))  # sections by the order in a source
        return io.append_index(self.spark, self.path("chunks"), fresh.select(*[x for x in have.columns if x != "chunk_id"]))

    def chunks(self) -> DataFrame:
        return io.load_index(self.spark, self.path("chunks")).withColumnRenamed("chunk_id", "doc_id")

    def build_graph(self) -> P.Graph:
        """Extraction of chunks that have no record with the same text yet, then the merge of all records."""
        cache, c = self.path("records"), self.chunks()
        keyed = c.select(F.col("doc_id").cast("string").alias("chunk_key"), F.substring(F.sha1(T.collapse(F.col("text"))), 1, 16).alias("text_hash"), "text")
        if io.exists(self.spark, cache):
            keyed = kg.to_extract(keyed, self.spark.read.parquet(cache))
        self.extractor.records(keyed, "chunk_key", "text").withColumn("at", F.current_timestamp()).write.mode("append").parquet(cache)
        r = written(kg.last_records(self.spark.read.parquet(cache), "chunk_key", "at"), "records")
        ent, rel = kg.entities_of(r), kg.relations_of(r)
        keys = written(kg.entity_keys(ent), "entity-keys")
        local = kg.local_names(ent, keys)
        e = kg.merged_entities(ent, keys)
        e = written(e.withColumn("embedding", self.embedder.embed(kg.entity_text(e))), "entities")
        doc = lambda links, key: links.select(key, F.col("chunk_key").cast("bigint").alias("doc_id")).distinct()
        g = P.Graph(e, kg.merged_relations(rel, e, local), doc(kg.links(ent, keys), "entity_id"), doc(kg.relation_links(rel, e, local), "relation_id"))
        io.save_graph(g, self.path("graph"))
        io.write_manifest(self.spark, self.path("graph/manifest"), {"entities": e, "relations": g.relations}, r.filter("status <> 'ok'"))
        return self.graph()

    def graph(self) -> P.Graph | None:
        return io.load_graph(self.spark, self.path("graph")) if io.graph_available(self.spark, self.path("graph")) else None

    def build_communities(self) -> int:
        g = self.graph() or self.build_graph()
        c = C.build(g.entities, g.relations, g.links, g.relation_links, self.settings.algorithm, generator=self.generator, embedder=self.embedder)
        io.write_community_index(c["index"], c["key_entities"], c["sources"], self.path("communities"))
        c["sources"].write.mode("overwrite").parquet(self.path("community_sources"))
        return self.spark.read.parquet(self.path("communities")).count()

    def build_hierarchy(self, max_levels: int = 3) -> H.Hierarchy:
        """Entities numbered, joined to communities level by level, linked and saved."""
        g = self.graph() or self.build_graph()
        n = written(chunking.numbered(g.entities.select("entity_id", "name", "description", "embedding"), ["entity_id"], name="node_id"), "nodes")
        ids = n.select("entity_id", "node_id")
        e = C.entity_edges(g.entities, g.relations, 1.0, 1.0)
        e = e.join(ids.select(F.col("entity_id").alias("src"), F.col("node_id").alias("a")), "src").join(ids.select(F.col("entity_id").alias("dst"), F.col("node_id").alias("b")), "dst")
        e = e.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight")
        refs = g.links.join(ids, "entity_id").select("node_id", "doc_id")
        nodes = n.select("node_id", "name", F.col("description").alias("summary"), "embedding")
        h = H.linked(H.build(nodes, H.with_similar(e, nodes), refs, max_levels, algorithm=self.settings.algorithm, embedder=self.embedder, generator=self.generator))
        h.save(self.path("hierarchy"))
        return h

    def build_all(self, pages: DataFrame, force: bool = False) -> None:
        """Index, graph, communities, hierarchy, in order."""
        self.build_index(pages, force)
        self.build_graph()
        self.build_communities()
        self.build_hierarchy()

    # Asking -----------------------------------------------------------------------------------------------------------
    def questions(self, rows: list[tuple[int, str]]) -> DataFrame:
        q = self.spark.createDataFrame(rows, "qid bigint, question string").withColumn("question", T.normalised(F.col("question")))
        return q.withColumn("qvec", self.embedder.embed(F.col("question")))

    def search(self, questions: DataFrame, mode: str | None = None, k: int | None = None, include_references: bool = False) -> DataFrame:
        """qid, doc_id, score, rank by any spelling of a mode. Modes that need a graph, communities or a hierarchy do without where there is none."""
        mode, k = T.retrieval_mode(mode or self.settings.mode), k or self.settings.k
        c, g = self.chunks(), self.graph()
        if mode == "archrag":
            h = self.hierarchy()
            return P.hierarchy_rerank(P.rerank_candidates(self.found(h, questions), h.refs, c, questions), k).select("qid", "doc_id", "score", "rank")
        index = refs = None
        if io.exists(self.spark, self.path("communities")):
            index, refs = self.spark.read.parquet(self.path("communities")), self.spark.read.parquet(self.path("community_sources"))
        if mode == "archrag-gated":
            return P.gated_search(c, questions, k, g=g, index=index, refs=refs, embedder=self.embedder, include_references=include_references).select("qid", "doc_id", F.col("final").alias("score"), "rank")
        if mode == "archrag-lite" and g is not None and index is not None:
            out = P.community_augmented(c, questions, g, index, refs, self.embedder, k, include_references=include_references)
        elif mode in ("graph", "archrag-lite") and g is not None:
            out = P.graph_search(c, questions, g, k, include_references)
        else:
            out = P.retrieve(c, questions, k, include_references)
        return out.select("qid", "doc_id", "score", F.col("kept_rank").alias("rank"))

    def hierarchy(self) -> H.Hierarchy:
        return H.Hierarchy.load(self.spark, self.path("hierarchy")) if io.exists(self.spark, self.path("hierarchy")) else self.build_hierarchy()

    def found(self, h: H.Hierarchy, questions: DataFrame) -> DataFrame:
        return written(H.search(h, questions, beam=None), "found")

    def rewritten(self, question: str, session: str | None = None) -> tuple[str, str]:
        """The question by itself, and the text that the hierarchy is searched by (with its entities, keywords and sub-questions): from a model that has seen the
        last messages, or by rule."""
        both = lambda q: tuple(q.select("r.standalone_query", T.retrieval_query(F.col("r"))).first())
        q = self.spark.createDataFrame([(question,)], "question string")
        if self.generator is None:
            return both(q.select(T.rewritten(F.col("question")).alias("r")))
        prompt = F.concat(F.lit(f"Rewrite the question as JSON with standalone_query, entities, keywords, sub_questions, query_type.\nConversation:\n{self.history_text(session)}\nQuestion: "), "question")
        parsed = F.from_json(T.json_object(answered(self.generator, prompt)), "standalone_query string, entities array<string>, keywords array<string>, sub_questions array<string>, query_type string")
        r = q.select("question", F.coalesce(parsed, F.from_json(F.lit("{}"), "standalone_query string, entities array<string>, keywords array<string>, sub_questions array<string>, query_type string")).alias("p"))
        return both(r.select(T.rewritten(F.col("question"), F.col("p")).alias("r")))

    def ask(self, question: str, mode: str | None = None, k: int | None = None, session: str | None = None) -> dict:
        """answer, sources (rows) and mode; both messages go to the session's history."""
        if not question.strip():
            raise ValueError("a question must not be empty")
        standalone, sought = self.rewritten(question, session)
        q = self.questions([(1, standalone)])
        texts = self.chunks().select("doc_id", "source", "page", "text")
        if T.retrieval_mode(mode or self.settings.mode) == "archrag":  # the answer is merged from what each level says
            h = self.hierarchy()
            q = q.withColumn("qvec", self.embedder.embed(F.lit(sought)))
            found = self.found(h, q)
            hits = written(P.hierarchy_rerank(P.rerank_candidates(found, h.refs, self.chunks(), q), k or self.settings.k), "hits")
            sources = written(A.source_rows(hits, texts, chars=A.SOURCE_CHARS), "sources")
            answer = A.merged(q, A.points(found, h.nodes), sources, self.generator).select(T.with_citations(F.col("answer"), F.array(*[F.lit(r.id) for r in sources.orderBy("rank").collect()]).cast("array<string>")).alias("answer")).first().answer
        else:
            hits = written(self.search(q, mode, k), "hits")
            sources = written(A.source_rows(hits, texts), "sources")
            answer = A.cited_answers(q, sources, self.generator).first().answer
        if session:
            self.remember(session, [("user", question), ("assistant", answer)])
        return {"question": question, "standalone_question": standalone, "mode": T.retrieval_mode(mode or self.settings.mode), "answer": answer, "sources": [r.asDict() for r in sources.orderBy("rank").collect()]}

    def evaluate(self, dataset: DataFrame, k: int | None = None, mode: str | None = None) -> DataFrame:
        """io.read_dataset's rows with metrics of papers and of evidence; run_summary's means come from them."""
        d = written(chunking.numbered(dataset, ["id"], name="qid"), "dataset")
        q = d.select("qid", F.col("query").alias("question")).withColumn("qvec", self.embedder.embed(F.col("question")))
        c = self.chunks().select("doc_id", "source", "page", "text", "stable_chunk_id")
        rows = written(self.search(q, mode, k).join(c, "doc_id"), "retrieved")
        papers = d.select("qid", F.explode("target_papers").alias("p")).select("qid", T.path_stem(F.col("p")).alias("item"))
        by_paper = metrics.question_metrics(d, rows.select("qid", T.path_stem(F.col("source")).alias("item"), "rank"), papers)
        e = d.select("qid", F.posexplode("evidence").alias("evidence_id", "e"))
        evidence = e.select("qid", F.concat_ws("|", "e.source", "e.page", "e.chunk_id").alias("evidence_id"), "e.stable_chunk_id", "e.source", F.col("e.page").cast("int").alias("page"), F.coalesce("e.must_include_terms", F.array().cast("array<string>")).alias("terms"))
        met = metrics.evidence_matches(rows.select("qid", "rank", "stable_chunk_id", "source", "page", "text"), evidence)
        by_evidence = metrics.question_metrics(d, met.select("qid", F.col("evidence_id").alias("item"), F.col("first_rank").alias("rank")), evidence.select("qid", F.col("evidence_id").alias("item")))
        paper = by_paper.select("qid", F.col("hit").alias("target_paper_hit"), F.col("all_hit").alias("all_target_papers_hit"), F.col("recall").alias("target_paper_recall"), F.col("mrr").alias("mrr_target_paper"), F.col("first_rank").alias("first_target_paper_rank"))
        ev = by_evidence.select("qid", F.col("hit").alias("evidence_hit"), F.col("recall").alias("evidence_recall"), F.col("mrr").alias("mrr_evidence"), F.col("first_rank").alias("first_evidence_rank"))
        seen = rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col("rank").cast("string"), F.lit(":"), "source", F.lit("#p"), F.col("page").cast("string")).alias("s")))), lambda x: x["s"]), " | ").alias("retrieved_sources"))
        return d.join(paper, "qid").join(ev, "qid").join(seen, "qid", "left")

    # Conversations ----------------------------------------------------------------------------------------------------
    def remember(self, session: str, said: list[tuple[str, str]]) -> None:
        path = self.path("messages")
        top = io.read_messages(self.spark, path).agg(F.max("id")).first()[0] if io.exists(self.spark, path) else None
        rows = [(session, (top or 0) + i + 1, json.dumps({"role": r, "content": t}, ensure_ascii=False)) for i, (r, t) in enumerate(said)]
        io.append_messages(self.spark.createDataFrame(rows, "session_id string, id bigint, message_json string").withColumn("created_at", F.current_timestamp()), path)

    def history_text(self, session: str | None) -> str:
        path = self.path("messages")
        if not session or not io.exists(self.spark, path):
            return ""
        m = io.read_messages(self.spark, path).filter(F.col("session_id") == session)
        rows = io.last_messages(m, "session_id", "id", HISTORY).orderBy("id").collect()
        return "\n".join(f"{d['role']}: {d['content'][:1200]}" for d in (json.loads(r.message_json) for r in rows))

    def clear_history(self, session: str) -> None:
        if io.exists(self.spark, self.path("messages")):
            io.clear_session(self.spark, self.path("messages"), session)

    def status(self) -> dict[str, bool]:
        ready = {name: io.exists(self.spark, self.path(name)) for name in ("chunks", "communities", "hierarchy", "messages")}
        return ready | {"graph": io.graph_available(self.spark, self.path("graph"))}
