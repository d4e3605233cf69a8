"""Composite retrieval. Questions are rows (qid, question, qvec), chunks are rows (doc_id, source, text, embedding);
results are (qid, doc_id, rank, score, ...).

Scoring all chunks against all questions has no join key. Questions are the small side: they are broadcast
in batches of QUESTIONS at most, checked, and chunks stream past them; only the best of each partition are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, vectors as V
from ..models import Embedder
from ..operators import kg, ranking as R
from ..tables import written
from . import lexical, walk

#: Questions that are broadcast at once.
QUESTIONS = 10_000


def past_questions(chunks: DataFrame, questions: DataFrame, n: int | None = None) -> DataFrame:
    """Each chunk with each question. More than QUESTIONS questions are taken in batches, each with a scan of its own. n: their number, if it is known."""
    n = questions.count() if n is None else n
    batches = max(1, -(-n // QUESTIONS))
    if batches == 1:
        return chunks.crossJoin(F.broadcast(questions))
    numbered = questions.withColumn("_b", F.pmod(F.xxhash64(*[c for c in questions.columns if c in ("qid", "question")] or questions.columns[:1]), F.lit(2 * batches)))
    return reduce(DataFrame.unionByName, [chunks.crossJoin(F.broadcast(numbered.filter(F.col("_b") == i).drop("_b"))) for i in range(2 * batches)])


def vector_search(chunks: DataFrame, questions: DataFrame, k: int, n: int | None = None) -> DataFrame:
    """By squared distance; chunks without a vector aren't found."""
    c = chunks.select("doc_id", "embedding").filter("embedding IS NOT NULL")
    s = past_questions(c, questions.select("qid", "qvec"), n).select("qid", "doc_id", F.round(V.l2_squared(F.col("embedding"), F.col("qvec")), 9).alias("distance"))
    return R.ranked(s, ["qid"], [F.col("distance"), F.col("doc_id")], k, "vector_rank")


def cosine_search(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    c = chunks.select("doc_id", "embedding").filter("embedding IS NOT NULL")
    s = past_questions(c, questions.select("qid", "qvec")).select("qid", "doc_id", F.round(V.cosine(F.col("embedding"), F.col("qvec")), 9).alias("similarity"))
    return R.ranked(s, ["qid"], [F.desc("similarity"), F.col("doc_id")], k, "rank")


def searchable(chunks: DataFrame) -> DataFrame:
    """doc_id, searchable: T.search_text; as it is where an index keeps it."""
    return chunks.select("doc_id", "searchable") if "searchable" in chunks.columns else chunks.select("doc_id", T.search_text(chunks.columns).alias("searchable"))


def keyword_scores(chunks: DataFrame, questions: DataFrame, n: int | None = None) -> DataFrame:
    """qid, doc_id, keyword_score of all chunks that hold an anchor."""
    q = questions.select("qid", T.query_terms(F.col("question")).alias("terms"))
    s = past_questions(searchable(chunks), q, n).filter("exists(terms, t -> t.anchor AND contains(searchable, t.term))")
    return s.select("qid", "doc_id", F.round(T.keyword_score("searchable", "terms"), 9).alias("keyword_score"))


def keyword_search(chunks: DataFrame, questions: DataFrame, k: int, n: int | None = None) -> DataFrame:
    """The best k by keywords; through the index of substrings where the chunks have one (lexical.with_postings), else by a scan of all texts for all questions at once."""
    if lexical.postings_of(chunks) is not None:
        return lexical.search(chunks, questions, k)[0]
    q, n = questions.select("qid", T.query_terms(F.col("question")).alias("terms")), questions.count() if n is None else n
    if n <= QUESTIONS:
        return lexical.scan(searchable(chunks), q, k)
    return R.ranked(keyword_scores(chunks, questions, n), ["qid"], [F.desc("keyword_score"), F.col("doc_id")], k, "keyword_rank")


def hybrid_legs(chunks: DataFrame, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """What hybrid_search fuses for k, by vectors and by keywords; written, to be cut for any smaller k as well."""
    raw, n = R.over_fetch(k), questions.count()
    return written(vector_search(chunks, questions, raw, n), "vector-leg"), written(keyword_search(chunks, questions, raw, n), "keyword-leg")


def hybrid_search(chunks: DataFrame, questions: DataFrame, k: int = 10, legs: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """legs: hybrid_legs for k or more."""
    raw = R.over_fetch(k)
    if legs is None:
        n = questions.count()
        vector, keyword = vector_search(chunks, questions, raw, n), keyword_search(chunks, questions, raw, n)
    else:
        vector, keyword = legs[0].filter(F.col("vector_rank") <= raw), legs[1].filter(F.col("keyword_rank") <= raw)
    return R.fuse(vector, keyword, ["qid", "doc_id"], ("vector_rank", "keyword_rank"), (R.VECTOR_WEIGHT, R.KEYWORD_WEIGHT), k)


def filtered_vector_search(chunks: DataFrame, questions: DataFrame, keep, k: int, fetch_k: int | None = None, prefilter: bool = False) -> DataFrame:
    """keep: a predicate on chunks. As a filter behind the search: the best fetch_k of all, of those the ones that pass, of
    those k. prefilter: search only what passes."""
    if prefilter:
        return vector_search(chunks.filter(keep), questions, k)
    top = vector_search(chunks, questions, fetch_k or max(4 * k, 20)).join(chunks.filter(keep).select("doc_id"), "doc_id", "left_semi")
    return R.ranked(top, ["qid"], [F.col("vector_rank")], k, "rank")


def references_last(hits: DataFrame, chunks: DataFrame, k: int, rank: str = "rank", include: bool = False) -> DataFrame:
    """The first k of each question, lists of references only as a last resort; with include, as they come. hits: qid, doc_id, rank."""
    if include:
        return hits.filter(F.col(rank) <= k).withColumn("kept_rank", F.col(rank))
    flagged = hits.join(chunks.select("doc_id", T.reference_like(F.col("text")).alias("is_reference")), "doc_id")
    return R.soft_filter(flagged, ["qid"], "is_reference", k, rank)


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 10, include_references: bool = False) -> DataFrame:
    """Hybrid search with lists of references only as a last resort."""
    return references_last(hybrid_search(chunks, questions, R.over_fetch(k)), chunks, k, include=include_references)


SEED_HITS, SEED_SOURCES = 8, 5
RELATION_SHARE = 0.6


def seeds_of(hits: DataFrame, chunks: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Seed chunks (qid, doc_id, rank) and the sources of the first five (qid, source)."""
    seeds = hits.filter(F.col("rank") <= max(k, SEED_HITS)).select("qid", "doc_id", "rank")
    return seeds, seeds.filter(F.col("rank") <= SEED_SOURCES).join(chunks.select("doc_id", "source"), "doc_id").filter("source <> ''").select("qid", "source").distinct()


def seed_entities(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """qid, entity_id, weight: 2.5 / sqrt(rank) for each seed chunk that an entity stands in, added up before anything is expanded, so that a hub
    entity's chunks are met once a question, not once a seed."""
    return seeds.join(links, "doc_id").groupBy("qid", "entity_id").agg(F.sum(2.5 / F.sqrt(F.col("rank").cast("double"))).alias("weight"))


def seed_expansion(hits: DataFrame, links: DataFrame, k: int = 10, relation_links: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score: from the first hits over their entities to those entities' chunks, 2.5 / sqrt(rank) a path, and over the entities'
    relations to the relations' chunks, 0.6 of that. links: entity_id, doc_id; relation_links: relation_id, doc_id; relations: with both ends."""
    reached = seed_entities(hits.filter(F.col("rank") <= max(k, SEED_HITS)).select("qid", "doc_id", "rank"), links)
    paths = reached.join(links, "entity_id").select("qid", "doc_id", "weight")
    if relations is not None:
        over = reached.join(kg.relations_by_entity(relations), "entity_id").groupBy("qid", "relation_id").agg(F.sum("weight").alias("weight"))
        paths = paths.unionByName(over.join(relation_links, "relation_id").select("qid", "doc_id", (RELATION_SHARE * F.col("weight")).alias("weight")))
    return paths.groupBy("qid", "doc_id").agg(F.round(F.sum("weight"), 9).alias("score"))


def touching(ref_links: DataFrame, key: str, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """qid, key: what stands in a chunk of a seed source."""
    of = chunks.select("doc_id", "source").join(F.broadcast(sources), "source")
    return ref_links.join(of, "doc_id").select("qid", key).distinct()


def _flagged(rows: DataFrame, touches: DataFrame | None, key: str) -> DataFrame:
    if touches is None:
        return rows.withColumn("touches", F.lit(False))
    return rows.join(touches.withColumn("t", F.lit(True)), ["qid", key], "left").withColumn("touches", F.col("t").isNotNull()).drop("t")


def entity_matches(questions: DataFrame, entities: DataFrame, touches: DataFrame | None = None) -> DataFrame:
    """qid, entity_id, score: 10 and more for the longest name (or alias) of three letters or more that the question holds, the overlap of words, and the
    bonus of a type whose intent the question shows, if the entity matches besides or touches a seed source."""
    names = F.transform(F.concat(F.array("name", "canonical_name"), F.col("aliases")), lambda n: F.lower(T.collapse(n)))
    e = entities.select("entity_id", "type", names.alias("names"), kg.entity_search_text(entities).alias("searchable"))
    q = questions.select("qid", F.lower(T.collapse(F.col("question"))).alias("q"), T.overlap_terms(F.col("question")).alias("terms"))
    named = F.coalesce(F.array_max(F.transform(F.filter("names", lambda n: (F.length(n) >= 3) & F.contains(F.col("q"), n)), lambda n: 10 + F.least(F.length(n), F.lit(80)) / 20)), F.lit(0.0))
    s = past_questions(e, q).select("qid", "entity_id", (named + T.weighted_overlap(F.col("terms"), F.col("searchable"))).alias("direct"), T.entity_type_intent(F.col("type"), F.col("q")).alias("intent")).filter("direct > 0 OR intent > 0")
    s = _flagged(s, touches, "entity_id")
    return s.select("qid", "entity_id", F.round(F.col("direct") + F.when((F.col("direct") > 0) | F.col("touches"), F.col("intent")).otherwise(0.0), 9).alias("score")).filter("score > 0")


def relation_matches(questions: DataFrame, relations: DataFrame, entities: DataFrame, matched: DataFrame, touches: DataFrame | None = None) -> DataFrame:
    """qid, relation_id, score: a quarter of the scores of its ends, the overlap of words, and the predicate's intent, if the relation matches besides or touches a
    seed source. matched: qid, entity_id, score."""
    r = kg.relation_search_text(relations, entities).select("relation_id", "predicate", "searchable")
    q = questions.select("qid", F.lower(T.collapse(F.col("question"))).alias("q"), T.overlap_terms(F.col("question")).alias("terms"))
    own = past_questions(r, q).select("qid", "relation_id", T.weighted_overlap(F.col("terms"), F.col("searchable")).alias("overlap"), T.predicate_intent(F.col("predicate"), F.col("q")).alias("intent")).filter("overlap > 0 OR intent > 0")
    ends = kg.relations_by_entity(relations).join(matched, "entity_id").groupBy("qid", "relation_id").agg((0.25 * F.sum("score")).alias("ends"))
    s = _flagged(own.join(ends, ["qid", "relation_id"], "full_outer").na.fill(0.0, ["overlap", "intent", "ends"]), touches, "relation_id")
    match = F.col("ends") + F.col("overlap")
    return s.select("qid", "relation_id", F.round(match + F.when((match > 0) | F.col("touches"), F.col("intent")).otherwise(0.0), 9).alias("score")).filter("score > 0")


@dataclass
class Graph:
    """entities (entity_id, name, canonical_name, type, description, aliases, observed_types), relations (relation_id, subject_id, predicate, object_id,
    description, evidence), and where they stand: links (entity_id, doc_id), relation_links (relation_id, doc_id)."""

    entities: DataFrame
    relations: DataFrame
    links: DataFrame
    relation_links: DataFrame


def graph_scores(chunks: DataFrame, questions: DataFrame, g: Graph, base: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score: entity matches and relation matches carried to their chunks, plus the seed expansion, added up."""
    _, sources = seeds_of(base, chunks, k)
    sources = written(sources, "seed-sources")
    matched = written(entity_matches(questions, g.entities, touching(g.links, "entity_id", chunks, sources)), "entity-matches")
    related = relation_matches(questions, g.relations, g.entities, matched, touching(g.relation_links, "relation_id", chunks, sources))
    legs = [matched.join(g.links, "entity_id"), related.join(g.relation_links, "relation_id"), seed_expansion(base, g.links, k, g.relation_links, g.relations)]
    return reduce(DataFrame.unionByName, [x.select("qid", "doc_id", "score") for x in legs]).groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


def graph_depth(k: int) -> int:
    """Rows of the hybrid search that graph retrieval of k starts from."""
    return max(8 * k, k + 30)


def graph_search(chunks: DataFrame, questions: DataFrame, g: Graph, k: int = 10, include_references: bool = True, legs: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Hybrid and graph ranks fused; hybrid retrieval alone where the graph is empty. legs: hybrid_legs for graph_depth(k), if they are known."""
    if g.entities.isEmpty() and g.relations.isEmpty():
        return retrieve(chunks, questions, k, include_references)
    raw = graph_depth(k)
    base = written(hybrid_search(chunks, questions, raw, legs), "graph-base")
    scored = written(graph_scores(chunks, questions, g, base, k), "graph-scores")  # a sort by range looks at its rows twice
    ranked = R.ranked_whole(scored, "qid", "score", "doc_id", "graph_rank").join(chunks.select("doc_id"), "doc_id", "left_semi")
    fused = R.fuse(ranked, base.withColumnRenamed("rank", "base_rank"), ["qid", "doc_id"], ("graph_rank", "base_rank"), (R.GRAPH_WEIGHT, R.BASE_WEIGHT), k if include_references else raw)
    return references_last(fused, chunks, k, include=include_references)


def community_hits(questions: DataFrame, index: DataFrame, embedder: Embedder, k: int) -> DataFrame:
    """qid, community_id, c_rank: the communities whose summaries are nearest to the question, by squared distance. index: community_id, embedding."""
    q = questions.select("qid", embedder.embed(F.col("question")).alias("qvec"))
    s = past_questions(index.select("community_id", "embedding"), q).select("qid", "community_id", F.round(V.l2_squared(F.col("embedding"), F.col("qvec")), 9).alias("distance"))
    return R.ranked(s, ["qid"], [F.col("distance"), F.col("community_id")], k, "c_rank")


def community_scores(found: DataFrame, refs: DataFrame) -> DataFrame:
    """qid, doc_id, score, community_rank, community_id: found (qid, community_id, c_rank), refs (community_id, doc_id, ref_rank)."""
    part = 1.0 / (60 + F.col("c_rank")) / (1 + 0.04 * F.greatest(F.col("ref_rank") - 1, F.lit(0)))
    j = found.join(refs, "community_id")
    return j.groupBy("qid", "doc_id").agg(F.round(F.sum(part), 9).alias("score"), F.min("c_rank").alias("community_rank"), F.min_by("community_id", "c_rank").alias("community_id"))


def community_search(base: DataFrame, found: DataFrame, refs: DataFrame, k: int = 10) -> DataFrame:
    """Chunk ranks fused with the scores that communities lend: 1/(60+rank) + 2 * score."""
    c = community_scores(found, refs).select("qid", "doc_id", F.col("score").alias("c_score"), "community_rank", "community_id")
    b = base.select("qid", "doc_id", F.col("rank").alias("chunk_rank"))
    j = b.join(c, ["qid", "doc_id"], "full_outer").withColumn("score", F.round(R.rrf(F.col("chunk_rank"), R.CHUNK_WEIGHT) + R.COMMUNITY_WEIGHT * F.coalesce("c_score", F.lit(0.0)), 9)).drop("c_score")
    return R.ranked(j, ["qid"], [F.desc("score"), F.asc_nulls_last("community_rank"), F.asc_nulls_last("chunk_rank"), F.col("doc_id")], k)


def community_augmented(chunks: DataFrame, questions: DataFrame, g: Graph, index: DataFrame, refs: DataFrame, embedder: Embedder, k: int = 10, community_k: int = 3, include_references: bool = False) -> DataFrame:
    """Graph retrieval fused with what the nearest communities cite. refs: community_id, doc_id, ref_rank."""
    raw = max(5 * k, k + 30)
    base = graph_search(chunks, questions, g, raw, include_references).withColumn("rank", F.col("kept_rank"))
    found = community_hits(questions, index, embedder, community_k)
    fused = community_search(base, found, refs.join(chunks.select("doc_id"), "doc_id", "left_semi"), k if include_references else 2 * raw)
    return references_last(fused, chunks, k, include=include_references)


def with_communities(selected: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """selected (qid, doc_id, kept_rank) cut to make room for communities: as many as a quarter of k, one at least and two at most, at the end.
    qid, place, kind (chunk or community), doc_id, community_id."""
    room = max(1, min(2, k // 4))
    c = found.filter(F.col("c_rank") <= room)
    n = c.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    kept = selected.join(n, "qid", "left").filter(F.col("kept_rank") <= k - F.coalesce("n", F.lit(0)))
    kept = kept.select("qid", F.lit(0).alias("part"), F.col("kept_rank").alias("r"), F.lit("chunk").alias("kind"), "doc_id", F.lit(None).cast("string").alias("community_id"))
    both = kept.unionByName(c.select("qid", F.lit(1).alias("part"), F.col("c_rank").alias("r"), F.lit("community").alias("kind"), F.lit(None).cast("bigint").alias("doc_id"), "community_id"))
    return R.ranked(both, ["qid"], [F.col("part"), F.col("r")], k, "place").select("qid", "place", "kind", "doc_id", "community_id")


PAPER_WEIGHTS = {"hybrid": 1.0, "community": 1.2, "graph": 1.0}


def paper_votes(hits: DataFrame, k: int) -> DataFrame:
    """hits: qid, signal, source, rank -> qid, source, score, signals, rank: a paper's first rank in each signal votes."""
    first = hits.groupBy("qid", "signal", "source").agg(F.min("rank").alias("r"))
    weight = F.create_map(*[F.lit(x) for kv in PAPER_WEIGHTS.items() for x in kv])[F.col("signal")]
    votes = first.withColumn("v", weight / (60 + F.col("r")))
    out = votes.groupBy("qid", "source").agg(F.round(F.sum("v"), 9).alias("score"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "signal", F.ceil("r").cast("string")))), ",").alias("signals"))
    return R.ranked(out, ["qid"], [F.desc("score"), F.lower("source"), F.col("source")], k)


def candidate_papers(chunks: DataFrame, questions: DataFrame, k: int = 5, g: Graph | None = None, index: DataFrame | None = None, refs: DataFrame | None = None, embedder: Embedder | None = None, community_k: int = 3) -> DataFrame:
    """Votes of hybrid search, and of graph retrieval and communities where there are any. A community's vote counts a tenth of a rank less for each of its
    sources after the first."""
    raw = max(8 * k, k + 20)
    src = chunks.select("doc_id", "source").filter("source <> ''")
    both = hybrid_legs(chunks, questions, raw if g is None else graph_depth(raw))  # texts and vectors are read once for both signals
    legs = [hybrid_search(chunks, questions, raw, both).select("qid", "doc_id", "rank", F.lit("hybrid").alias("signal"))]
    if g is not None:
        legs.append(graph_search(chunks, questions, g, raw, legs=both).select("qid", "doc_id", "rank", F.lit("graph").alias("signal")))
    votes = reduce(DataFrame.unionByName, legs).join(src, "doc_id").select("qid", "signal", "source", F.col("rank").cast("double").alias("rank"))
    if index is not None:
        cited = refs.join(src, "doc_id").groupBy("community_id", "source").agg(F.min("ref_rank").alias("f"))
        cited = R.ranked(cited, ["community_id"], [F.col("f"), F.col("source")], None, "s_rank")
        found = community_hits(questions, index, embedder, max(community_k, k))
        # As the communities come: a paper's first community votes.
        first = R.ranked(found.join(cited, "community_id"), ["qid", "source"], [F.col("c_rank")], 1, "one")
        votes = votes.unionByName(first.select("qid", F.lit("community").alias("signal"), "source", F.round(F.col("c_rank") + 0.1 * (F.col("s_rank") - 1), 1).alias("rank")))
    return paper_votes(votes, k)


def in_paper(scored: DataFrame, papers: DataFrame, per_paper: int) -> DataFrame:
    """scored: qid, doc_id, source, score; the best per_paper chunks of each candidate paper."""
    j = scored.join(papers.select("qid", "source", F.col("score").alias("paper_score"), F.col("rank").alias("paper_rank")), ["qid", "source"])
    return R.ranked(j, ["qid", "source"], [F.desc("score"), F.col("doc_id")], per_paper, "in_paper_rank")


def in_papers(chunks: DataFrame, questions: DataFrame, papers: DataFrame, per_paper: int) -> DataFrame:
    """qid, source, doc_id, score, paper_score, paper_rank, in_paper_rank: within each candidate paper, vector and keyword ranks fused. Only chunks of a
    question's candidates are scored: papers are joined before any text is looked at."""
    wanted = papers.select("qid", "source", F.round("score", 6).alias("paper_score"), F.col("rank").alias("paper_rank")).join(questions, "qid")
    by = ["qid", "source"]
    c = chunks.filter("embedding IS NOT NULL").select("doc_id", "source", "embedding").join(F.broadcast(wanted.select(*by, "qvec")), "source")  # a few papers each question
    v = c.select(*by, "doc_id", F.round(V.l2_squared(F.col("embedding"), F.col("qvec")), 9).alias("distance"))
    v = R.ranked(v, by, [F.col("distance"), F.col("doc_id")], R.over_fetch(per_paper), "vector_rank")
    low = F.col("searchable") if "searchable" in chunks.columns else T.search_text(chunks.columns)
    asking = wanted.groupBy("source").agg(F.array_distinct(F.collect_list("qid")).alias("qids"))
    texts = chunks.select("doc_id", "source", low.alias("searchable")).join(F.broadcast(asking), "source")
    w = lexical.scores(texts, questions.join(papers.select("qid"), "qid", "left_semi").select("qid", T.query_terms(F.col("question")).alias("terms")))
    w = R.ranked(w, by, [F.desc("keyword_score"), F.col("doc_id")], R.over_fetch(per_paper), "keyword_rank")
    both = v.select(*by, "doc_id", "vector_rank").join(w.select(*by, "doc_id", "keyword_rank"), [*by, "doc_id"], "full_outer")
    both = both.withColumn("score", F.round(R.rrf(F.col("vector_rank"), R.VECTOR_WEIGHT) + R.rrf(F.col("keyword_rank"), R.KEYWORD_WEIGHT), 9))
    top = R.ranked(both, by, [F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), F.col("doc_id")], per_paper, "in_paper_rank")
    return top.join(wanted.select("qid", "source", "paper_score", "paper_rank"), by).select("qid", "source", "doc_id", "score", "paper_score", "paper_rank", "in_paper_rank")


def gated_features(cands: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """cands with keyword, section and is_reference, read from the question and from the chunk's text, section title and type."""
    q = questions.select("qid", T.gated_terms(F.col("question")).alias("terms"))
    c = chunks.select("doc_id", "text", "section_title", "section_type")
    j = cands.join(c, "doc_id").join(F.broadcast(q), "qid")
    searchable = F.lower(T.collapse(F.concat_ws(" ", "source", "section_title", "section_type", "text")))
    return j.withColumn("keyword", T.keyword_overlap(F.col("terms"), searchable)).withColumn("section", T.section_match(F.col("terms"), F.col("section_title"), F.col("section_type"))).withColumn("is_reference", T.reference_like(F.col("text"))).drop("text", "terms", "section_title", "section_type")


def gated_rerank(cands: DataFrame, k: int, include_references: bool = True) -> DataFrame:
    """cands: qid, doc_id, relevance, keyword, paper_score, section, is_reference, rank. Relevance and paper scores are divided by their maximum for the question;
    equal scores put the later candidate first. Without references, those come last."""
    from pyspark.sql import Window

    w = Window.partitionBy("qid")
    share = lambda c: F.when(F.max(c).over(w) > 0, F.least(F.greatest(F.col(c) / F.max(c).over(w), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    s = cands.withColumn("final", F.round(0.5 * share("relevance") + 0.25 * F.col("keyword") + 0.15 * share("paper_score") + 0.05 * F.col("section") - 0.1 * F.col("is_reference").cast("double"), 9))
    last = [] if include_references else [F.col("is_reference")]
    return R.ranked(s.withColumnRenamed("rank", "candidate_rank"), ["qid"], [*last, F.desc("final"), F.desc("candidate_rank"), F.col("doc_id")], k)


def gated_search(chunks: DataFrame, questions: DataFrame, k: int = 10, papers: int = 5, per_paper: int = 4, g: Graph | None = None, index: DataFrame | None = None, refs: DataFrame | None = None, embedder: Embedder | None = None, include_references: bool = False) -> DataFrame:
    """Candidate papers, the best chunks in each, one rerank of all of them."""
    found = candidate_papers(chunks, questions, papers, g, index, refs, embedder)
    cands = in_papers(chunks, questions, found, 3 * per_paper)
    cands = R.ranked(cands, ["qid"], [F.col("paper_rank"), F.col("in_paper_rank")], max(papers * per_paper * 5, 50), "rank").withColumnRenamed("score", "relevance")
    return gated_rerank(gated_features(cands, chunks, questions), k, include_references)


LOCAL, ROUTE = 0.85, 0.15
#: Weights of meaning, hierarchy and keywords by kind of question. Fixed values.
POLICY = {"fact": (0.45, 0.20, 0.35), "multi-hop": (0.45, 0.40, 0.15), "abstract": (0.65, 0.25, 0.10), "procedural": (0.45, 0.45, 0.10)}
#: The beam: 2 for facts, 5 for procedures; 4 and 6 for multi-hop and abstract questions, and one more at each level down.
PER_NODE, PER_PAPER = 3, 6


def beam_width(kind: Column, depth: int) -> Column:
    return F.when(kind == "multi-hop", 4 + depth).when(kind == "abstract", 6 + depth).when(kind == "procedural", 5).otherwise(2)


def beam_search(levels: list[DataFrame], children: DataFrame, questions: DataFrame, beam: int | None = 3, top_k: int = 5, max_levels: int | None = None, inter_links: DataFrame | None = None, intra_links: DataFrame | None = None) -> DataFrame:
    """levels: from the top down, (node_id, embedding); children: (parent, child); inter_links too: a node's best child, met besides. qid, level, node_id, local,
    route, rank of each level's first max(top_k, beam). Levels below the top only look at children of the beam; a question without any there
    walks the level's intra_links (level, src, dst) from the child linked to the best of the beam (walk.layer_search), or, without these links, looks at the whole
    level, exactly. beam None: by the question's kind. max_levels keeps the top ones."""
    q = questions.select("qid", "qvec", T.query_kind(F.col("question")).alias("kind")) if beam is None else questions.select("qid", "qvec", F.lit("").alias("kind"))
    keys = [c for c in ("level", "parent", "child") if c in children.columns]
    if inter_links is not None:
        children = children.select(*keys).unionByName(inter_links.select(*keys)).distinct()
    out, parents = None, None
    for depth, nodes in enumerate(levels[:max_levels] if max_levels else levels):
        level = len(levels) - 1 - depth
        width = beam_width(F.col("kind"), depth) if beam is None else F.lit(beam)
        if parents is None:
            met = past_questions(nodes, q).withColumn("parent_route", F.lit(None).cast("double"))
        else:
            below = children.filter(F.col("level") == level + 1) if "level" in keys else children
            reach = parents.join(below, F.col("node_id") == F.col("parent")).groupBy("qid", "child").agg(F.max("route").alias("parent_route"))
            met = reach.join(nodes, F.col("child") == F.col("node_id")).join(F.broadcast(q), "qid").select("qid", "node_id", "embedding", "qvec", "kind", "parent_route")
            lost = q.join(met.select("qid").distinct(), "qid", "left_anti")
            if intra_links is not None and inter_links is not None and not (lost := written(lost, "lost")).isEmpty():
                begin = parents.join(inter_links.filter(F.col("level") == level + 1), F.col("node_id") == F.col("parent")).groupBy("qid").agg(F.max_by("child", F.struct("route", -F.col("parent"))).alias("node_id"))
                walked = walk.layer_search(nodes, intra_links.filter(F.col("level") == level), lost, begin, max(top_k, 6 + depth if beam is None else beam), nodes.orderBy("node_id").limit(1))
                lost_nodes = walked.select("qid", "node_id").join(nodes, "node_id").join(lost, "qid")
            else:
                lost_nodes = past_questions(nodes, lost)
            met = met.unionByName(lost_nodes.select("qid", "node_id", "embedding", "qvec", "kind", F.lit(None).cast("double").alias("parent_route")))
        s = met.withColumn("local", F.round(V.cosine(F.col("embedding"), F.col("qvec")), 6))
        s = s.withColumn("route", F.round(F.when(F.col("parent_route").isNull(), F.col("local")).otherwise(LOCAL * F.col("local") + ROUTE * F.col("parent_route")), 6))
        most = max(top_k, 6 + depth if beam is None else beam)  # of any kind
        s = R.ranked(s, ["qid"], [F.desc("route"), F.col("node_id")], most).filter(F.col("rank") <= F.greatest(F.lit(top_k), width))
        s = written(s.select("qid", F.lit(level).cast("bigint").alias("level"), "node_id", "local", "route", "rank", width.alias("width")), "beam-level")
        out = s if out is None else out.unionByName(s)
        parents = s.filter(F.col("rank") <= F.col("width")).select("qid", "node_id", "route")
    return out.drop("width")


def for_quotas(cands: DataFrame, limit: int, per_node: int, per_paper: int, order: list[Column] | None = None) -> DataFrame:
    """The rows that a greedy choice of limit can take, of any number of candidates (qid, node, paper, in order of pos or as told): of a node and paper together the first
    that fit the tighter quota; of a node as many as its quota and those that full papers (limit / per_paper at most) may shut out;
    and the first rows of all for the filling up. What goes would be passed over or never be reached. Every window has a limit, so no task sorts all candidates."""
    order, least = order or [F.col("pos")], min(per_node, per_paper)
    first = R.ranked(cands, ["qid"], order, 2 * limit, "_n")
    pair = R.ranked(cands, ["qid", "node", "paper"], order, least, "_n").drop("_n")
    node = R.ranked(pair, ["qid", "node"], order, per_node + least * (limit // per_paper), "_n")
    return first.unionByName(node).drop("_n").distinct()


def rerank_candidates(found: DataFrame, refs: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, doc_id, source, node_id, node_level, node_score, similarity, keyword, kind: the chunks that found nodes (qid, level, node_id, route) cite.
    refs: level, node_id, doc_id. Only cited chunks are compared with the question."""
    cited = found.select("qid", "level", "node_id", F.col("route").alias("node_score")).join(refs, ["level", "node_id"]).withColumnRenamed("level", "node_level")
    best = R.ranked(cited, ["qid", "doc_id"], [F.desc("node_score"), F.desc("node_level"), F.col("node_id")], 1, "one").drop("one")
    q = questions.select("qid", "qvec", T.query_kind(F.col("question")).alias("kind"), T.rerank_terms(F.col("question")).alias("terms"))
    j = best.join(chunks.select("doc_id", "source", "text", "embedding"), "doc_id").join(F.broadcast(q), "qid")
    return j.select("qid", "doc_id", "source", "node_id", "node_level", "node_score", F.round(V.cosine(F.col("embedding"), F.col("qvec")), 9).alias("similarity"), F.round(T.keyword_relevance(F.col("terms"), T.collapse(F.col("text"))), 9).alias("keyword"), "kind")


def hierarchy_rerank(cands: DataFrame, k: int, weights: tuple[float, float, float] | None = None, per_node: int = PER_NODE, per_paper: int = PER_PAPER) -> DataFrame:
    """A weighted sum of meaning, hierarchy and keywords (by the question's kind, unless weights are given), then k rows under the quotas of nodes and papers. cands: as from
    rerank_candidates. qid, doc_id, source, node_id, score, rank."""
    of = lambda i: F.lit(weights[i]) if weights else F.element_at(F.create_map(*[F.lit(x) for kind, w in POLICY.items() for x in (kind, w[i])]), F.col("kind"))
    s = cands.withColumn("score", F.round(of(0) * V.unit_interval(F.col("similarity")) + of(1) * V.unit_interval(F.col("node_score")) + of(2) * F.col("keyword"), 6))
    order = [F.desc("score"), F.col("paper"), F.col("doc_id")]
    s = s.select("qid", F.col("node_id").cast("string").alias("node"), F.col("source").alias("paper"), "doc_id", "score")
    few = written(R.ranked(for_quotas(s, k, per_node, per_paper, order), ["qid"], order, None, "pos"), "quota-candidates")
    chosen = R.quota_select(few.select("qid", "pos", "node", "paper"), "qid", k, per_node, per_paper)
    return chosen.select("qid", "pos", "rank").join(few, ["qid", "pos"]).select("qid", "doc_id", F.col("paper").alias("source"), F.col("node").alias("node_id"), "score", "rank")


def level_documents(found: DataFrame, refs: DataFrame, limit: int) -> DataFrame:
    """qid, doc_id, node_id, score, rank: what found nodes cite, by the node's score; each chunk once, under its first node."""
    cited = found.select("qid", "level", "node_id", F.col("route").alias("score")).join(refs, ["level", "node_id"])
    first = R.ranked(cited, ["qid", "doc_id"], [F.desc("score"), F.col("node_id")], 1, "one").drop("one")
    return R.ranked(first, ["qid"], [F.desc("score"), F.col("node_id"), F.col("doc_id")], limit).select("qid", "doc_id", "node_id", "score", "rank")


def retrieval_paths(found: DataFrame, children: DataFrame) -> DataFrame:
    """qid, place, level, node_id, parents: found nodes from the top level down, each with the found nodes that led to it."""
    on = ["level", "parent"] if "level" in children.columns else ["parent"]
    up = found.select("qid", "level", F.col("node_id").alias("parent")).join(children, on).select("qid", (F.col("level") - 1).alias("level"), F.col("child").alias("node_id"), "parent")
    parents = up.groupBy("qid", "level", "node_id").agg(F.array_sort(F.collect_set("parent")).alias("parents"))  # as many as a level's results
    j = found.join(parents, ["qid", "level", "node_id"], "left")
    return R.ranked(j, ["qid"], [F.desc("level"), F.col("rank")], None, "place").select("qid", "place", "level", "node_id", "local", "route", F.coalesce("parents", F.array().cast("array<" + found.schema["node_id"].dataType.simpleString() + ">")).alias("parents"))
