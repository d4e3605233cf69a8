"""From found nodes and chunks to cited answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..models import Generator, answered
from ..operators import ranking as R

LEAST_SCORE, MOST_POINTS, MOST_SOURCES, POINT_CHARS, SNIPPET_CHARS, SOURCE_CHARS = 35.0, 24, 12, 600, 1200, 1600


def points(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """qid, place, level, node_id, score, description: a found node's score in hundredths and the start of its summary; those of LEAST_SCORE and more, the best
    MOST_POINTS of a question. The rule that stands in for a model's choice."""
    p = found.join(nodes.select("level", "node_id", "summary"), ["level", "node_id"])
    p = p.select("qid", "level", "node_id", F.round(T.clamped((F.col("route") * 100).cast("string")), 4).alias("score"), F.substring(T.collapse(F.col("summary")), 1, POINT_CHARS).alias("description"))
    return R.ranked(p.filter(F.col("score") >= LEAST_SCORE), ["qid"], [F.desc("score"), F.desc("level"), F.col("node_id")], MOST_POINTS, "place")


def point_scores(reply: DataFrame, found: DataFrame) -> DataFrame:
    """points from a model's replies (qid, level, reply: JSON with points of description, score, source E1, E2, ... by rank). Scores are clamped; an unknown source
    stands for the first node."""
    parsed = F.from_json(T.json_object(F.col("reply")), "points array<struct<description:string,score:string,source:string>>")
    r = reply.select("qid", "level", F.posexplode(parsed["points"]).alias("i", "p"))
    n = F.coalesce(F.regexp_extract("p.source", r"^\s*E(\d+)\s*$", 1).try_cast("bigint"), F.lit(1))
    r = r.select("qid", "level", "i", n.alias("n"), T.clamped(F.col("p.score")).alias("score"), F.btrim("p.description").alias("description"))
    size = found.groupBy("qid", "level").agg(F.max("rank").alias("m"))
    r = r.join(size, ["qid", "level"]).withColumn("rank", F.when(F.col("n").between(1, F.col("m")), F.col("n")).otherwise(1))
    j = r.join(found.select("qid", "level", "rank", "node_id"), ["qid", "level", "rank"])
    return R.ranked(j.filter(F.col("score") >= LEAST_SCORE).select("qid", "level", "node_id", "score", "description", "i"), ["qid"], [F.desc("score"), F.desc("level"), F.col("node_id"), F.col("i")], MOST_POINTS, "place").drop("i")


def point_sources(p: DataFrame, refs: DataFrame) -> DataFrame:
    """qid, rank, id (S1, ...), doc_id, score: what the points cite, each chunk once, at its first point."""
    first = R.ranked(p.join(refs, ["level", "node_id"]), ["qid", "doc_id"], [F.col("place")], 1, "one")
    top = R.ranked(first, ["qid"], [F.col("place"), F.col("doc_id")], MOST_SOURCES)
    return top.select("qid", "rank", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("id"), "doc_id", F.format_string("%.1f", "score").alias("score"))


def source_rows(results: DataFrame, chunks: DataFrame, rank: str = "rank", chars: int = SNIPPET_CHARS) -> DataFrame:
    """qid, rank, id, source, page, chunk, score, snippet of the results (qid, doc_id, score and rank), numbered as they come."""
    c = chunks.select("doc_id", "source", F.col("page").cast("string").alias("page") if "page" in chunks.columns else F.lit("?").alias("page"), F.substring(T.collapse(F.col("text")), 1, chars).alias("snippet"))
    j = results.select("qid", "doc_id", F.col(rank).alias("_r"), "score").join(c, "doc_id")
    j = R.ranked(j, ["qid"], [F.col("_r")], None)
    return j.select("qid", "rank", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("id"), F.coalesce("source", F.lit("unknown")).alias("source"), "page", F.col("doc_id").cast("string").alias("chunk"), F.format_string("%.4f", F.bround("score", 4)).alias("score"), "snippet")


def contexts(sources: DataFrame) -> DataFrame:
    """qid, context, ids: the sources of a question (k at most) as blocks, in order."""
    block = F.concat(F.lit("["), "id", F.lit("] "), "source", F.lit(" | page "), "page", F.lit(" | chunk "), "chunk", F.lit("\n"), "snippet")
    l = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"), "id")))  # noqa: E741
    return sources.groupBy("qid").agg(l.alias("l")).select("qid", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("context"), F.transform("l", lambda x: x["id"]).alias("ids"))


def merged(questions: DataFrame, p: DataFrame, sources: DataFrame, generator: Generator | None = None) -> DataFrame:
    """qid, answer: by the generator from points and sources; without one, or where it fails, the first points with the first sources."""
    listed = p.filter("place <= 6").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "description"))).alias("l"))
    cited = contexts(sources)
    j = questions.select("qid", "question").join(listed, "qid", "left").join(cited, "qid", "left")
    marks = F.array_join(F.transform(F.slice(F.coalesce("ids", F.array().cast("array<string>")), 1, 3), lambda i: F.concat(F.lit("["), i, F.lit("]"))), " ")
    rule = F.when(F.col("l").isNull(), F.lit("The evidence found does not answer this question.")).otherwise(F.concat(F.lit("From the evidence found:\n"), F.array_join(F.transform("l", lambda x: F.btrim(F.concat(F.lit("- "), x["description"], F.lit(" "), marks))), "\n")))
    prompt = F.concat(F.lit("Answer from this evidence only, and cite sources as [S1].\nQuestion: "), "question", F.lit("\n"), rule, F.lit("\n\n"), F.coalesce("context", F.lit("")))
    return j.select("qid", F.coalesce(F.nullif(answered(generator, prompt), F.lit("")), rule).alias("answer"))


def cited_answers(questions: DataFrame, sources: DataFrame, generator: Generator | None = None) -> DataFrame:
    """qid, answer, with citations: by the generator from the sources' blocks; without one, the first source's snippet."""
    j = questions.select("qid", "question").join(contexts(sources), "qid", "left").join(sources.filter("rank = 1").select("qid", "snippet"), "qid", "left")
    prompt = F.concat(F.lit("Answer from these sources only, and cite them as [S1].\n\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "question")
    answer = F.coalesce(F.nullif(answered(generator, prompt), F.lit("")), F.col("snippet"), F.lit("No source was found."))
    return j.select("qid", T.with_citations(answer, F.coalesce("ids", F.array().cast("array<string>"))).alias("answer"))


def filtered_documents(results: DataFrame, reply: DataFrame, k: int) -> DataFrame:
    """results (qid, doc_id, rank) by a model's scores (qid, reply: JSON with items of source E1, ..., score): the best k, of equal scores the later first; results as they
    come where there is no reply."""
    parsed = F.from_json(T.json_object(F.col("reply")), "items array<struct<source:string,score:string>>")
    s = reply.filter(parsed["items"].isNotNull()).select("qid", F.explode(parsed["items"]).alias("x")).select("qid", F.regexp_extract("x.source", r"^\s*E(\d+)\s*$", 1).try_cast("bigint").alias("rank"), T.clamped(F.col("x.score")).alias("s")).groupBy("qid", "rank").agg(F.max("s").alias("s"))
    some = s.select("qid").distinct().withColumn("scored", F.lit(True))
    j = results.join(s, ["qid", "rank"], "left").join(some, "qid", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    order = [F.desc(F.when(F.col("scored"), F.col("s")).otherwise(0.0)), F.when(F.col("scored"), -F.col("rank")).otherwise(F.col("rank"))]
    return R.ranked(j, ["qid"], order, k, "place").select("qid", "doc_id", F.col("rank").alias("found_rank"), F.col("s").alias("adaptive_score"), "place")
