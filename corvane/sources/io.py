"""Readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

#: A page parser takes the bytes of a file and yields (page number from 1, text).
PageParser = Callable[[bytes], Iterator[tuple[int, str]]]


def plain_text_pages(data: bytes) -> Iterator[tuple[int, str]]:
    """Pages of a text file: form feeds part them."""
    for i, t in enumerate(data.decode("utf-8", "replace").split("\f"), 1):
        yield i, t


def pdf_pages(data: bytes) -> Iterator[tuple[int, str]]:
    """Pages of a PDF by pypdf; by pymupdf, which skips blank pages, where pypdf is not installed or fails on the file."""
    import io

    try:
        from pypdf import PdfReader

        pages = [(i, p.extract_text() or "") for i, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1)]
    except Exception as first:  # noqa: BLE001  whatever one parser trips over, the other may read
        try:
            import fitz
        except ImportError:
            raise first from None
        yield from pymupdf_pages(fitz.open(stream=data))
        return
    yield from pages


def pymupdf_pages(document) -> Iterator[tuple[int, str]]:
    for i, p in enumerate(document, 1):
        if p.get_text().strip():
            yield i, p.get_text()


PAGES = "source string, source_path string, paper_id string, page int, text string"


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length of the folder's files by path; an error if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length").orderBy("path")
    if files.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return files


def read_pages(spark: SparkSession, folder: str, parser: PageParser = pdf_pages, pattern: str = "*.pdf") -> DataFrame:
    """source, source_path, paper_id, page, text of all files, parsed on the executors a file at a time; an error if there is no file."""
    list_files(spark, folder, pattern)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def work(frames):
        for f in frames:
            for path, data in zip(f["path"], f["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
                yield pd.DataFrame([(name, path, stem, n, t) for n, t in parser(bytes(data))], columns=["source", "source_path", "paper_id", "page", "text"])

    return files.mapInPandas(work, PAGES)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def purge(spark: SparkSession, *paths: str) -> None:
    """Deletes outputs that are there."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, on_error: str = "fail") -> DataFrame:
    """on_error: fail, drop, or loose (control characters in strings are taken as they are)."""
    r = spark.read.schema(schema)
    if on_error == "loose":
        r = r.option("allowUnquotedControlChars", True)
    return r.option("mode", "DROPMALFORMED" if on_error == "drop" else "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def write_manifest(spark: SparkSession, path: str, counts: dict[str, DataFrame], failures: DataFrame | None = None) -> None:
    """One row: the tables' counts, the time, and whether anything failed."""
    row = {k: v.count() for k, v in counts.items()}
    failed = failures.count() if failures is not None else 0
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()], F.lit("partial" if failed else "complete").alias("status"), F.lit(failed).alias("failures"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("built_at")).write.mode("overwrite").json(path)


def build_index(chunks: DataFrame, path: str, force: bool = False) -> None:
    chunks.write.mode("overwrite" if force else "errorifexists").parquet(path)


def embed_index(chunks: DataFrame, embedder, path: str, force: bool = False) -> None:
    """The chunks with the vectors of their texts, embedded in batches on the executors and stored."""
    build_index(chunks.withColumn("embedding", embedder.embed(F.col("text"))), path, force)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"no index at {path}: build it first")
    return spark.read.parquet(path)


def append_index(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds chunks of sources that the index lacks, numbered on from its last; returns counts by source. With keys, adds chunks whose keys it lacks,
    for sources that come in parts."""
    from ..operators.chunking import append_new, numbered

    have = spark.read.parquet(path)
    top = have.agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0]
    new = incoming.dropDuplicates(keys).join(have.select(*keys), keys, "left_anti") if keys else append_new(have, incoming)
    fresh = numbered(new.drop("chunk_id"), ["source", "page", "start_index"], top + 1)
    fresh.select(*have.columns).write.mode("append").parquet(path)
    return spark.read.parquet(path).filter(F.col("chunk_id") > top).groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"))


# Knowledge graphs -----------------------------------------------------------------------------------------------------
GRAPH_TABLES = ("entities", "relations", "links", "relation_links")


def save_graph(graph, path: str) -> None:
    """A plans.retrieval.Graph as four tables; Spark's commit makes each whole or absent."""
    for name in GRAPH_TABLES:
        getattr(graph, name).write.mode("overwrite").parquet(f"{path}/{name}")


def graph_available(spark: SparkSession, path: str) -> bool:
    return all(exists(spark, f"{path}/{name}") for name in GRAPH_TABLES)


def load_graph(spark: SparkSession, path: str):
    from ..plans.retrieval import Graph

    return Graph(*[spark.read.parquet(f"{path}/{name}") for name in GRAPH_TABLES])


def inverted(links: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id, chunk_key: the links, and what entities name as their source_chunks (array of struct with stable_chunk_id or chunk_key, source, page, chunk_id); each once."""
    from ..functions.text import chunk_key

    have = links.select("entity_id", "chunk_key")
    if "source_chunks" in entities.columns:
        r = entities.select("entity_id", F.explode("source_chunks").alias("r"))
        fields = r.schema["r"].dataType.fieldNames()
        get = lambda n: F.coalesce(F.col(f"r.{n}").cast("string"), F.lit("")) if n in fields else F.lit("")
        stable = F.coalesce(F.nullif(get("stable_chunk_id"), F.lit("")), get("chunk_key"))
        have = have.unionByName(r.select("entity_id", chunk_key(stable, get("source"), get("page"), get("chunk_id")).alias("chunk_key")))
    return have.filter("chunk_key <> ''").distinct()


def write_community_index(index: DataFrame, key_entities: DataFrame, sources: DataFrame, path: str) -> None:
    """Summaries and vectors, with the first 12 names and 30 sources of each community as arrays."""
    first = lambda rows, rank, value, k, name: rows.filter(F.col(rank) <= k).groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(value).alias("v")))), lambda x: x["v"]).alias(name))
    names, refs = first(key_entities, "rank", "name", 12, "key_entities"), first(sources, "ref_rank", "doc_id", 30, "source_chunks")
    index.join(names, "community_id", "left").join(refs, "community_id", "left").write.mode("overwrite").parquet(path)


# Chat -----------------------------------------------------------------------------------------------------------------
def append_messages(messages: DataFrame, path: str) -> None:
    """session_id, id, message_json, created_at."""
    messages.write.mode("append").partitionBy("session_id").parquet(path)


MESSAGES = "id bigint, message_json string, created_at timestamp, session_id string"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGES).parquet(path)


def clear_session(spark: SparkSession, path: str, session_id: str) -> None:
    """Overwrites one session's partition with nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/session_id={session_id}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def last_messages(messages: DataFrame, session: str, order: str, n: int = 12) -> DataFrame:
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


# Evaluation ---------------------------------------------------------------------------------------------------------------
EVIDENCE = "array<struct<source:string,page:string,chunk_id:string,stable_chunk_id:string,must_include_terms:array<string>>>"
TURN = f"question:string,canonical_question:string,alias_terms:array<string>,type:string,category:string,difficulty:string,target_papers:array<string>,expected_answer_points:array<string>,evidence:{EVIDENCE},negative_checks:array<string>"
ITEMS = f"items array<struct<id:string,{TURN},turns:array<struct<turn_id:string,{TURN}>>>>"


def read_dataset(spark: SparkSession, path: str, field: str = "question") -> DataFrame:
    """One row a question: id, parent_id, turn_index, query (of the field, question or canonical_question), and the item's fields. A turn has its own, or else its parent's, type,
    category and difficulty, and its parent's alias terms before its own."""
    if field not in ("question", "canonical_question"):
        raise ValueError("the query field is question or canonical_question")
    item = spark.read.schema(ITEMS).option("multiLine", True).json(path).select(F.explode("items").alias("i"))
    own = ["target_papers", "expected_answer_points", "evidence", "negative_checks"]
    passed = ["type", "category", "difficulty"]
    single = item.filter(F.coalesce(F.size("i.turns"), F.lit(0)) == 0).select(F.col("i.id").alias("id"), F.col("i.id").alias("parent_id"), F.lit(None).cast("int").alias("turn_index"), *[F.col(f"i.{c}").alias(c) for c in ("question", "canonical_question", "alias_terms", *passed, *own)])
    t = item.filter(F.size("i.turns") > 0).select("i", F.posexplode("i.turns").alias("n", "t"))
    turn_id = F.coalesce("t.turn_id", (F.col("n") + 1).cast("string"))
    none = F.array().cast("array<string>")
    turns = t.select(
        F.concat_ws(":", "i.id", turn_id).alias("id"),
        F.col("i.id").alias("parent_id"),
        (F.col("n") + 1).alias("turn_index"),
        F.col("t.question").alias("question"),
        F.col("t.canonical_question").alias("canonical_question"),
        F.array_distinct(F.concat(F.coalesce("i.alias_terms", none), F.coalesce("t.alias_terms", none))).alias("alias_terms"),
        *[F.coalesce(f"t.{c}", f"i.{c}", F.lit("")).alias(c) for c in passed],
        *[F.col(f"t.{c}").alias(c) for c in own],
    )
    return single.unionByName(turns).withColumn("query", F.coalesce(field, F.lit("")))


CSV_COLUMNS = ["id", "question", "canonical_question", "type", "category", "difficulty", "target_paper_hit", "all_target_papers_hit", "evidence_hit", "target_paper_recall", "evidence_recall", "first_target_paper_rank", "first_evidence_rank", "mrr_target_paper", "mrr_evidence", "citation_present", "answer_length", "retrieved_sources"]


def write_evaluation(rows: DataFrame, folder: str, run: dict[str, str]) -> None:
    """A run's rows (CSV_COLUMNS, parent_id, turn_index and what else they have) as CSV; as review lines, one for an item or a conversation with its turns; and whole. run: what the
    run is told by (run_id, dataset_id, query_field, k)."""
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS]).write.mode("overwrite").csv(f"{folder}/csv", header=True)
    told = [F.lit(v).alias(k) for k, v in run.items()]
    scores = ("answer_correctness_0_to_45", "evidence_support_0_to_30", "academic_reading_quality_0_to_15", "citation_format_0_to_10")
    review = F.struct(*[F.lit(None).cast("int").alias(c) for c in scores], F.lit("").alias("notes")).alias("manual_review")
    body = [c for c in rows.columns if c not in ("parent_id", "turn_index")]
    singles = rows.filter("turn_index IS NULL").select(F.lit("review_item.v1").alias("schema"), *told, *body, review)
    singles.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/review_items")
    turn = F.struct("turn_index", *body, review)
    talks = rows.filter("turn_index IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(turn), lambda a, b: F.when(a["turn_index"] < b["turn_index"], -1).when(a["turn_index"] > b["turn_index"], 1).otherwise(0)).alias("turns"))
    talks.select(F.lit("review_conversation.v1").alias("schema"), *told, "id", "turns").write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/review_conversations")
    rows.select(*told, F.to_json(F.struct(*rows.columns)).alias("item")).write.mode("overwrite").json(f"{folder}/full")


def write_report(rows: DataFrame, folder: str) -> None:
    """A run's rows as CSV and JSON lines."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").csv(f"{folder}/csv", header=True)
    rows.write.mode("overwrite").json(f"{folder}/json")


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A report table for reading; at most limit rows."""
    esc = lambda v: str("" if v is None else f"{v:.4f}" if isinstance(v, float) else v).replace("|", "\\|").replace("\n", " ")
    out = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    out += ["| " + " | ".join(map(esc, r)) + " |" for r in rows.limit(limit).collect()]
    return "\n".join(out)
