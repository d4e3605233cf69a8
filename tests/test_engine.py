"""The engine from end to end on text pages, its sinks and readers, streams, and what stands in for models."""

import json

import pytest
from pyspark.sql import functions as F

from corvane import __main__ as cli
from corvane.engine import Engine
from corvane.functions import text as T
from corvane.models import CallEmbedder, CallGenerator, HashEmbedder, response_text
from corvane.operators import chunking, graph, kg, ranking as R
from corvane.plans import answers as A, communities as C, hierarchy as H, retrieval as P
from corvane.settings import Settings
from corvane.sources import io
from corvane.streaming import incremental


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("papers")
    for i in range(4):
        body = " ".join(f"Methodology{chr(97 + (i + j) % 6) * 2} extends Networking{chr(97 + j % 5) * 3} and Sampling{chr(97 + i)}s." for j in range(40))
        (d / f"paper{i}.txt").write_text(f"Abstract\nWe study {['graphs', 'bags', 'trees', 'waves'][i]}.\n{body}\fResults\nThe {['graphs', 'bags', 'trees', 'waves'][i]} were measured.")
    return d


@pytest.fixture(scope="module")
def engine(spark, folder, tmp_path_factory):
    e = Engine(spark, Settings(root="file://" + str(tmp_path_factory.mktemp("engine")), k=3, chunk_size=400, chunk_overlap=50))
    e.build_all(io.read_pages(spark, str(folder), io.plain_text_pages, "*.txt"))
    return e


@pytest.mark.parametrize("mode", ["hybrid", "kg", "community", "archrag_gated", "archrag"])
def test_ask_in_each_mode(engine, mode):
    got = engine.ask("Which paper measured waves?", mode)
    assert got["sources"] and len(got["sources"]) <= 3 and "[S1]" in got["answer"]
    if mode == "hybrid":
        assert got["sources"][0]["source"] == "paper3.txt"


def test_ask_with_a_generator_and_history(spark, engine):
    def call(prompt):
        return json.dumps({"standalone_query": "trees measured", "query_type": "factual"}) if "JSON" in prompt else "<think>hm</think>Trees, see [S1]"

    e = Engine(spark, engine.settings, generator=CallGenerator(call))
    got = e.ask("and those?", "hybrid", session="s1")
    assert got["standalone_question"] == "trees measured" and got["answer"] == "Trees, see [S1]"
    assert e.history_text("s1") == "user: and those?\nassistant: Trees, see [S1]"
    e.clear_history("s1")
    assert e.history_text("s1") == ""
    with pytest.raises(ValueError):
        e.ask("  ")
    with pytest.raises(ValueError):
        e.search(e.questions([(1, "x")]), "nonsense")


def test_append_and_status(spark, engine, tmp_path):
    before = engine.chunks().count()
    (tmp_path / "paper9.txt").write_text("Abstract\nA new one on dunes.")
    (tmp_path / "paper0.txt").write_text("known already")
    assert [tuple(r) for r in engine.append(io.read_pages(spark, str(tmp_path), io.plain_text_pages, "*.txt")).collect()] == [("paper9.txt", 1)]
    assert engine.chunks().count() == before + 1 and engine.chunks().agg(F.max("doc_id")).first()[0] == before + 1
    assert all(v for k, v in engine.status().items() if k != "messages")
    with pytest.raises(FileNotFoundError):
        io.read_pages(spark, str(tmp_path), io.plain_text_pages, "*.none")
    with pytest.raises(FileNotFoundError):
        io.load_index(spark, str(tmp_path / "nothing"))


def test_evaluation_and_its_sinks(spark, engine, tmp_path):
    item = {"question": "waves measured", "canonical_question": "", "type": "t", "category": "c", "difficulty": "d", "target_papers": ["paper3"], "evidence": [{"source": "paper3.txt", "page": "2", "chunk_id": "1", "must_include_terms": ["waves"]}]}
    talk = {"id": "q2", "type": "talk", "category": "c2", "difficulty": "hard", "alias_terms": ["a"], "turns": [{"turn_id": "t1", "question": "trees measured", "alias_terms": ["a", "b"], "target_papers": ["paper2"]}, {"question": "and bags measured"}]}
    path = tmp_path / "set.json"
    path.write_text(json.dumps({"items": [{"id": "q1", **item}, talk]}))
    d = io.read_dataset(spark, str(path))
    rows = {r.id: r for r in d.collect()}
    assert set(rows) == {"q1", "q2:t1", "q2:2"} and rows["q2:t1"].alias_terms == ["a", "b"] and rows["q2:2"].difficulty == "hard" and rows["q1"].turn_index is None
    out = engine.evaluate(d, 3, "hybrid")
    m = {r.id: r for r in out.collect()}
    assert m["q1"].target_paper_hit and m["q1"].evidence_hit and m["q1"].mrr_evidence > 0 and m["q2:2"].target_paper_hit is None
    io.write_evaluation(out, str(tmp_path / "run"), {"run_id": "r", "k": "3"})
    assert spark.read.csv(str(tmp_path / "run/csv"), header=True).columns == io.CSV_COLUMNS
    talks = spark.read.json(str(tmp_path / "run/review_conversations")).first()
    assert [t.turn_index for t in talks.turns] == [1, 2] and talks["schema"] == "review_conversation.v1"
    assert spark.read.json(str(tmp_path / "run/review_items")).count() == 1 and spark.read.json(str(tmp_path / "run/full")).count() == 3
    with pytest.raises(ValueError):
        io.read_dataset(spark, str(path), "other")


def test_command_line(spark, folder, tmp_path, capsys):
    root = ["--root", "file://" + str(tmp_path / "cli")]
    assert cli.main([*root, "index", str(folder), "--pattern", "*.txt"], spark)["chunks"] > 4
    assert cli.main([*root, "kg-build"], spark)["entities"] > 5
    assert "paper1.txt" in [s["source"] for s in cli.main([*root, "ask", "bags measured", "--retrieval-mode", "chunks", "--k", "2"], spark)["sources"]]
    assert cli.main([*root, "models"], spark)["generator"] is None


def test_settings():
    s = Settings.from_env({"CORVANE_MODE": "community_gated", "CORVANE_K": "5"})
    assert (s.mode, s.k) == ("archrag-gated", 5)
    for bad in ({"CORVANE_K": "x"}, {"CORVANE_MODE": "x"}, {"CORVANE_ALGORITHM": "x"}):
        with pytest.raises(ValueError):
            Settings.from_env(bad)


def test_json_lines(spark, tmp_path):
    p = str(tmp_path / "x")
    io.write_json_lines(spark.createDataFrame([(1, "a"), (2, "b")], "n bigint, s string"), p)
    assert io.read_json_lines(spark, p, "n bigint, s string").count() == 2
    (tmp_path / "bad.json").write_text('{"n": 1, "s": "a"}\nnot json\n{"n": 3, "s": "c\td"}\n')
    bad = str(tmp_path / "bad.json")
    assert sorted(r.n for r in io.read_json_lines(spark, bad, "n bigint, s string", "drop").collect())[0] == 1
    with pytest.raises(Exception):
        io.read_json_lines(spark, bad, "n bigint, s string").collect()
    (tmp_path / "loose.json").write_text('{"n": 3, "s": "c\td"}\n')
    assert io.read_json_lines(spark, str(tmp_path / "loose.json"), "n bigint, s string", "loose").first().s == "c\td"


def test_manifest_purge_and_markdown(spark, tmp_path):
    p = str(tmp_path / "m")
    io.write_manifest(spark, p, {"rows": spark.range(3)}, spark.range(1))
    r = spark.read.json(p).first()
    assert (r.rows, r.status, r.failures) == (3, "partial", 1)
    io.purge(spark, p)
    assert not io.exists(spark, p)
    assert io.markdown(spark.createDataFrame([("a|b", 0.5)], "x string, y double")).endswith("| a\\|b | 0.5000 |")


def test_inverted_links(spark):
    e = spark.createDataFrame([("e1", [("k1", "", "", ""), ("", "s", "1", "2")])], "entity_id string, source_chunks array<struct<stable_chunk_id:string,source:string,page:string,chunk_id:string>>")
    links = spark.createDataFrame([("e1", "k1"), ("e2", "k2")], "entity_id string, chunk_key string")
    assert {tuple(r) for r in io.inverted(links, e).collect()} == {("e1", "k1"), ("e1", "s|1|2"), ("e2", "k2")}


def test_chunk_numbers_lose_no_row(spark):
    w = chunking.fixed_windows(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), ["doc_id", "source"])
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        n = chunking.numbered(w, ["doc_id", "start_index"])
        got = n.select("chunk_id", "doc_id", "start_index").orderBy("chunk_id").toPandas()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(got) == w.count() > 30_000 and (got.chunk_id == range(1, len(got) + 1)).all()
    assert got[["doc_id", "start_index"]].apply(tuple, axis=1).is_monotonic_increasing


def test_streams(spark, tmp_path):
    schema = "source string, page int, start_index bigint, text string"
    src, index = str(tmp_path / "in"), str(tmp_path / "index")
    spark.createDataFrame([("old", 1, 0, "x", 1)], schema + ", chunk_id bigint").write.parquet(index)
    run = lambda: incremental.watch_pages(spark, src, schema, index, str(tmp_path / "cp"), lambda b: b.withColumn("chunk_id", F.lit(0).cast("bigint"))).awaitTermination()
    for page in (1, 2):  # one source in two batches
        spark.createDataFrame([("new", page, 0, f"p{page}")], schema).write.mode("append").parquet(src)
        run()
    assert sorted((r.source, r.page, r.chunk_id) for r in spark.read.parquet(index).collect()) == [("new", 1, 2), ("new", 2, 3), ("old", 1, 1)]


def test_upsert_and_chat_streams(spark, tmp_path):
    src, out = str(tmp_path / "r"), str(tmp_path / "out")
    for rows in ([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")]):
        spark.createDataFrame(rows, "k string, at int, v string").write.mode("append").parquet(src)
        incremental.upserts(spark.readStream.schema("k string, at int, v string").parquet(src), out, "k", "at", str(tmp_path / "c1")).awaitTermination()
    assert sorted((r.k, r.v) for r in incremental.latest(spark, out).collect()) == [("a", "z"), ("b", "y")]
    m = str(tmp_path / "m")
    spark.createDataFrame([("s", i, f"m{i}") for i in range(5)], "session_id string, id bigint, message_json string").write.parquet(m)
    q = incremental.last_messages_stream(spark.readStream.schema("session_id string, id bigint, message_json string").parquet(m), 2).writeStream.outputMode("update").format("memory").queryName("last_two").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("last_two").first().messages == ["m3", "m4"]
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet("/root/testdata/sf0.001/events.parquet")
    assert incremental.event_counts(events).isStreaming


def test_embedders_and_answers(spark):
    d = spark.createDataFrame([("one two",), ("two one",), (None,)], "t string")
    v = [r.v for r in d.select(HashEmbedder(8).embed(F.coalesce("t", F.lit(""))).alias("v")).collect()]
    assert v[0] == v[1] and sum(map(abs, v[0])) > 0 and v[2] == [0.0] * 8
    sizes = [r.v for r in d.select(CallEmbedder(lambda xs: [[float(len(xs)), float(len(x))] for x in xs], 2).embed(F.col("t")).alias("v")).collect()]
    assert [x[1] for x in sizes] == [7.0, 7.0, 0.0] and all(x[0] <= 2 for x in sizes)

    def call(p):
        if "bad" in p:
            raise RuntimeError
        return [{"text": "a"}, "b"]

    got = spark.createDataFrame([("ok",), ("bad",)], "p string").select(CallGenerator(call).answer(F.col("p")).alias("a")).collect()
    assert [r.a for r in got] == ["a\nb", None] and response_text("x") == "x"


def test_intents(spark):
    assert one(spark, T.entity_type_intent(F.lit("Dataset"), F.lit("which data is used"))) == 3 and one(spark, T.entity_type_intent(F.lit("Dataset"), F.lit("why"))) == 0
    assert one(spark, T.predicate_intent(F.lit("proposes"), F.lit("a novel way"))) == 4 and one(spark, T.predicate_intent(F.lit("uses"), F.lit("it employs"))) == 2
    assert one(spark, T.predicate_intent(F.lit("nothing"), F.lit("it employs"))) == 0


def test_query_planning(spark):
    assert one(spark, T.rerank_terms(F.lit("How does MI-Graph work? how"))) == ["How", "does", "MI-Graph", "work", "how"]
    assert one(spark, T.rerank_terms(F.lit("图卷积"))) == ["图卷", "卷积"]
    assert one(spark, T.query_entities(F.lit('Is "bag of words" like Multi Instance Learning or BERT-large? éNope'))) == ["bag of words", "Is", "Multi Instance Learning", "BERT-large"]
    r = one(spark, T.rewritten(F.lit("Compare A and B")))
    assert r.query_type == "multi-hop" and len(r.sub_questions) == 2 and r.keywords == ["Compare", "and"]
    assert one(spark, T.normalized_kind(F.lit(" Multi_Hop "))) == "multi-hop" and one(spark, T.query_kind(F.lit("overall trend"))) == "abstract"
    assert one(spark, T.retrieval_query(T.rewritten(F.lit("steps of x")))).startswith("steps of x\nKeywords: steps; method; input; output\nSub-questions: steps of x")
    assert T.retrieval_mode("Graph_Assisted") == "graph" and T.retrieval_mode("communities") == "archrag-lite"


def test_model_output(spark):
    assert one(spark, T.json_object(F.lit('```json\n{"a": {"b": 1}}\n```'))) == '{"a": {"b": 1}}' and one(spark, T.json_object(F.lit("none"))) is None
    assert one(spark, T.clamped(F.lit("140"))) == 100 and one(spark, T.clamped(F.lit("x"))) == 0
    assert one(spark, T.with_citations(F.lit("a"), F.array(F.lit("S1"), F.lit("S2")))).endswith("[S1] [S2]") and one(spark, T.with_citations(F.lit("a [S3]"), F.array(F.lit("S1")))) == "a [S3]"
    assert one(spark, T.chunk_key(F.lit(""), F.lit("s"), F.lit("1"), F.lit("2"))) == "s|1|2" and one(spark, T.chunk_key(F.lit(" id "), F.lit(""), F.lit(""), F.lit(""))) == "id"
    assert one(spark, T.nfkc(F.lit("ﬁ"))) == "fi" and one(spark, T.safe_int(F.lit("x"))) == 0
    assert one(spark, T.keyword_relevance(F.array(F.lit("Ab"), F.lit("CD")), F.lit("Ab cd"))) == 0.75


def test_quota_select(spark):
    """Row 4 falls to its node, row 3 to its paper; row 6 fits both; candidates beyond those that can matter change nothing."""
    rows = [(1, "n1", "p1"), (2, "n1", "p1"), (3, "n2", "p1"), (4, "n1", "p2"), (5, "n2", "p1"), (6, "n2", "p2")]
    d = spark.createDataFrame([(1, *r) for r in rows], "qid bigint, pos bigint, node string, paper string")
    got = [(r.pos, r["rank"]) for r in R.quota_select(d, "qid", 4, 2, 2).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (6, 3), (3, 4)]
    import random

    rng = random.Random(1)
    for limit, per_node, per_paper in ((10, 3, 6), (7, 2, 3), (5, 4, 2)):
        many = spark.createDataFrame([(q, i, f"n{rng.choice([0, 0, 0, 1, 2, 5])}", f"p{rng.choice([0, 0, 1, 2, 9])}") for q in range(3) for i in range(1, 150)], "qid bigint, pos bigint, node string, paper string")
        whole = sorted(map(tuple, R.quota_select(many, "qid", limit, per_node, per_paper).collect()))
        assert whole == sorted(map(tuple, R.quota_select(P.for_quotas(many, limit, per_node, per_paper), "qid", limit, per_node, per_paper).collect()))


def test_ranks_of_all_rows(spark):
    d = spark.createDataFrame([(q, i, float(i * 7 % 5)) for q in (1, 2) for i in range(9)], "qid bigint, doc_id bigint, score double")
    got = {(r.qid, r.doc_id): r.r for r in R.ranked_whole(d, "qid", "score", "doc_id", "r").collect()}
    for q in (1, 2):
        order = sorted(range(9), key=lambda i: (-(i * 7 % 5), i))
        assert [got[q, i] for i in order] == list(range(1, 10))


def test_points_from_replies(spark):
    found = spark.createDataFrame([(1, 0, 7, 0.9, 0.9, 1), (1, 0, 8, 0.5, 0.5, 2)], "qid bigint, level bigint, node_id bigint, local double, route double, rank bigint")
    reply = spark.createDataFrame([(1, 0, '{"points": [{"description": "x", "score": "120", "source": "E2"}, {"description": "y", "score": "10", "source": "E1"}, {"description": "z", "score": "40", "source": "E9"}]}')], "qid bigint, level bigint, reply string")
    got = [(r.node_id, r.score, r.place) for r in A.point_scores(reply, found).orderBy("place").collect()]
    assert got == [(8, 100.0, 1), (7, 40.0, 2)]
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "qid bigint, doc_id bigint, rank bigint")
    said = spark.createDataFrame([(1, '{"items": [{"source": "E3", "score": "90"}]}')], "qid bigint, reply string")
    f = {(r.qid, r.place): r.doc_id for r in A.filtered_documents(hits, said, 2).collect()}
    assert f == {(1, 1): 12, (1, 2): 11, (2, 1): 10}


def test_merged_answers(spark):
    q = spark.createDataFrame([(1, "a?"), (2, "b?")], "qid bigint, question string")
    p = spark.createDataFrame([(1, 1, "fact")], "qid bigint, place bigint, description string")
    s = spark.createDataFrame([(1, 1, "S1", "src", "2", "3", "0.5", "snip")], "qid bigint, rank bigint, id string, source string, page string, chunk string, score string, snippet string")
    got = {r.qid: r.answer for r in A.merged(q, p, s).collect()}
    assert got[1].endswith("- fact [S1]") and "does not answer" in got[2]
    assert {r.qid: r.answer for r in A.merged(q, p, s, CallGenerator(lambda x: "said")).collect()} == {1: "said", 2: "said"}


def test_whole_merge(spark):
    rows = [
        ("1", "ok", [("Net", "Method", ["N"], "short", {"a": "1"}), ("Data", "dataset", [], "", {})], [("net", "employs", "Data", "d", "e1"), ("Net", "uses", "Net", "", ""), ("Net", "uses", "Unknown", "", "")]),
        ("2", "ok", [("net", "model", ["NN"], "a longer text", {"a": "2", "b": "3"})], [("Net", "uses", "data", "longer", "e2")]),
        ("3", "error", [("Net", "Metric", [], "", {})], []),
    ]
    r = spark.createDataFrame(rows, "chunk_key string, status string, entities array<struct<name:string,type:string,aliases:array<string>,description:string,attributes:map<string,string>>>, relations array<struct<subject:string,predicate:string,object:string,description:string,evidence:string>>")
    e = kg.merged_entities(kg.entities_of(r))
    net = e.filter("canonical_name = 'net'").first()
    assert (net.name, net.type, net.observed_types, net.aliases, net.description, net.attributes, net.n_chunks) == ("Net", "Method", ["Method", "Model"], ["N", "NN"], "a longer text", {"a": "2", "b": "3"}, 2)
    rel = kg.merged_relations(kg.relations_of(r), e).collect()
    assert len(rel) == 1 and (rel[0].predicate, rel[0].description, rel[0].evidence, rel[0].n) == ("uses", "longer", ["e1", "e2"], 2)
    keys = kg.entity_keys(kg.entities_of(r))
    assert {tuple(x) for x in keys.collect()} == {("1", 0, "net"), ("1", 1, "data"), ("2", 0, "net")}
    moved = kg.migrated(spark.createDataFrame([("1", "old"), ("9", "kept")], "chunk_key string, source string"), spark.createDataFrame([("1", "new")], "chunk_key string, source string"), ["source"])
    assert sorted(map(tuple, moved.collect())) == [("1", "new"), ("9", "kept")]


def test_the_hierarchy_is_searched_by_the_rewritten_question(spark, tmp_path):
    e = Engine(spark, Settings(root=str(tmp_path)))
    standalone, sought = e.rewritten("steps of “Graph Nets”")
    assert standalone == "steps of “Graph Nets”" and sought.startswith(standalone + "\n") and "Keywords: " in sought and "Sub-questions: " in sought


def test_detect(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("c", "d", 0.1)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    for how in ("louvain", "greedy", "async", "label"):
        got = {r.node: r.label for r in graph.detect(nodes, e, how).collect()}
        assert got["f"] == "f" and set(got) == set("abcdef")
        if how != "label":
            assert got["a"] == got["b"] == got["c"] == "a" and got["d"] == got["e"] == "d"
    with pytest.raises(ValueError):
        graph.detect(nodes, e, "other")


def test_nearest_takes_valid_vectors_only(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, [1.0]), (5, None), (6, [float("nan"), 1.0]), (2, [5.0, 5.0])], "id bigint, v array<double>")
    assert sorted((r.src, r.dst) for r in graph.nearest(d, "id", "v", 3).collect()) == [(1, 2), (2, 1)]


def test_hierarchy_saved_and_loaded(spark, tmp_path):
    nodes = spark.createDataFrame([(i, f"n{i}", [float(i % 3 == j) + 0.01 * i for j in range(3)]) for i in range(12)], "node_id bigint, name string, embedding array<double>")
    e = H.with_similar(spark.createDataFrame([], "src bigint, dst bigint, weight double"), nodes, 3, 0.5)
    h = H.linked(H.build(nodes, e, nodes.select("node_id", F.col("node_id").alias("doc_id")), embedder=None))
    h.save(str(tmp_path / "h"))
    back = H.Hierarchy.load(spark, str(tmp_path / "h"))
    for t in H.Hierarchy.TABLES:
        cols = sorted(getattr(h, t).columns)
        assert sorted(map(repr, getattr(h, t).select(*cols).collect())) == sorted(map(repr, getattr(back, t).select(*cols).collect()))
    assert back.top() >= 1 and back.config["m_neighbors"] == "8" and back.find(0, 0).count() == 1
    q = spark.createDataFrame([(1, "how", [1.0, 0.0, 0.0])], "qid bigint, question string, qvec array<double>")
    top = H.search(back, q, beam=2, max_levels=1)
    assert {r.level for r in top.collect()} == {back.top()} and H.search(back, q, beam=2).filter("level = 0").count() > 0
    lost = P.beam_search(back.levels(), back.children.limit(0), q, beam=2)  # no children: the whole level is looked at
    assert lost.filter("level = 0").count() == 5


def test_more_questions_than_a_batch(spark, monkeypatch):
    monkeypatch.setattr(P, "QUESTIONS", 3)
    q = spark.createDataFrame([(i, "x") for i in range(10)], "qid bigint, question string")
    assert P.past_questions(spark.range(5).select(F.col("id").alias("doc_id")), q).count() == 50


def test_retrieval_without_a_graph(spark):
    c = spark.createDataFrame([(1, "s", "alpha beta", [1.0, 0.0]), (2, "t", "References [1] alpha", [0.0, 1.0]), (3, "u", "gamma", None)], "doc_id bigint, source string, text string, embedding array<double>")
    q = spark.createDataFrame([(1, "alpha", [0.0, 1.0])], "qid bigint, question string, qvec array<double>")
    empty = P.Graph(spark.createDataFrame([], "entity_id string"), spark.createDataFrame([], "relation_id string"), None, None)
    got = P.graph_search(c, q, empty, 2, False).orderBy("kept_rank").collect()
    assert [r.doc_id for r in got] == [1, 2] and got[1].is_reference
    assert P.filtered_vector_search(c, q, F.col("source") == "s", 1, prefilter=True).first().doc_id == 1


def test_community_summary_falls_back(spark):
    e = spark.createDataFrame([("a", "A", "a", "Method", "does", ["x"], ["Method"]), ("b", "B", "b", "Concept", "", [], ["Concept"]), ("c", "C", "c", "Other", "", [], ["Other"])], "entity_id string, name string, canonical_name string, type string, description string, aliases array<string>, observed_types array<string>").withColumn("attributes", F.create_map().cast("map<string,string>"))
    r = spark.createDataFrame([("r1", "a", "uses", "b", "how", ["ev"])], "relation_id string, subject_id string, predicate string, object_id string, description string, evidence array<string>")
    links = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "entity_id string, doc_id bigint")

    def call(prompt):
        if "Community c0001" in prompt:
            raise RuntimeError
        return "refined"

    built = C.build(e, r, links, spark.createDataFrame([("r1", 1)], "relation_id string, doc_id bigint"), "louvain", generator=CallGenerator(call))
    got = {x.community_id: x.summary for x in built["index"].collect()}
    assert got["c0001"].startswith("Community c0001\nTheme: A; B") and "- A --uses--> B: how" in got["c0001"] and got["c0002"] == "refined"
