import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T, vectors as V
from corvane.operators import chunking, graph, kg, metrics, ranking as R
from corvane.sources import io
from tests.plain.aliases import fold


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_anchors(spark):
    assert one(spark, T.anchors(F.lit("How does MI-Graph use the bag_of_words method?"))) == ["does", "mi-graph", "migraph", "mi-graph"][:1] + ["mi-graph", "migraph", "use", "bag_of_words", "bagofwords"]


def test_reference_like(spark):
    assert one(spark, T.reference_like(F.lit("References\n[1]")))
    assert one(spark, T.reference_like(F.lit("ACM 1999, IEEE 2001, x 2003")))
    assert not one(spark, T.reference_like(F.lit("in 1999 and 2001 acm ieee")))


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, V.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, V.l2_squared(a, b)) == 2


def test_names(spark):
    assert one(spark, T.canonical_name(F.lit("Multi-Instance  Learning (MIL)"))) == "multi instance learning"
    assert one(spark, T.path_stem(F.lit("/a/B.c.PDF"))) == "b.c"


def test_splitter():
    text = "\n\n".join("word " * n for n in (30, 5, 260, 40))
    parts = chunking.split_text(text, 200, 40)
    assert all(0 < len(p) <= 200 for p in parts)
    assert "".join(text.split()) in "".join("".join(parts).split()) or len("".join(parts)) >= len(text.replace(" ", "")) - 10
    assert chunking.split_text("") == []
    assert chunking.split_text("short") == ["short"]


@pytest.mark.parametrize("seed", range(3))
def test_alias_keys(spark, seed):
    """Against one ordered fold over all records; components of one name and of many, names in several spellings, rows that repeat."""
    rng = random.Random(seed)
    pool = ["Alpha", "alpha (A)", "A", "B-b", "b_b", "Beta", "  ", "(NN)", *(f"n{i}" for i in range(40))]
    rows = [(f"{rng.randint(0, 60):03d}", i, rng.choice(pool), rng.sample(pool, rng.choice([0, 0, 0, 1, 2]))) for i in range(300)]
    e = spark.createDataFrame(rows, "chunk_key string, pos int, name string, aliases array<string>")
    rows.sort(key=lambda r: r[:2])
    want = {(c, p, k) for (c, p, _, _), k in zip(rows, fold([r[2:] for r in rows]), strict=True) if k is not None}
    assert {tuple(r) for r in kg.entity_keys(e).collect()} == want
    assert {tuple(r) for r in kg.entity_keys(e.repartition(1)).collect()} == want
    assert kg.entity_keys(e.limit(0)).count() == 0


def test_aliases_merge_entities_and_relations(spark):
    rows = [
        ("1", "ok", [("Graph Net", "Method", ["GN"], "first"), ("Data", "Dataset", [], "")], [("GN", "uses", "Data", "d", "e1")]),
        ("2", "ok", [("gn", "Model", [], "a longer text"), ("Net of graphs", "Method", ["GN"], "")], [("Net of graphs", "uses", "data", "", "e2"), ("GN", "uses", "Graph Net", "", "")]),
    ]
    r = spark.createDataFrame(rows, "chunk_key string, status string, entities array<struct<name:string,type:string,aliases:array<string>,description:string>>, relations array<struct<subject:string,predicate:string,object:string,description:string,evidence:string>>")
    ent = kg.entities_of(r)
    keys = kg.entity_keys(ent)
    e = {x.canonical_name: x for x in kg.merged_entities(ent, keys).collect()}
    assert set(e) == {"graph net", "data"} and (e["graph net"].aliases, e["graph net"].description, e["graph net"].n_chunks) == (["GN", "Net of graphs", "gn"], "a longer text", 2)
    local = kg.local_names(ent, keys)
    rel = kg.merged_relations(kg.relations_of(r), kg.merged_entities(ent, keys), local).collect()
    assert [(x.predicate, x.evidence, x.n) for x in rel] == [("uses", ["e1", "e2"], 2)]  # one to itself goes
    assert kg.links(ent, keys).count() == 3 and kg.relation_links(kg.relations_of(r), kg.merged_entities(ent, keys), local).count() == 2


def test_components(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(70)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "src string, dst string")).collect()}
    assert {got[f"{i:03d}"] for i in range(71)} == {"000"} and got["x"] == got["y"] == "x" and got["z"] == "z"


def test_extraction_records(spark):
    rows = [("1", "ok", [("Name X", "claim", ["n"], "d")] + [(f"e{i}", "", [], "") for i in range(20)], [("Name X", "introduces", "e1", "", "")]), ("2", "error", [], [])]
    r = spark.createDataFrame(rows, "chunk_key string, status string, entities array<struct<name:string,type:string,aliases:array<string>,description:string>>, relations array<struct<subject:string,predicate:string,object:string,description:string,evidence:string>>")
    e = kg.entities_of(r)
    assert e.count() == 14 and e.filter("name = 'Name X'").first().type == "Contribution"
    merged = kg.merged_entities(e)
    assert kg.merged_relations(kg.relations_of(r), merged).first().predicate == "proposes"


def test_louvain_and_modularity(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 1.0), (3, 4, 0.1)], "src bigint, dst bigint, weight double")
    labels = graph.louvain(e)
    assert {r.node: r.label for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    best = graph.modularity(e, labels).first()[0]
    assert best >= graph.modularity(e, graph.label_propagation(labels.select("node"), e)).first()[0]


def test_nearest_blocks_agree(spark):
    v = np.random.default_rng(0).standard_normal((90, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    a = {(r.src, r.dst, r.rank) for r in graph.nearest(df, "id", "v", 4).collect()}
    b = {(r.src, r.dst, r.rank) for r in graph.nearest(df, "id", "v", 4, block=16).collect()}
    assert a == b and len(a) == 360


def test_rrf_is_symmetric(spark):
    l = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid bigint, doc_id bigint, a bigint")
    r = spark.createDataFrame([(1, 11, 1), (1, 10, 2)], "qid bigint, doc_id bigint, b bigint")
    got = R.fuse(l, r, ["qid", "doc_id"], ("a", "b"), (1.0, 1.0), 5).collect()
    assert got[0].score == got[1].score and [x.doc_id for x in sorted(got, key=lambda x: x.rank)] == [10, 11]


def test_metrics_without_gold(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid bigint")
    res = spark.createDataFrame([(1, 5, 2)], "qid bigint, item bigint, rank bigint")
    gold = spark.createDataFrame([(1, 5), (1, 6)], "qid bigint, item bigint")
    m = {r.qid: r for r in metrics.question_metrics(q, res, gold).collect()}
    assert (m[1].hit, m[1].all_hit, m[1].recall, m[1].mrr) == (True, False, 0.5, 0.5) and m[2].hit is None and m[2].mrr is None


def test_evidence(spark):
    res = spark.createDataFrame([(1, 1, "x", "s", 2, "the MI-Graph way")], "qid bigint, rank bigint, stable_chunk_id string, source string, page int, text string")
    ev = spark.createDataFrame([(1, 1, "x", "", 0, []), (1, 2, "y", "s", 2, ["migraph"]), (1, 3, "y", "s", 2, ["absent"])], "qid bigint, evidence_id bigint, stable_chunk_id string, source string, page int, terms array<string>")
    assert sorted(r.evidence_id for r in metrics.evidence_matches(res, ev).collect()) == [1, 2]


def test_index_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("a", 1, 0, 1), ("b", 1, 0, 2)], "source string, page int, start_index bigint, chunk_id bigint")
    path = str(tmp_path / "index")
    io.build_index(c, path)
    more = spark.createDataFrame([("b", 1, 0, 0), ("c", 1, 0, 0), ("c", 2, 0, 0)], c.schema)
    assert [tuple(r) for r in io.append_index(spark, path, more).collect()] == [("c", 2)]
    assert sorted(r.chunk_id for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]


def test_pages(spark, tmp_path):
    (tmp_path / "p.v1.txt").write_text("one\ftwo")
    got = io.read_pages(spark, str(tmp_path), io.plain_text_pages, "*.txt").orderBy("page").collect()
    assert [(r.source, r.paper_id, r.page, r.text) for r in got] == [("p.v1.txt", "p.v1", 1, "one"), ("p.v1.txt", "p.v1", 2, "two")]
