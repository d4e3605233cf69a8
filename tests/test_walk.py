"""Walks over a layer's links against a plain best-first search that knows the whole layer."""

import heapq
import random

import pytest

from corvane.plans import hierarchy as H, retrieval as P, walk


def plain(scores, links, starts, k):
    heap, popped = [(-scores[s], s) for s in starts if s in scores], {}
    heapq.heapify(heap)
    n = len(heap)
    while heap and len(popped) < min(len(scores), max(32, 8 * k, 8 * n)):
        s, node = heapq.heappop(heap)
        if node not in popped:
            popped[node] = -s
            for to in links.get(node, []):
                if to not in popped and to in scores:
                    heapq.heappush(heap, (-scores[to], to))
    if n and len(popped) < min(k, len(scores)):
        for node, s in scores.items():
            popped.setdefault(node, s)
    return sorted(popped.items(), key=lambda x: (-x[1], x[0]))[:k]


def layer(spark, seed, n, degree):
    rng = random.Random(seed)
    big = 1 << 60  # ids beyond what a double holds
    ids = [big + i for i in range(n)]
    v = {i: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] for i in ids}
    links = {i: rng.sample(ids, min(degree, n)) for i in ids if rng.random() < 0.9}
    nodes = spark.createDataFrame([(i, x) for i, x in v.items()] + [(big - 1, None)], "node_id bigint, embedding array<double>")
    edges = spark.createDataFrame([(a, b) for a, bs in links.items() for b in bs] + [(ids[0], 5)], "src bigint, dst bigint")
    q = {1: [1.0, 2.0, 0.5], 2: [-1.0, 0.0, 0.25], 3: [0.5, 0.5, 0.5], 4: [1.0, 1.0, 1.0]}
    questions = spark.createDataFrame(list(q.items()), "qid bigint, qvec array<double>")

    def cos(a, b):
        d = (sum(x * x for x in a) ** 0.5) * (sum(x * x for x in b) ** 0.5)
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / d, 6) if d else 0.0

    scores = {k: {i: cos(x, y) for i, x in v.items()} | {big - 1: 0.0} for k, y in q.items()}
    starts = [(1, ids[0]), (1, ids[1]), (1, ids[1]), (2, ids[-1]), (3, 7)]  # 3 starts at no node of the layer, 4 nowhere
    return nodes, edges, questions, starts, scores, links, ids


@pytest.mark.parametrize("n, degree, k", [(200, 3, 5), (200, 2, 9), (40, 1, 50), (3, 2, 5)])
def test_layer_search(spark, n, degree, k):
    nodes, edges, questions, starts, scores, links, ids = layer(spark, n + k, n, degree)
    begin = spark.createDataFrame(starts, "qid bigint, node_id bigint")
    central = spark.createDataFrame([(ids[2],)], "node_id bigint")
    got = {}
    for r in walk.layer_search(nodes, edges, questions, begin, k, central).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.node_id, r.local))
    first = {1: ids[:2], 2: [ids[-1]], 3: [ids[2]], 4: [ids[2]]}
    for qid, at in first.items():
        want = plain(scores[qid], links, list(dict.fromkeys(at)), k)
        assert [x[0] for x in got[qid]] == [x[0] for x in want] and all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got[qid], want, strict=True))


def test_layer_search_without_starts_or_nodes(spark):
    nodes, edges, questions, starts, *_ = layer(spark, 1, 10, 2)
    none = spark.createDataFrame([], "qid bigint, node_id bigint")
    assert walk.layer_search(nodes, edges, questions, none, 3).count() == 0
    assert walk.layer_search(nodes.limit(0), edges, questions, spark.createDataFrame(starts, "qid bigint, node_id bigint"), 3).count() == 0


def test_a_lost_question_walks(spark):
    """No child of the beam is in the level: the walk begins at the linked child and goes over links alone."""
    nodes = spark.createDataFrame([(1, 10, [1.0, 0.0]), *((0, i, [1.0, i / 10]) for i in range(5))], "level bigint, node_id bigint, embedding array<double>")
    empty = spark.createDataFrame([], "level bigint, parent bigint, child bigint")
    links = spark.createDataFrame([(0, 4, 3), (0, 3, 2)], "level bigint, src bigint, dst bigint")
    inter = spark.createDataFrame([(1, 10, 77)], "level bigint, parent bigint, child bigint")  # a child that is gone
    q = spark.createDataFrame([(1, "what", [1.0, 0.0])], "qid bigint, question string, qvec array<double>")
    h = H.Hierarchy(nodes, empty, None, None, links, inter)
    got = H.search(h, q, beam=2, top_k=3).filter("level = 0").orderBy("rank").collect()
    assert [r.node_id for r in got] == [0, 1, 2]  # from the least id, which links nowhere, filled up by a scan
    assert P.beam_search(h.levels(), empty, q, beam=2, top_k=3).filter("level = 0").count() == 3
