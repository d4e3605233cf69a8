"""Communities in turns against the forms of one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import graph
from tests.plain.modularity import greedy_labels, louvain_labels


def planted(seed, groups=6, size=12, inside=0.5, outside=0.02):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b, round(rng.uniform(0.5, 2.0), 3)) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a % groups == b % groups else outside)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "src bigint, dst bigint, weight double")


def plain_modularity(rows, label, resolution=1.0):
    total, inside, degree = sum(w for *_, w in rows), 0.0, {}
    for a, b, w in rows:
        inside += w * (label[a] == label[b])
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0.0) + w
    return inside / total - resolution * sum(d * d for d in degree.values()) / (4 * total * total)


@pytest.mark.parametrize("seed, inside, outside, share", [(1, 0.5, 0.02, 0.99), (2, 0.25, 0.05, 0.985)])
def test_louvain_is_as_good_as_in_one_task(spark, seed, inside, outside, share):
    rows = planted(seed, inside=inside, outside=outside)
    want = plain_modularity(rows, louvain_labels(*map(np.array, zip(*rows, strict=True))))
    got = {r.node: r.label for r in graph.louvain(frame(spark, rows)).collect()}
    assert plain_modularity(rows, got) >= share * want
    least = {}
    for node, label in got.items():
        least[label] = min(least.get(label, node), node)
    assert all(k == v for k, v in least.items())
    labels = spark.createDataFrame(list(got.items()), "node bigint, label bigint")
    assert abs(graph.modularity(frame(spark, rows), labels).first()[0] - plain_modularity(rows, got)) < 1e-5


def test_greedy_is_nearly_as_good_and_merges_stars(spark):
    rows = planted(3)
    want = plain_modularity(rows, greedy_labels(*map(np.array, zip(*rows, strict=True))))
    assert plain_modularity(rows, {r.node: r.label for r in graph.greedy(frame(spark, rows)).collect()}) >= 0.95 * want
    star = [(0, i, 1.0) for i in range(1, 40)] + [(100, 101, 30.0)]
    got = {r.node: r.label for r in graph.greedy(frame(spark, star)).collect()}
    assert {got[i] for i in range(40)} == {0} and got[101] == 100


def test_labels_in_turns_come_to_rest(spark):
    """On a graph of two sides, where all at once may swing; over 1 and 8 partitions alike."""
    rows = [(a, b, 1.0) for a in range(6) for b in range(10, 15)] + [(20, 21, 1.0)]
    e = frame(spark, rows)
    got = [{r.node: r.label for r in graph.label_turns(x).collect()} for x in (e.coalesce(1), e.repartition(8))]
    assert got[0] == got[1] and got[0][20] == got[0][21]
    around = {}
    for a, b, w in planted(4):
        for x, y in ((a, b), (b, a)):
            around.setdefault(x, []).append((y, w))
    rest = {r.node: r.label for r in graph.label_turns(frame(spark, planted(4))).collect()}
    for node, near in around.items():
        votes = {}
        for y, w in near:
            votes[rest[y]] = votes.get(rest[y], 0.0) + w
        assert votes.get(rest[node], 0.0) >= max(votes.values()) - 1e-9  # a fixed point


def test_neighbours_never_move_at_once(spark):
    rows = planted(5)
    around, degree, _ = graph._whole(frame(spark, rows))
    wanting = degree.filter("node % 3 > 0").select("node", F.lit(1).alias("new"))
    for step in range(3):
        turn = {r.node for r in graph._in_turn(around, wanting, step).collect()}
        assert turn and not any(a in turn and b in turn for a, b, _ in rows) and all(x % 3 for x in turn)


def test_modularity_of_nothing(spark):
    none = frame(spark, [])
    assert graph.louvain(none).count() == graph.greedy(none).count() == graph.label_turns(none).count() == 0
    assert {tuple(r) for r in graph.louvain(frame(spark, [(1, 1, 5.0), (1, 2, 1.0), (2, 1, 1.0)])).collect()} == {(1, 1), (2, 1)}
