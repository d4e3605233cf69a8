"""Best-first search of one layer over its links, for many questions at once.

A walk pops the best node met so far (by similarity, then id), takes in the nodes that it links to, and stops after a budget of nodes. What a
walk will pop isn't known beforehand, so walks go in rounds: each is replayed over the links that are known of it, as far as they
reach, and then asks for the links of the AHEAD best nodes on its frontier; all questions' wishes are met by one join with the links and one
with the vectors. A question knows at most rounds * AHEAD * links rows, whatever the size of the layer, and questions are spread over
tasks by qid.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V
from ..operators import ranking as R
from ..tables import dropped, written

#: Nodes of a frontier whose links are fetched at once.
AHEAD = 16
LEAST_BUDGET, PER_RESULT = 32, 8


def budget(nodes: int, k: int, starts: int) -> int:
    return min(nodes, max(LEAST_BUDGET, PER_RESULT * k, PER_RESULT * starts))


def replay(starts: list[tuple[float, int]], links: dict[int, list[tuple[float, int]]], most: int) -> tuple[dict[int, float], list[int]]:
    """The nodes popped, with their scores, as far as links are known; and the nodes whose links are wanted to go on, none if the walk is over."""
    heap = [(-score, node) for score, node in starts]
    heapq.heapify(heap)
    popped: dict[int, float] = {}
    while heap and len(popped) < most:
        score, node = heap[0]
        if node in popped:
            heapq.heappop(heap)
            continue
        if node not in links:
            frontier = dict.fromkeys(n for _, n in heapq.nsmallest(4 * AHEAD, heap) if n not in popped and n not in links)
            return popped, list(frontier)[:AHEAD]
        heapq.heappop(heap)
        popped[node] = -score
        for s, n in links[node]:
            if n not in popped:
                heapq.heappush(heap, (-s, n))
    return popped, []


def layer_search(nodes: DataFrame, links: DataFrame, questions: DataFrame, starts: DataFrame, k: int, central: DataFrame | None = None) -> DataFrame:
    """qid, node_id, local, rank: the first k of a walk from starts (qid, node_id) over links (src, dst), filled up by a scan of the layer where the walk met
    fewer. nodes: node_id, embedding (null or zero vectors score 0); questions: qid, qvec. A question without a start in the layer starts at central
    (node_id, one row); without that, and in an empty layer, it finds nothing. Links to nodes that the layer lacks are passed over."""
    n = nodes.count()
    score = F.round(F.coalesce(V.cosine(F.col("embedding"), F.col("qvec")), F.lit(0.0)), 6).alias("score")
    q = questions.select("qid", "qvec")
    begin = starts.join(nodes.select("node_id"), "node_id", "left_semi").select("qid", "node_id").distinct()
    if central is not None:
        begin = begin.unionByName(q.join(begin.select("qid").distinct(), "qid", "left_anti").crossJoin(F.broadcast(central.select("node_id").limit(1))).select("qid", "node_id"))
    begin = begin.join(nodes, "node_id").join(q, "qid")
    # A node's links are rows (qid, src, dst, score); a start has no src, a node without links a row without dst.
    known = written(begin.select("qid", F.lit(None).cast("bigint").alias("src"), F.col("node_id").alias("dst"), score), "walk-known")

    def step(table: pa.Table) -> pa.Table:
        first, found = [], {}
        for src, dst, s in zip(*(table.column(c).to_pylist() for c in ("src", "dst", "score")), strict=True):
            if src is None:
                first.append((s, dst))
            else:
                to = found.setdefault(src, [])
                if dst is not None:
                    to.append((s, dst))
        popped, wanted = replay(first, found, budget(n, k, len(first)))
        out = [(node, 0.0, True) for node in wanted] or [(node, s, False) for node, s in popped.items()]
        columns = zip(*out, strict=True)
        return pa.table([pa.array([table.column("qid")[0].as_py()] * len(out), pa.int64()), *(pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.float64(), pa.bool_()), strict=True))], names=["qid", "node_id", "score", "wanted"])

    done = None
    while True:
        state = written(known.groupBy("qid").applyInArrow(step, "qid bigint, node_id bigint, score double, wanted boolean"), "walk-state")
        over = state.filter("NOT wanted").select("qid", "node_id", "score")
        done = over if done is None else done.unionByName(over)
        wanted = state.filter("wanted").select("qid", F.col("node_id").alias("src"))
        if wanted.isEmpty():
            break
        reached = wanted.join(links.select("src", "dst"), "src").join(nodes, F.col("dst") == F.col("node_id")).join(q, "qid").select("qid", "src", "dst", score)
        mark = wanted.select("qid", "src", F.lit(None).cast("bigint").alias("dst"), F.lit(None).cast("double").alias("score"))
        still = known.join(wanted.select("qid").distinct(), "qid", "left_semi")
        before, known = known, written(still.unionByName(reached).unionByName(mark), "walk-known")
        dropped(before)
    met = written(done, "walk-met")
    short = q.join(met.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid").filter(F.col("n") < min(k, n)).select("qid", "qvec")
    if not short.isEmpty():
        from .retrieval import past_questions

        every = past_questions(nodes, short).select("qid", "node_id", score)
        met = met.unionByName(R.ranked(every.join(met.select("qid", "node_id"), ["qid", "node_id"], "left_anti"), ["qid"], [F.desc("score"), F.col("node_id")], k, "r").drop("r"))
    return R.ranked(met, ["qid"], [F.desc("score"), F.col("node_id")], k).select("qid", "node_id", F.col("score").alias("local"), "rank")
