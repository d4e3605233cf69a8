"""Weighted undirected graphs: edges, degrees, neighbours, communities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..functions import vectors as V
from ..tables import dropped, written
from .chunking import numbered

# Fixed values -----------------------------------------------------------------------------------------------------
PREDICATE_WEIGHTS = {
    "proposes": 2.0,
    "has_component": 2.0,
    "solves": 1.8,
    "has_finding": 1.8,
    "reports_result": 1.6,
    "evaluated_on": 1.5,
    "evaluated_by": 1.4,
    "improves_on": 1.4,
    "compares_with": 1.2,
    "has_limitation": 1.2,
    "has_future_work": 1.2,
    "uses": 1.0,
    "defines": 1.0,
    "has_property": 1.0,
    "formulates_as": 1.0,
    "outputs": 1.0,
    "supports": 1.0,
    "similar_to": 0.8,
    "extends": 0.8,
    "mentions": 0.4,
    "other": 0.2,
}
DEFAULT_WEIGHT = 0.5
# -------------------------------------------------------------------------------------------------------------------


def predicate_weight(predicate: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PREDICATE_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, predicate), F.lit(DEFAULT_WEIGHT))


def edges(relations: DataFrame, a: str, b: str, weight: Column) -> DataFrame:
    """src < dst, weight, n: parallel relations added up, both directions as one."""
    return relations.filter(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(F.round(F.sum(weight), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(e: DataFrame) -> DataFrame:
    return both_ways(e).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("weight"), 6).alias("weighted_degree"))


#: Rows of a block of vectors at least and at most, and its bytes at most; blocks that rows are cut into if those allow; rows of a tile of a product; neighbours up to
#: which a row's best are kept in a block; places of a row whose largest similarities bound its k-th; pairs that are compared exactly at once.
BLOCK, MOST_BLOCK, BLOCK_BYTES, BLOCKS, TILE, FEW, PLACES, EXACT = 1024, 32_768, 16 << 20, 24, 1024, 256, 64, 1 << 15


def valid_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: one row for each key (of several its least vector), as long as the first key's, finite and not zero."""
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter("id IS NOT NULL AND size(v) > 0").groupBy("id").agg(F.min("v").alias("v"))
    first = rows.agg(F.min_by(F.size("v"), "id").alias("d")).first().d or 0
    return rows.filter(V.valid(F.col("v"), first))


def _where(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask that is nearly all false: eight places at a time."""
    flat = np.ascontiguousarray(mask).reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eight = np.flatnonzero(flat.view(np.uint64))
    return (eight[:, None] * 8 + np.arange(8))[flat.reshape(-1, 8)[eight]]


class _Best:
    """The best k of each row of a block, by descending similarity and then id. Columns come in the order of their ids, so of equal similarities the first ones
    stay: a later one must be larger than the k-th, and few are. Similarities come as float32, off by slack at most, and tell which pairs are compared exactly."""

    def __init__(self, n: int, k: int, threshold: float, slack: float):
        self.k, self.threshold, self.slack = k, threshold, slack + 1e-9
        self.s, self.at = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        self.low = np.full(n, threshold - self.slack, np.float32)  # what isn't over it can't come in any more

    def open(self, lo: int, s: np.ndarray, turned: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the pairs in a tile that may come in. s: similarities of the rows from lo on with columns; turned: of columns with the rows."""
        n, width = s.shape[turned], s.shape[not turned]
        low = self.low[lo : lo + n]
        if width > self.k and np.isneginf(self.s[lo : lo + n, -1]).any():  # no k yet: k of this tile are as large as the k-th largest of some, whichever
            if width % PLACES or self.k > PLACES // 2:
                some = s.T if turned else s
            else:
                some = s.reshape(-1, PLACES, n).max(axis=0).T if turned else s.reshape(n, -1, PLACES).max(axis=1)
            kth = np.partition(some, some.shape[1] - self.k, axis=1)[:, -self.k]
            low = np.maximum(low, kth - np.float32(2 * self.slack))
        at = _where(s > (low if turned else low[:, None]))
        return np.divmod(at, n)[::-1] if turned else np.divmod(at, width)

    def add(self, where: np.ndarray, names: np.ndarray, s: np.ndarray) -> None:
        """Similarities, exact and rounded, of rows with ids."""
        good = (s >= self.threshold) & (s > self.s[where, -1])
        where, s, names = where[good], s[good], names[good]
        if not len(where):
            return
        rows = np.flatnonzero(np.bincount(where, minlength=len(self.s)))
        old = np.nonzero(np.isfinite(self.s[rows]))
        node, value, name = (np.concatenate(x) for x in ((rows[old[0]], where), (self.s[rows][old], s), (self.at[rows][old], names)))
        order = np.argsort(4.0 * node - value, kind="stable")  # of equal ones by id, as they come; similarities are billionths apart
        node, value, name = node[order], value[order], name[order]
        place = np.arange(len(node)) - np.searchsorted(node, rows)[np.cumsum(np.concatenate(([0], node[1:] != node[:-1])))]
        first = place < self.k
        self.s[rows] = -np.inf
        self.s[node[first], place[first]], self.at[node[first], place[first]] = value[first], name[first]
        full = rows[np.isfinite(self.s[rows, -1])]
        self.low[full] = self.s[full, -1] - self.slack


def _exact(m1: np.ndarray, m2: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Similarities, rounded, of pairs of rows."""
    parts = [np.einsum("ij,ij->i", m1[row[lo : lo + EXACT]], m2[col[lo : lo + EXACT]]) for lo in range(0, len(row), EXACT)]
    return np.round(np.concatenate(parts), 9) if parts else np.zeros(0)


def _pairs(src: np.ndarray, dst: np.ndarray, similarity: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(similarity)], names=["src", "dst", "similarity"])


def nearest(vectors: DataFrame, key: str, vector: str, k: int, threshold: float = -1.0, block: int | None = None) -> DataFrame:
    """src, dst, similarity, rank: the k nearest others of each vector by cosine, those at or over threshold. Rows that are no
    valid vector (valid_vectors) have no neighbours.

    Exact. Rows with equal vectors are compared once, under their least id (_of_copies). The others go in blocks: rows are cut into BLOCKS blocks, or into more if those
    would be too large; each two blocks meet once, in tiles of a product of matrices that serve both, in single precision, and what its error leaves open is
    compared in double; only k a row go on. Blocks meet by an equi-join on the pair of their numbers, so nothing that grows is broadcast or gathered in one task, and no task has more
    than a pair at once. Copies of blocks grow with the rows as long as blocks may (MOST_BLOCK); the products grow with the square of the different vectors: that is
    what exactness costs.
    """
    rows = written(valid_vectors(vectors, key, vector), "vectors")
    kinds = written(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "vector-kinds")
    found = kinds.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.max("copies").alias("copies")).first()
    w = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    met = _met(kinds.select("id", "v"), found.n, found.d or 1, k, threshold, block)
    best = met.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
    return best if (found.copies or 1) == 1 else _of_copies(rows, kinds, best, k, threshold)


def _of_copies(rows: DataFrame, kinds: DataFrame, best: DataFrame, k: int, threshold: float) -> DataFrame:
    """nearest of all rows (id, v) from best, the nearest of the kinds (id, v, copies), each named by its least row. A row among the first k brings its kind's least row along, which
    is no later; so the first k rows are of a row's own kind and of the k kinds next to it, and of each kind the first k and one more will do."""
    several = kinds.filter("copies > 1").select("v", F.col("id").alias("kind"))
    members = written(rows.join(several, "v").select("kind", "id"), "vector-copies")
    first = written(members.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).filter(F.col("_n") <= k + 1).drop("_n"), "vector-first")
    own = first.select(F.col("kind").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("similarity")).filter(F.col("similarity") >= threshold)
    others = best.select("src", F.col("dst").alias("kind"), "similarity").join(first, "kind", "left").select("src", F.coalesce("id", "kind").alias("dst"), "similarity")
    order = [F.desc("similarity"), F.col("dst")]
    near = own.unionByName(others).withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy(*order))).filter(F.col("_n") <= k + 1).drop("_n").withColumnRenamed("src", "kind")
    alone = kinds.filter("copies = 1").select(F.col("id").alias("kind"), "id")
    out = members.select("kind", "id").unionByName(alone).join(near, "kind").filter("id <> dst").select(F.col("id").alias("src"), "dst", "similarity")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= k)


def _met(rows: DataFrame, n: int, d: int, k: int, threshold: float, block: int | None = None) -> DataFrame:
    """src, dst, similarity: of n different vectors (id, v) of d places at least the k nearest of each, at or over threshold."""
    block = block or min(max(BLOCK, -(-n // BLOCKS)), MOST_BLOCK, max(1, BLOCK_BYTES // (8 * d)))
    n_blocks = max(1, -(-n // block))
    cut = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    #: Of a product in float32: rounding of both vectors and of d products and sums.
    slack = (d + 8) * 6.1e-8

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        m = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        ids = t.column("id").to_numpy()
        return pa.table({"b": pa.array([t.column("b")[0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary())})

    blocks = written(cut.groupBy("b").applyInArrow(gather, "b bigint, ids binary, m binary"), "vector-blocks")
    left = blocks.select(F.col("b").alias("b1"), F.col("ids").alias("ids1"), F.col("m").alias("m1"), F.explode(F.sequence("b", F.lit(n_blocks - 1).cast("bigint"))).alias("b2"))
    right = blocks.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "b")).alias("b1"), F.col("b").alias("b2"), F.col("ids").alias("ids2"), F.col("m").alias("m2"))

    def met_in(i1, m1, i2, m2, same):
        """All similarities at or over the threshold, or the best k of each row, of two blocks, for the first one's rows and, if it is another, for the second one's."""
        f1, f2 = m1.astype(np.float32), m2.astype(np.float32)
        kept = [_Best(len(i), k, threshold, slack) for i in ((i1,) if same else (i1, i2))] if k <= FEW else None
        for a in range(0, len(i1), TILE):
            for b in range(0, len(i2), TILE):
                s = f1[a : a + TILE] @ f2[b : b + TILE].T
                if same and a == b:
                    np.fill_diagonal(s, -np.inf)
                if kept:
                    row, col = kept[0].open(a, s)
                    kept[0].add(row + a, i2[col + b], _exact(m1, m2, row + a, col + b))
                    if not same:
                        row, col = kept[1].open(b, s, True)
                        kept[1].add(row + b, i1[col + a], _exact(m1, m2, col + a, row + b))
                    continue
                row, col = np.divmod(_where(s > np.float32(threshold - slack - 1e-9)), s.shape[1])
                value = _exact(m1, m2, row + a, col + b)
                good = value >= threshold
                src, dst, value = i1[row[good] + a], i2[col[good] + b], value[good]
                yield _pairs(src, dst, value)
                if not same:
                    yield _pairs(dst, src, value)
        for ids, best in zip((i1, i2), kept or [], strict=False):
            row, col = np.nonzero(np.isfinite(best.s))
            yield _pairs(ids[row], best.at[row, col], best.s[row, col])

    def product(batches):
        for batch in batches:
            for lo in range(batch.num_rows):
                r = batch.slice(lo, 1).to_pylist()[0]
                i1, i2 = (np.frombuffer(r[c], np.int64) for c in ("ids1", "ids2"))
                yield from met_in(i1, np.frombuffer(r["m1"]).reshape(len(i1), -1), i2, np.frombuffer(r["m2"]).reshape(len(i2), -1), r["b1"] == r["b2"])

    return left.join(right.hint("merge"), ["b1", "b2"]).select("b1", "b2", "ids1", "m1", "ids2", "m2").mapInArrow(product, "src bigint, dst bigint, similarity double")


def label_propagation(nodes: DataFrame, e: DataFrame, rounds: int = 3) -> DataFrame:
    """node, label. Synchronous: each node takes the label with the largest weight around it (its own counts 0), the smallest of equal ones.
    Labels are written each round, so that a round's plan doesn't hold all those before."""
    labels = nodes.select("node", F.col("node").alias("label"))
    around = written(both_ways(e), "lpa-edges")
    for _ in range(rounds):
        votes = around.join(labels, around.dst == labels.node).groupBy(F.col("src").alias("node"), "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        best = votes.groupBy("node").agg(F.min_by("label", F.struct((-F.col("w")).alias("w"), F.col("label").alias("l"))).alias("new"))
        labels = written(labels.join(best, "node", "left").select("node", F.coalesce("new", "label").alias("label")), "lpa-labels")
    return labels


def components(e: DataFrame) -> DataFrame:
    """node, component (the least node that it is joined with) for all ends of edges src, dst. Each round a node takes the least label around it, and then
    the label of that label, so that long chains are short in few rounds."""
    around = written(e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "component-edges")
    labels = written(around.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("label")), "component-labels")
    while True:
        near = around.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        seen = Observation()
        new = met.join(up, "low", "left").select("node", F.least("low", "up").alias("label"), "old").observe(seen, F.count_if(F.col("label") < F.col("old")).alias("n"))
        new = written(new, "component-labels")
        dropped(labels)
        if not seen.get["n"]:
            return new.select("node", F.col("label").alias("component"))
        labels = new.drop("old")
        labels._corvane_path = new._corvane_path


def modularity(e: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of the partition (node, label)."""
    total = e.agg(F.sum("weight").alias("m"))
    inside = e.join(labels.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst").filter("ls = ld").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inner"))
    by_label = degrees(e).join(labels, "node").groupBy("label").agg(F.sum("weighted_degree").alias("d"))
    squares = by_label.agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return total.crossJoin(inside).crossJoin(squares).select(F.round(F.col("inner") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m")), 6).alias("modularity"))  # three one-row tables


def roll_up(e: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between parents (child, parent): weights of edges that cross are added up."""
    a = parents.select(F.col("child").alias("src"), F.col("parent").alias("pa"))
    b = parents.select(F.col("child").alias("dst"), F.col("parent").alias("pb"))
    up = e.join(a, "src").join(b, "dst").filter("pa <> pb")
    return up.groupBy(F.least("pa", "pb").alias("src"), F.greatest("pa", "pb").alias("dst")).agg(F.round(F.sum("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


def detect(nodes: DataFrame, e: DataFrame, algorithm: str = "label", resolution: float = 1.0, rounds: int = 3) -> DataFrame:
    """node, label for every node, by label propagation (at once or, "async", in turns), louvain or greedy modularity; nodes without an edge are alone."""
    name = algorithm.strip().lower()
    if name in ("label", "label_propagation"):
        return label_propagation(nodes, e, rounds)
    found = {"async": label_turns, "async_label": label_turns, "louvain": louvain, "auto": louvain, "greedy": greedy, "greedy_modularity": greedy}.get(name)
    if found is None:
        raise ValueError("algorithm must be one of: louvain, greedy, label, async")
    found = found(e) if found is label_turns else found(e, resolution)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


#: Steps of a level at most; the share of nodes that still want to move which a step is worth.
STEPS, WORTH = 40, 0.005
_LEAST_GAIN = 1e-9


def _in_turn(around: DataFrame, wanting: DataFrame, step: int) -> DataFrame:
    """Of the nodes that want to move (node, new) those that no neighbour which wants to move goes before: neighbours never move at once. The order is by a hash of
    node and step, another each step."""
    first = lambda node: F.struct(F.xxhash64(node, F.lit(step)), F.col(node))
    ends = around.select("src", "dst").join(wanting.select(F.col("node").alias("src")), "src", "left_semi").join(wanting.select(F.col("node").alias("dst")), "dst", "left_semi")
    return wanting.join(ends.filter(first("dst") > first("src")).select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def _harmless(around: DataFrame, wanting: DataFrame, step: int, crowding: float) -> DataFrame:
    """Of the nodes that want to move (node, own, new, degree, gain) those that may at once. Of two neighbours one of which wants to go where the other is now, one waits, by a
    hash of node and step, for its gain counts on the other; other neighbours only gain by each other's moves. Of those that go to the same community all go
    that would gain even after all others have come, and else the first: crowding is what a unit of their degrees costs a unit of a node's."""
    first = lambda node: F.struct(F.xxhash64(node, F.lit(step)), F.col(node))
    a = wanting.select(F.col("node").alias("src"), F.col("own").alias("own_a"), F.col("new").alias("new_a"))
    b = wanting.select(F.col("node").alias("dst"), F.col("own").alias("own_b"), F.col("new").alias("new_b"))
    waits = around.select("src", "dst").join(a, "src").join(b, "dst").filter(((F.col("new_a") == F.col("own_b")) | (F.col("new_b") == F.col("own_a"))) & (first("dst") > first("src")))
    go = wanting.join(waits.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    come = go.groupBy("new").agg(F.sum("degree").alias("come"), F.max_by("node", first("node")).alias("leader"))
    return go.join(come, "new").filter((F.col("node") == F.col("leader")) | (F.col("gain") > crowding * (F.col("come") - F.col("degree")) * F.col("degree"))).select("node", "new")


def _moved(around: DataFrame, state: DataFrame, votes_of, steps: int = STEPS, worth: float = WORTH, crowding: float | None = None) -> tuple[DataFrame, bool]:
    """state (node, label, degree) after steps in which nodes take the label with the best vote, until no more than a share, worth, want to; and
    whether any did. Neighbours never move at once (_in_turn), or, if crowding is told, only where it does no harm (_harmless).
    votes_of: (votes (node, own, degree, label, w), state) -> votes with vote. A node's own label is kept among equals, then the least is taken."""
    n, old = state.count(), []
    for step in range(steps):
        own = state.select("node", F.col("label").alias("own"), "degree")
        near = around.join(own, around.src == own.node).drop("src").join(state.select(F.col("node").alias("dst"), "label"), "dst")
        votes = near.groupBy("node", "own", "degree", "label").agg(F.sum("w").alias("w"))
        gain = F.max("vote") - F.coalesce(F.max(F.when(F.col("label") == F.col("own"), F.col("vote"))), F.lit(0.0))
        best = votes_of(votes, state).groupBy("node", "own", "degree").agg(F.min_by("label", F.struct((-F.round("vote", 9)).alias("v"), F.col("label") != F.col("own"), F.col("label").alias("l"))).alias("new"), gain.alias("gain"))
        seen = Observation()
        wanting = written(best.filter("new <> own").observe(seen, F.count(F.lit(1)).alias("n")), "graph-wanting")
        if seen.get["n"] <= worth * n:
            break
        turn = _in_turn(around, wanting.select("node", "new"), step) if crowding is None else _harmless(around, wanting, step, crowding)
        new = written(state.join(turn, "node", "left").select("node", F.coalesce("new", "label").alias("label"), "degree"), "graph-state")
        old += [wanting, new]
        state = new
    dropped(*old[:-1])
    return state, bool(old)


def _alone(degree: DataFrame) -> DataFrame:
    return degree.select("node", F.col("node").alias("label"), "degree")


def _whole(e: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Both ways of the added-up edges (src, dst, w), degrees (node, degree) and the total weight."""
    one = e.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    around = written(both_ways(one).withColumnRenamed("weight", "w"), "graph-edges")
    degree = around.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"))
    return around, degree, (around.agg(F.sum("w")).first()[0] or 0.0) / 2


def label_turns(e: DataFrame, steps: int = 10 * STEPS) -> DataFrame:
    """node, label (the least member): label propagation in turns, so that a node sees what its neighbours have taken before it. Where all at once may swing for ever (two sides
    of a graph trade their labels), this comes to rest."""
    around, degree, _ = _whole(e)
    state, _ = _moved(around, _alone(degree), lambda votes, _: votes.withColumn("vote", F.col("w")), steps, 0.0)
    return _least_members(state.select("node", "label"))


def _contracted(around: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of the labels: edges between them, added up, and their degrees (edges inside count twice, as before)."""
    to = lambda end: state.select(F.col("node").alias(end), F.col("label").alias(f"l_{end}"))
    up = around.join(to("src"), "src").join(to("dst"), "dst").filter("l_src <> l_dst").groupBy(F.col("l_src").alias("src"), F.col("l_dst").alias("dst")).agg(F.sum("w").alias("w"))
    return written(up, "graph-edges"), written(state.groupBy(F.col("label").alias("node")).agg(F.sum("degree").alias("degree")), "graph-nodes")


def _least_members(members: DataFrame) -> DataFrame:
    least = members.groupBy("label").agg(F.min("node").alias("least"))
    return members.join(least, "label").select("node", F.col("least").alias("label"))


def _improved(around: DataFrame, degree: DataFrame, total: float, resolution: float, members: DataFrame, times: int) -> DataFrame:
    """members (node, label) after moves of nodes in turns, then of the communities as nodes, until none moves; all of it so many times, each from what the
    last has found: nodes may leave the communities that they came along with."""

    def gains(votes: DataFrame, state: DataFrame) -> DataFrame:
        size = state.groupBy("label").agg(F.sum("degree").alias("size"))
        stay = votes.select("node", "own", "degree", F.col("own").alias("label"), F.lit(0.0).alias("w")).distinct()  # its own, also where no neighbour is in it
        all_of = votes.unionByName(stay).groupBy("node", "own", "degree", "label").agg(F.sum("w").alias("w")).join(size, "label")
        others = F.col("size") - F.when(F.col("label") == F.col("own"), F.col("degree")).otherwise(0.0)
        return all_of.withColumn("vote", F.col("w") - resolution * others * F.col("degree") / (2 * total))

    for _ in range(times if total else 0):
        level, state = around, degree.join(members, "node").select("node", "label", "degree")
        state, moves = _moved(level, state, gains, crowding=resolution / (2 * total))
        if not moves:
            break
        found = state.select("node", "label")
        while moves:
            level, size = _contracted(level, state)
            state, moves = _moved(level, _alone(size), gains, crowding=resolution / (2 * total))
            up = state.select(F.col("node").alias("label"), F.col("label").alias("up"))
            found = found.join(up, "label").select("node", F.col("up").alias("label"))
        members = written(found, "graph-members")
    return members


def louvain(e: DataFrame, resolution: float = 1.0) -> DataFrame:
    """node, label (the least member): modularity by moves of nodes, then of communities, in turns. What a move gains is told by partial sums (a node's weight
    to a community, the community's degree), so no community or neighbourhood is gathered anywhere. Each step is a written table."""
    around, degree, total = _whole(e)
    degree = written(degree, "graph-nodes")
    return _least_members(_improved(around, degree, total, resolution, degree.select("node", F.col("node").alias("label")), 2))


def greedy(e: DataFrame, resolution: float = 1.0) -> DataFrame:
    """node, label (the least member): modularity by merging, round by round. Every community has a best partner (the union that gains most, the least name of
    equals). Two that are each other's best merge, and with them others whose best is the smaller-named of the two, if they would gain even after all of
    those have come: a star of any size is gone in few rounds. Nodes then move as in louvain, once."""
    around, degree, total = _whole(e)
    members = written(degree.select("node", F.col("node").alias("label")), "graph-members")
    degree = written(degree, "graph-nodes")
    whole, sizes = around, degree
    while total:
        d = lambda end: degree.select(F.col("node").alias(end), F.col("degree").alias(f"d_{end}"))
        pairs = around.join(d("src"), "src").join(d("dst"), "dst").withColumn("gain", F.round(F.col("w") / total - resolution * F.col("d_src") * F.col("d_dst") / (2 * total * total), 12)).filter(F.col("gain") > _LEAST_GAIN / total)
        best = written(pairs.groupBy("src").agg(F.min_by(F.struct("dst", "w", "d_src", "d_dst"), F.struct((-F.col("gain")).alias("g"), F.col("dst").alias("x"))).alias("b")).select("src", "b.*"), "graph-best")
        hub = best.join(best.select(F.col("src").alias("p"), F.col("dst").alias("q")), (F.col("src") == F.col("q")) & (F.col("dst") == F.col("p"))).filter("src < dst").select(F.col("src").alias("hub"), F.col("dst").alias("mate"))
        suitors = best.join(hub, F.col("dst") == F.col("hub"))
        come = suitors.groupBy("hub").agg(F.sum("d_src").alias("come"))
        others = suitors.join(come, "hub").filter((F.col("src") == F.col("mate")) | (F.col("w") * 2 * total > resolution * F.col("d_src") * (F.col("d_dst") + F.col("come") - F.col("d_src"))))
        merged = written(others.select(F.col("src").alias("node"), F.col("hub").alias("up")), "graph-merged")
        if merged.isEmpty():
            break
        state = degree.join(merged, "node", "left").select("node", F.coalesce("up", "node").alias("label"), "degree")
        old = members
        members = written(members.withColumnRenamed("node", "member").join(state.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").select(F.col("member").alias("node"), F.col("up").alias("label")), "graph-members")
        around, degree = _contracted(around, state)
        dropped(old, best, merged)
    return _least_members(_improved(whole, sizes, total, resolution, members, 1))


def communities(labels: DataFrame, min_size: int = 1) -> DataFrame:
    """label, size, community (1-based: larger first, then the smaller least member)."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).filter(F.col("size") >= min_size).withColumn("less", -F.col("size"))
    return numbered(sizes, ["less", "least"], name="community").drop("least", "less")


def key_entities(members: DataFrame, degree: DataFrame, k: int = 24) -> DataFrame:
    """The k members of each community (label) with the largest weighted degree."""
    d = members.join(degree, "node")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("weighted_degree"), "node")).cast("bigint")).filter(F.col("rank") <= k)
