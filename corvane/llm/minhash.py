"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Documents with equal shingle sets are one class from the start: copies are never expanded into pairs.

1. Each class's signature is sorted in TREES orders. A region is the rows of an order that share a prefix. It starts at
   LEAST hashes and gets deeper, by the DEPTHS, until CROWD rows at most share it. Rows of a region that had to get deeper
   take part in MORE further orders (other choices of hashes of the same signature), which make up for the depth.
2. In a region all rows meet. A sketch of the whole signature tells which are alike; only a spanning forest of those
   goes on, so that what a region yields is linear in its rows. Rows that share a whole prefix of DEPTH hashes, and are more than
   CROWD, are taken as alike without meeting.
3. Components of what is alike are families. A pair with a similarity of 0.8 is in one family but for the misses that
   README tells; nothing else is decided here.
4. Families are brought together with their texts, once, and all their pairs are compared by full sets, but for those that are
   connected already. A family of over ROWS rows or SETS shingles is dealt into blocks, dealt again while that finds
   links (unless it has FEW blocks), and at last each two blocks meet that aren't of one and the same group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, functions as F

from .common import CACHED, dropped, packed, small, written

TREES, DEPTH, LEAST, MORE = 12, 8, 2, 36
DEPTHS, CROWD = (LEAST, 4, DEPTH), 512
HASHES = TREES * DEPTH
SCREEN = 0.62  # of the sketch's nibbles; at a similarity of 0.8 nearly five deviations under the 0.81 expected
SHINGLE, PERCENT = 4, 80
#: Of a block of a family.
ROWS, SETS = 1024, 1_000_000
#: Blocks of a family that isn't dealt again: its few pairs of blocks cost no more than deals would.
FEW = 4
#: Rows of regions, labels or ids that may be broadcast.
SMALL = 1_000_000

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(32)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= CACHED:
            self[word] = h
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The text's set of shingles as sorted hashes of 64 bits. A-Z are lower-cased; words are split at ASCII spaces."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        out = _mix(out * _M3 + h[k : len(words) - n + 1 + k])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 2048):
        np.minimum(best, (s[lo : lo + 2048, None] * _MUL + _ADD).min(axis=0), out=best)
    return (best >> _S).astype(np.uint32)


#: The places in the signature that each order sorts by: own hashes for the first TREES, then choices among all.
ORDERS = [list(range(t * DEPTH, (t + 1) * DEPTH)) for t in range(TREES)] + [_rng.choice(HASHES, DEPTH, replace=False).tolist() for _ in range(MORE)]


def _signatures(size):
    names = ["doc_id", "xh", "n", "key", "sig", "sketch"]

    def work(batches):
        for batch in batches:
            ids, xhs, texts = batch.columns
            for lo in range(0, batch.num_rows, 512):
                ns, keys, sigs, sketches = [], [], [], []
                for text in texts[lo : lo + 512].to_pylist():
                    s = shingles(text, size)
                    ns.append(len(s))
                    if not len(s):
                        keys.append(None), sigs.append(None), sketches.append(None)
                        continue
                    sig = signature(s)
                    low = (sig & np.uint32(15)).astype(np.uint8)
                    keys.append(xxhash.xxh128_digest(s.tobytes()))
                    sigs.append(sig.astype(">u4").tobytes())
                    sketches.append((low[0::2] | low[1::2] << 4).tobytes())
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 512], xhs[lo : lo + 512], pa.array(ns, pa.int64()), *(pa.array(c, pa.binary()) for c in (keys, sigs, sketches))], names=names)

    return work


#: Zero nibbles of a byte.
_ZEROS = np.array([(b & 15 == 0) + (b >> 4 == 0) for b in range(256)], np.uint8)


def _whole(batches, keys: list[str]):
    """Tables of whole groups: rows come sorted by keys, and the last group of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [c[-1] for c in (batch.column(k) for k in keys)]
        at = batch.num_rows
        while at and all(batch.column(k)[at - 1] == v for k, v in zip(keys, last, strict=True)):
            at -= 1
        if at or (held and any(held[-1].column(k)[-1] != v for k, v in zip(keys, last, strict=True))):
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that it is connected with by the edges i, j."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        low = np.minimum(label[i], label[j])
        for side in (i, j):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _meet(batches):
    """Rows sorted by tree, region, cid -> (a, b): a spanning forest, by stars, of the rows of a region that are alike."""
    for t in _whole(batches, ["tree", "region"]):
        tree, region, cid, n = (t.column(c).to_numpy() for c in ("tree", "region", "cid", "n"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES // 2)
        rows = len(tree)
        at = np.arange(rows)
        start = np.ones(rows, bool)
        start[1:] = (tree[1:] != tree[:-1]) | (region[1:] != region[:-1])
        first = np.maximum.accumulate(np.where(start, at, 0))
        found, ok = [], at[at > first]
        back = 1
        while len(ok):
            i, j = ok, ok - back
            fits = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            alike = _ZEROS[sketch[i] ^ sketch[j]].sum(axis=1) >= SCREEN * HASHES
            found.append((i[alike], j[alike]))
            back += 1
            ok = ok[ok - back >= first[ok]]
        if found:
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            label = _least(rows, i, j)
            own = label != at
            yield pa.RecordBatch.from_arrays([pa.array(cid[own]), pa.array(cid[label[own]])], names=["a", "b"])


def linked(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets that a chain of links connects: (i, j) by place, i > j. Sets of one group are connected
    already. With sides, only sets of different sides are compared."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(words), bool)
    root = np.unique(group, return_inverse=True)[1]
    out = []
    for x in range(1, len(sets)):
        rest = np.flatnonzero((root[:x] != root[x]) & (100 * np.minimum(sizes[:x], sizes[x]) >= PERCENT * np.maximum(sizes[:x], sizes[x])))
        if side is not None:
            rest = rest[side[rest] != side[x]]
        if not len(rest):
            continue
        mark[ids[begin[x] : ends[x]]] = True
        # A few first: in a group of near copies they connect the rest, which isn't compared then.
        step = 8
        while len(rest):
            some, rest = rest[:step], rest[step:]
            ahead = np.cumsum(sizes[some])
            places = np.arange(ahead[-1]) + np.repeat(begin[some] - (ahead - sizes[some]), sizes[some])
            both = np.add.reduceat(mark[ids[places]].astype(np.int64), ahead - sizes[some])
            for j in some[100 * both >= PERCENT * (sizes[some] + sizes[x] - both)]:
                if root[j] != root[x]:
                    out.append((x, int(j)))
                    root[root == root[j]] = root[x]
            rest = rest[root[rest] != root[x]]
            step = min(step * 4, 256)
        mark[ids[begin[x] : ends[x]]] = False
    return out


def _linked(size: int, sided: bool = False):
    """Rows (fam, block, side, cid, grp, text), sorted by fam, block, cid -> links (a, b) between groups, by the groups' numbers: of
    what a batch connects, each to the smallest."""

    def work(batches):
        for t in _whole(batches, ["fam", "block"]):
            fam, block, side, cid, grp = (t.column(c).to_numpy() for c in ("fam", "block", "side", "cid", "grp"))
            texts = t.column("text")
            edge = np.flatnonzero(np.concatenate(([True], (fam[1:] != fam[:-1]) | (block[1:] != block[:-1]), [True])))
            out = []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                at = lo + np.unique(cid[lo:hi], return_index=True)[1]  # rows that repeat an id and a text come once for each
                if len(at) > 1 and (grp[at] != grp[at[0]]).any():
                    sets = [shingles(texts[int(i)].as_py(), size) for i in at]
                    out += [(int(grp[at[i]]), int(grp[at[j]])) for i, j in linked(sets, grp[at], side[at] if sided else None)]
            if out:
                groups, places = np.unique(np.array(out), return_inverse=True)
                label = _least(len(groups), *places.reshape(-1, 2).T)
                own = label != np.arange(len(groups))
                yield pa.RecordBatch.from_arrays([pa.array(groups[own]), pa.array(groups[label[own]])], names=["a", "b"])

    return work


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (cid, comp) for every node in an edge: comp is the smallest node that can be reached.

    Small-star and large-star in turn, until each node has one link, to its component's smallest; links that are so from the
    start need no turn. Each step is a minimum by node (summed before the shuffle) and a plain join, so a node with a third
    of all links is no task of its own. Links stay in tables; those that repeat do no harm, and a turn adds one a node at most.
    """
    now, turn = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"), None
    while True:
        ends = now.select(F.col("a").alias("cid"), F.col("b").alias("to")).unionByName(now.select(F.col("b").alias("cid"), F.lit(None).cast("bigint").alias("to")))
        nodes = ends.groupBy("cid").agg(F.min("to").alias("to"), F.max("to").alias("most"), F.max(F.col("to").isNull()).alias("aim"))
        more = F.col("to").isNotNull() & (F.col("aim") | (F.col("to") < F.col("most")))
        # Told by the writing itself. A task that runs twice may count twice, but nothing is nothing.
        told = Observation()
        nodes = written(nodes.observe(told, F.count(F.lit(1)).alias("n"), F.sum(more.cast("bigint")).alias("more")).select("cid", F.coalesce("to", "cid").alias("comp")), "cc-nodes")
        if not told.get["more"]:
            if turn is not None:
                dropped(turn)
            return nodes
        few = F.broadcast if told.get["n"] <= SMALL else lambda df: df
        # Small-star: what a node is linked to goes to its least, and so does the node.
        small_star = now.join(few(nodes), F.col("a") == F.col("cid")).select(F.col("b").alias("v"), "comp").unionByName(nodes.select(F.col("cid").alias("v"), "comp")).filter("v <> comp")
        # Large-star: of a node's links, those to larger ones go to the least of all.
        both = small_star.select(F.col("v").alias("u"), F.col("comp").alias("v")).unionByName(small_star.select(F.col("comp").alias("u"), "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        new = written(both.filter("v > u").join(few(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b")), "cc")
        dropped(nodes, *([] if turn is None else [turn]))
        now = turn = new


def _alike(classes: DataFrame) -> list[DataFrame]:
    """classes (cid, n, sig, sketch) -> edges (a, b) of what is alike.

    Regions of all depths are counted at once for the rows that need it, and each row goes to the first of its regions
    that isn't crowded, once. Rows of a crowded region join in the further orders too.
    """

    def orders(of: DataFrame, lo: int, hi: int) -> DataFrame:
        cut = [F.concat(*[F.substring("sig", p * 4 + 1, 4) for p in ORDERS[t]]) if t >= TREES else F.substring("sig", t * DEPTH * 4 + 1, DEPTH * 4) for t in range(lo, hi)]
        return of.select("cid", "n", "sketch", F.posexplode(F.array(*cut)).alias("tree", "prefix")).withColumn("tree", F.col("tree") + lo)

    def region(depth: int):
        return F.substring("prefix", 1, depth * 4)

    columns = ["tree", "region", "cid", "n", "sketch"]
    rows = orders(classes, 0, TREES).withColumn("region", region(LEAST))
    # Rows alone in their region meet nobody.
    sizes = written(rows.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("tree").alias("t"), F.col("region").alias("r"), "m"), "minhash-regions")
    same = (F.col("tree") == F.col("t")) & (F.col("region") == F.col("r"))
    meeting = rows.join(small(sizes.filter(F.col("m") <= CROWD), SMALL), same, "left_semi").select(*columns)
    edges, tables, crowded = [], [sizes], sizes.filter(F.col("m") > CROWD)
    if not crowded.isEmpty():
        deeper = written(rows.join(small(crowded, SMALL), same, "left_semi").drop("region"), "minhash-deeper")
        deeper_too = orders(classes.join(small(deeper.select("cid"), SMALL), "cid", "left_semi"), TREES, TREES + MORE)
        names = ["wide", "narrow", "whole"]
        rows = deeper.unionByName(deeper_too).withColumns({k: region(d) for k, d in zip(names, DEPTHS, strict=True)}).drop("prefix")
        counted = rows.groupingSets([["tree", k] for k in names], "tree", *names).agg(F.count(F.lit(1)).alias("m"), F.min("cid").alias("low"))
        sizes = written(counted.filter("m > 1").select(F.col("tree").alias("t"), F.coalesce(*names).alias("r"), "m", "low"), "minhash-regions")
        placed = rows.withColumn("region", F.col(names[-1]))
        for k in reversed(names[:-1]):
            crowded = sizes.filter((F.col("m") > CROWD) & (F.length("r") == DEPTHS[names.index(k)] * 4)).select(F.col("t").alias("ct"), F.col("r").alias("cr"))
            placed = placed.join(small(crowded, SMALL), (F.col("tree") == F.col("ct")) & (F.col(k) == F.col("cr")), "left").withColumn("region", F.when(F.col("ct").isNull(), F.col(k)).otherwise(F.col("region"))).drop("ct", "cr")
        placed = written(placed.join(small(sizes, SMALL), same).select(*columns, "m", "low"), "minhash-placed")
        meeting = meeting.unionByName(placed.filter(F.col("m") <= CROWD).select(*columns))
        edges.append(written(placed.filter(F.col("m") > CROWD).select(F.col("cid").alias("a"), F.col("low").alias("b")).filter("a <> b"), "minhash-alike"))
        tables += [deeper, sizes, placed]
    edges.append(written(meeting.repartition("tree", "region").sortWithinPartitions("tree", "region", "cid").mapInArrow(_meet, "a bigint, b bigint"), "minhash-alike"))
    dropped(*tables)
    return edges


def _spread(rows: DataFrame, shingles_in_all: int) -> DataFrame:
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles_in_all // (4 * SETS)))
    return rows.repartition(parts, "fam", "block").sortWithinPartitions("fam", "block", "cid")


_COLUMNS = ["fam", "block", "side", "cid", "grp", "text"]


def _many_blocks(rows: DataFrame, groups: DataFrame, most: int, size: int) -> DataFrame:
    """rows (fam, k, cid, n, text) of families of several blocks, and groups (cid, grp) of those that are in one with others -> (cid, grp), whole."""
    zero = F.lit(0).cast("bigint")
    total = int(rows.agg(F.sum("n")).first()[0] or 0)
    at = written(rows.select("cid").join(small(groups, SMALL), "cid", "left").select("cid", F.coalesce("grp", "cid").alias("grp")), "minhash-groups")

    def connected(links: DataFrame) -> bool:
        nonlocal at
        links = written(links, "minhash-links")
        some = not links.isEmpty()
        if some:
            merged = components(links)
            old, at = at, written(at.join(small(merged.select(F.col("cid").alias("grp"), "comp"), SMALL), "grp", "left").select("cid", F.coalesce("comp", "grp").alias("grp")), "minhash-groups")
            dropped(old, merged)
        dropped(links)
        return some

    def mixed() -> DataFrame:
        """Rows with their groups, of families with more groups than one."""
        r = rows.join(small(at, SMALL), "cid")
        several = r.groupBy("fam").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).filter("x < y").select("fam")
        return r.join(small(several, SMALL), "fam", "left_semi")

    for nth in range(1, most.bit_length() + 2 if most > FEW else 1):  # what these deals leave, the last step finds
        dealt = mixed().filter(F.col("k") > FEW).withColumn("block", F.pmod(F.xxhash64("cid", F.lit(nth)), F.col("k"))).withColumn("side", zero)
        if not connected(_spread(dealt.select(*_COLUMNS), total).mapInArrow(_linked(size), "a bigint, b bigint")):
            break
    # Large groups have blocks of their own, small ones share some; each two blocks meet but those of one group.
    rest = rows.join(small(at, SMALL), "cid")
    per = rest.groupBy("fam", "grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).withColumn("b", F.greatest(F.ceil(F.col("m") / ROWS), F.ceil(F.col("s") / SETS)))
    per = written(per.withColumn("own", F.col("b") > 1), "minhash-per")
    few = F.greatest(F.ceil(F.sum(F.when(~F.col("own"), F.col("m"))) / ROWS), F.ceil(F.sum(F.when(~F.col("own"), F.col("s"))) / SETS))
    pools = written(per.groupBy("fam").agg(F.count(F.lit(1)).alias("groups"), few.alias("pools")).filter("groups > 1").drop("groups"), "minhash-pools")
    name = F.when(F.col("own"), F.xxhash64("grp", F.pmod(F.xxhash64("cid"), F.col("b")))).otherwise(F.pmod(F.xxhash64("grp"), F.col("pools")))
    owner = F.when(F.col("own"), F.col("grp"))
    placed = written(rest.join(small(per, SMALL), ["fam", "grp"]).join(small(pools, SMALL), "fam").select("fam", "cid", "grp", "n", "text", name.alias("at"), owner.alias("owner")), "minhash-placed")
    blocks = placed.groupBy("fam", "at").agg(F.max("owner").alias("owner"))
    x, y = blocks.select("fam", F.col("at").alias("p"), F.col("owner").alias("po")), blocks.select("fam", F.col("at").alias("q"), F.col("owner").alias("qo"))
    two = written(x.join(y, "fam").filter("p <= q AND NOT (po IS NOT NULL AND qo IS NOT NULL AND po = qo)").select("fam", "p", "q", F.xxhash64("p", "q").alias("block")), "minhash-blocks")
    ends = two.select("fam", F.col("p").alias("at"), "block", zero.alias("side"), (F.col("p") == F.col("q")).alias("same")).unionByName(two.filter("p <> q").select("fam", F.col("q").alias("at"), "block", F.lit(1).cast("bigint").alias("side"), F.lit(False).alias("same")))
    # Within one block each row is a side of its own.
    both = placed.join(small(ends, SMALL), ["fam", "at"]).withColumn("side", F.when(F.col("same"), F.col("cid")).otherwise(F.col("side")))
    connected(_spread(both.select(*_COLUMNS), total).mapInArrow(_linked(size, True), "a bigint, b bigint"))
    dropped(per, pools, placed, two)
    return at


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row, in docs' own order of nothing.

    Null texts and texts without words have no shingle and are linked with nothing, not with one another: component_id is their own id.
    Null ids count as larger than any other; rows that repeat are in one component by their equal sets, and kept tells of ids, so all rows with
    the least id are kept (keep_near has one row). A text of any length is one set. An empty table gives an empty one; further columns
    of any name aren't read.
    """
    return _grouped(docs, id_col, text_col, size).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, xh, n, component_id, and least, the smallest (doc_id, xh) of the component, for every row."""
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("xh"), text.alias("text"))
    rows = written(texts.mapInArrow(_signatures(size), "doc_id bigint, xh bigint, n bigint, key binary, sig binary, sketch binary"), "minhash-rows")
    # One row for each class of equal sets; cid is its number, fixed once written. Null ids come last.
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "xh")
    sets = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min(least).alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("sketch").alias("sketch"))
    classes = written(sets.withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")

    edges = _alike(classes)
    every = edges[0]
    for more in edges[1:]:
        every = every.unionByName(more)
    labels = components(every)
    dropped(*edges)
    families = written(classes.join(small(labels, SMALL), "cid").select("cid", F.col("comp").alias("fam"), "n", F.col("rep.doc_id").alias("rid"), F.col("rep.xh").alias("rxh")), "minhash-families")
    dropped(labels)
    counts = families.groupBy("fam").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    counts = written(counts.select("fam", "s", F.greatest(F.ceil(F.col("m") / ROWS), F.ceil(F.col("s") / SETS)).alias("k")), "minhash-sizes")
    found = counts.agg(F.max("k").alias("k"), F.sum("s").alias("s")).first()
    groups = None
    if found.k:
        members = families.join(small(counts.select("fam", "k"), SMALL), "fam")
        some = texts.join(small(members, SMALL), (F.col("xh") == F.col("rxh")) & F.col("doc_id").eqNullSafe(F.col("rid"))).select("fam", "k", "cid", "n", "text", "rid", "rxh")
        # Rows that repeat an id and a text would bring a class's text as often.
        twice = written(rows.filter("key IS NOT NULL").groupBy("doc_id", "xh").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("doc_id").alias("tid"), F.col("xh").alias("txh")), "minhash-twice")
        if not twice.isEmpty():
            same = F.col("rid").eqNullSafe(F.col("tid")) & (F.col("rxh") == F.col("txh"))
            once = some.join(small(twice, SMALL), same, "left_semi").groupBy("fam", "k", "cid", "n").agg(F.first("text").alias("text"))
            some = some.join(small(twice, SMALL), same, "left_anti").select(*once.columns).unionByName(once)
        some = some.drop("rid", "rxh")
        if found.k > 1:
            some = written(some, "minhash-texts")
        dealt = some.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("k"))).withColumn("side", F.lit(0).cast("bigint")).withColumn("grp", F.col("cid"))
        links = written(_spread(dealt.select(*_COLUMNS), int(found.s)).mapInArrow(_linked(size), "a bigint, b bigint"), "minhash-links")
        groups = components(links).withColumnRenamed("comp", "grp")
        if found.k > 1:
            several = _many_blocks(some.filter("k > 1"), groups, int(found.k), size)
            groups = written(groups.join(small(several, SMALL), "cid", "left_anti").unionByName(several), "minhash-labels")
        dropped(links)
    dropped(families, counts)
    found = classes.select("key", "cid", F.col("rep").alias("least"))
    if groups is not None:
        # Only classes of a group have another's smallest row.
        members = classes.join(small(groups.withColumnRenamed("cid", "gid"), SMALL), F.col("cid") == F.col("gid"))
        lows = written(members.groupBy("grp").agg(F.min("rep").alias("low")), "minhash-lows")
        of = written(groups.join(small(lows, SMALL), "grp").select(F.col("cid").alias("gid"), "low"), "minhash-found")
        found = found.join(small(of, SMALL), F.col("cid") == F.col("gid"), "left").withColumn("least", F.coalesce("low", "least"))
    found = found.select("key", "least")
    out = rows.select("doc_id", "xh", "n", "key").join(found, "key", "left")
    alone = F.col("key").isNull()
    return out.select("doc_id", "xh", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), "least")


def keep_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row of each group, with docs' own columns: the row of the smallest id; of rows equal in id and text any one. Rows without
    words all stay. Null ids, empty tables and long texts are as in near_groups; columns of any name pass through."""
    grouped = _grouped(docs, id_col, text_col, size)
    # Rows by (id, hash of the text): how many there are, and whether they are their group's first.
    kept = grouped.filter("least IS NULL OR (doc_id <=> least.doc_id AND xh <=> least.xh)").groupBy("doc_id", "xh").agg(F.count(F.lit(1)).alias("m"), F.first("least").isNull().alias("bare"))
    kept = written(kept.select(F.col("doc_id").alias("_kid"), F.col("xh").alias("_kxh"), ((F.col("m") > 1) & ~F.col("bare")).alias("_repeats")), "minhash-kept")
    rows = packed(docs).withColumn("_id", F.col(f"_row.`{id_col}`").cast("bigint")).withColumn("_xh", F.xxhash64(F.col(f"_row.`{text_col}`").cast("string")))
    rows = rows.join(small(kept, SMALL), F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_xh") == F.col("_kxh")))
    out = rows.filter("NOT _repeats")
    if not kept.filter("_repeats").isEmpty():
        out = out.unionByName(rows.filter("_repeats").dropDuplicates(["_kid", "_kxh"]))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
