"""Keyword search by an index of substrings: exact top k of keyword_scores, reading only what can win.

Chunks are numbered as they are written, 64 to a block. A posting (gram, block) tells for a few code points in a row which chunks of
the block hold them (docs), and in which they stand first before two places (near, early): one bit a chunk. A term can only be
in a chunk that holds all of its grams, no earlier than they allow; so the postings of its grams, joined bit by bit, bound
what the term adds to the chunk's score, and sums over terms bound the scores of chunks and of whole blocks.

A search takes the blocks with the largest bounds, scores the chunks with the largest bounds there by their text, and so
has a score that k chunks reach. After that only blocks, and in them only chunks, whose bound reaches this score are looked at. What
is found is scored by its text, so that the result is the same as that of a scan.

The index is some times as large as the text. A scan (scan) reads each text once for all questions, writes and shuffles nothing of it, and is what chunks without an index get.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..operators import ranking as R
from ..tables import written

#: Code points of a gram (one less for terms that are no longer); chunks of a block; places before which a first occurrence counts (those of the keyword score).
GRAM, BLOCK, NEAR, EARLY = 4, 64, 120, 500
#: A term's grams beyond so many tell nothing of places; the masks of places allow for that.
FRONT = 32
#: Code points whose grams are found at once.
PIECE = 1 << 20
#: Pairs of question and chunk, and letters of all questions' terms, up to which they are broadcast.
PAIRS = 1_000_000
#: Ranges of blocks that a scan is told to read.
RANGES, BLOCKS = 32, 10_000
#: What is scored first, for a score that k chunks reach: chunks for each of k, of so many blocks at least.
FIRST_CHUNKS, FIRST_BLOCKS = 8, 16
_SLACK = 1e-6


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks with block and bit; to be written at once, for the numbers follow the order of rows."""
    n = F.monotonically_increasing_id()
    return chunks.withColumn("block", F.shiftright(n, 6)).withColumn("bit", n.bitwiseAND(F.lit(BLOCK - 1)).cast("int"))


def first_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a text and the place where each stands first. A gram is named by the low 16 bits of its code points; those that share a name share
    their masks, which makes bounds larger but never too small."""
    found, places = [], []
    for lo in range(0, len(text), PIECE):
        c = np.frombuffer(text[lo : lo + PIECE + GRAM - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) & 0xFFFF
        name = c
        for k in range(1, min(GRAM, len(c))):
            name = name[:-1] << 16 | c[k:]
            if k >= GRAM - 2:
                g, at = np.unique(name[:PIECE], return_index=True)
                found.append(g)
                places.append(at + lo)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, p = np.concatenate(found), np.concatenate(places)
    order = np.lexsort((p, g))
    g, p = g[order], p[order]
    first = np.concatenate(([True], g[1:] != g[:-1]))
    return g[first], p[first]


def postings(chunks: DataFrame) -> DataFrame:
    """gram, block, docs, early, near of numbered chunks with their searchable text. Null and short texts have none."""
    names = ["gram", "block", "docs", "early", "near"]

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4 * BLOCK):
                grams, blocks, bits, at = [], [], [], []
                for text, block, bit in zip(*(c.to_pylist() for c in batch.slice(lo, 4 * BLOCK).columns), strict=True):
                    g, first = first_places(text or "")
                    grams.append(g)
                    at.append(first)
                    blocks.append(np.full(len(g), block, np.int64))
                    bits.append(np.full(len(g), np.int64(1) << np.int64(bit), np.int64))
                g, b, m, first = (np.concatenate(x) for x in (grams, blocks, bits, at))
                if not len(g):
                    continue
                order = np.lexsort((b, g))
                g, b, m, first = g[order], b[order], m[order], first[order]
                start = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (b[1:] != b[:-1]))))
                masks = [np.bitwise_or.reduceat(np.where(first < limit, m, 0), start) for limit in (1 << 62, EARLY + FRONT, NEAR + FRONT)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g[start], b[start], *masks)], names=names)

    rows = chunks.select("searchable", "block", "bit").mapInArrow(work, ", ".join(f"{n} bigint" for n in names))
    return rows.groupBy("gram", "block").agg(*[F.bit_or(n).alias(n) for n in names[2:]])


def with_postings(chunks: DataFrame, name: str) -> DataFrame:
    """Written chunks (numbered, with searchable) whose keyword searches go through an index from now on."""
    found = postings(chunks)
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks._corvane_postings = written(found.repartitionByRange(n, "gram", "block").sortWithinPartitions("gram", "block"), name)
    return chunks


def postings_of(chunks: DataFrame) -> DataFrame | None:
    return getattr(chunks, "_corvane_postings", None)


def grams_of(term: Column) -> Column:
    """The grams of a term, as postings name them."""
    codes = F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.ascii(F.substring(term, i, F.lit(1))).cast("bigint").bitwiseAND(F.lit(0xFFFF)))
    size = F.least(F.length(term), F.lit(GRAM))
    return F.transform(F.sequence(F.lit(1), F.length(term) - size + 1), lambda i: F.aggregate(F.slice(codes, i, size), F.lit(0).cast("bigint"), lambda a, c: F.shiftleft(a, 16).bitwiseOR(c)))


def block_bounds(index: DataFrame, asked: DataFrame, share=F.broadcast) -> DataFrame:
    """qid, block, bound, terms: what chunks of a block reach at most, and each term's masks. asked: qid, term (of three letters or more),
    weight, anchor. share: broadcasts what follows from the questions alone, or doesn't."""
    terms = asked.select("term").distinct().select("term", grams_of(F.col("term")).alias("gs"))
    pieces = terms.select("term", F.size("gs").alias("n"), F.posexplode("gs").alias("i", "gram"))
    masks = index.join(share(pieces), "gram")
    placed = lambda c: F.bit_and(F.when(F.col("i") < FRONT, F.col(c)).otherwise(F.lit(-1).cast("bigint"))).alias(c)
    held = masks.groupBy("term", "block").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.bit_and("docs").alias("docs"), placed("early"), placed("near")).filter("k = n AND docs <> 0")
    base = F.col("weight") * (1 + F.log(1 + F.when(F.col("anchor"), 1.0).otherwise(3.0)))
    most = F.when(F.col("docs").bitwiseAND(F.col("near")) != 0, F.col("weight")).when(F.col("docs").bitwiseAND(F.col("early")) != 0, 0.5 * F.col("weight")).otherwise(0.0)
    rows = held.join(share(asked), "term").select("qid", "block", (base + most).alias("most"), F.struct(base.alias("base"), "weight", "anchor", "docs", "early", "near").alias("t"))
    return rows.groupBy("qid", "block").agg(F.sum("most").alias("bound"), F.collect_list("t").alias("terms")).filter("exists(terms, t -> t.anchor)")


def chunk_bounds(blocks: DataFrame, *more: str) -> DataFrame:
    """qid, block, more, bit and bound of each chunk that may hold an anchor."""
    bound = "aggregate(terms, 0D, (a, t) -> a + if(getbit(t.docs, b) = 0, 0D, t.base + if(getbit(t.near, b) = 1, t.weight, if(getbit(t.early, b) = 1, 0.5D * t.weight, 0D))))"
    each = blocks.withColumn("some", F.expr("aggregate(terms, 0L, (a, t) -> a | if(t.anchor, t.docs, 0L))")).withColumn("bits", F.expr(f"filter(sequence(0, {BLOCK - 1}), b -> getbit(some, b) = 1)"))
    return each.select("qid", "block", *more, F.explode(F.expr(f"transform(bits, b -> struct(b AS bit, {bound} AS bound))")).alias("x")).select("qid", "block", *more, "x.bit", "x.bound")


def scored(chunks: DataFrame, pairs: DataFrame, terms: DataFrame, share=F.broadcast) -> DataFrame:
    """qid, doc_id, keyword_score of pairs (qid, block, bit) by their text; those without an anchor go. terms: qid, terms.

    If the pairs' blocks are few (BLOCKS), the scan is told to read RANGES ranges of blocks that hold them, and pairs are broadcast up to PAIRS."""
    rows = chunks.select("doc_id", "searchable", "block", "bit")
    asked = pairs.select("qid", "block", "bit").join(share(terms), "qid")
    found = sorted(map(tuple, pairs.groupBy("block").count().limit(BLOCKS + 1).collect()))
    if found and len(found) <= BLOCKS:
        gaps = sorted(sorted(range(1, len(found)), key=lambda i: found[i - 1][0] - found[i][0])[: RANGES - 1])
        cuts = [0, *gaps, len(found)]
        rows = rows.filter(reduce(Column.__or__, [F.col("block").between(found[a][0], found[b - 1][0]) for a, b in zip(cuts, cuts[1:], strict=False)]))
        asked = F.broadcast(asked) if sum(n for _, n in found) <= PAIRS else asked
    rows = rows.join(asked, ["block", "bit"]).filter("exists(terms, t -> t.anchor AND contains(searchable, t.term))")
    return rows.select("qid", "doc_id", F.round(T.keyword_score("searchable", "terms"), 9).alias("keyword_score"))


def search(chunks: DataFrame, questions: DataFrame, k: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """qid, doc_id, keyword_score, keyword_rank of the best k; and what was looked at: blocks (qid, block, bound, terms) of all questions, the
    pairs (qid, block, bit, bound) that were scored first, and then."""
    terms = written(questions.select("qid", T.query_terms(F.col("question")).alias("terms")), "asked-terms")
    asked = terms.select("qid", F.explode("terms").alias("t")).select("qid", "t.*")
    size = asked.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]  # letters: at least as many as terms, or their grams
    share = F.broadcast if size <= PAIRS else lambda df: df
    blocks = written(block_bounds(postings_of(chunks), asked, share), "block-bounds")
    first = R.ranked(blocks, ["qid"], [F.desc("bound"), F.col("block")], max(FIRST_BLOCKS, -(-FIRST_CHUNKS * k // BLOCK)), "r").drop("r")
    tried = written(R.ranked(chunk_bounds(first), ["qid"], [F.desc("bound"), F.col("block"), F.col("bit")], FIRST_CHUNKS * k, "r").drop("r"), "first-pairs")
    least = R.ranked(scored(chunks, tried, terms, share), ["qid"], [F.desc("keyword_score"), F.col("doc_id")], k, "r").filter(F.col("r") == k).select("qid", F.col("keyword_score").alias("least"))
    enough = (F.col("bound") + _SLACK >= F.col("least")) | F.col("least").isNull()  # fewer than k so far: all are looked at
    still = blocks.join(share(least), "qid", "left").filter(enough)
    pairs = written(chunk_bounds(still, "least").filter(enough).drop("least"), "pairs")
    return R.ranked(scored(chunks, pairs, terms, share), ["qid"], [F.desc("keyword_score"), F.col("doc_id")], k, "keyword_rank"), {"blocks": blocks, "first": tried, "then": pairs}


def report(seen: dict[str, DataFrame]) -> DataFrame:
    """qid, blocks (with a bound above 0), blocks_read, chunks_scored (both times) of a search."""
    both = seen["first"].select("qid", "block").unionAll(seen["then"].select("qid", "block"))
    return seen["blocks"].groupBy("qid").agg(F.count(F.lit(1)).alias("blocks")).join(both.groupBy("qid").agg(F.count_distinct("block").alias("blocks_read"), F.count(F.lit(1)).alias("chunks_scored")), "qid")


#: Letters of a run; a term of these alone lies within a run of them. Runs that a scan remembers the terms of, and their length at most; chunks that are scored at once; terms up to
#: which each is sought by itself, for cutting a text into runs takes longer.
RUN, RUNS, RUN_CHARS, ROWS, SOUGHT = re.compile(r"[a-z0-9_-]+"), 200_000, 64, 512, 64


class _Terms:
    """Which of some terms a text holds."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        in_runs = {t for t in terms if len(terms) > SOUGHT and RUN.fullmatch(t)}
        self.lengths = sorted({len(t) for t in in_runs})
        self.others = [(t, i) for i, t in enumerate(terms) if t not in in_runs]
        self.known: dict[str, dict[int, int]] = {}

    def within(self, run: str) -> dict[int, int]:
        """The terms in a run, and where each stands first."""
        found = self.known.get(run)
        if found is None:
            found = {}
            for n in self.lengths:
                for i in range(len(run) - n + 1):
                    t = self.number.get(run[i : i + n])
                    if t is not None:
                        found.setdefault(t, i)
            if len(run) <= RUN_CHARS and len(self.known) < RUNS:
                self.known[run] = found
        return found

    def places(self, text: str) -> dict[int, int]:
        """The terms that a text holds, and where each stands first, or EARLY if that is no earlier."""
        found: dict[int, int] = {}
        for run in set(RUN.findall(text)) if self.lengths else ():
            held = self.within(run)
            if held:
                found.update(dict.fromkeys(held, EARLY))
        for m in RUN.finditer(text) if self.lengths else ():
            if m.start() >= EARLY:
                break
            for t, i in self.within(m[0]).items():
                found[t] = min(found[t], m.start() + i)
        for t, i in self.others:
            at = text.find(t)
            if at >= 0:
                found[i] = min(at, EARLY)
        return found


def _summed(asked: list[tuple]):
    """asked: (qid, [(term, weight, anchor)]). Their terms, and a function of these (_Terms) and texts that tells of each question with anchors its place in asked, which texts hold an
    anchor, and their sums. Values are added up in the order of the terms, as T.keyword_score does."""
    terms = sorted({t for _, ts in asked for t, _, _ in ts})
    number = {t: i for i, t in enumerate(terms)}
    kinds = sorted({x for _, ts in asked for x in ts})  # a term with its weight
    of = np.array([number[t] for t, _, _ in kinds], np.int64)
    weight, anchor = np.array([w for _, w, _ in kinds], float), np.array([a for *_, a in kinds], bool)
    counted = [(f, number[t], t) for f, (t, _, a) in enumerate(kinds) if not a]
    where = {x: f for f, x in enumerate(kinds)}
    needs = [([where[x] for x in ts if x[2]], [where[x] for x in ts if not x[2]]) for _, ts in asked]  # anchors come first
    base = {n: math.log(1 + n) for n in (1, 2, 3)}

    def values(found: list[dict[int, int]], texts: list[str]) -> np.ndarray:
        place = np.full((len(terms), len(found)), -1, np.int64)
        for i, at in enumerate(found):
            place[list(at), i] = list(at.values())
        p = place[of]
        more = np.where(p < NEAR, weight[:, None], np.where(p < EARLY, 0.5 * weight[:, None], 0.0))
        out = weight[:, None] * (1 + base[1]) + more
        for f, t, term in counted:
            for i in np.flatnonzero(place[t] >= 0):
                out[f, i] = weight[f] * (1 + base[min(3, texts[i].count(term))]) + more[f, i]
        return np.where(p >= 0, out, 0.0)

    def sums(seek: _Terms, texts: list[str]):
        value = values([seek.places(t) for t in texts], texts)
        for q, (anchors, intents) in enumerate(needs):
            if not anchors:
                continue
            s = np.add.reduce(value[anchors], axis=0)
            held = s > 0
            for f in intents:
                s = s + value[f]
            yield q, held, s

    return terms, sums


def _scanned(asked: list[tuple], k: int, numeric: bool):
    """A function of batches (doc_id, searchable) that finds the best k of each question of asked among them. Values are compared as they are when rounded."""
    terms, sums = _summed(asked)

    def work(batches):
        seek, best = _Terms(terms), [[] for _ in asked]
        least = np.full(len(asked), -np.inf)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                ids, texts = (c.to_pylist() for c in batch.slice(lo, ROWS).columns)
                ids, texts = zip(*[(i, t) for i, t in zip(ids, texts, strict=True) if t is not None], strict=True) if any(t is not None for t in texts) else ((), ())
                if not texts:
                    continue
                order = np.array(ids, np.int64 if numeric else object)
                for q, held, s in sums(seek, texts):
                    r = np.round(s, 9)
                    new = np.flatnonzero(held & (r >= least[q]))
                    if len(best[q]) == k and len(new):
                        new = new[(r[new] > least[q]) | (order[new] < best[q][-1][1])]
                    if len(new):
                        best[q] = sorted(best[q] + [(-r[i], ids[i], float(s[i])) for i in new], key=lambda x: x[:2])[:k]
                        least[q] = -best[q][-1][0] if len(best[q]) == k else -np.inf
        rows = [(asked[q][0], i, s) for q, b in enumerate(best) for _, i, s in b]
        yield from (rows,) if rows else ()

    return work


def scan(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, keyword_score, keyword_rank of the best k, as search finds them: each text is read once for all questions (a batch of them), its runs of letters tell
    which terms it holds, and only k rows of each task and question go on. chunks: doc_id, searchable; questions, of which there are few: qid, terms."""
    kinds = {c: chunks.schema["doc_id"].dataType if c == "doc_id" else questions.schema["qid"].dataType for c in ("qid", "doc_id")}
    schema = f"qid {kinds['qid'].simpleString()}, doc_id {kinds['doc_id'].simpleString()}, s double"
    asked = [(r.qid, [(t.term, t.weight, t.anchor) for t in r.terms]) for r in questions.select("qid", "terms").collect()]
    find = _scanned(asked, k, kinds["doc_id"].simpleString() in ("bigint", "int", "smallint", "tinyint"))

    def work(batches):
        for rows in find(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["qid", "doc_id", "s"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kinds["qid"]), to_arrow_type(kinds["doc_id"]), pa.float64()]
    s = chunks.select("doc_id", "searchable").mapInArrow(work, schema).select("qid", "doc_id", F.round("s", 9).alias("keyword_score"))
    return R.ranked(s, ["qid"], [F.desc("keyword_score"), F.col("doc_id")], k, "keyword_rank")


def scores(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, source, doc_id, keyword_score of each chunk that holds an anchor of a question which looks at it; each text is read once for all of them. chunks: doc_id, source,
    searchable, qids (those that look at it); questions, of which there are few: qid, terms."""
    names = {"qid": questions.schema["qid"].dataType, **{c: chunks.schema[c].dataType for c in ("source", "doc_id")}}
    asked = [(r.qid, [(t.term, t.weight, t.anchor) for t in r.terms]) for r in questions.select("qid", "terms").collect()]
    terms, sums = _summed(asked)

    def work(batches):
        seek = _Terms(terms)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                part = part.filter(part.column(3).is_valid())
                looks = [set(x) for x in part.column(2).to_pylist()]
                for q, held, s in sums(seek, part.column(3).to_pylist()) if looks else ():
                    at = np.array([i for i in np.flatnonzero(held) if asked[q][0] in looks[i]], np.int64)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([asked[q][0]] * len(at), types[0]), part.column(1).take(pa.array(at)), part.column(0).take(pa.array(at)), pa.array(s[at])], names=["qid", "source", "doc_id", "s"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(names["qid"])]
    schema = ", ".join(f"{n} {t.simpleString()}" for n, t in names.items()) + ", s double"
    return chunks.select("doc_id", "source", "qids", "searchable").mapInArrow(work, schema).select(*names, F.round("s", 9).alias("keyword_score"))
