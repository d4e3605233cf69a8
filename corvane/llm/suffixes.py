"""Removal of passages that repeat, by a distributed merge sort of suffixes that never compares a known prefix twice.

Every byte covered by a WINDOW-byte string that starts anywhere else too, in any document, is to go. A window's anchor is
the GRAM-byte string in it whose hash is the least (the first of equal ones): equal windows have equal anchors at
equal places. So only suffixes that start at anchors are sorted, about one in 190 bytes, each for the consecutive
windows whose anchor it is, and all windows are covered.

1. Anchors are counted by hash; one that occurs once has no repeated window.
2. For the others, each task cuts the suffix from its anchor to the end of its last window, and the bytes from its first window to the anchor. It sorts
   them, by the anchor's hash and then by their bytes, into runs. Equal records of a run are repeats already; one of them goes on.
3. Runs are exchanged front-coded (length of the prefix shared with the record before, and the rest), by ranges of
   the order: the hash makes ranges even without a sample. (Its last byte comes first: an anchor's hash is a least
   one, so that its first bits are small.)
4. A loser tree merges the runs of a range. Each loser keeps the length of the prefix it shares with the winner of its
   match, so that two records are only compared from where they are not yet known to be equal. The merge yields the lengths of shared
   prefixes; records that share an anchor are neighbours, and their windows are compared with one another, by bytes.

Anchors that occur more than HOT times are not brought together in one task: their windows are counted by their SHA-256 in a
partial aggregation instead, so that no group of them is ever held.

Rows of equal texts are sought through once for all of them; every window of theirs stands elsewhere.

The same is done with words in the place of bytes, each as a hash of 64 bits, where passages are told by their number of words:
without_passages, the pipeline's stage, and the last columns of repeats.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import SPACES, dropped, packed, small, written
from .minhash import _hashes

WINDOW, GRAM, HOT = 400, 32, 20_000
#: In words: the shortest passage that counts, and its anchor. Anchors of 16 words seldom repeat where no passage does.
WORDS, WORD_GRAM = 51, 16
_WORD = re.compile(SPACES.replace("[", "[^").encode())
RUN_BYTES, RESOLVE_BYTES, PART_ROWS = 32 << 20, 1 << 20, 30_000
#: Windows whose anchors are sought at once: longer texts are taken in pieces that overlap.
PIECE = 1 << 20

_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def units(data: bytes, words: bool) -> np.ndarray:
    """What windows are counted in: bytes, or hashes of words."""
    return np.fromiter(map(_hashes.__getitem__, data.split()), np.uint64) if words else np.frombuffer(data, np.uint8)


def rolling(b: np.ndarray, width: int) -> np.ndarray:
    """Hash of each string of width units of b, from hashes of strings of 1, 2, 4, ... units."""
    h, span, power = b.astype(np.uint64) + np.uint64(1), 1, _P
    out, done, w = None, 0, width
    while w:
        if w & 1:
            if out is None:
                out = h
            else:
                n = min(len(out), len(h) - done)
                out = out[:n] * np.uint64(power) + h[done : done + n]
            done += span
        w >>= 1
        if w:
            h = h[:-span] * np.uint64(power) + h[span:]
            power, span = power * power & _MASK, span * 2
    return _mix(out[: len(b) - width + 1])


def anchors(b: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(place, hash, first window, last window) of each anchor, as arrays."""
    g = rolling(b, gram)
    k = window - gram + 1  # grams in a window
    rows = -(-len(g) // k)
    key = np.full(rows * k, np.iinfo(np.uint64).max, np.uint64)
    key[: len(g)] = g & np.uint64(0xFFFFFFFF00000000) | np.arange(len(g), dtype=np.uint64)
    blocks = key.reshape(rows, k)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(b) - window + 1
    at = (np.minimum(behind[:n], ahead[k - 1 : k - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [n])) - 1
    place = at[first]
    return place, g[place].view(np.int64), first, last


#: Windows of words: how many make one, how many an anchor, and that it's words.
BY_WORDS = (WORDS, WORD_GRAM, True)


def _find(kinds):
    names = ["doc_id", "xh", "kind", "hash", "place", "first", "last"]

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                parts, owners = [], []
                for i, x, t in zip(*(c.to_pylist() for c in batch.slice(lo, 128).columns), strict=True):
                    data = t.encode()
                    for k, (window, gram, words) in enumerate(kinds):
                        b = units(data, words)
                        for at in range(0, len(b) - window + 1, PIECE):
                            place, h, first, last = anchors(b[at : at + PIECE + window - 1], window, gram)
                            parts.append((place + at, h, first + at, last + at))
                            owners += [(i, x, k)] * len(place)
                if owners:
                    place, h, first, last = (np.concatenate(c) for c in zip(*parts, strict=True))
                    who = zip(zip(*owners, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in who), pa.array(h), *(pa.array(c.astype(np.int32)) for c in (place, first, last))], names=names)

    return work


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which known bytes are known."""
    n = min(len(a), len(b))
    while known < n:
        step = min(64, n - known)
        if a[known : known + step] != b[known : known + step]:
            while a[known] == b[known]:
                known += 1
            return known
        known += step
    return known


_HEAD = struct.Struct("<HHHBqqi")
_DONE, _NO_ID = 1, 2


def front_coded(records) -> bytes:
    """records: sorted (text, left, done, doc, xh, first). Texts are coded against the one before."""
    out, before = bytearray(), b""
    for text, left, done, doc, xh, first in records:
        n = shared(before, text, 0)
        out += _HEAD.pack(n, len(text) - n, len(left), _DONE * done | _NO_ID * (doc is None), doc or 0, xh, first)
        out += text[n:]
        out += left
        before = text
    return bytes(out)


def run_of(blob: bytes):
    """(length shared with the record before, text, the rest of the record) one by one."""
    at, text = 0, b""
    while at < len(blob):
        n, more, m, flags, doc, xh, first = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        text = text[:n] + blob[at : at + more]
        at += more
        yield n, text, (blob[at : at + m], bool(flags & _DONE), None if flags & _NO_ID else doc, xh, first)
        at += m


class LoserTree:
    """Merges sorted runs. Between outputs, each run's head knows how long a prefix it shares with what it was last
    beaten by (at first: with nothing); the larger that is, the smaller the head, and only equals are compared, from there on."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs]
        self.known = [0] * len(self.runs)
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.runs else -1
        self.compared = 0

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, self.losers[node] = self._match(a, b)
        return won

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix is with the winner from now on."""
        x, y, known = self.heads[a], self.heads[b], self.known
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = shared(x[1], y[1], known[a])
        won, lost = (a, b) if x[1][n : n + 1] < y[1][n : n + 1] or (x[1][n : n + 1] == y[1][n : n + 1] and a < b) else (b, a)
        known[lost] = n
        return won, lost

    def __iter__(self):
        """(length shared with the output before, text, rest) in order."""
        while self.winner >= 0 and self.heads[self.winner] is not None:
            w = self.winner
            _, text, rest = self.heads[w]
            yield self.known[w], text, rest
            self.heads[w] = head = next(self.runs[w], None)
            self.known[w] = head[0] if head else 0
            node = (w + self.k) // 2
            while node >= 1:
                w, self.losers[node] = self._match(w, self.losers[node])
                node //= 2
            self.winner = w


#: Windows that are compared at once.
AT_ONCE = 1 << 18


def repeated_windows(records, window: int, words: bool = False):
    """records of whole groups: (text without hash, left, done, doc, xh, first) -> (doc, xh, start, end) of what repeats.

    A hash of each window tells which may be equal; their bytes decide, compared a run of neighbouring windows at a time. Equal windows have their anchor at the same
    distance, so the windows of large groups are taken by distance, about AT_ONCE at a time: memory is that and a few bytes a window."""
    data = b"".join(left + text for text, left, *_ in records)
    b = np.frombuffer(data, np.uint64 if words else np.uint8)
    sizes = np.fromiter((len(r[0]) + len(r[1]) for r in records), np.int64, len(records)) // b.itemsize
    ahead = np.fromiter((len(r[1]) for r in records), np.int64, len(records)) // b.itemsize
    base = np.cumsum(sizes) - sizes
    counts = sizes - window + 1
    begin = np.cumsum(counts) - counts
    total = int(counts.sum())
    starts = (np.arange(total) - np.repeat(begin - base, counts)).astype(np.int32)
    owner = np.repeat(np.arange(len(records), dtype=np.int32), counts)
    apart = (ahead[owner] - (starts - base[owner])).astype(np.int32)  # of the window's start and the anchor
    apart -= apart.min()
    h = np.empty(total, np.uint64)
    for lo in range(0, len(b) - window + 1, 1 << 18):  # the whole buffer's hashes are never held
        g = rolling(b[lo : lo + (1 << 18) + window - 1], window)
        i, j = np.searchsorted(starts, (lo, lo + len(g)))
        h[i:j] = g[starts[i:j] - lo]
    again = np.zeros(total, bool)
    # Distances from 0 on, in ranges of about as many windows.
    per = np.cumsum(np.bincount(apart))
    ranges = np.searchsorted(per, np.arange(AT_ONCE, total, AT_ONCE)) + 1 if total > AT_ONCE else []
    for d0, d1 in zip([0, *ranges], [*ranges, len(per)], strict=True):
        mine = np.flatnonzero((apart >= d0) & (apart < d1)) if total > AT_ONCE else np.arange(total)
        if len(mine):
            again[mine] = _equal_windows(b, starts[mine].astype(np.int64), h[mine], window)
    edge = np.flatnonzero(np.concatenate(([True], (again[1:] != again[:-1]) | (owner[1:] != owner[:-1]))))
    ends = np.concatenate((edge[1:], [total]))
    out = []
    for s, e in zip(edge[again[edge]], ends[again[edge]], strict=True):
        r = records[owner[s]]
        if not r[2]:
            p = r[5] + int(s - begin[owner[s]])
            out.append((r[3], r[4], p, p + int(e - s) - 1 + window))
    return out


def _equal_windows(b: np.ndarray, starts: np.ndarray, h: np.ndarray, window: int) -> np.ndarray:
    """Of windows (in order, with their hashes), whether another has the same content."""
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    like = first[inverse]  # the first window of the same hash
    copy = np.flatnonzero(like != np.arange(len(h)))
    again = np.zeros(len(h), bool)
    if not len(copy):
        return again
    # Windows in a row that are like windows in a row, with the same distance, are one comparison.
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(copy) != 1) | (np.diff(starts[copy]) != 1) | (np.diff(starts[like[copy]]) != 1))))
    for s, e in zip(cut, [*cut[1:], len(copy)], strict=True):
        x, y, n = starts[copy[s]], starts[like[copy[s]]], e - s
        if np.array_equal(b[x : x + n + window - 1], b[y : y + n + window - 1]):
            again[copy[s:e]] = again[like[copy[s:e]]] = True
            continue
        for k in copy[s:e]:  # hashes that are equal by chance: all windows of such a hash, by their bytes
            same: dict[bytes, list[int]] = {}
            for w in np.flatnonzero(like == like[k]):
                same.setdefault(b[starts[w] : starts[w] + window].tobytes(), []).append(w)
            for members in same.values():
                again[members] |= len(members) > 1
    return again


_OUT = "kind int, part int, run binary, wh binary, doc_id bigint, xh bigint, start int, stop int"
_OUT_NAMES = ["kind", "part", "run", "wh", "doc_id", "xh", "start", "stop"]
_OUT_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _OUT_KINDS, strict=True)], names=_OUT_NAMES)


def _few(batches, rows: int = 64):
    """The rows of batches as Python values, of a few rows at a time: lists of spots are large as such."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, rows).columns), strict=True)


def _runs(parts: int, kinds):
    """Documents with their repeated anchors -> runs by kind and part, what repeats within a run, and windows of hot anchors."""

    def work(batches):
        held: list[dict[tuple[bytes, bytes], list]] = [{} for _ in kinds]
        size = 0

        def flush():
            rows = []
            for kind, records_of in enumerate(held):
                width, by_part = 8 if kinds[kind][2] else 1, {}
                for (text, left), members in sorted(records_of.items()):
                    done = len(members) > 1
                    if done:
                        rows += [(kind, None, None, None, doc, xh, first, first + (len(left) + len(text) - 8) // width) for doc, xh, first in members]
                    part = int.from_bytes(text[:8], "big") * parts >> 64
                    by_part.setdefault(part, []).append((text, left, done, *members[0]))
                rows += [(kind, kind * parts + part, front_coded(records), None, None, None, None, None) for part, records in by_part.items()]
                records_of.clear()
            return rows

        for doc, xh, text, spots in _few(batches):
            data, hot = text.encode(), []
            by_kind: list[list] = [[] for _ in kinds]
            for s in spots:
                by_kind[s["kind"]].append(s)
            for kind, (window, _, words) in enumerate(kinds):
                if not by_kind[kind]:
                    continue
                b, width = units(data, words), 8 if words else 1
                raw = b.tobytes() if words else data
                for s in by_kind[kind]:
                    place, first, last = s["place"], s["first"], s["last"]
                    if s["hot"]:
                        hot += [(kind, None, None, hashlib.sha256(raw[k * width : (k + window) * width]).digest(), doc, xh, k, k + window) for k in range(first, last + 1)]
                        continue
                    key = ((s["hash"] & _MASK).to_bytes(8, "little") + raw[place * width : (last + window) * width], raw[first * width : place * width])
                    held[kind].setdefault(key, []).append((doc, xh, first))
                    size += len(key[0]) + len(key[1])
            if hot:
                yield _rows(hot)
            if size >= RUN_BYTES:
                yield _rows(flush())
                size = 0
        rows = flush()
        if rows:
            yield _rows(rows)

    return work


def _merge(kinds):
    def work(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        window, gram, words = kinds[kind]
        same = 8 + gram * (8 if words else 1)
        out, ready, group, size = [], [], [], 0
        for n, text, rest in LoserTree([run_of(x) for x in table.column("run").to_pylist()]):
            if n < same and group:  # another anchor
                if len(group) > 1:
                    ready += group
                    size += sum(len(r[0]) + len(r[1]) for r in group)
                group = []
                if size >= RESOLVE_BYTES:
                    out += repeated_windows(ready, window, words)
                    ready, size = [], 0
            group.append((text[8:], *rest))
        if len(group) > 1:
            ready += group
        if ready:
            out += repeated_windows(ready, window, words)
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        return pa.table([pa.array([kind] * len(out), pa.int32()), *columns], names=["kind", "doc_id", "xh", "start", "stop"])

    return work


def merged_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(x) for x in out]


def bytes_of(data: bytes, spans) -> list[tuple[int, int]]:
    """Spans (start, stop, words) in bytes. Those of words go on to the next word, and begin with the text if no word is before."""
    out, at = [], None
    for s in spans:
        start, stop = s["start"], s["stop"]
        if s["words"]:
            if at is None:
                at = [m.start() for m in _WORD.finditer(data)] + [len(data)]
            start, stop = at[start] if start else 0, at[stop]
        out.append((start, stop))
    return out


#: Ids of documents to look at again are broadcast up to this many; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _with_lists(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """texts (doc_id, xh, text) with the lists (lid, lxh, l) of those that have one. Only their texts are shuffled if their ids are few enough to broadcast."""
    some = texts
    if lists.count() <= BROADCAST_IDS:
        some = texts.join(F.broadcast(lists.select(F.col("lxh").alias("bxh")).distinct()), F.col("xh") == F.col("bxh"), "left_semi")
    return some.join(lists, (F.col("xh") == F.col("lxh")) & F.col("doc_id").eqNullSafe(F.col("lid"))).select("doc_id", "xh", "text", "l")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(t).alias("xh"), t.alias("text"))


def _once(texts: DataFrame, kinds) -> tuple[DataFrame, DataFrame]:
    """texts with one row for all that are equal, whatever their ids, and spans of the whole texts of such rows, of each kind that they are long
    enough for. xh spreads the keys, SHA-256 decides which texts are equal."""
    keyed = texts.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = keyed.groupBy(F.col("xh").alias("_rxh"), F.col("sha").alias("_rsha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("_rid")).filter("n > 1").drop("n")
    rows = small(written(rows, "suffix-copies"), BROADCAST_IDS)
    same = (F.col("xh") == F.col("_rxh")) & (F.col("sha") == F.col("_rsha"))
    least = keyed.join(rows, same).filter(F.col("doc_id").eqNullSafe(F.col("_rid")))  # rows that share this id, too, are still many
    one = written(least.groupBy("xh", "sha").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")), "suffix-copied")
    n_words = F.size(F.filter(F.split("text", SPACES), lambda w: w != ""))
    ends = [one.select(F.col("xh").alias("_rxh"), F.col("sha").alias("_rsha"), (n_words if words else F.octet_length("text")).alias("stop"), F.lit(words).alias("words")).filter(F.col("stop") >= window) for window, _, words in kinds]
    ends = small(written(reduce(DataFrame.unionByName, ends), "suffix-ends"), BROADCAST_IDS)
    whole = keyed.select("doc_id", "xh", "sha").join(ends, same).select("doc_id", "xh", F.lit(0).alias("start"), "stop", "words").distinct()
    return keyed.join(rows, same, "left_anti").unionByName(one).drop("sha"), whole


def _spans(texts: DataFrame, kinds, hot: int) -> DataFrame:
    """(doc_id, xh, start, stop, words) of what repeats, for all kinds in one pass: a text is read and sent once for all of them."""
    spark = texts.sparkSession
    texts, copied = _once(texts, kinds)
    spots = written(texts.mapInArrow(_find(kinds), "doc_id bigint, xh bigint, kind int, hash bigint, place int, first int, last int"), "suffix-anchors")
    again = written(spots.groupBy("kind", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("kind").alias("hk"), F.col("hash").alias("h"), (F.col("n") > hot).alias("hot")), "suffix-again")
    lists = spots.join(again, (F.col("hash") == F.col("h")) & (F.col("kind") == F.col("hk"))).groupBy(F.col("doc_id").alias("lid"), F.col("xh").alias("lxh")).agg(F.collect_list(F.struct("kind", "hash", "place", "first", "last", "hot")).alias("l"))
    lists = written(lists, "suffix-lists")
    dropped(spots)
    n = lists.agg(F.sum(F.size("l"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_ROWS))
    runs = written(_with_lists(texts, lists).mapInArrow(_runs(parts, kinds), _OUT), "suffix-runs")
    # More tasks than parts, so that few tasks have two: a task's share doesn't grow with the input.
    merged = runs.filter("run IS NOT NULL").select("kind", "part", "run").repartition(2 * parts * len(kinds), "part").groupBy("part").applyInArrow(_merge(kinds), "kind int, doc_id bigint, xh bigint, start int, stop int")
    spans = merged.unionByName(runs.filter("run IS NULL AND wh IS NULL").select("kind", "doc_id", "xh", "start", "stop"))
    if not again.filter("hot").isEmpty():
        hot_rows = runs.filter("wh IS NOT NULL")
        twice = written(hot_rows.groupBy("kind", "wh").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("kind").alias("hk"), F.col("wh").alias("w")), "suffix-hot")
        spans = spans.unionByName(hot_rows.join(twice, (F.col("wh") == F.col("w")) & (F.col("kind") == F.col("hk"))).select("kind", "doc_id", "xh", "start", "stop"))
    by_words = F.col("kind").isin([k for k, x in enumerate(kinds) if x[2]])
    spans = written(spans.select("doc_id", "xh", "start", "stop", by_words.alias("words")).unionByName(copied), "suffix-found")
    dropped(runs, again, lists)
    return spans


def _cut(data: bytes, spans) -> tuple[bytes, int, int]:
    """What is left of data, the number of bytes that go and of the runs they make."""
    at, kept, removed = 0, [], 0
    spans = merged_spans(bytes_of(data, spans))
    for start, stop in spans:
        kept.append(data[at:start])
        removed += stop - start
        at = stop
    return b"".join([*kept, data[at:]]), removed, len(spans)


#: Bytes of spans that may be broadcast, and of one span in a row as Spark holds it; beyond, texts and spans are shuffled.
SPAN_BYTES, SPAN_SIZE = 160 << 20, 40


def _joined(spans: DataFrame) -> DataFrame:
    """spans of a text and kind that overlap or touch, as one: a passage has a span for each of its anchors."""
    text = Window.partitionBy("doc_id", "xh", "words").orderBy("start", "stop")
    reached = F.max("stop").over(text.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("run", F.when(F.col("start") <= reached, 0).otherwise(1))
    runs = fresh.withColumn("run", F.sum("run").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "xh", "words", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def _with_spans(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, hot: int, passages: bool) -> DataFrame:
    """docs, packed in _row, with _id, _text (null is empty) and the spans that go (_l, null: none). passages: repeats of WORDS words go as well."""
    texts = _texts(docs, id_col, text_col)
    spans = _spans(texts, [(window, gram, False), *([BY_WORDS] if passages else [])], hot)
    runs = _joined(spans.repartition("doc_id", "xh"))
    by_doc = written(runs.groupBy(F.col("doc_id").alias("_lid"), F.col("xh").alias("_lxh")).agg(F.collect_list(F.struct("start", "stop", "words")).alias("_l")), "suffix-spans")
    text = F.col(f"_row.`{text_col}`").cast("string")
    rows = packed(docs).withColumn("_id", F.col(f"_row.`{id_col}`").cast("bigint")).withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_xh", F.xxhash64("_text"))
    return rows.join(small(by_doc, BROADCAST_IDS, F.size("_l") * SPAN_SIZE + 64, SPAN_BYTES), (F.col("_xh") == F.col("_lxh")) & F.col("_id").eqNullSafe(F.col("_lid")), "left")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, passages: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text for every row.

    Null is empty; texts shorter than a window lose nothing. Rows that repeat lose all of a text of a window or more: each stands elsewhere.
    Texts of any length are read whole; an empty table gives an empty one; further columns of any name aren't read. kept_text lacks
    characters that a cut divides; kept_sha256 is of all bytes that are left.

    passages: n_passage_bytes, n_passages and passage_free_text follow. They tell what goes, in how many runs, and what is left if repeats of
    WORDS words go as well, as in without_passages; the columns before them stay as they are.
    """
    fields = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    if passages:
        fields += ", n_passage_bytes bigint, n_passages bigint, passage_free_text string"
        kinds += [pa.int64()] * 2 + [pa.string()]
    names = [f.split()[0] for f in fields.split(", ")]

    def left(data, text, spans):
        kept, removed, n = _cut(data, spans) if spans else (data, 0, 0)
        return kept, removed, n, kept.decode("utf-8", "ignore") if spans else text

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                rows = []
                for doc, text, spans in zip(*(c.to_pylist() for c in batch.slice(lo, 128).columns), strict=True):
                    data, spans = text.encode(), spans or []
                    by_bytes = [s for s in spans if not s["words"]]
                    kept, removed, n, kept_text = left(data, text, by_bytes)
                    row = (doc, len(data), removed, n, hashlib.sha256(kept).hexdigest(), kept_text)
                    if passages:
                        row += left(data, text, spans)[1:] if len(by_bytes) < len(spans) else (removed, n, kept_text)
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = _with_spans(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col, window, gram, hot, passages)
    return rows.select("_id", "_text", "_l").mapInArrow(work, fields)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, passages: bool = False) -> DataFrame:
    """docs with repeated passages cut out of the text; every copy goes, by op9's rule, so that which one stays doesn't depend on order. A
    character cut in two goes whole. Null texts stay null; other columns of any name pass through; an empty table stays empty."""
    rows = _with_spans(docs, id_col, text_col, window, gram, hot, passages)
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(*[F.col(f"_row.`{c}`").alias(c) for c in others])
    rows = rows.select(rest.alias("rest"), F.when(F.col(f"_row.`{text_col}`").isNotNull(), F.col("_text")).alias("text"), F.col("_l").alias("l"))

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = part.column(1).to_pylist()
                for k, spans in enumerate(part.column(2).to_pylist()):
                    if spans:
                        texts[k] = _cut(texts[k].encode(), spans)[0].decode("utf-8", "ignore")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["rest", "text"])

    out = rows.mapInArrow(work, rows.select("rest", "text").schema)
    return out.select(*[(F.col("text") if c == text_col else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """without_repeats, and every repeat of WORDS words or more goes too, however few bytes it has and whatever spaces part its words."""
    return without_repeats(docs, id_col, text_col, passages=True)
