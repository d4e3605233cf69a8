"""Best-fit packing of documents into bins of a fixed capacity, under conflicts.

Two documents of one duplicate cluster never share a bin; nor do more than a bin's share of documents of one source
(one, by default two). Bins are ordered by residual. A document, longest first, looks up the
smallest residual that holds it and goes on to successors until it meets a compatible bin, the tightest one. Each
residual holds its bins as a bitmap; each source and each cluster has a bitmap of the bins that are closed to it, so a
step of the search is one operation on bitmaps, however many bins of that residual are incompatible.

Documents longer than a bin fill bins of their own first; only the remainder is packed with others. Work is split
in shards by a hash of the id: so a hot source is spread over all shards, and a shard's size is bounded.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small, written
from .radix import normalised

#: Bytes of UTF-8 a bin holds; rows a shard is planned for; documents of one source in a bin.
CAPACITY, SHARD_ROWS, PER_SOURCE = 16_384, 4_096, 2


class Bins:
    def __init__(self, capacity: int, per_source: int = PER_SOURCE):
        self.capacity, self.per_source = capacity, per_source
        self.residuals: list[int] = []  # those that some bin has, in order
        self.with_residual: dict[int, int] = {}  # residual -> bitmap of bins
        self.source_level: list[dict] = [{} for _ in range(per_source)]  # source -> bitmap of bins with more than so many of it
        self.cluster_bins: dict = {}  # cluster -> bitmap of bins
        self.used: list[int] = []
        self.content: list[list] = []

    def _set(self, b: int, residual: int) -> None:
        if residual not in self.with_residual:
            self.with_residual[residual] = 0
            insort(self.residuals, residual)
        self.with_residual[residual] |= 1 << b

    def _unset(self, b: int, residual: int) -> None:
        self.with_residual[residual] &= ~(1 << b)
        if not self.with_residual[residual]:
            del self.with_residual[residual]
            del self.residuals[bisect_left(self.residuals, residual)]

    def add(self, item, size: int, source, cluster) -> tuple[int, int]:
        """The bin and the place in it."""
        closed = 0
        if source is not None:
            closed |= self.source_level[-1].get(source, 0)
        if cluster is not None:
            closed |= self.cluster_bins.get(cluster, 0)
        b = -1
        for i in range(bisect_left(self.residuals, size), len(self.residuals)):
            open_here = self.with_residual[self.residuals[i]] & ~closed
            if open_here:
                b = (open_here & -open_here).bit_length() - 1  # the oldest of the tightest
                break
        if b < 0:
            b = len(self.used)
            self.used.append(0)
            self.content.append([])
        else:
            self._unset(b, self.capacity - self.used[b])
        at = self.used[b]
        self.used[b] += size
        self._set(b, self.capacity - self.used[b])
        self.content[b].append(item)
        bit = 1 << b
        if source is not None:
            for level in self.source_level:
                if not level.get(source, 0) & bit:
                    level[source] = level.get(source, 0) | bit
                    break
        if cluster is not None:
            self.cluster_bins[cluster] = self.cluster_bins.get(cluster, 0) | bit
        return b, at


def pack_shard(items: list[tuple], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple]:
    """items: (key, size, source, cluster) -> (key, bin, start in the item, start in the bin, size), longest first, ties by key.
    Whole bins of a long item come before all others; an empty item takes a place in no bin (bin -1)."""
    out, solo = [], 0
    bins = Bins(capacity, per_source)
    rest = []
    for key, size, source, cluster in items:
        at = 0
        while size - at >= capacity:
            out.append((key, solo, at, 0, capacity))
            solo, at = solo + 1, at + capacity
        if size > at:
            rest.append((size - at, key, at, source, cluster))
        elif not size:
            out.append((key, -1, 0, 0, 0))
    rest.sort(key=lambda x: (-x[0], x[1], x[2]))
    for size, key, at, source, cluster in rest:
        b, place = bins.add(key, size, source, cluster)
        out.append((key, solo + b, at, place, size))
    return out


def cluster_of(text_col: str = "text") -> Column:
    """The duplicate cluster of a text: texts that op2 takes as equal (A-Z as a-z) are one."""
    return F.xxhash64(normalised(F.col(f"`{text_col}`").cast("string")))


SCHEMA = "doc_id bigint, shard bigint, bin bigint, doc_start bigint, bin_start bigint, n_bytes bigint, source string, cluster bigint"


#: Kinds of repeated rows that may be broadcast.
SMALL = 1_000_000


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", cluster: str | Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece of a document: doc_id, shard, bin (of the shard), doc_start, bin_start, n_bytes, source, cluster.

    cluster, a column or its name: documents with equal values never share a bin; null or no column: no such conflict. Null text is empty,
    empty texts get bin -1. A null source conflicts with nothing. Rows with one id are packed each; rows that repeat are spread
    over the shards. A text longer than a bin fills bins of its own. Empty table: no rows. Further columns of any name aren't read.
    """
    cluster = F.lit(None) if cluster is None else F.col(f"`{cluster}`") if isinstance(cluster, str) else cluster
    source = F.col(f"`{source_col}`").cast("string") if source_col else F.lit(None).cast("string")
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("bigint")
    plain = written(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), size.alias("n_bytes"), source.alias("source"), cluster.cast("bigint").alias("cluster"), F.monotonically_increasing_id().alias("rid")), "packing-rows")
    shards = max(1, -(-plain.count() // shard_rows))
    kind = F.xxhash64("doc_id", "n_bytes", "source", "cluster")
    again = written(plain.groupBy(kind.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k"), "packing-again")
    # The shard is a hash of the row; rows that repeat, by their number too, or a hot one would be one shard.
    rows = plain.join(small(again, SMALL), kind == F.col("k"), "left").select(F.pmod(F.when(F.col("k").isNull(), kind).otherwise(F.xxhash64(kind, "rid")), F.lit(shards)).alias("shard"), "doc_id", "n_bytes", "source", "cluster")

    def work(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "n_bytes", "source", "cluster")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or 0))
        placed = pack_shard([(i, r[1], r[2], r[3]) for i, r in enumerate(rows)], capacity, per_source)
        shard = table.column("shard")[0].as_py()
        cols = [(rows[k][0], shard, b, start, place, n, rows[k][2], rows[k][3]) for k, b, start, place, n in placed]
        kinds = (pa.int64(),) * 6 + (pa.string(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*cols, strict=True), kinds, strict=True)], names=["doc_id", "shard", "bin", "doc_start", "bin_start", "n_bytes", "source", "cluster"])

    return rows.groupBy("shard").applyInArrow(work, SCHEMA)
