"""Filter interaction audit: what each filter removes, in every order that the filters can be applied in.

A document is reduced to its mask (one bit for each filter that it fails) and its labels; documents are counted by part and
mask. All that an order of filters does follows from these cells, of which a part has 2 ** filters at most, so orders are
never run on documents.

Orders are visited by adjacent transpositions (each differs from the one before by one swap of neighbours). A swap changes
what two filters have before them, and nothing else: only these two steps are counted anew from the cells. Shapley sums
accumulate along the walk.

Filter E, a text equal to that of a smaller id, needs all documents: texts are grouped by their SHA-256 and length, ids
within a group by partial aggregates, so that a text of a third of all rows is no single task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES

MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 3
FILTERS = "ABCDE"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: fewer than MIN_WORDS words, too few distinct ones, too many capitals, a symbol. A null text is empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(t, SPACES), "")
    # size of words once, not in each bit: the struct is one expression that the bits read
    seen = F.struct(F.size(words).cast("bigint").alias("n"), F.size(F.array_distinct(words)).cast("bigint").alias("d"), F.length(t).cast("bigint").alias("c"), F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("bigint").alias("u"), t.rlike("[#$%&*|]").alias("s"))

    def bits(x: Column) -> Column:
        tests = (x.n < MIN_WORDS, 100 * x.d < DISTINCT_PERCENT * x.n, 100 * x.u > CAPITALS_PERCENT * x.c, x.s)
        return sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)), F.lit(0))

    return F.transform(F.array(seen), bits)[0]


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail, and how many of them are labelled."""
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ident = F.col(f"`{id_col}`").cast("bigint")
    # A null id equals no label; a number spreads such rows over the tasks of the join.
    salt = F.when(ident.isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1024))).otherwise(F.lit(0))
    rows = docs.select(ident.alias("id"), salt.alias("salt"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.sha2(t, 256).alias("digest"), F.length(t).alias("len"), text_mask(F.col(f"`{text_col}`")).alias("mask"))
    said = labels.select(F.col("doc_id").cast("bigint").alias("_l"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic")).dropna(subset=["_l"])
    said = said.groupBy("_l").agg(F.coalesce(F.max("good"), F.lit(0)).alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic")).withColumn("_s", F.lit(0).cast("bigint"))
    rows = rows.join(said, (F.col("id") == F.col("_l")) & (F.col("salt") == F.col("_s")), "left")
    kind = ["digest", "len", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    same = ["digest", "len", "part", "mask", "good", "toxic"]
    # Rows by id first: several rows with the least id of a group all keep their text.
    ids = rows.select("id", "salt", *kind).groupBy("id", "salt", *same).agg(F.count(F.lit(1)).alias("c"))
    groups = ids.groupBy(*same).agg(F.sum("c").alias("n"), F.min("id").alias("least"), F.min_by("c", "id").alias("at_least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("c"))), F.lit(0)).alias("nameless"))
    first = groups.groupBy("digest", "len").agg(F.min("least").alias("first"), F.collect_list(F.struct("part", "mask", "good", "toxic", "n", "least", "at_least", "nameless")).alias("g"))
    each = first.select("first", F.explode("g").alias("g")).select("first", "g.*")
    kept = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(F.lit(0))
    both = each.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - kept).alias("n")))).alias("x"))
    return both.select("part", "good", "toxic", "x.*").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places k whose swaps (k with k + 1), one after the other, lead from 0..n-1 through every other order of n things, each once:
    the largest thing that can move does, and all larger ones turn round."""
    order, ahead = list(range(n)), [-1] * n
    while True:
        able = [(x, k) for k, x in enumerate(order) if 0 <= k + ahead[x] < n and order[k + ahead[x]] < x]
        if not able:
            return
        x, k = max(able)
        to = k + ahead[x]
        order[k], order[to] = order[to], order[k]
        for y in range(x + 1, n):
            ahead[y] = -ahead[y]
        yield min(k, to)


class Walk:
    """The steps of the order at hand. counts: masks x (n, good, toxic)."""

    def __init__(self, counts: np.ndarray, filters: int):
        self.counts, self.masks = counts, np.arange(len(counts))
        self.order = list(range(filters))
        self.fails = np.array([counts[(self.masks >> f) & 1 == 1, 0].sum() for f in self.order])
        self.alone = counts[1 << np.arange(filters), 0]
        #: By place: kept, removed, good lost, toxic lost.
        self.steps = np.zeros((filters, 4), np.int64)
        self.total = np.zeros(filters, np.int64)
        for k in self.order:
            self._count(k)

    def _count(self, k: int) -> None:
        before = sum(1 << f for f in self.order[:k])
        fails = (self.masks >> self.order[k]) & 1 == 1
        left = self.masks & before == 0
        self.steps[k, 1:] = self.counts[left & fails].sum(axis=0)
        self.steps[k, 0] = self.counts[left & ~fails, 0].sum()

    def swap(self, k: int) -> None:
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]
        self._count(k)
        self._count(k + 1)

    def visit(self) -> None:
        self.total[self.order] += self.steps[:, 1]


def orders(counts: np.ndarray, filters: int = len(FILTERS), names: str = FILTERS) -> pd.DataFrame:
    """All steps of all orders of the filters over one part."""
    walk, rows = Walk(counts, filters), []

    def visit():
        walk.visit()
        text = "".join(names[f] for f in walk.order)
        for k, f in enumerate(walk.order):
            kept, removed, good, toxic = map(int, walk.steps[k])
            rows.append((text, k + 1, kept, removed, int(walk.fails[f]) - removed, int(walk.alone[f]), good, toxic, f))

    visit()
    for k in swaps(filters):
        walk.swap(k)
        visit()
    out = pd.DataFrame(rows, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
    out["shapley"] = walk.total[out["shapley"].to_numpy()]
    return out


_SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part.

    A null text is empty and fails A (too short); a null part is the empty string, one part with it. A null id is equal to no smaller one
    and has no label; rows that repeat the least id of equal texts all pass E. An id labelled twice counts as good or toxic if one
    label says so. Texts are read whole; an empty table gives an empty result; further columns of any name aren't read.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << len(FILTERS), 3), np.int64)
        counts[part["mask"].to_numpy()] = part[["n", "good", "toxic"]].to_numpy()
        out = orders(counts)
        out.insert(0, "part", part["part"].iloc[0])
        return out

    return cells(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(one, _SCHEMA)
