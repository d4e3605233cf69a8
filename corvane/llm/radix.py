"""Exact dedup by distributed MSD radix partitioning.

Rows are split by successive pieces ("digits") of their normalised bytes. A group that holds one row, or whose rows
have ended, is done; the others are split again by the next digit. Digits widen eightfold from round to round, so
a text of n bytes takes log8(n) rounds. Groups are told apart by the bytes themselves, never by a digest.

Rows are numbered once, in a written table. Counting a digit is a partial aggregation, which also picks the row that stays, so a
group of a third of all rows reaches the shuffle as one row a task. What goes back to rows is a number: joins carry
row numbers and digits, and tails follow only for rows of groups that are still open. The adaptive planner may broadcast
the smaller side of these joins or split a skewed one; the plan is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import dropped, packed, small, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIRST_WIDTH, WIDER = 64, 8
#: Rows of groups, or of row numbers, that may be broadcast.
SMALL = 1_000_000


def normalised(text):
    """Null as empty; A-Z lower-cased, nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The numbered rows (rid, _row), and for each that has equals (rid, group_size, keep_id, keep_rid)."""
    base = written(packed(docs).withColumn("rid", F.monotonically_increasing_id()), "radix-base")
    ident, text = F.col(f"_row.`{id_col}`").cast("bigint").alias("id"), F.col(f"_row.`{text_col}`").cast("string")
    width = FIRST_WIDTH
    # Of the first digit only the first bytes are needed: no whole text is lower-cased for it.
    head = normalised(F.substring(text, 1, width + 1)).cast("binary")
    digits = base.select("rid", ident, F.lit(0).cast("bigint").alias("gid"), F.substring(head, 1, width).alias("digit"), (F.length(head) <= width).alias("ended"))
    rows = base.select("rid", ident, normalised(text).cast("binary").alias("rest"))
    done: list[DataFrame] = []
    while True:
        # Of equal ids the row with the largest number stays; a null id is less than any other.
        groups = digits.groupBy("gid", "digit", "ended").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "rid")).alias("keep")).filter("n > 1")
        groups = written(groups.withColumn("next", F.monotonically_increasing_id()), "radix-groups")
        hits = digits.join(small(groups, SMALL, F.length("digit")), ["gid", "digit", "ended"])
        hits = written(hits.select("rid", "ended", "next", F.col("n").alias("group_size"), F.col("keep.id").alias("keep_id"), F.col("keep.rid").alias("keep_rid")), "radix-hits")
        done.append(hits.filter("ended").select("rid", "group_size", "keep_id", "keep_rid"))
        last = groups.filter("NOT ended").isEmpty()
        dropped(groups)
        if last:
            break
        still = hits.filter("NOT ended").select("rid", "next")
        old, rows = rows, written(rows.join(small(still, SMALL), "rid").select("rid", "id", F.col("next").alias("gid"), F.expr(f"substring(rest, {width + 1})").alias("rest")), "radix-rows")
        dropped(old)
        width *= WIDER
        digits = rows.select("rid", "id", "gid", F.substring("rest", 1, width).alias("digit"), (F.length("rest") <= width).alias("ended"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return base, out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. Of equal texts the row with the largest id stays;
    of rows that repeat that id with the same text, one.

    Nulls: a null text is empty; a null id counts in group_size and never wins against another id. Empty texts are
    one group. Texts of any length are compared whole. An empty table gives an empty result; further columns of any name aren't read.
    """
    base, equals = radix_groups(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col)
    ident = F.col(f"_row.`{id_col}`").cast("bigint")
    rows = base.select("rid", ident.alias("doc_id"), F.sha2(normalised(F.col(f"_row.`{text_col}`").cast("string")).cast("binary"), 256).alias("text_sha256"))
    alone = F.col("group_size").isNull()
    return rows.join(small(equals, SMALL), "rid", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        "text_sha256",
    )


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' own columns of any names; the rest is as in exact_dedup. Only the numbers of rows that go are joined back."""
    base, equals = radix_groups(docs, id_col, text_col)
    gone = equals.filter("rid <> keep_rid").select("rid")
    return base.join(small(gone, SMALL), "rid", "left_anti").select("_row.*")
