"""Ranks, fusion, soft filters and quotas. Every order ends in a unique key, scores are rounded before they are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .chunking import numbered

RRF_K = 60
VECTOR_WEIGHT, KEYWORD_WEIGHT = 1.0, 2.0
BASE_WEIGHT, GRAPH_WEIGHT = 1.0, 2.7
CHUNK_WEIGHT, COMMUNITY_WEIGHT = 1.0, 2.0


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """row_number within by; rows beyond k go (Spark cuts them before the shuffle: WindowGroupLimit)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    return out.filter(F.col(name) <= k) if k is not None else out


def ranked_whole(df: DataFrame, by: str, score: str, key: str, name: str) -> DataFrame:
    """Ranks without a limit, by descending score and then key: a window would put all rows of a value of by into one task; here one sort by range numbers all rows, and each
    value counts from its first."""
    n = numbered(df.withColumn("_less", -F.col(score)), [by, "_less", key], name="_n").drop("_less")
    low = n.groupBy(F.col(by).alias("_by")).agg(F.min("_n").alias("_low"))
    return n.join(low, F.col(by) == F.col("_by")).withColumn(name, F.col("_n") - F.col("_low") + 1).drop("_n", "_by", "_low")


def over_fetch(k: int) -> int:
    return max(6 * k, k + 20)


def rrf(rank: Column, weight: float) -> Column:
    return F.coalesce(F.lit(weight) / (RRF_K + rank), F.lit(0.0))


def fuse(left: DataFrame, right: DataFrame, keys: list[str], ranks: tuple[str, str], weights: tuple[float, float], k: int) -> DataFrame:
    """Reciprocal-rank fusion of two rankings; ties by the first rank, the second, the last key."""
    both = left.select(*keys, ranks[0]).join(right.select(*keys, ranks[1]), keys, "full_outer")
    both = both.withColumn("score", F.round(rrf(F.col(ranks[0]), weights[0]) + rrf(F.col(ranks[1]), weights[1]), 9))
    return ranked(both, keys[:1], [F.desc("score"), F.asc_nulls_last(ranks[0]), F.asc_nulls_last(ranks[1]), F.col(keys[-1])], k)


def soft_filter(df: DataFrame, by: list[str], flag: str, k: int, rank: str = "rank") -> DataFrame:
    """The first k of each group with flagged rows last; the order is otherwise kept."""
    return ranked(df, by, [F.col(flag), F.col(rank)], k, "kept_rank")


def quota_select(df: DataFrame, by: str, limit: int, per_node: int, per_paper: int) -> DataFrame:
    """by, pos, node, paper -> the rows chosen, greedily in order of pos: at most per_node of a node and per_paper of a paper,
    then others in order until limit. A row that one quota rejects doesn't use up the other. Groups are candidate lists (bounded by
    the over-fetch)."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "node", "paper")))
    folded = df.groupBy(by).agg(rows.alias("rows")).select(
        by,
        "rows",
        F.expr(
            f"aggregate(rows, cast(array() as array<struct<pos:bigint,node:string,paper:string>>), (a, r) -> if(size(a) >= {limit} OR size(filter(a, x -> x.node = r.node)) >= {per_node} OR size(filter(a, x -> x.paper = r.paper)) >= {per_paper}, a, concat(a, array(r))))"
        ).alias("chosen"),
    )
    full = folded.select(by, F.expr(f"concat(chosen, slice(filter(rows, r -> NOT array_contains(chosen, r)), 1, greatest({limit} - size(chosen), 0)))").alias("all"))
    return full.select(by, F.posexplode("all").alias("p", "r")).select(by, (F.col("p") + 1).cast("bigint").alias("rank"), "r.pos", "r.node", "r.paper")
