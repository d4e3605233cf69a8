"""Interval overlap join: sales with the click sessions of the same client, classified by how their intervals lie.

Clicks become sessions in three steps, none of which holds a client's clicks in one task. Clicks of a client in one aligned
quarter of an hour lie no more than GAP apart, so a plain aggregate makes one cell of them; a day's cells are chained to runs;
runs are chained over days. A client has at most 96 cells a day and, beside its sessions, one run a day, however many clicks
it has.

Times are floored to slots of SLOT; an open end is FOREVER. Two intervals share a slot if the session starts within the sale
or the sale starts strictly within the session, never both: two range joins whose results are disjoint. In each the side that
is an interval is copied to every bucket that it touches, and the side that is a point (a start) is in one. Buckets are at
most BUCKETS ranges of about equally many starts, by quantiles: open or broken ends make no more copies than that, and no
result depends on where the edges lie.

How a sale and a session lie depends on their slots only. So both sides are first reduced to classes (client, start, end): a
client's pairs are bounded by the slots of its time range, not by the square of its rows. Each class is counted once and its
counts are joined back to its sales.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Microseconds: the longest pause within a session, a slot, a day.
GAP, SLOT, DAY = 15 * 60 * 1_000_000, 6 * 3600 * 1_000_000, 86_400_000_000
#: The slot of an open end.
FOREVER = 1 << 60
BUCKETS = 16


def micros(df: DataFrame, name: str) -> Column:
    """Whole microseconds since 1970; of a time without a zone as it stands, whatever the session's zone."""
    c = F.col(f"`{name}`")
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    clock = (F.hour(c) * 60 + F.minute(c)).cast("bigint") * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return F.unix_date(c.cast("date")).cast("bigint") * DAY + clock


def _floor(name: str, step: int) -> Column:
    return F.expr(f"({name} - pmod({name}, {step}L)) div {step}L")


def _chained(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (client, lo, hi, ...) whose pauses are no longer than GAP are one, within keys. hi is twice the last time, plus 1 if an error stands there."""
    w = Window.partitionBy(*keys).orderBy("lo")
    before = F.lag("hi").over(w)
    rows = rows.withColumn("_new", F.coalesce((F.col("lo") - F.shiftright(before, 1) > GAP).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def click_sessions(clicks: DataFrame) -> DataFrame:
    """client, first, last (microseconds) and open (a click at the last time is an error) of every session; clicks without a client or a time are left out."""
    rows = clicks.select(F.col("client_id").alias("client"), micros(clicks, "ts").alias("us"), F.coalesce(F.col("kind") == "error", F.lit(False)).cast("bigint").alias("bad")).dropna(subset=["client", "us"])
    cells = rows.groupBy("client", _floor("us", GAP).alias("cell")).agg(F.min("us").alias("lo"), F.max(2 * F.col("us") + F.col("bad")).alias("hi"))
    days = _chained(cells.select("client", "lo", "hi", _floor("lo", DAY).alias("day")), ["client", "day"])
    runs = _chained(days.drop("day"), ["client"])
    return runs.select("client", F.col("lo").alias("first"), F.shiftright("hi", 1).alias("last"), (F.col("hi") % 2 == 1).alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """sale_id, client, first, last (microseconds) and open of every sale that has a client and a time."""
    shipped = lines.select(F.col("sale_id").alias("_line"), micros(lines, "shipped_at").alias("us")).dropna().groupBy("_line").agg(F.max("us").alias("_shipped"))
    rows = sales.select("sale_id", F.col("client_id").alias("client"), micros(sales, "sold_at").alias("first"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open")).dropna(subset=["client", "first"])
    rows = rows.join(shipped.hint("merge"), F.col("sale_id") == F.col("_line"), "left")
    return rows.select("sale_id", "client", "first", F.greatest("first", "_shipped").alias("last"), "open")


def _slots(rows: DataFrame, *more: str | Column) -> DataFrame:
    """client, s and e (the first and last slot), and more."""
    return rows.select("client", _floor("first", SLOT).alias("s"), F.when(F.col("open"), F.lit(FOREVER)).otherwise(_floor("last", SLOT)).alias("e"), *more)


def _edges(*tables: DataFrame) -> list[int]:
    """At most BUCKETS - 1 slots at which starts are cut into ranges of about equally many."""
    starts = tables[0].select("s")
    for t in tables[1:]:
        starts = starts.unionAll(t.select("s"))
    found = starts.agg(F.percentile_approx("s", [k / BUCKETS for k in range(1, BUCKETS)], 1000).alias("q")).first().q
    return sorted(set(found or []))


def _bucket(c: Column, edges: list[int]) -> Column:
    return sum((F.when(c >= F.lit(x), 1).otherwise(0) for x in edges), F.lit(0))


def _spread(rows: DataFrame, low: Column, edges: list[int]) -> DataFrame:
    """A copy of each interval from low to e for every bucket that it touches."""
    return rows.withColumn("b", F.explode(F.sequence(_bucket(low, edges), _bucket(F.col("e"), edges))))


def relation(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Of the interval s1..e1 to one that it shares a slot with."""
    names = {-1: ("overlaps", "finished_by", "contains"), 0: ("starts", "equals", "started_by"), 1: ("during", "finishes", "overlapped_by")}

    def by_end(k):
        a, b, c = names[k]
        return F.when(e1 < e2, a).when(e1 == e2, b).otherwise(c)

    return F.when(s1 < s2, by_end(-1)).when(s1 == s2, by_end(0)).otherwise(by_end(1))


def overlaps(sales: DataFrame, lines: DataFrame, clicks: DataFrame) -> DataFrame:
    """sale_id, relation, n_pairs, overlap_slots (null if both ends are open) and sessions_crc for every sale and relation that occurs.

    Rows without a client, of sales without sold_at and of clicks without ts are left out; lines without a shipped_at or a sale count for
    nothing; an unknown status or kind is closed. Each row of sales is a sale of its own, also one whose id is null or repeated; clicks
    that repeat are one time. Empty tables give an empty result; further columns of any name aren't read.
    """
    crc = F.crc32(F.col("first").cast("string").cast("binary"))
    sessions = _slots(click_sessions(clicks), crc.alias("crc")).groupBy("client", "s", "e").agg(F.count(F.lit(1)).alias("n"), F.sum("crc").alias("crc"))
    sessions = written(sessions, "sessions")
    sold = written(_slots(sale_intervals(sales, lines), "sale_id"), "sold")
    edges = _edges(sessions, sold)
    kinds = sold.select("client", "s", "e").distinct()
    asked = sessions.select(F.col("client").alias("_c"), F.col("s").alias("_s"), F.col("e").alias("_e"), "n", "crc")
    same = F.col("client") == F.col("_c")
    # The session starts within the sale: sales are spread, sessions are points.
    inside = _spread(kinds, F.col("s"), edges).join(asked.withColumn("_b", _bucket(F.col("_s"), edges)).hint("merge"), same & (F.col("b") == F.col("_b")) & (F.col("_s") >= F.col("s")) & (F.col("_s") <= F.col("e")))
    # The sale starts strictly within the session: sessions are spread, sales are points.
    longer = _spread(sessions.filter("e > s"), F.col("s") + 1, edges).select(F.col("client").alias("_c"), F.col("s").alias("_s"), F.col("e").alias("_e"), "n", "crc", F.col("b").alias("_b"))
    within = kinds.withColumn("b", _bucket(F.col("s"), edges)).join(longer.hint("merge"), same & (F.col("b") == F.col("_b")) & (F.col("s") > F.col("_s")) & (F.col("s") <= F.col("_e")))
    columns = ["client", "s", "e", "_s", "_e", "n", "crc"]
    pairs = inside.select(*columns).unionAll(within.select(*columns))
    end = F.least("e", "_e")
    shared = F.when(end < FOREVER, (end - F.greatest("s", "_s") + 1) * F.col("n"))
    counts = pairs.groupBy("client", "s", "e", relation(F.col("s"), F.col("e"), F.col("_s"), F.col("_e")).alias("relation")).agg(F.sum("n").alias("n_pairs"), F.sum(shared).alias("overlap_slots"), F.sum("crc").alias("sessions_crc"))
    counts = counts.withColumnsRenamed({"client": "_c", "s": "_s", "e": "_e"})
    out = sold.join(counts.hint("merge"), same & (F.col("s") == F.col("_s")) & (F.col("e") == F.col("_e")))
    return out.select("sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc")
