"""From pages to chunks with provenance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..tables import packed, written

SIZE, OVERLAP = 1000, 180
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def fixed_windows(pages: DataFrame, keys: list[str], text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """keys, start_index (0-based), chunk: windows of size characters, each overlap into the one before. No row for empty text."""
    step = size - overlap
    # The length once a text, not once a window: to tell it takes a look at the whole text.
    starts = F.expr(f"if(length(`{text}`) > 0, transform(sequence(0, greatest(int(ceil((length(`{text}`) - {overlap}) / {step}D)), 1) - 1), i -> i * {step}), cast(array() as array<int>))")
    return pages.select(*keys, F.col(text).alias("_t"), F.explode(starts).alias("start_index")).select(*keys, F.col("start_index").cast("bigint").alias("start_index"), F.substring("_t", F.col("start_index") + 1, F.lit(size)).alias("chunk"))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive character splitting: by the first separator that occurs; what is still too long, by the next ones."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    if sep:
        parts = text.split(sep)
        parts = [p for p in [parts[0], *(sep + p for p in parts[1:])] if p]
    else:
        parts = list(text)
    out: list[str] = []
    fits: list[str] = []

    def gathered():
        held: list[str] = []
        total = 0
        for p in fits:
            if total + len(p) > size and held:
                out.append("".join(held).strip())
                while held and (total > overlap or total + len(p) > size):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        if held:
            out.append("".join(held).strip())
        fits.clear()

    for p in parts:
        if len(p) < size:
            fits.append(p)
        else:
            gathered()
            out.extend(split_text(p, size, overlap, rest) if rest else [p])
    gathered()
    return [c for c in out if c]


def recursive_chunks(pages: DataFrame, key: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, start_index, chunk."""

    def work(frames):
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[text], strict=True):
                at, length = 0, 0
                for c in split_text(t or "", size, overlap):
                    at = (t or "").find(c, max(0, at + length - overlap))
                    length = len(c)
                    rows.append((k, at, c))
            yield pd.DataFrame(rows, columns=[key, "start_index", "chunk"]).astype({key: "int64", "start_index": "int64"})

    return pages.select(key, text).mapInPandas(work, f"{key} bigint, start_index bigint, chunk string")


def numbered(chunks: DataFrame, order: list[str], first: int = 1, name: str = "chunk_id") -> DataFrame:
    """name from first on, over all rows, in order.

    A window over everything would be one task; so the rows are sorted by range and written once, each with its partition and place there, and
    partitions count on from the sizes of those before. Both are read back from what was written: a second evaluation of the sort could
    divide the rows otherwise."""
    by = [F.col(f"_row.`{c}`") for c in order]
    spread = packed(chunks).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    spread = written(spread, "numbered")
    sizes = spread.groupBy("p").agg(F.min("i").alias("low"), F.count(F.lit(1)).alias("n"))  # one row a partition
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("p").alias("q"), "low", "before")
    return spread.join(F.broadcast(before), F.col("p") == F.col("q")).select("_row.*", (F.col("i") - F.col("low") + F.col("before") + first).alias(name))


def with_sections(chunks: DataFrame, source: str = "source", chunk_id: str = "chunk_id", page: str = "page", text: str = "text") -> DataFrame:
    """section_title (the last one seen in the source) and section_type."""
    seen = F.nullif(T.section_title(F.col(text)), F.lit(""))
    last = F.last(seen, ignorenulls=True).over(Window.partitionBy(source).orderBy(chunk_id).rowsBetween(Window.unboundedPreceding, 0))
    out = chunks.withColumn("section_title", F.coalesce(last, F.lit("")))
    return out.withColumn("section_type", T.section_type(F.col("section_title"), F.col(text), F.col(page), F.col(chunk_id)))


def append_new(existing: DataFrame, incoming: DataFrame, source: str = "source") -> DataFrame:
    """Rows of incoming whose source is not there yet, neither as a source nor as the base name of a source_path."""
    have = existing.select(F.col(source).alias("_s"))
    if "source_path" in existing.columns:
        have = have.unionByName(existing.select(F.regexp_replace("source_path", r"^.*[/\\\\]", "").alias("_s")))
    return incoming.join(have.distinct(), F.col(source) == F.col("_s"), "left_anti")
