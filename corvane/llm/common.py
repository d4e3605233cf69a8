"""What the training-data operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..tables import dropped, new_path, packed, shared_dir, small, written

__all__ = ["SPACES", "crc_mod", "dropped", "new_path", "packed", "shared_dir", "slices", "small", "table", "written"]

#: Words longer than this are not kept in a worker's caches, which hold so many entries whatever their length.
CACHED = 256
#: Words are runs of anything but these six characters.
SPACES = r"[\x20\x09-\x0D]+"


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 8 << 20):
    """batch in parts of so many rows, and of so many bytes of a text column, at most; a longer text is a part of its own."""
    length = np.fromiter((x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()), np.int64, batch.num_rows)
    lo = 0
    while lo < batch.num_rows:
        hi = lo + max(1, int(np.searchsorted(np.cumsum(length[lo : lo + rows]), size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
