"""Incremental forms of the batch operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kg import last_records
from ..sources.io import append_index, exists

CHUNK = ["source", "page", "start_index"]


def watch_pages(spark: SparkSession, folder: str, schema, index_path: str, checkpoint: str, to_chunks) -> StreamingQuery:
    """Files that arrive in folder are chunked and appended. Chunks that the index has are left out one by one, so a batch that is run again appends nothing, and a source
    whose pages come in several batches is appended whole."""

    def each(batch: DataFrame, _: int) -> None:
        append_index(spark, index_path, to_chunks(batch), CHUNK)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserts(records: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """The last record of each key, as a table of versions: each batch writes the next one (path/v=N) from the one before. A batch that is run again writes
    the same version anew."""

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v={n - 1}"
        both = spark.read.parquet(before).unionByName(batch) if exists(spark, before) else batch
        last_records(both, key, order).write.mode("overwrite").parquet(f"{path}/v={n}")

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last version that upserts() wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return spark.read.parquet(f"{path}/v={max(int(f.getPath().getName()[2:]) for f in files)}")


def last_messages_stream(messages: DataFrame, n: int = 12) -> DataFrame:
    """session_id, messages (the last n by id, in order): the state of a session is those n alone."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held += list(zip(f["id"].tolist(), f["message_json"].tolist(), strict=True))
        held = sorted(dict(held).items())[-n:]
        state.update((tuple(i for i, _ in held), tuple(m for _, m in held)))
        yield pd.DataFrame({"session_id": [key[0]], "messages": [[m for _, m in held]]})

    return messages.groupBy("session_id").applyInPandasWithState(work, "session_id string, messages array<string>", "ids array<bigint>, texts array<string>", "update", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums by window and type; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
