"""Written tables in the folder that all executors share, and broadcasts of a checked size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only in a single JVM whose session names none (tests)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage once, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


#: Rows of a part of a kept table that is scanned with costly expressions.
PART_ROWS = 20_000


def kept(df: DataFrame, name: str, key: str, last=lambda df: df) -> DataFrame:
    """written, in parts of about PART_ROWS rows by key and as many as shuffles have at least: what is small in bytes may still be work for all cores.
    last: a step on the rows as they are written."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
    return written(last(df.repartition(n, key)), name)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more. The JVM is asked to collect its garbage, for it is then that Spark
    deletes the shuffle files behind them; in a loop they would pile up."""
    for spark in {t.sparkSession for t in tables[:1]}:
        spark._jvm.System.gc()
    for df in tables:
        path = getattr(df, "_corvane_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, most: int, size=None, most_bytes: int = 64 << 20) -> DataFrame:
    """df, to be broadcast if it has so many rows at most, and, where size tells the bytes of a row of any length, so many
    bytes at most; otherwise Spark shuffles both sides, and splits skewed keys."""
    total = F.coalesce(F.sum(size), F.lit(0)) if size is not None else F.lit(0)
    found = df.agg(F.count(F.lit(1)).alias("n"), total.alias("b")).first()
    return F.broadcast(df) if found.n <= most and found.b <= most_bytes else df


def packed(df: DataFrame) -> DataFrame:
    """The whole row as one struct column _row, so that no input column can clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
