"""Session settings the library relies on, and where scratch tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SETTINGS = {
    # Event times are instants; text without an offset is read as UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key is legal and the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Exact streaming deduplication keeps per-key state with timers.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Keep only what changed in each state commit, instead of uploading whole snapshots.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators need; safe to call repeatedly."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. A temporary folder is only
    acceptable when driver and executors are one local process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/quoteflow-{purpose}-{uuid.uuid4().hex}"
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix=f"quoteflow-{purpose}-")


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """The table, written to scratch space and read back: what it comes from is computed once, however often it is used."""
    path = f"{scratch_dir(df.sparkSession, purpose)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, share: Column, count: int, purpose: str) -> list[DataFrame]:
    """The table in ``count`` shares, by a column that says which from 0 on; written once, and each reads its own files only."""
    path, shares = f"{scratch_dir(df.sparkSession, purpose)}/rows", T.StructField("_share", T.IntegerType())
    df.withColumn("_share", share.cast("int")).repartition(count, "_share").write.partitionBy("_share").parquet(path)
    whole = df.sparkSession.read.schema(T.StructType([*df.schema.fields, shares])).parquet(path)
    return [whole.filter(F.col("_share") == i).drop("_share") for i in range(count)]


def spread(df: DataFrame) -> DataFrame:
    """Share a table that comes in fewer files than there are cores among all of them.

    Parsing costs far more than moving such a table once. How many pieces Spark cuts its files into says little: a file
    has its rows in a few groups, and pieces in which no group lies are empty. A table in many files is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)
