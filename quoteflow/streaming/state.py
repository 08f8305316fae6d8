"""What the streaming dedup remembers, read from its state as a table.

Counters say how many keys should be remembered; this says how many are. Spark's state source reads the state as of the
last finished micro-batch and does not touch the query.
"""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.operators import dedup


def _state(spark: SparkSession, checkpoint: str, variable: str | None = None) -> DataFrame:
    reader = spark.read.format("statestore")
    return (reader.option("stateVarName", variable) if variable else reader).load(checkpoint)


def exact_keys(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Per generation, the keys that ``dedup.exact`` remembers."""
    held = _state(spark, checkpoint, "held").select("key.bucket", F.posexplode("value.gens").alias("place", "gen"))
    held = held.filter("gen is not null")
    places = held.agg(F.max("place")).first()[0]
    if places is None:
        return spark.createDataFrame([], "gen long, keys long")
    parts = [
        _state(spark, checkpoint, f"place{i}").groupBy("key.bucket").agg(F.count(F.lit(1)).alias("keys")).withColumn("place", F.lit(i))
        for i in range(places + 1)  # one for each generation that is kept
    ]
    counts = reduce(DataFrame.unionByName, parts)
    return held.join(counts, ["bucket", "place"]).groupBy("gen").agg(F.sum("keys").alias("keys"))


def watermark_keys(
    spark: SparkSession, checkpoint: str, retention: timedelta, window: timedelta = dedup.DEFAULT_WINDOW
) -> DataFrame:
    """Per generation, the keys that ``dedup.within_watermark`` remembers, by when each was accepted."""
    accepted = F.timestamp_micros(F.col("value.expiresAtMicros") - dedup.window_millis(retention) * 1000)
    rows = _state(spark, checkpoint).select(dedup.generation(accepted, window).alias("gen"))
    return rows.groupBy("gen").agg(F.count(F.lit(1)).alias("keys"))


def tracked(keys: DataFrame, newest: int) -> int:
    """The keys that a tick of generation ``newest`` can meet: its own and those of the one before."""
    return keys.filter(F.col("gen").isin(newest, newest - 1)).agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0]
