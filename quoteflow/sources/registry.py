"""The table of configured sources and the format each of them speaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.config import Source, check_names
from quoteflow.schemas import FRAMES, SOURCES


def registry_table(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    return spark.createDataFrame([(s.name, s.uri, s.format) for s in sources], SOURCES)


def bind_formats(frames: DataFrame, sources: Sequence[Source]) -> DataFrame:
    """Give every frame the format its source is registered with.

    A frame of an unregistered source gets no format and goes to quarantine. Names are registered once.
    Tables made from driver rows have no size Spark knows, so it is held against Spark's limit here.
    """
    check_names([s.name for s in sources])
    table = registry_table(frames.sparkSession, sources).select(
        F.col("name").alias("source"), F.upper("format").alias("format")
    )
    limit = frames.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if sum(len(s.name) + len(s.format) + 64 for s in sources) <= limit:
        table = F.broadcast(table)
    return frames.drop("format").join(table, "source", "left").select(FRAMES.fieldNames())
