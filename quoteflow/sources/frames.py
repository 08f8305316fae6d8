"""Reading landed frames, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.schemas import FRAMES
from quoteflow.sources.lines import text_lines


def read_frames(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Everything landed so far. ``file_format`` is parquet, json or orc."""
    return spark.read.schema(FRAMES).format(file_format).load(path)


def stream_frames(
    spark: SparkSession, path: str, file_format: str = "parquet", max_files_per_trigger: int | None = None
) -> DataFrame:
    """Frames as they land; the checkpoint of the query remembers which files were taken."""
    reader = spark.readStream.schema(FRAMES).format(file_format)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def text_frames(
    spark: SparkSession, path: str, source: str, fmt: str, stream: bool = False,
    max_files_per_trigger: int | None = None, arrival: Column | None = None,
) -> DataFrame:
    """One feed landed as plain text, a frame per line, as a table or as a stream.

    ``arrival`` says when a line arrived, in terms of ``path``, ``modified`` and ``raw``; without it the time its file
    was modified stands in. ``frame_seq`` is the byte where the line begins, above it 15 bits of a hash of the file's
    name: the order of lines inside a file, the same however the file is read and cut.
    """
    file = F.shiftleft(F.pmod(F.xxhash64("path"), F.lit(1 << 15)), 48)
    return text_lines(spark, path, stream, max_files_per_trigger).select(
        F.lit(source).alias("source"),
        F.lit(fmt).alias("format"),
        "raw",
        (F.col("modified") if arrival is None else arrival).alias("arrival_ts"),
        (file + F.col("place")).alias("frame_seq"),
    )


def kafka_frames(
    spark: SparkSession, servers: str, topic: str, source: str, fmt: str,
    max_offsets_per_trigger: int | None = None,
) -> DataFrame:
    """One feed from a Kafka topic. Needs Spark's Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return from_kafka(reader.load(), source, fmt)


def from_kafka(records: DataFrame, source: str, fmt: str) -> DataFrame:
    """Kafka records as frames; offsets give the order inside a partition."""
    return records.select(
        F.lit(source).alias("source"),
        F.lit(fmt).alias("format"),
        F.col("value").cast("string").alias("raw"),
        F.col("timestamp").alias("arrival_ts"),
        (F.shiftleft(F.col("partition").cast("bigint"), 48) + F.col("offset")).alias("frame_seq"),
    )


def land_text(df: DataFrame, path: str) -> None:
    """Write ``raw`` as text files, one frame per line."""
    df.select(F.col("raw").alias("value")).write.text(path)
