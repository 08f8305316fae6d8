"""Configuration, registry and feeds."""

from datetime import timedelta

import pytest
from helpers import at, frames
from pyspark.sql import functions as F

from quoteflow.config import ConfigError, JobConfig, SinkOptions, Source, check_sources
from quoteflow.operators.fanin import fan_in
from quoteflow.operators.normalize import classify, ticks
from quoteflow.sources.frames import from_kafka, read_frames, stream_frames, text_frames
from quoteflow.sources.registry import bind_formats

A = {"name": "exchange-a", "uri": "tcp://one.quotes.example", "format": "A"}
B = {"name": "exchange-b", "uri": "tcp://two.quotes.example", "format": "b"}


def test_loads_sources_and_store():
    config = JobConfig.load({"store": "/data/ticks", "drain_timeout_seconds": 5, "sources": [A, B]}, {})
    assert config.store == "/data/ticks"
    assert config.drain_timeout == timedelta(seconds=5)
    assert config.dedup_window == timedelta(minutes=2)
    assert config.sources[1] == Source("exchange-b", "tcp://two.quotes.example", "B")


def test_environment_overrides_the_store():
    config = JobConfig.load({"store": "/data/ticks", "sources": [A]}, {"QUOTEFLOW_STORE": "/elsewhere"})
    assert config.store == "/elsewhere"


@pytest.mark.parametrize(
    "settings, message",
    [
        ({"store": "x"}, "no sources"),
        ({"sources": [A]}, "no store"),
        ({"store": " ", "sources": [A]}, "no store"),
        ({"store": "x", "sources": [{**A, "uri": None}]}, "'exchange-a' has no uri"),
        ({"store": "x", "sources": [{**A, "format": " "}]}, "'exchange-a' has no format"),
        ({"store": "x", "sources": [A, {**B, "name": ""}]}, "index 1 has no name"),
        ({"store": "x", "sources": [{**A, "format": "Z"}]}, "unknown format 'Z'"),
        ({"store": "x", "sources": [A], "dedup_window_seconds": 0}, "positive"),
    ],
)
def test_rejects(settings, message):
    with pytest.raises(ConfigError, match=message):
        JobConfig.load(settings, {})


def test_backoff_ceilings():
    options = SinkOptions(backoff_initial=timedelta(milliseconds=500), backoff_max=timedelta(seconds=30))
    ceilings = [options.delay_ceiling(n) / timedelta(milliseconds=1) for n in range(1, 9)]
    assert ceilings == [500, 1000, 2000, 4000, 8000, 16000, 30000, 30000]


@pytest.mark.parametrize(
    "given",
    [
        {"max_attempts": 0},
        {"backoff_initial": timedelta(0)},
        {"backoff_max": timedelta(milliseconds=1)},
        {"backoff_factor": 0.5},
        {"on_exhausted": "ignore"},
        {"max_files": 0},
    ],
)
def test_rejects_sink_options(given):
    with pytest.raises(ConfigError):
        SinkOptions(**given)


def test_binding_gives_each_source_its_format(spark):
    sources = [Source("exchange-a", "u", "C"), Source("exchange-b", "u", "B")]
    df = frames(spark, [("A", "x|1|1|1"), ("B", '{"alive":true}')]).drop("format")
    bound = bind_formats(df, sources)
    assert "BroadcastHashJoin" in bound._jdf.queryExecution().executedPlan().toString()
    rows = classify(bound).orderBy("frame_seq").select("format", "status").collect()
    assert [tuple(r) for r in rows] == [("C", "tick"), ("B", "ignored")]


def test_frames_of_a_source_that_is_not_registered_are_quarantined(spark):
    bound = bind_formats(frames(spark, [("A", "x"), ("C", "a|1|1|1")]).drop("format"), [Source("exchange-c", "u", "C")])
    rows = classify(bound).orderBy("frame_seq").select("status", "reason").collect()
    assert [tuple(r) for r in rows] == [("parse_error", "unknown_format"), ("tick", None)]


def test_a_name_is_registered_once(spark):
    twice = [{"name": "x", "uri": "u", "format": "A"}, {"name": " x ", "uri": "v", "format": "B"}]
    with pytest.raises(ConfigError, match="more than once"):
        check_sources(twice)
    with pytest.raises(ConfigError, match="more than once"):
        bind_formats(frames(spark, [("A", "x")]), [Source("x", "u", "A")] * 2)


def test_fan_in_keeps_everything_of_every_feed(spark):
    feeds = [spark.range(5).withColumn("f", F.lit(n)) for n in range(3)]
    assert fan_in(feeds).count() == 15
    assert fan_in([feeds[0], feeds[1].select("f", "id")]).columns == ["id", "f"]
    with pytest.raises(ValueError):
        fan_in([])


def test_text_feed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x|1|1|1\n   \nbroken\n")
    feed = text_frames(spark, str(tmp_path), "exchange-c", "C")
    assert feed.select("frame_seq").distinct().count() == 3
    rows = classify(feed).select("status").collect()
    assert sorted(r.status for r in rows) == ["ignored", "parse_error", "tick"]


@pytest.mark.parametrize("file_format", ["parquet", "json", "orc"])
def test_landed_frames_read_alike_as_table_and_stream(spark, tmp_path, file_format):
    path = str(tmp_path / "frames")
    df = frames(spark, [("C", "x|1|1|1"), ("C", "y|2|2|2")])
    df.write.format(file_format).save(path)
    assert read_frames(spark, path, file_format).exceptAll(df).isEmpty()
    out = str(tmp_path / "out")
    (
        stream_frames(spark, path, file_format, max_files_per_trigger=1)
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    assert df.exceptAll(spark.read.parquet(out)).isEmpty()


def test_kafka_records_become_frames(spark):
    records = spark.createDataFrame(
        [(bytearray(b"x|1|1|1"), at(1), 2, 7), (bytearray(b"x|1|1|1"), at(1), 0, 9)],
        "value binary, timestamp timestamp, partition int, offset long",
    )
    df = from_kafka(records, "exchange-c", "C")
    assert [r.frame_seq for r in df.collect()] == [(2 << 48) + 7, 9]
    assert ticks(classify(df)).count() == 2
