"""Checks on the stored ticks and on the accounting of every frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.schemas import KEY, STORE_COLUMNS


def store_counts(store: DataFrame) -> DataFrame:
    """Rows and distinct sources."""
    return store.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("source").alias("distinct_sources")
    )


def distinct_rows(store: DataFrame) -> DataFrame:
    return store.select(STORE_COLUMNS).distinct()


def distinct_key_count(store: DataFrame) -> DataFrame:
    return distinct_rows(store).agg(F.count(F.lit(1)).alias("distinct_keys"))


def stored_sources(store: DataFrame) -> DataFrame:
    return store.select("source").distinct()


def source_coverage(store: DataFrame, registry: DataFrame) -> DataFrame:
    """Every source that is expected or stored, and whether it is each of these."""
    sides = registry.select(F.col("name").alias("source"), F.lit(1).alias("e"), F.lit(0).alias("s")).unionByName(
        stored_sources(store).select("source", F.lit(0).alias("e"), F.lit(1).alias("s"))
    )
    return sides.groupBy("source").agg(
        (F.max("e") == 1).alias("expected"), (F.max("s") == 1).alias("stored")
    )


def missing_sources(store: DataFrame, registry: DataFrame) -> DataFrame:
    return source_coverage(store, registry).filter("expected AND NOT stored").select("source")


def unexpected_sources(store: DataFrame, registry: DataFrame) -> DataFrame:
    return source_coverage(store, registry).filter("stored AND NOT expected").select("source")


def duplicate_audit(store: DataFrame) -> DataFrame:
    """Identical rows stored more than once."""
    return store.groupBy(*STORE_COLUMNS).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def adjacent_duplicates(ticks: DataFrame) -> DataFrame:
    """Per source: ticks, and how many equal the tick that arrived just before them.

    The arrivals of a source are cut into consecutive segments of even size, whatever the source or
    the moment they crowd into. Ticks are compared inside their segment; across segments only the
    first and last tick of each meet.
    """
    spark = ticks.sparkSession
    segments = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.struct("arrival_ts", "frame_seq")
    tick = F.struct(*KEY)
    in_segment = Window.partitionBy("segment", "source").orderBy("arrival_ts", "frame_seq")
    per_segment = (
        ticks.select(*KEY, "arrival_ts", "frame_seq")
        .repartitionByRange(segments, "source", "arrival_ts", "frame_seq")
        .withColumn("segment", F.spark_partition_id())
        .withColumn("_same", F.lag(tick).over(in_segment).eqNullSafe(tick))
        .groupBy("segment", "source")
        .agg(
            F.count(F.lit(1)).alias("received"),
            F.count_if("_same").alias("inside"),
            F.min_by(tick, order).alias("head"),
            F.max_by(tick, order).alias("tail"),
        )
    )
    across = F.lag("tail").over(Window.partitionBy("source").orderBy("segment")).eqNullSafe(F.col("head"))
    adjacent = F.sum(F.col("inside") + F.when(F.col("_across"), 1).otherwise(0))
    return (
        per_segment.withColumn("_across", across)
        .groupBy("source")
        .agg(F.sum("received").alias("received"), adjacent.alias("adjacent_duplicates"))
        .withColumn("has_adjacent_duplicate", F.col("adjacent_duplicates") > 0)
    )


def reconcile(counters: DataFrame, stored: DataFrame, dead: DataFrame) -> DataFrame:
    """Per source: every received tick must be a re-send, written, counted as dropped, or late.

    ``counters`` has received, deduplicated and, where a policy drops late ticks, late_dropped per
    source as counted on the way; written and dropped are counted in the tables themselves.
    ``unaccounted`` must be 0.
    """
    zero = F.lit(0).cast("bigint")
    names = ["received", "deduplicated", "late_dropped", "written", "dropped"]

    def side(df: DataFrame, **given) -> DataFrame:
        return df.select("source", *[given.get(n, zero).alias(n) for n in names])

    def rows(df: DataFrame) -> DataFrame:
        return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))

    known = {n: F.col(n) for n in names[:3] if n in counters.columns}
    return (
        side(counters, **known)
        .unionByName(side(rows(stored), written=F.col("n")))
        .unionByName(side(rows(dead), dropped=F.col("n")))
        .groupBy("source")
        .agg(*[F.sum(n).alias(n) for n in names])
        .withColumn(
            "unaccounted",
            F.col("received") - F.col("deduplicated") - F.col("late_dropped") - F.col("written") - F.col("dropped"),
        )
        .withColumn("balanced", F.col("unaccounted") == 0)
    )


def written_equals_stored(counters: DataFrame, stored: DataFrame) -> DataFrame:
    """Per source: rows the writer counted as written, rows in the store, and whether they agree."""
    zero = F.lit(0).cast("bigint")
    counted = counters.groupBy("source").agg(F.sum("written").alias("written"))
    there = stored.groupBy("source").agg(F.count(F.lit(1)).alias("stored"))
    return (
        counted.select("source", "written", zero.alias("stored"))
        .unionByName(there.select("source", zero.alias("written"), "stored"))
        .groupBy("source")
        .agg(F.sum("written").alias("written"), F.sum("stored").alias("stored"))
        .withColumn("equal", F.col("written") == F.col("stored"))
    )


def first_rows(store: DataFrame, n: int) -> DataFrame:
    """The first ``n`` stored ticks by event time, with ties broken by the other columns."""
    return store.orderBy("ts", "source", "ticker", "price", "volume").limit(n)
