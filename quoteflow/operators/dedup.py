"""Dropping exact re-sends inside a bounded window.

Arrival time is cut into generations of one window each. A key is accepted in a generation unless it
was accepted in that one or the one before, so it is remembered for one to two windows, and a
rejected re-send does not extend that. Generations lie on a fixed grid, which makes the result
independent of the order and partitioning of the input.
"""

from __future__ import annotations

from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.schemas import KEY, TICKS

DEFAULT_WINDOW = timedelta(minutes=2)


def window_millis(window: timedelta) -> int:
    millis = int(window.total_seconds() * 1000)
    if millis <= 0:
        raise ValueError(f"the dedup window must be positive, not {window}")
    return millis


def generation(arrival_ts: Column, window: timedelta) -> Column:
    millis, width = F.unix_millis(arrival_ts), window_millis(window)
    return F.floor((millis - F.pmod(millis, F.lit(width))) / width).cast("bigint")


def decisions(
    ticks: DataFrame, window: timedelta = DEFAULT_WINDOW, key: list[str] = KEY, remembered: DataFrame | None = None
) -> DataFrame:
    """One row per key and generation: first and last arrival, copies, and whether it is accepted.

    Copies are counted before the first shuffle, so a key that holds a large share of all rows
    arrives as one row per task. What follows works on at most one row per key and generation.

    A key's generations fall into runs without gaps. After a gap the next one is always accepted,
    and inside a run every second one is, starting with the first.

    ``remembered`` has keys and generations they were accepted in before these ticks came, as ``memory`` gives them.
    Such a generation begins a run, and what comes in it now is a re-send.
    """
    candidates = (
        ticks.withColumn("gen", generation(F.col("arrival_ts"), window))
        .groupBy(*key, "gen")
        .agg(
            F.min("arrival_ts").alias("arrival_ts"),
            F.max("arrival_ts").alias("last_arrival_ts"),
            F.min(_arrival_order()).alias("_order"),
            F.count(F.lit(1)).alias("copies"),
        )
        .withColumn("_before", F.lit(False))
    )
    if remembered is not None:
        candidates = _with_memory(candidates, remembered, key)
    # All keys of a source start alike; sorting by a hash first settles nearly every comparison.
    candidates = candidates.withColumn("_hash", F.xxhash64(*key))
    by_key = Window.partitionBy("_hash", *key).orderBy("gen")
    previous = F.lag("gen").over(by_key)
    run_start = F.max("_starts").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        candidates.withColumn("_starts", F.when(previous.isNull() | (F.col("gen") - previous > 1), F.col("gen")))
        .withColumn("accepted", ((F.col("gen") - run_start) % 2 == 0) & ~F.col("_before"))
        .filter("copies > 0")
        .select(
            *key,
            "gen",
            "arrival_ts",
            "last_arrival_ts",
            (F.col("_order") - _order_base()).cast("bigint").alias("frame_seq"),
            "copies",
            "accepted",
        )
    )


def _with_memory(candidates: DataFrame, remembered: DataFrame, key: list[str]) -> DataFrame:
    """Candidates and remembered generations as one row for each key and generation.

    What is remembered is two generations and joins the shuffle that the candidates need anyway.
    """
    others = [c for c in candidates.columns if c not in (*key, "gen", "copies", "_before")]
    types = dict(candidates.dtypes)
    before = remembered.select(
        *key, "gen", *[F.lit(None).cast(types[c]).alias(c) for c in others], F.lit(0).cast("bigint").alias("copies"), F.lit(True).alias("_before")
    )
    return candidates.unionByName(before).groupBy(*key, "gen").agg(
        *[F.max(c).alias(c) for c in others], F.sum("copies").alias("copies"), F.bool_or("_before").alias("_before")
    )


def memory(decided: DataFrame, remembered: DataFrame | None = None, key: list[str] = KEY) -> DataFrame:
    """Keys and generations that ticks from now on can still meet: those accepted in the newest generation and the one before."""
    accepted = decided.filter("accepted").select(*key, "gen")
    if remembered is not None:
        accepted = accepted.unionByName(remembered.select(*key, "gen"))
        newest = decided.select("gen").unionByName(remembered.select("gen")).agg(F.max("gen").alias("newest"))
    else:
        newest = decided.agg(F.max("gen").alias("newest"))
    return accepted.join(F.broadcast(newest), F.col("gen") >= F.col("newest") - 1).drop("newest")  # one row


def _order_base() -> Column:
    return F.unix_micros("arrival_ts").cast("decimal(18,0)") * F.lit(Decimal(2 * 10**19))


def _arrival_order() -> Column:
    """(arrival_ts, frame_seq) as one number, which a hash aggregate can keep in place.

    Microseconds are spaced wider than any two 64-bit ``frame_seq`` are apart.
    """
    return (_order_base() + F.col("frame_seq")).cast("decimal(38,0)")


def accepted_ticks(decided: DataFrame) -> DataFrame:
    return decided.filter("accepted").select(TICKS.fieldNames())


def deduplicate(ticks: DataFrame, window: timedelta = DEFAULT_WINDOW) -> DataFrame:
    """The ticks that survive, each as its first arrival in the accepting generation."""
    return accepted_ticks(decisions(ticks, window))


def decision_counts(decided: DataFrame) -> DataFrame:
    """Per source: ticks offered, accepted, and dropped as re-sends."""
    accepted = F.count_if("accepted")
    offered = F.sum("copies")
    return decided.groupBy("source").agg(
        offered.alias("received"), accepted.alias("accepted"), (offered - accepted).alias("deduplicated")
    )


def tracked_keys(per_generation: DataFrame) -> DataFrame:
    """Add ``tracked_keys``: keys remembered in a generation, its own plus the previous one's.

    Takes one row per generation with ``gen`` and ``accepted``; generations without traffic have no
    row and none is made up for them.
    """
    others = [c for c in per_generation.columns if c not in ("gen", "accepted")]
    own = F.struct(
        F.col("gen").alias("gen"), F.col("accepted").alias("accepted"), F.lit(0).cast("bigint").alias("carried"),
        *[F.col(c).alias(c) for c in others],
    )
    # The same keys once more, one generation on.
    types = dict(per_generation.dtypes)
    later = F.struct(
        (F.col("gen") + 1).alias("gen"), F.lit(None).cast("bigint").alias("accepted"),
        F.col("accepted").alias("carried"), *[F.lit(None).cast(types[c]).alias(c) for c in others],
    )
    return (
        per_generation.select(F.inline(F.array(own, later)))
        .groupBy("gen")
        .agg(
            F.max("accepted").alias("accepted"),
            F.sum("carried").alias("carried"),
            *[F.max(c).alias(c) for c in others],
        )
        .filter(F.col("accepted").isNotNull())
        .withColumn("tracked_keys", F.col("accepted") + F.col("carried"))
        .drop("carried")
    )


def accepted_per_generation(decided: DataFrame) -> DataFrame:
    return decided.groupBy("gen").agg(F.count_if("accepted").alias("accepted"))
