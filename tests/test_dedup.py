"""The generation rule on whole tables, against a plain fold over the arrivals."""

import random
from collections import defaultdict
from datetime import timedelta

import pytest
from helpers import T0, at, tick, ticks
from pyspark.sql import functions as F

from quoteflow.operators import dedup
from quoteflow.session import settled

MINUTE = 60


def accepted_seconds(df):
    rows = dedup.deduplicate(df).select(F.unix_seconds("arrival_ts") - int(T0.timestamp())).collect()
    return sorted(r[0] for r in rows)


def fold(rows, window_ms):
    """Keys here differ only in the ticker. Accept a tick unless its key was accepted in its generation or the one before."""
    last, out = {}, defaultdict(lambda: [0, None, False])
    for row in sorted(rows, key=lambda r: (r[6], r[7])):
        key, gen = row[1], int(row[6].timestamp() * 1000) // window_ms
        entry = out[(key, gen)]
        entry[0] += 1
        if entry[1] is None:
            entry[1] = row[7]
            entry[2] = key not in last or gen >= last[key] + 2
            if entry[2]:
                last[key] = gen
    return {(k, g): tuple(v) for (k, g), v in out.items()}


def decided(df, window=dedup.DEFAULT_WINDOW):
    return {
        (r.ticker, r.gen): (r.copies, r.frame_seq, r.accepted)
        for r in dedup.decisions(df, window).select("ticker", "gen", "copies", "frame_seq", "accepted").collect()
    }


def test_first_arrival_is_accepted_and_a_resend_is_not(spark):
    assert accepted_seconds(ticks(spark, [tick(0, 0), tick(1, 1), tick(1, 2)])) == [0]


@pytest.mark.parametrize(
    "change",
    [{"source": "exchange-b"}, {"ticker": "ETH-USD"}, {"price": 101}, {"volume": 2}, {"ts": at(0.001)}, {"sub": 1}],
    ids=lambda c: next(iter(c)),
)
def test_a_difference_in_any_field_makes_another_quote(spark, change):
    assert accepted_seconds(ticks(spark, [tick(0, 0), tick(1, 1, **change)])) == [0, 1]


@pytest.mark.parametrize(
    "arrivals, accepted",
    [
        ([0, 3 * MINUTE], [0]),
        ([0, 5 * MINUTE], [0, 5 * MINUTE]),
        # a rejected re-send does not extend the memory
        ([0, 3 * MINUTE, 5 * MINUTE], [0, 5 * MINUTE]),
        ([0, 119.999, 120, 239.999, 240], [0, 240]),
        ([0, 120, 240, 360, 480], [0, 240, 480]),
        ([0, 360], [0, 360]),
    ],
)
def test_memory_lasts_one_to_two_windows(spark, arrivals, accepted):
    assert accepted_seconds(ticks(spark, [tick(s, i) for i, s in enumerate(arrivals)])) == accepted


def test_keys_across_a_rotation(spark):
    rows = [tick(m * MINUTE, i, ticker=f"SYM-{i}") for m in (0, 1, 3) for i in range(500)]
    window = timedelta(minutes=1)
    assert dedup.decisions(ticks(spark, rows), window).groupBy("gen").agg(
        F.count_if("accepted").alias("n")
    ).orderBy("gen").select("n").collect() == [(500,), (0,), (500,)]


def test_tracked_keys_stay_bounded(spark):
    rows = [tick(w * 60, 0, ticker=f"SYM-{w * 1000 + i}") for w in range(20) for i in range(1000)]
    gauge = dedup.tracked_keys(
        dedup.accepted_per_generation(dedup.decisions(ticks(spark, rows), timedelta(minutes=1)))
    )
    counts = [r.tracked_keys for r in gauge.orderBy("gen").collect()]
    assert counts == [1000] + [2000] * 19


def test_tracked_keys_forget_across_a_gap(spark):
    per_gen = spark.createDataFrame([(1, 5), (2, 7), (4, 1)], "gen long, accepted long")
    assert dedup.tracked_keys(per_gen).orderBy("gen").collect() == [(1, 5, 5), (2, 7, 12), (4, 1, 1)]


def test_heavy_overlap_of_many_inputs(spark):
    rows = [tick(copy, copy, ticker=f"SYM-{i}") for copy in range(8) for i in range(5000)]
    df = ticks(spark, rows).repartition(7)
    assert dedup.deduplicate(df).select("ticker").distinct().count() == 5000
    counts = dedup.decision_counts(dedup.decisions(df)).collect()
    assert [tuple(r) for r in counts] == [("exchange-a", 40000, 5000, 35000)]


def test_random_arrivals_agree_with_a_fold_in_any_partitioning(spark):
    rng = random.Random(7)
    rows = [
        tick(rng.choice([rng.randrange(0, 3600), rng.randrange(0, 40) * 120]), seq, ticker=f"SYM-{rng.randrange(60)}")
        for seq in range(3000)
    ]
    want = fold(rows, 120_000)
    rng.shuffle(rows)
    for parts in (1, 5):
        assert decided(ticks(spark, rows).repartition(parts)) == want


def test_one_key_with_a_third_of_all_rows(spark):
    rng = random.Random(3)
    rows = [tick(rng.randrange(0, 7200), i, ticker="HOT") for i in range(5000)]
    rows += [tick(rng.randrange(0, 7200), 5000 + i, ticker=f"SYM-{i % 4000}") for i in range(10000)]
    df = ticks(spark, rows)
    assert decided(df) == fold(rows, 120_000)
    # before the shuffle that brings a key together, it is down to a row per task and generation
    plan = dedup.decisions(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.index("partial_count") > plan.index("Window")


def test_frame_order_breaks_ties_even_at_the_ends_of_its_range(spark):
    rows = [tick(5, 2**63 - 1), tick(5, -(2**63)), tick(5, 0), tick(6, -(2**63))]
    assert [r.frame_seq for r in dedup.deduplicate(ticks(spark, rows)).collect()] == [-(2**63)]


def test_the_dedup_aggregates_by_hash(spark):
    plan = dedup.decisions(ticks(spark, [tick()]))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("window", [timedelta(0), timedelta(seconds=-1)])
def test_the_window_must_be_positive(window):
    with pytest.raises(ValueError, match="positive"):
        dedup.window_millis(window)


@pytest.mark.parametrize("seed", range(3))
def test_runs_cut_anywhere_in_time_decide_as_one_run(spark, seed):
    rng = random.Random(seed)
    rows = sorted((tick(rng.random() * 1500, i, ticker=f"K{rng.randrange(12)}") for i in range(400)), key=lambda r: r[6])
    whole = {(r.ticker, r.gen) for r in dedup.decisions(ticks(spark, rows)).filter("accepted").collect()}
    cuts = [0, *sorted(rng.sample(range(400), 5)), 400]
    got, before = [], None
    for a, b in zip(cuts, cuts[1:], strict=False):
        decided = settled(dedup.decisions(ticks(spark, rows[a:b]), remembered=before), "run")
        got += [(r.ticker, r.gen) for r in decided.filter("accepted").collect()]
        before = settled(dedup.memory(decided, before), "memory")
        assert before.select("gen").distinct().count() <= 2
    assert len(got) == len(set(got)) and set(got) == whole


def test_a_run_without_ticks_keeps_what_is_remembered(spark):
    first = dedup.decisions(ticks(spark, [tick(0, 0)]))
    kept = dedup.memory(first)
    empty = dedup.decisions(ticks(spark, []), remembered=kept)
    assert empty.isEmpty() and dedup.memory(empty, kept).count() == 1
    again = dedup.decisions(ticks(spark, [tick(1, 1)]), remembered=dedup.memory(empty, kept))
    assert [(r.copies, r.accepted) for r in again.collect()] == [(1, False)]
