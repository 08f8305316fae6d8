"""Counters, gauges, silence and audits."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from helpers import T0, at, frames, tick, ticks
from pyspark.sql import functions as F

from quoteflow.operators import audit, monitor
from quoteflow.operators.normalize import classify
from quoteflow.operators.spans import carry
from quoteflow.schemas import FRAMES, METRICS, SOURCES, STORE

ZERO = dict.fromkeys(METRICS.fieldNames(), 0)


def snapshots(spark, *rows):
    filled = [{**ZERO, "outbound_capacity": 10_000, **r} for r in rows]
    return spark.createDataFrame([tuple(r[n] for n in METRICS.fieldNames()) for r in filled], METRICS)


def lines(df):
    return [r.line for r in monitor.stats_line(monitor.received_rate(df)).orderBy("ts").collect()]


def test_the_rate_follows_from_neighbouring_snapshots(spark):
    df = snapshots(
        spark,
        {"ts": at(0), "received": 7}, {"ts": at(0.5), "received": 19}, {"ts": at(4.5), "received": 19}, {"ts": at(4.5), "received": 31},
    )
    assert [line.split()[1] for line in lines(df)] == ["recv/s=24", "recv/s=0", "recv/s=0"]


@pytest.mark.parametrize(("waiting", "room", "share"), [(0, 80, 0.0), (30, 80, 0.375), (90, 80, 1.125), (5, 0, 0.0)])
def test_the_fill_of_any_room(spark, waiting, room, share):
    df = snapshots(spark, {"ts": at(0)}, {"ts": at(1), "outbound_count": waiting, "outbound_capacity": room})
    assert df.filter(F.col("ts") == F.lit(at(1))).select(monitor.fill()).first()[0] == share
    assert f"fill={share * 100:.0f}%" in lines(df)[0].replace("fill=113%", "fill=112%")


def test_every_gauge_has_its_own_place_in_the_line(spark):
    names = ["received", "parse_errors", "deduplicated", "written", "dropped", "tracked_keys", "connections_up", "source_count"]
    last = {n: 11 * (i + 1) for i, n in enumerate(names)}
    (line,) = lines(snapshots(spark, {"ts": at(0)}, {"ts": at(11), **last}))
    assert line == "stats recv/s=1 recv=11 parse=22 dedup=33 written=44 dropped=55 fill=0% keys=66 conns=77/88"


def test_values_are_carried_over_spans(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), t, rng.choice([None, *range(9)])) for t in range(200)]
    df = carry(
        spark.createDataFrame(rows, "k string, t long, x long"), ["k"], F.floor(F.col("t") / 7), ["t"],
        lagged={"before": "t"}, running={"sum": ("sum", "x"), "top": ("max", "x")},
    )
    assert df.columns == ["k", "t", "x", "before", "sum", "top"]
    want, last, xs = [], {}, {}
    for k, t, x in rows:
        known = xs.setdefault(k, [])
        known += [x] if x is not None else []
        want.append((k, t, x, last.get(k), sum(known) if known else None, max(known, default=None)))
        last[k] = t
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])
    # a sum of nothing yet may be 0 or null
    assert [(*r[:4], r[4] or 0, r[5]) for r in got] == [(*r[:4], r[4] or 0, r[5]) for r in want]


def test_high_water(spark):
    df = snapshots(spark, *[{"ts": at(i), "outbound_count": n} for i, n in enumerate([3, 9, 4, 12, 0])])
    assert [r.high_water for r in monitor.high_water(df).orderBy("ts").collect()] == [3, 9, 9, 12, 12]


def feed(spark):
    """exchange-c: one tick twice, another once, a broken frame and a blank; exchange-b: later."""
    rows = [
        ("exchange-c", "C", "X|100|1|5", at(0), 0),
        ("exchange-c", "C", "X|100|1|5", at(1), 1),
        ("exchange-c", "C", "X|101|1|5", at(2), 2),
        ("exchange-c", "C", "broken", at(3), 3),
        ("exchange-c", "C", " ", at(4), 4),
        ("exchange-b", "B", '{"alive":true}', at(130), 5),
        ("exchange-b", "B", '{"s":"X","p":"1","v":"1","t":"2026-08-01T00:00:00Z"}', at(131), 6),
        ("exchange-b", "B", "broken", at(500), 7),
    ]
    return classify(spark.createDataFrame(rows, FRAMES))


def test_source_counters(spark):
    rows = monitor.source_counters(feed(spark)).orderBy("source").collect()
    assert [tuple(r) for r in rows] == [("exchange-b", 1, 1, 1), ("exchange-c", 3, 1, 1)]


def test_flow_by_source_accounts_for_every_frame(spark):
    rows = monitor.flow_by_source(monitor.flow_by_generation(feed(spark))).orderBy("source").collect()
    assert [tuple(r)[:6] for r in rows] == [("exchange-b", 1, 1, 1, 1, 0), ("exchange-c", 3, 1, 1, 2, 1)]


def test_metrics_and_snapshot(spark):
    m = monitor.metrics(monitor.flow_by_generation(feed(spark)), source_count=4)
    rows = m.orderBy("ts").collect()
    assert [r.received for r in rows] == [3, 4, 4]
    assert [r.tracked_keys for r in rows] == [2, 3, 0]
    assert [r.connections_up for r in rows] == [1, 1, 1]
    last = monitor.snapshot(m).first()
    assert (last.received, last.parse_errors, last.ignored, last.deduplicated, last.written) == (4, 2, 2, 1, 3)
    assert (last.source_count, last.outbound_fill) == (4, 0.0)


def test_throughput_per_second(spark):
    rows = monitor.throughput(feed(spark), "2 seconds").filter("source = 'exchange-c'").orderBy("interval_start")
    assert [tuple(r)[2:] for r in rows.collect()] == [(2, 0, 0), (1, 1, 0), (0, 0, 1)]


def test_live_sources(spark):
    df = spark.createDataFrame([("a", at(0)), ("b", at(95)), ("c", at(100))], "source string, arrival_ts timestamp")
    live = {r.source: r.connected for r in monitor.live_sources(df, timedelta(seconds=10)).collect()}
    assert live == {"a": False, "b": True, "c": True}


def arrivals(spark, rows):
    return spark.createDataFrame([(s, at(sec)) for s, sec in rows], "source string, arrival_ts timestamp")


@pytest.mark.parametrize("seed", [1, 2])
def test_silence_agrees_with_sorted_arrivals(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(3)}", rng.randrange(0, 20_000) / rng.choice([1, 1, 10])) for _ in range(900)]
    rows += [("s0", 30_000.0)] * 400 + [("s0", 30_010.0), ("s0", 30_020.001)]
    gaps, sessions = [], []
    for source in sorted({s for s, _ in rows}):
        times = sorted(t for s, t in rows if s == source)
        start = before = times[0]
        n = 0
        for t in times:
            if t - before > 10 + 1e-9:
                gaps.append((source, before, t))
                sessions.append((source, start, before, n))
                start, n = t, 0
            before, n = t, n + 1
        sessions.append((source, start, before, n))

    def rel(x):
        return round((x - T0.replace(tzinfo=None)).total_seconds(), 6)

    df = arrivals(spark, rows)
    ntz = lambda d: d.select(*[F.col(c).cast("timestamp_ntz") if t == "timestamp" else c for c, t in d.dtypes])
    got = [(r[0], rel(r[1]), rel(r[2])) for r in ntz(monitor.idle_gaps(df, timedelta(seconds=10))).collect()]
    assert sorted(got) == sorted(gaps)
    got = ntz(monitor.sessions(df, timedelta(seconds=10))).collect()
    assert sorted((r.source, rel(r.session_start), rel(r.session_end), r.frames) for r in got) == sorted(sessions)


def stored(spark, rows):
    when = datetime(2026, 7, 30, 12)
    return spark.createDataFrame([(s, t, Decimal(p), Decimal(1), when) for s, t, p in rows], STORE)


def test_audits_of_the_store(spark):
    df = stored(spark, [("a", "X", 1), ("a", "X", 1), ("a", "X", 2), ("b", "X", 1)])
    assert tuple(audit.store_counts(df).first()) == (4, 2)
    assert audit.distinct_key_count(df).first()[0] == 3
    assert [(r.source, r.price, r.copies) for r in audit.duplicate_audit(df).collect()] == [("a", 1, 2)]
    assert sorted(r.source for r in audit.stored_sources(df).collect()) == ["a", "b"]
    assert [r.price for r in audit.first_rows(df, 3).collect()] == [1, 1, 2]
    assert tuple(audit.store_counts(df.filter("false")).first()) == (0, 0)


def test_source_coverage(spark):
    df = stored(spark, [("a", "X", 1), ("b", "X", 1)])
    expected = spark.createDataFrame([("a", "u", "A"), ("c", "u", "A")], SOURCES)
    assert [r.source for r in audit.missing_sources(df, expected).collect()] == ["c"]
    assert [r.source for r in audit.unexpected_sources(df, expected).collect()] == ["b"]


def adjacent(rows):
    out = {}
    for source in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == source), key=lambda r: (r[6], r[7]))
        out[source] = (len(mine), sum(a[:6] == b[:6] for a, b in zip(mine, mine[1:], strict=False)))
    return out


def test_adjacent_duplicates_across_all_cuts(spark):
    rng = random.Random(5)
    # a third of all rows at one moment of one source, in long runs of equal ticks
    rows = [tick(7, i, ticker=f"T{i // 100 % 2}") for i in range(1000)]
    rows += [tick(rng.randrange(50), 1000 + i, source=f"s{i % 3}", price=rng.randrange(3)) for i in range(2000)]
    want = adjacent(rows)
    rng.shuffle(rows)
    got = {r.source: (r.received, r.adjacent_duplicates) for r in audit.adjacent_duplicates(ticks(spark, rows)).collect()}
    assert got == want


def test_no_adjacent_duplicates(spark):
    df = ticks(spark, [tick(0, 0, price=1), tick(1, 1, price=2), tick(2, 2, price=1)])
    assert audit.adjacent_duplicates(df).first().has_adjacent_duplicate is False


def test_reconcile_finds_what_is_missing(spark):
    counters = spark.createDataFrame([("a", 5, 1), ("b", 3, 0)], "source string, received long, deduplicated long")
    rows = audit.reconcile(
        counters,
        stored(spark, [("a", "X", 1), ("a", "X", 2), ("b", "X", 1)]),
        stored(spark, [("a", "X", 3), ("a", "X", 4)]),
    )
    got = {r.source: (r.written, r.dropped, r.unaccounted, r.balanced) for r in rows.collect()}
    assert got == {"a": (2, 2, 0, True), "b": (1, 0, 2, False)}


def test_frames_with_the_wrong_format_show_up_as_ignored(spark):
    df = classify(frames(spark, [("B", '{"symbol":"X","price":1,"size":1,"ts":1}')]))
    assert monitor.source_counters(df).first().ignored == 1
