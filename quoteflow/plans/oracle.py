"""SQL that states each registered query's answer straight from ``events``.

None of it parses wire text or uses the window form of the dedup: ticks are known from how the feed
is made, and the dedup rule is applied one generation after the other by a recursive query.
"""

from __future__ import annotations

from quoteflow.plans.event_feed import MALFORMED_REASONS

_KEY = "source, ticker, price, volume, ts_us"
_SAME_KEY = " AND ".join(f"c.{k} = r.{k}" for k in _KEY.split(", "))

_LETTER = "CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END"

_QUOTES = f"""
q AS (
  SELECT event_id, 'exchange-' || {_LETTER} AS source, upper({_LETTER}) AS format,
         upper(event_type) || '-' || CAST(user_id % 10 AS VARCHAR) AS ticker,
         CAST(value AS DECIMAL(18,2)) AS price,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS DECIMAL(18,2)) AS volume,
         epoch_us(ts) AS sent_us,
         CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000 * 1000
                           WHEN 1 THEN epoch_us(ts)
                           ELSE epoch_us(ts) // 1000000 * 1000000 END AS ts_us
  FROM events)"""

_FRAMES = f"""{_QUOTES},
fr AS (
  SELECT q.*, c.copy, event_id * 10 + c.copy AS frame_seq, sent_us + c.after * 1000000 AS at_us,
         CASE WHEN c.copy <= 3 THEN 'tick' WHEN c.copy = 4 THEN 'ignored' ELSE 'parse_error' END AS status
  FROM q JOIN (VALUES (0, 0, 1), (1, 30, 5), (2, 150, 5), (3, 330, 5), (4, 1, 11), (5, 2, 13))
         AS c(copy, after, every) ON q.event_id % c.every = 0)"""

_TICKS = f"""{_FRAMES},
tk AS (SELECT *, at_us // 120000000 AS gen FROM fr WHERE status = 'tick')"""

_DECIDED = f"""{_TICKS},
cand AS (
  SELECT {_KEY}, gen, min(at_us) AS at_us, count(*) AS copies,
         arg_min(frame_seq, CAST(at_us AS HUGEINT) * 1000000000000 + frame_seq) AS frame_seq
  FROM tk GROUP BY {_KEY}, gen),
r AS (
  SELECT {_KEY}, min(gen) AS gen FROM cand GROUP BY {_KEY}
  UNION ALL
  SELECT {", ".join(f"c.{k}" for k in _KEY.split(", "))}, min(c.gen) AS gen
  FROM r JOIN cand c ON {_SAME_KEY} AND c.gen >= r.gen + 2
  GROUP BY {", ".join(f"c.{k}" for k in _KEY.split(", "))}),
acc AS (SELECT c.* FROM cand c JOIN r ON {_SAME_KEY} AND c.gen = r.gen)"""

_PER_GEN = f"""{_DECIDED},
g AS (
  SELECT f.gen, f.received, f.parse_errors, f.ignored, f.sources, coalesce(a.accepted, 0) AS accepted,
         coalesce(a.lost, 0) AS lost
  FROM (SELECT at_us // 120000000 AS gen,
               count(*) FILTER (status = 'tick') AS received,
               count(*) FILTER (status = 'parse_error') AS parse_errors,
               count(*) FILTER (status = 'ignored') AS ignored,
               count(DISTINCT source) AS sources
        FROM fr GROUP BY 1) f
  LEFT JOIN (SELECT gen, count(*) AS accepted, count(*) FILTER (source = 'exchange-b') AS lost
             FROM acc GROUP BY gen) a ON a.gen = f.gen),
m AS (
  SELECT g.gen, (g.gen + 1) * 120000000 AS ts_us,
         CAST(sum(received) OVER w AS BIGINT) AS received,
         CAST(sum(parse_errors) OVER w AS BIGINT) AS parse_errors,
         CAST(sum(ignored) OVER w AS BIGINT) AS ignored,
         CAST(sum(received - accepted) OVER w AS BIGINT) AS deduplicated,
         CAST(sum(accepted - lost) OVER w AS BIGINT) AS written, CAST(sum(lost) OVER w AS BIGINT) AS dropped,
         accepted + CASE WHEN lag(gen) OVER w = gen - 1 THEN lag(accepted) OVER w ELSE 0 END AS tracked_keys,
         accepted AS outbound_count, sources AS connections_up
  FROM g WINDOW w AS (ORDER BY gen)),
rate AS (
  SELECT *, (received - lag(received) OVER (ORDER BY gen))
            / (CAST(ts_us - lag(ts_us) OVER (ORDER BY gen) AS DOUBLE) / 1000000) AS received_per_second
  FROM m)"""

# The frames of every seventeenth event land last, behind four stretches of the others; ten minutes are waited for.
_LATE = f"""{_TICKS},
span AS (SELECT min(at_us) AS low, (max(at_us) - min(at_us)) // 4 + 1 AS width FROM fr),
heard AS (
  SELECT max(at_us) // 1000 * 1000 - 600000000 AS mark_us FROM fr, span WHERE event_id % 17 <> 0 AND (at_us - low) // width < 3),
sorted AS (SELECT tk.*, coalesce(event_id % 17 = 0 AND at_us <= mark_us, FALSE) AS late FROM tk, heard),
kept AS (SELECT DISTINCT {_KEY} FROM sorted WHERE NOT late)"""

_SILENCE = 30 * 60 * 1_000_000

_GAPS = f"""{_FRAMES},
heard AS (
  SELECT source, at_us, lag(at_us) OVER (PARTITION BY source ORDER BY at_us, frame_seq) AS before_us FROM fr)"""

_TICK_COLUMNS = (
    "source, ticker, CAST(price AS DOUBLE) AS price, CAST(volume AS DOUBLE) AS volume, ts_us, "
    "0 AS ts_sub_us, at_us AS arrival_us, frame_seq"
)
_FIVE = "source, ticker, CAST(price AS DOUBLE) AS price, CAST(volume AS DOUBLE) AS volume, ts_us"

# decimal and time text as the formats write them
_NUM = "regexp_replace(regexp_replace(CAST({} AS VARCHAR), '0+$', ''), '[.]$', '')"
_P, _V = _NUM.format("price"), _NUM.format("volume")
_ISO = "strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00'"
_MS, _S = "CAST(ts_us // 1000 AS VARCHAR)", "CAST(ts_us // 1000000 AS VARCHAR)"

_WIRE = f"""CASE format
  WHEN 'A' THEN '{{"symbol":"' || ticker || '","price":' || {_P} || ',"size":' || {_V} || ',"ts":' || {_MS} || '}}'
  WHEN 'B' THEN '{{"s":"' || ticker || '","p":"' || {_P} || '","v":"' || {_V} || '","t":"' || {_ISO} || '"}}'
  ELSE ticker || '|' || {_P} || '|' || {_V} || '|' || {_S} END"""

_A = f"""'{{"symbol":"' || ticker || '","price":' || {_P} || ',"size":' || {_V} || ',"ts":' || {_MS}"""
_B = f"""'{{"s":"' || ticker || '","p":"' || {_P} || '"'"""
_C = f"ticker || '|' || {_P} || '|' || {_V} || '|' || {_S}"
_BROKEN = {
    "A": [
        f"""'{{"symbol":"' || ticker || '","size":' || {_V} || ',"ts":' || {_MS} || '}}'""",
        f"""'{{"symbol":"' || ticker || '","price":[' || {_P} || '],"size":' || {_V} || ',"ts":' || {_MS} || '}}'""",
        _A,
        f"""'{{"symbol":"' || ticker || '","price":' || {_P} || ',"size":false,"ts":' || {_MS} || '}}'""",
        f"""{_A} || '7000000}}'""",
        f"""'{{"symbol":"' || ticker || '","price":' || {_P} || ',"size":3.0000000000000000000007,"ts":' || {_MS} || '}}'""",
    ],
    "B": [
        f"""{_B} || ',"t":"' || {_ISO} || '"}}'""",
        f"""'{{"s":"' || ticker || '","p":"' || {_P} || ' per lot","v":"' || {_V} || '","t":"' || {_ISO} || '"}}'""",
        f"""'"s":"' || ticker || '","p":"' || {_P} || '","v":"' || {_V} || '","t":"' || {_ISO} || '"'""",
        f"""{_B} || ',"v":{{"lots":"' || {_V} || '"}},"t":"' || {_ISO} || '"}}'""",
        f"""{_B} || ',"v":"' || {_V} || '","t":"day ' || {_ISO} || '"}}'""",
        f"""{_B} || ',"v":"' || {_V} || 'E1","t":"' || {_ISO} || '"}}'""",
    ],
    "C": [
        f"ticker || ';' || {_P} || ';' || {_V} || ';' || {_S}",
        f"ticker || '|$' || {_P} || '|' || {_V} || '|' || {_S}",
        f"{_C} || '|' || {_S}",
        f"ticker || '|' || {_P} || '|-|' || {_S}",
        f"{_C} || 's'",
        f"{_C} || '7000000'",
    ],
}


def _by_kind(of_format: dict[str, list[str]]) -> str:
    cases = []
    for fmt, kinds in of_format.items():
        for kind, expression in enumerate(kinds):
            cases.append(f"WHEN format = '{fmt}' AND event_id // 13 % 6 = {kind} THEN {expression}")
    return "CASE " + "\n ".join(cases) + " END"


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


def _reconciled(dropped: str) -> str:
    """Accounting per source where accepted ticks matching ``dropped`` did not reach the store."""
    return _with(
        _DECIDED,
        f"""
SELECT t.source, t.received, t.received - a.accepted AS deduplicated, CAST(0 AS BIGINT) AS late_dropped,
       a.accepted - a.lost AS written, a.lost AS dropped, CAST(0 AS BIGINT) AS unaccounted, TRUE AS balanced
FROM (SELECT source, count(*) AS received FROM tk GROUP BY source) t
JOIN (SELECT source, count(*) AS accepted, count(*) FILTER ({dropped}) AS lost FROM acc GROUP BY source) a
  ON a.source = t.source""",
    )


_STATUS_COUNTS = """count(*) FILTER (status = 'tick') AS received,
       count(*) FILTER (status = 'parse_error') AS parse_errors,
       count(*) FILTER (status = 'ignored') AS ignored"""


def oracle() -> dict[str, str]:
    accepted = _with(_DECIDED, f"SELECT {_TICK_COLUMNS} FROM acc")
    stored = _with(_DECIDED, f"SELECT {_FIVE} FROM acc")
    sql = {
        "encode_frames": _with(_QUOTES, f"SELECT event_id, source, format, {_WIRE} AS raw FROM q"),
        "classify_frames": _with(_FRAMES, "SELECT source, frame_seq, status FROM fr"),
        "quarantine_frames": _with(
            _FRAMES,
            f"""SELECT source, format, {_by_kind(_BROKEN)} AS raw, at_us AS arrival_us, frame_seq,
{_by_kind({f: [f"'{r}'" for r in reasons] for f, reasons in MALFORMED_REASONS.items()})} AS reason
FROM fr WHERE status = 'parse_error'""",
        ),
        "ignored_frames": _with(
            _FRAMES,
            """SELECT source, format, CASE format WHEN 'C' THEN '   ' ELSE '{"alive":true}' END AS raw,
       at_us AS arrival_us, frame_seq FROM fr WHERE status = 'ignored'""",
        ),
        "format_round_trip": _with(
            _QUOTES,
            """SELECT source, count(*) AS sent, count(*) AS read_back, CAST(0 AS BIGINT) AS different
FROM q GROUP BY source""",
        ),
        "fan_in_union": "\nUNION ALL\n".join(
            f"SELECT * FROM ({_with(_TICKS, f'SELECT {_FIVE}, frame_seq FROM tk')}) WHERE source = 'exchange-{x}'"
            for x in "abc"
        ),
        "source_binding": _with(
            _FRAMES,
            """SELECT s.name AS source, s.format, count(*) AS frames, count(*) FILTER (status = 'tick') AS ticks
FROM fr JOIN (VALUES ('exchange-a', 'A'), ('exchange-b', 'B'), ('exchange-c', 'C')) AS s(name, format)
  ON s.name = fr.source GROUP BY s.name, s.format""",
        ),
        "dedup_two_generation": accepted,
        "stream_dedup_exact": accepted,
        "stream_dedup_watermark": _with(_TICKS, f"SELECT DISTINCT {_FIVE}, 0 AS ts_sub_us FROM tk"),
        "stream_ticks_landed": stored,
        "store_compacted": stored,
        "dedup_across_runs": stored,
        "stream_tracked_keys": _with(
            _DECIDED,
            """, span AS (SELECT min(at_us) AS low, (max(at_us) - min(at_us)) // 4 + 1 AS width FROM fr),
newest AS (SELECT nth, max(gen) AS gen FROM tk, span, (VALUES (0), (1), (2), (3)) AS n(nth) WHERE (at_us - low) // width <= nth GROUP BY nth)
SELECT nth, newest.gen, (SELECT count(*) FROM acc, span WHERE acc.gen IN (newest.gen, newest.gen - 1) AND (at_us - low) // width <= nth) AS tracked_keys
FROM newest""",
        ),
        "dedup_decisions_by_source": _with(
            _DECIDED,
            """SELECT t.source, t.received, a.accepted, t.received - a.accepted AS deduplicated
FROM (SELECT source, count(*) AS received FROM tk GROUP BY source) t
JOIN (SELECT source, count(*) AS accepted FROM acc GROUP BY source) a ON a.source = t.source""",
        ),
        "tracked_keys_by_generation": _with(
            _DECIDED,
            """, n AS (
  SELECT c.gen, count(r.gen) AS accepted FROM cand c
  LEFT JOIN acc r ON r.gen = c.gen AND r.frame_seq = c.frame_seq AND r.at_us = c.at_us GROUP BY c.gen)
SELECT n.gen, n.accepted, n.accepted + coalesce(p.accepted, 0) AS tracked_keys
FROM n LEFT JOIN n p ON p.gen = n.gen - 1""",
        ),
        "stream_throughput": _with(
            _FRAMES,
            f"""SELECT source, at_us // 60000000 * 60000000 AS interval_start_us, {_STATUS_COUNTS}
FROM fr GROUP BY 1, 2""",
        ),
        "throughput_per_interval": _with(
            _FRAMES,
            f"""SELECT source, at_us // 1000000 * 1000000 AS interval_start_us, {_STATUS_COUNTS}
FROM fr GROUP BY 1, 2""",
        ),
        "stream_late_ticks": _with(_LATE, f"SELECT {_FIVE}, at_us AS arrival_us, frame_seq FROM sorted WHERE late"),
        "reconcile_watermark": _with(
            _LATE,
            """SELECT t.source, t.received, t.received - t.late_dropped - k.written AS deduplicated, t.late_dropped, k.written,
       CAST(0 AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS unaccounted, TRUE AS balanced
FROM (SELECT source, count(*) AS received, count(*) FILTER (late) AS late_dropped FROM sorted GROUP BY source) t
JOIN (SELECT source, count(*) AS written FROM kept GROUP BY source) k ON k.source = t.source""",
        ),
        "flow_snapshot_watermark": _with(
            _LATE,
            f"""SELECT (max(at_us) // 120000000 + 1) * 120000000 AS ts_us, {_STATUS_COUNTS},
       (SELECT count(*) FROM sorted WHERE late) AS late_dropped,
       (SELECT count(*) FROM sorted WHERE NOT late) - (SELECT count(*) FROM kept) AS deduplicated,
       (SELECT count(*) FROM kept) AS written, CAST(0 AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS outbound_count
FROM fr""",
        ),
        "flow_snapshot_replayed": _with(
            _PER_GEN,
            """SELECT ts_us, received, parse_errors, ignored, CAST(0 AS BIGINT) AS late_dropped, deduplicated,
       written + dropped AS written, CAST(0 AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS outbound_count
FROM m ORDER BY gen DESC LIMIT 1""",
        ),
        "batch_sizes": _with(_TICKS, "SELECT count(*) AS ticks, TRUE AS within_bound, TRUE AS several FROM tk"),
        "reconcile_by_source": _reconciled("FALSE"),
        "written_equals_stored": _with(
            _DECIDED,
            "SELECT source, count(*) AS written, count(*) AS stored, TRUE AS equal FROM acc GROUP BY source",
        ),
        "stream_ticks_landed_watermark": _with(_TICKS, f"SELECT DISTINCT {_FIVE} FROM tk"),
        "store_day_counts": _with(
            _DECIDED,
            """SELECT source, CAST(make_timestamp(acc.ts_us) AS DATE) AS event_date, count(*) AS row_count FROM acc
WHERE acc.ts_us >= (SELECT epoch_us(date_trunc('day', max(ts)) - INTERVAL 6 DAY) FROM events) GROUP BY 1, 2""",
        ),
        "frame_batch_scan": _with(_FRAMES, "SELECT source, format, count(*) AS frames, min(at_us) AS first_us, max(at_us) AS last_us FROM fr GROUP BY 1, 2"),
        "sink_outage_accounting": _reconciled(
            "at_us >= epoch_us(TIMESTAMP '2024-01-11') AND at_us < epoch_us(TIMESTAMP '2024-01-21')"
        ),
        "source_counters": _with(_FRAMES, f"SELECT source, {_STATUS_COUNTS} FROM fr GROUP BY source"),
        "flow_counters": _with(
            _DECIDED,
            f"""SELECT f.source, received, parse_errors, ignored, accepted, received - accepted AS deduplicated,
       last_arrival_us
FROM (SELECT source, max(at_us) AS last_arrival_us, {_STATUS_COUNTS} FROM fr GROUP BY source) f
JOIN (SELECT source, count(*) AS accepted FROM acc GROUP BY source) a ON a.source = f.source""",
        ),
        "flow_snapshot": _with(
            _PER_GEN,
            """SELECT ts_us, received, parse_errors, ignored, CAST(0 AS BIGINT) AS late_dropped, deduplicated,
       written, dropped, tracked_keys, CAST(0 AS BIGINT) AS outbound_count,
       CAST(10000 AS BIGINT) AS outbound_capacity, connections_up, CAST(3 AS BIGINT) AS source_count,
       CAST(0 AS DOUBLE) AS outbound_fill
FROM m ORDER BY gen DESC LIMIT 1""",
        ),
        "received_rate": _with(_PER_GEN, "SELECT ts_us, received, received_per_second FROM rate"),
        "stats_line": _with(
            _PER_GEN,
            """SELECT ts_us, 'stats recv/s=' || CAST(CAST(round(received_per_second) AS BIGINT) AS VARCHAR)
       || ' recv=' || received || ' parse=' || parse_errors || ' dedup=' || deduplicated
       || ' written=' || written || ' dropped=' || dropped || ' fill=0'
       || '% keys=' || tracked_keys || ' conns=' || connections_up || '/3' AS line
FROM rate WHERE received_per_second IS NOT NULL""",
        ),
        "backlog_high_water": _with(
            _PER_GEN,
            """SELECT ts_us, outbound_count, CAST(outbound_count AS DOUBLE) / CAST(10000 AS DOUBLE) AS outbound_fill,
       max(outbound_count) OVER (ORDER BY gen) AS high_water FROM m""",
        ),
        "stream_backlog": _with(
            _TICKS,
            """, span AS (SELECT min(at_us) AS low, (max(at_us) - min(at_us)) // 4 + 1 AS width FROM fr),
w AS (SELECT (at_us - low) // width AS batch_id, count(*) AS waiting FROM tk, span GROUP BY 1)
SELECT batch_id, waiting, max(waiting) OVER (ORDER BY batch_id) AS high_water FROM w""",
        ),
        "stream_silent_sources": _with(
            _FRAMES, "SELECT source, 'silent' AS event, max(at_us) AS last_us, count(*) AS frames FROM fr GROUP BY source"
        ),
        "idle_gaps": _with(
            _GAPS,
            f"""SELECT source, before_us AS idle_from_us, at_us AS idle_until_us
FROM heard WHERE at_us - before_us > {_SILENCE}""",
        ),
        "source_sessions": _with(
            _GAPS,
            f""", s AS (
  SELECT source, at_us,
         sum(CASE WHEN before_us IS NULL OR at_us - before_us > {_SILENCE} THEN 1 ELSE 0 END)
           OVER (PARTITION BY source ORDER BY at_us ROWS UNBOUNDED PRECEDING) AS n
  FROM heard)
SELECT source, min(at_us) AS session_start_us, max(at_us) AS session_end_us, count(*) AS frames
FROM s GROUP BY source, n""",
        ),
        "stream_idle_sources": _with(
            _GAPS,
            f""", s AS (
  SELECT source, at_us,
         sum(CASE WHEN before_us IS NULL OR at_us - before_us > {_SILENCE} THEN 1 ELSE 0 END)
           OVER (PARTITION BY source ORDER BY at_us ROWS UNBOUNDED PRECEDING) AS n
  FROM heard)
SELECT source, max(at_us) AS idle_from_us, count(*) AS frames FROM s GROUP BY source, n
HAVING max(at_us) + {_SILENCE} <= (SELECT max(at_us) FROM fr) - 10 * 60 * 1000000""",
        ),
        "live_sources": _with(
            _FRAMES,
            f"""SELECT source, max(at_us) AS last_arrival_us,
       (SELECT max(at_us) FROM fr) - max(at_us) <= {_SILENCE} AS connected FROM fr GROUP BY source""",
        ),
        "store_counts": _with(
            _DECIDED, "SELECT count(*) AS row_count, count(DISTINCT source) AS distinct_sources FROM acc"
        ),
        "store_distinct_keys": _with(
            _DECIDED, f"SELECT count(*) AS distinct_keys FROM (SELECT DISTINCT {_KEY} FROM acc)"
        ),
        "store_distinct_rows": _with(_DECIDED, f"SELECT DISTINCT {_FIVE} FROM acc"),
        "store_sources": _with(_DECIDED, "SELECT DISTINCT source FROM acc"),
        "source_coverage": _with(
            _DECIDED,
            """SELECT e.name AS source, TRUE AS expected, e.name IN (SELECT source FROM acc) AS stored
FROM (VALUES ('exchange-a'), ('exchange-b'), ('exchange-c'), ('exchange-d')) AS e(name)""",
        ),
        "duplicate_audit": _with(
            _DECIDED, f"SELECT {_FIVE}, count(*) AS copies FROM acc GROUP BY {_KEY} HAVING count(*) > 1"
        ),
        "adjacent_duplicates": _with(
            _TICKS,
            f""", s AS (
  SELECT source, ({_KEY}) IS NOT DISTINCT FROM lag(({_KEY}))
           OVER (PARTITION BY source ORDER BY at_us, frame_seq) AS same
  FROM tk)
SELECT source, count(*) AS received, count(*) FILTER (same) AS adjacent_duplicates,
       count(*) FILTER (same) > 0 AS has_adjacent_duplicate FROM s GROUP BY source""",
        ),
        "store_scan_top": _with(
            _DECIDED,
            f"SELECT {_FIVE} FROM acc ORDER BY acc.ts_us, acc.source, acc.ticker, acc.price, acc.volume LIMIT 100",
        ),
    }
    sql["adjacent_duplicates_text"] = sql["adjacent_duplicates"]  # the same feeds, landed as text
    for fmt in "abc":
        sql[f"normalize_format_{fmt}"] = _with(
            _TICKS, f"SELECT {_TICK_COLUMNS} FROM tk WHERE source = 'exchange-{fmt}'"
        )
    return sql
