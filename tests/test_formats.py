"""What each wire format accepts, ignores and refuses."""

from dataclasses import replace
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from helpers import frames
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quoteflow.functions.formats import FORMATS, WireFormat, reading
from quoteflow.operators.normalize import classify, encode_ticks, quarantine, ticks
from quoteflow.schemas import FRAMES

NO_LAYOUT = {name: replace(fmt, layout=None) for name, fmt in FORMATS.items()}
EPOCH = datetime(1970, 1, 1)


def tick(ticker, price, volume, ts, sub=0):
    return ("tick", ticker, Decimal(price), Decimal(volume), ts, sub, None)


def bad(reason):
    return ("parse_error", None, None, None, None, None, reason)


IGNORED = ("ignored", None, None, None, None, None, None)
AT = datetime(2025, 2, 3, 4, 5, 6)
AT_S = int((AT - EPOCH).total_seconds())

# A good frame of each format, field by field: its name on the wire, its value there, and its name in a reason.
A_FIELDS = [("symbol", '"PEAR/ZAR"', "ticker"), ("price", "12.25", "price"), ("size", "8", "volume"), ("ts", f"{AT_S}125", "ts")]
B_FIELDS = [("s", '"PEAR/ZAR"', "ticker"), ("p", '"12.25"', "price"), ("v", '"8"', "volume"), ("t", '"2025-02-03T04:05:06.125Z"', "ts")]
C_FIELDS = [("", "PEAR/ZAR", "ticker"), ("", "12.25", "price"), ("", "8", "volume"), ("", str(AT_S), "ts")]

# What is no value of a field, by what the field should hold.
NOT_TEXT = ["null", "true", "false", "17", "-0.5", "[]", '["a"]', "{}", '{"a":1}']
NOT_A_NUMBER = ["null", "true", "false", '"17"', '""', "[]", "[17]", "{}", '{"a":17}']
NO_DECIMAL = ["", " ", "-", ".", "+-1", "1 2", "1.2.3", "0x11", "1e", "NaN", "ten", "1٠"]
NO_TIME = ["", " ", "noon", "2025", "2025-2-3", "2025-02-03T", "2025-02-03T25:00", "2025-02-29T00:00:00Z", "04:05:06", "1738555506"]
NO_SECONDS = ["", " ", "-", "1.5", "1e3", "0x1", "1_000", "noon", "1 2"]
TOO_WIDE = ["1" * 21, "0." + "0" * 18 + "1", "-" + "9" * 30]
NOT_JSON = ["", " ", "{", "}", "[", '"', '{"a"', '{"a":}', "{a:1}", "plain", "{}{}", "nul", "﻿{}"]


def json_frame(fields, changed=None, value=None):
    """The frame as JSON text, with one field given another value, or left out."""
    members = [(n, value if n == changed else v) for n, v, _ in fields]
    return "{" + ",".join(f'"{n}":{v}' for n, v in members if v is not None) + "}"


def broken_frames():
    """Every field of every format: absent, of each wrong type, outside its grammar, beyond its range."""
    for fmt, fields in (("A", A_FIELDS), ("B", B_FIELDS)):
        for name, _, field in fields:
            # an object without a ticker is some other message, such as a heartbeat
            yield fmt, json_frame(fields, name), IGNORED if field == "ticker" else bad(f"missing_{field}")
            for value in NOT_TEXT if fmt == "B" or field == "ticker" else NOT_A_NUMBER:
                yield fmt, json_frame(fields, name, value), bad(f"bad_{field}")
            for value in TOO_WIDE if field in ("price", "volume") else []:
                text = f'"{value}"' if fmt == "B" else value
                yield fmt, json_frame(fields, name, text), bad("decimal_out_of_range")
        for text in NOT_JSON:
            yield fmt, text, bad("invalid_json")
    for name, _, field in B_FIELDS:
        for value in {"price": NO_DECIMAL, "volume": NO_DECIMAL, "ts": NO_TIME}.get(field, []):
            yield "B", json_frame(B_FIELDS, name, f'"{value}"'), bad(f"bad_{field}")
    values = [v for _, v, _ in C_FIELDS]
    for n in range(1, 9):
        if n != len(values):
            yield "C", "|".join((values * 2)[:n]), bad("field_count")
    for k, (_, _, field) in enumerate(C_FIELDS):
        for value in {"price": NO_DECIMAL, "volume": NO_DECIMAL, "ts": NO_SECONDS}.get(field, []):
            yield "C", "|".join([*values[:k], value, *values[k + 1 :]]), bad(f"bad_{field}")
        for value in TOO_WIDE if field in ("price", "volume") else []:
            yield "C", "|".join([*values[:k], value, *values[k + 1 :]]), bad("decimal_out_of_range")


GOOD = [
    ("A", json_frame(A_FIELDS), tick("PEAR/ZAR", "12.25", "8", AT + timedelta(milliseconds=125))),
    ("B", json_frame(B_FIELDS), tick("PEAR/ZAR", "12.25", "8", AT + timedelta(milliseconds=125))),
    ("C", "|".join(v for _, v, _ in C_FIELDS), tick("PEAR/ZAR", "12.25", "8", AT)),
]
SILENT = [("C", " " * n, IGNORED) for n in range(4)] + [("C", "\t", IGNORED), ("C", None, IGNORED)]

CASES = [
    *GOOD,
    *SILENT,
    *broken_frames(),
    ("A", f'{{"symbol":"KIWI/NZD","price":7.0625,"size":310,"ts":{AT_S}250}}',
     tick("KIWI/NZD", "7.0625", "310", AT + timedelta(milliseconds=250))),
    ("A", '{"alive":true}', IGNORED),
    ("A", '{"symbol":"B","price":1,"size":1,"ts":1.5}', bad("bad_ts")),
    ("A", '{"symbol":"B","price":1,"size":1,"ts":1e3}', bad("bad_ts")),
    ("A", "[1,2]", IGNORED),
    ("A", '[{"symbol":"B","price":1,"size":1,"ts":1}]', IGNORED),
    ("A", "5", IGNORED),
    ("A", "null", IGNORED),
    ("A", '"x"', IGNORED),
    ("A", "", bad("invalid_json")),
    ("A", None, bad("invalid_json")),
    ("A", '{"symbol":"B","price":1,"size":1,"ts":1} x', bad("invalid_json")),
    ("A", '{"symbol":"B","price":1,"size":1,"ts":1}{}', bad("invalid_json")),
    ("A", '{"symbol":"B","price":1,"size":1,"ts":1}]', bad("invalid_json")),
    ("A", '{"symbol":"B","price":1,"size":1,"ts":1},{"a":1}', bad("invalid_json")),
    ("A", '{"symbol":"B","price":1,"size":1,"ts":1,}', bad("invalid_json")),
    ("A", "{'symbol':'B','price':1,'size':1,'ts':1}", bad("invalid_json")),
    ("A", '{"symbol":"B","price":NaN,"size":1,"ts":1}', bad("invalid_json")),
    ("A", '{"symbol":"B","price":01,"size":1,"ts":1}', bad("invalid_json")),
    ("A", '{"symbol":"B","price":1.,"size":1,"ts":1}', bad("invalid_json")),
    ("A", ' {"symbol" : "B", "price":1, "size":1,\n"ts":1}\t', tick("B", "1", "1", EPOCH + timedelta(milliseconds=1))),
    ("A", '{"ts":1,"size":2,"extra":[1],"price":3,"symbol":"B"}', tick("B", "3", "2", EPOCH + timedelta(milliseconds=1))),
    ("A", '{"symbol":"a\\u002Bb|c","price":1,"size":1,"ts":1}', tick("a+b|c", "1", "1", EPOCH + timedelta(milliseconds=1))),
    ("A", '{"symbol":"a|b","price":1,"size":1,"ts":1}', tick("a|b", "1", "1", EPOCH + timedelta(milliseconds=1))),
    ("A", '{"symbol":"","price":-5,"size":0,"ts":-1}', tick("", "-5", "0", EPOCH - timedelta(milliseconds=1))),
    ("A", '{"symbol":"B","price":1e2,"size":1,"ts":0,"ts":7}', tick("B", "100", "1", EPOCH + timedelta(milliseconds=7))),
    ("A", '{"symbol":"B","price":1.5E-18,"size":1,"ts":0}', bad("decimal_out_of_range")),
    ("A", '{"symbol":"B","price":2E-18,"size":1,"ts":0}', tick("B", "0.000000000000000002", "1", EPOCH)),
    ("A", '{"symbol":"B","price":1,"size":1,"ts":999999999999999999}', bad("ts_out_of_range")),
    ("A", '{"symbol":"B","price":1,"size":1,"ts":253402300800000}', bad("ts_out_of_range")),
    ("A", '{"symbol":"B","price":1,"size":1,"ts":99999999999999999999}', bad("bad_ts")),
    ("A", '{"symbol":"B","price":0.12345678901234567891,"size":1,"ts":1}', bad("decimal_out_of_range")),
    ("A", '{"symbol":"B","price":0.1234567890123456780,"size":1,"ts":0}', tick("B", "0.123456789012345678", "1", EPOCH)),
    ("A", '{"symbol":"B","price":123456789012345678901,"size":1,"ts":1}', bad("decimal_out_of_range")),
    ("A", '{"symbol":"B","price":12345678901234567890,"size":1,"ts":0}', tick("B", "12345678901234567890", "1", EPOCH)),
    ("A", '{"symbol":"B","price":0.1000000000000000055511151231257827021181583,"size":1,"ts":1}', bad("decimal_out_of_range")),
    ("A", '{"symbol":"B","price":1e400,"size":1,"ts":1}', bad("decimal_out_of_range")),
    ("A", '{"symbol":"B","price":1.2345678901234567e2,"size":1,"ts":0}', tick("B", "123.45678901234567", "1", EPOCH)),
    ("A", '{"symbol":"B","price":12345678901234567890123E-5,"size":-0.5e+1,"ts":0}', tick("B", "123456789012345678.90123", "-5", EPOCH)),
    ("A", '{"symbol":"B","price":0.00e9,"size":5000E-3,"ts":0}', tick("B", "0", "5", EPOCH)),
    ("A", '{"symbol":"B","price":1.0000000000000000001e0,"size":1,"ts":0}', bad("decimal_out_of_range")),
    ("A", '{"symbol":"1234567890123456789012345678901234567890","price":1e2,"size":1,"ts":0}',
     tick("1234567890123456789012345678901234567890", "100", "1", EPOCH)),
    ("A", '{"symbol":"\\"price\\":3e1","price":2e1,"size":1,"ts":0}', tick('"price":3e1', "20", "1", EPOCH)),
    ("A", '{"symbol":"B","x":{"price":9e9},"price":2e1,"size":1,"ts":0}', tick("B", "20", "1", EPOCH)),
    ("A", '{"symbol":"B","pri\\u0063e":25e-1,"size":1,"ts":0}', tick("B", "2.5", "1", EPOCH)),
    ("A", f'{{"symbol":"B","price":{"0" * 0}1{"0" * 17}.{"0" * 70}5,"size":1,"ts":0}}', bad("decimal_out_of_range")),
    ("B", '{"s":"KIWI/NZD","p":"7.0625","v":"310","t":"2025-02-03T04:05:06.25+00:00"}',
     tick("KIWI/NZD", "7.0625", "310", AT + timedelta(milliseconds=250))),
    ("B", '{"alive":true}', IGNORED),
    ("B", '{"s":"B","p":"1,000.5","v":" 100- ","t":"2025-11-08T12:00:00.1234567+02:00"}',
     tick("B", "1000.5", "-100", datetime(2025, 11, 8, 10, 0, 0, 123456), 7)),
    ("B", '{"s":"B","p":"1e2","v":"1","t":"2025-11-08"}', bad("bad_price")),
    ("B", '{"s":"B","p":"-5-","v":"1","t":"2025-11-08"}', bad("bad_price")),
    ("B", '{"s":"B","p":"1","v":"1","t":"2026"}', bad("bad_ts")),
    ("B", '{"s":"B","p":"1","v":"1","t":"2026-13-01T00:00:00Z"}', bad("bad_ts")),
    ("B", '{"s":"B","p":"1","v":"1","t":"2026-02-30T00:00:00.0000000+00:00"}', bad("bad_ts")),
    ("B", '{"s":"B","p":"1","v":"1","t":"0000-01-01T00:00:00Z"}', bad("bad_ts")),
    ("B", '{"s":"B","p":"1","v":"1","t":"0001-01-01T00:00:00+01:00"}', bad("bad_ts")),
    ("B", '{"s":"B","p":"1","v":"1","t":"2025-11-08T12:00:00+15:00"}', bad("bad_ts")),
    ("B", '{"s":"B","p":"5.","v":".5","t":"2025-11-08 12:30"}', tick("B", "5", "0.5", datetime(2025, 11, 8, 12, 30))),
    ("B", '{"s":"B","p":"+1","v":"1","t":"2025-11-08T12:00:00.1230000\\u002B0130"}',
     tick("B", "1", "1", datetime(2025, 11, 8, 10, 30, 0, 123000))),
    ("B", '{"s":"B","p":"1","v":"1","t":"2025-11-08T12:00-02"}', tick("B", "1", "1", datetime(2025, 11, 8, 14, 0))),
    ("B", '{"s":"B","p":"1","v":"1","t":"2025-11-08T12:00:00.123456789Z"}',
     tick("B", "1", "1", datetime(2025, 11, 8, 12, 0, 0, 123456), 8)),
    ("B", '{"s":"B","p":"1","v":"1","t":"2025-11-08T12:00:00.99999999Z"}', tick("B", "1", "1", datetime(2025, 11, 8, 12, 0, 1))),
    ("B", '{"s":"B","p":"123456789012345678901","v":"1","t":"2025-11-08"}', bad("decimal_out_of_range")),
    ("B", '{"s":"B","p":"1.0000000000000000001","v":"1","t":"2025-11-08T00:00:00Z"}', bad("decimal_out_of_range")),
    ("C", f"KIWI/NZD|7.0625|310|{AT_S}", tick("KIWI/NZD", "7.0625", "310", AT)),
    ("C", "B|1|1|1.0", bad("bad_ts")),
    ("C", "B|1|1|99999999999999999999", bad("bad_ts")),
    ("C", "B|1|1|253402300800", bad("ts_out_of_range")),
    ("C", "|1|1|1", tick("", "1", "1", EPOCH + timedelta(seconds=1))),
    ("C", "a| 1 |1,0|\t+5 ", tick("a", "1", "10", EPOCH + timedelta(seconds=5))),
    ("C", "a|1|1|5\n", tick("a", "1", "1", EPOCH + timedelta(seconds=5))),
    ("C", "a|- 5|1|1", bad("bad_price")),
    ("C", "a|1||1", bad("bad_volume")),
    ("C", "a|-1.50|1|-1", tick("a", "-1.50", "1", EPOCH - timedelta(seconds=1))),
]


def outcomes(df):
    rows = df.orderBy("frame_seq").select(
        "status", "ticker", "price", "volume", "ts", "ts_sub_us", "reason"
    )
    return [tuple(r) for r in rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()]


@pytest.mark.parametrize("formats", [FORMATS, NO_LAYOUT], ids=["layout", "full"])
def test_every_case(spark, formats):
    got = outcomes(classify(frames(spark, [(f, raw) for f, raw, _ in CASES]), formats))
    wrong = [(f, raw, want, row) for (f, raw, want), row in zip(CASES, got, strict=True) if row != want]
    assert not wrong


def test_format_id_is_case_insensitive_and_source_is_stamped(spark):
    df = spark.createDataFrame([("anyone", "c", "source-in-text|1|1|1", None, 0)], FRAMES)
    row = classify(df).first()
    assert (row.status, row.source, row.ticker) == ("tick", "anyone", "source-in-text")


@pytest.mark.parametrize("fmt", ["D", None])
def test_a_frame_of_no_known_format_is_quarantined_alone(spark, fmt):
    df = classify(spark.createDataFrame([("s", fmt, "x", None, 0), ("t", "C", "a|1|1|1", None, 1)], FRAMES))
    assert quarantine(df).select("source", "raw", "reason").collect() == [("s", "x", "unknown_format")]
    assert ticks(df).count() == 1


def test_malformed_frame_does_not_stop_the_next(spark):
    df = classify(frames(spark, [("A", "half a fra"), ("A", CASES[0][1])]))
    assert quarantine(df).select("raw", "reason").collect() == [("half a fra", "invalid_json")]
    assert ticks(df).count() == 1


def test_a_new_format_is_one_registration(spark):
    def read(raw):
        parts = F.split(raw, ";")
        return reading(
            ignored=raw == "ping",
            reason=F.when(F.size(parts) != 3, "field_count"),
            ticker=F.try_element_at(parts, F.lit(1)),
            price=F.try_element_at(parts, F.lit(2)),
            volume=F.lit("1"),
            ts=F.timestamp_seconds(F.try_element_at(parts, F.lit(3)).try_cast("bigint")),
        )

    df = classify(
        frames(spark, [("X", "EUR;1.5;7"), ("X", "ping"), ("X", "EUR"), ("X", "EUR;x;7"), CASES[0][:2]]),
        {**FORMATS, "X": WireFormat("X", read)},
    )
    assert [(r[0], r[6]) for r in outcomes(df)] == [
        ("tick", None), ("ignored", None), ("parse_error", "field_count"), ("parse_error", "bad_price"), ("tick", None),
    ]


PIECES = ['"', "\\", "{", "}", "[", "]", ",", ":", "|", " ", "\n", "\x01", "0", "-", "+", ".", "e", "7", "T", "Z", "x", "null"]
VALID = [raw for f, raw, want in CASES if want[0] == "tick"] + [
    '{"s":"B","p":"1.25","v":"2","t":"2025-11-08T12:00:00.1234567+00:00"}',
]


@st.composite
def damaged(draw):
    """Valid text of some format with a few edits, for any format."""
    text = draw(st.sampled_from(VALID))
    for _ in range(draw(st.integers(0, 2))):
        i = draw(st.integers(0, len(text)))
        j = draw(st.integers(i, min(len(text), i + 3)))
        text = text[:i] + draw(st.sampled_from([*PIECES, ""])) + text[j:]
    return draw(st.sampled_from("ABC")), text


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(st.lists(damaged(), min_size=400, max_size=400))
def test_the_layout_shortcut_never_changes_the_outcome(spark, rows):
    df = frames(spark, rows)
    fast, full = outcomes(classify(df)), outcomes(classify(df, NO_LAYOUT))
    assert [(r, a, b) for r, a, b in zip(rows, fast, full, strict=True) if a != b] == []


def test_round_trip_of_every_format(spark):
    at = lambda micros: datetime(2024, 10, 27, 3, 33, 20, micros, tzinfo=UTC)
    rows = [
        ("A", "KIWI/NZD", Decimal("7.0625"), Decimal("310"), at(250000), 0),
        ("B", "KIWI/NZD", Decimal("7.0625"), Decimal("310"), at(250000), 0),
        ("B", 'quo"te\\|+<é', Decimal("0.000000000000000001"), Decimal("-12345678901234567890"), at(123456), 7),
        ("A", 'quo"te\\|+<é', Decimal("0"), Decimal("1000"), at(1000), 0),
        ("C", "KIWI/NZD", Decimal("7.0625"), Decimal("310"), at(0), 0),
        ("C", "", Decimal("-0.5"), Decimal("100"), at(0), 0),
    ]
    sent = spark.createDataFrame(
        rows, "format string, ticker string, price decimal(38,18), volume decimal(38,18), ts timestamp, ts_sub_us tinyint"
    )
    wire = encode_ticks(sent).select(
        F.lit("exchange-x").alias("source"), "format", "raw", F.col("ts").alias("arrival_ts"), F.lit(0).cast("bigint").alias("frame_seq")
    )
    columns = ["ticker", "price", "volume", "ts", "ts_sub_us"]
    back = ticks(classify(wire)).select(columns)
    assert back.exceptAll(sent.select(columns)).isEmpty()
    assert sent.select(columns).exceptAll(back).isEmpty()


def test_encoded_text(spark):
    sent = spark.createDataFrame(
        [(f, "KIWI/NZD", Decimal("7.0625"), Decimal("310.50"), datetime(2025, 2, 3, 4, 5, 6, 250000, tzinfo=UTC), 4) for f in "ABC"],
        "format string, ticker string, price decimal(38,18), volume decimal(38,18), ts timestamp, ts_sub_us tinyint",
    )
    assert [r.raw for r in encode_ticks(sent).orderBy("format").collect()] == [
        f'{{"symbol":"KIWI/NZD","price":7.0625,"size":310.5,"ts":{AT_S}250}}',
        '{"s":"KIWI/NZD","p":"7.0625","v":"310.5","t":"2025-02-03T04:05:06.2500004+00:00"}',
        f"KIWI/NZD|7.0625|310.5|{AT_S}",
    ]


def test_the_usual_layout_stays_out_of_the_slow_reading(spark):
    """The plan must parse usual frames with one match, and the JSON parser only behind it."""
    plan = classify(frames(spark, [CASES[0][:2]]))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("isnull(_parts") < plan.index("parseJson")
