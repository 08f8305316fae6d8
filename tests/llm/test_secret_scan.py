import hashlib
import math
import random
import re
import string

import pytest
from brute import documents
from pyspark.sql import functions as F

from quoteflow.llm import secret_scan
from quoteflow.llm.secret_scan import ALPHABETS, digests, find, least_bins, likelihood, matches

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ["assign", "access", "hex"]
    line = ",".join(f"{names[k]}:{b}:{e}" for b, k, e in sorted(out))
    return (*[sum(k == i for _, k, _ in out) for i in range(3)], hashlib.sha256(line.encode()).hexdigest())


def scan(spark, rows, **how):
    return {r.doc_id: r for r in digests(find(documents(spark, rows), **how)).collect()}


AWKWARD = [
    None,
    "",
    "no secrets here",
    'password = "hunter22" and Token: abc',
    "SECRET=abcdef secret: abcde passwd='x-y_z.1='",
    "token=token:abcdefgh api_key = zzzzzz APIKEY:zzzzzz api__key=zzzzzz",
    "ſecret=abcdefgh toKen=abcdefgh",  # letters that only look like the ASCII ones
    "AKIA" + "B2" * 8 + " AKIAAKIA AKIA" + "C" * 15 + " xAKIA" + "9" * 40,
    "0123456789abcdef01234567 0123456789abcdef0123456 ABCDEF" + "a" * 30,
    "é€😀 token=" + "0123456789abcdef" * 2 + "😀 tail",  # two kinds at one place; code points
    "my_secret_token=deadbeefdeadbeefdeadbeef&password==",
    "token" + " " * 50 + "=   'abcdef'",
    "\n\ttoken\n=abcdefg token=\nabcdefg",
]


def test_patterns_agree_with_plain_ones(spark):
    got = scan(spark, list(enumerate(AWKWARD)))
    for i, text in enumerate(AWKWARD):
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == base(text), text


@pytest.mark.parametrize("seed", range(3))
def test_patterns_agree_on_random_pieces(spark, seed):
    rng = random.Random(seed)
    bits = ["token", "Secret", "api_key", "passwd", "=", ":", " ", "'", '"', "abc", "0f" * 13, "AKIA", "A1B2" * 5, "é", "\n", ".", "-", "x" * 14, "_", "password"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(25))) for _ in range(300)]
    got = scan(spark, list(enumerate(texts)))
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == base(text), text
        assert r.spans == "" or all(int(p.split(":")[1]) < int(p.split(":")[2]) <= len(text) for p in r.spans.split(","))


def test_places_of_very_many_matches(spark):
    text = "é,ab1 " * 30_000
    df = spark.createDataFrame([(text,)], "text string").select(F.explode(matches(F.col("text"), "[a-z0-9]+")).alias("m")).select("m.*")
    assert df.agg(F.count("*"), F.min("begin"), F.max("end")).first() == (30_000, 2, 30_000 * 6 - 1)
    assert df.filter("begin % 6 <> 2 or end - begin <> 3 or found <> 'ab1'").isEmpty()


def beyond(z):
    return -math.log1p(math.exp(min(700, 0.07056 * z**3 + 1.5976 * z)))


def plain_likelihood(s, alphabet):
    n, k = len(s), len(alphabet)
    chi = (sum(s.count(c) ** 2 for c in alphabet) * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    levels = [4 * alphabet.index(c) // k for c in s]
    half = [x // 2 for x in levels]
    mean = 2 * half.count(0) * half.count(1) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(half, half[1:], strict=False))
    z2 = abs(runs - mean) / math.sqrt(var) if var > 0 else 40
    steps = sum((a - b) ** 2 for a, b in zip(levels, levels[1:], strict=False))
    z3 = abs(steps - 2.5 * (n - 1)) / math.sqrt(8.25 * (n - 1) + 2 * (n - 2))
    y = -(beyond(chi) + sum(min(0, beyond(z) + math.log(2)) for z in (z2, z3)))
    return math.exp(-y) * (1 + y + y * y / 2)


@pytest.mark.parametrize("name", list(ALPHABETS))
def test_the_battery_agrees_with_a_plain_one(spark, name):
    rng, alphabet = random.Random(name), ALPHABETS[name]
    rows = ["".join(rng.choices(alphabet, k=rng.randrange(16, 90))) for _ in range(40)]
    rows += [alphabet[0] * 20, alphabet, alphabet[:2] * 20, "".join(sorted(rows[0])), rows[1] * 30]
    got = spark.createDataFrame([(x,) for x in rows], "s string").select("s", likelihood(F.col("s"), alphabet).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(plain_likelihood(r.s, alphabet), rel=1e-6, abs=1e-12)
    values = [plain_likelihood(x, alphabet) for x in rows]
    assert sum(v > 0.05 for v in values[:40]) >= 34 and max(values[40:44]) < 0.02


@pytest.mark.parametrize("name", list(ALPHABETS))
def test_each_count_of_the_battery_is_made_once(spark, name):
    df = spark.range(1).select(F.col("id").cast("string").alias("s")).select(likelihood(F.col("s"), ALPHABETS[name]).alias("p"))
    plan = df._jdf.queryExecution().analyzed().expressions().mkString()
    # one for the symbols, two and two for the halves, twelve for the levels; the halves' counts are not spelled out again
    assert plan.count("replace(") <= 17, plan.count("replace(")


def test_windows_are_tested_once_however_often_they_come(spark):
    texts = [(0, "Internationalschaft and Konstraverschaft"), (1, "Internationalschaft and Konstraverschaft"), (2, "InternationalschaftX and")]
    words = spark.createDataFrame([("".join(re.findall("[A-Za-z]{14,}", t)),) for _, t in texts], "words string")
    windows = secret_scan._windows(words)
    plan = windows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    distinct = next(i for i, line in enumerate(plan) if "Aggregate" in line)  # upper nodes come first
    assert any("translate" in line for line in plan[: distinct + 1]) and not any("translate" in line for line in plan[distinct + 1 :])
    want = set()
    for (w,) in words.collect():
        for edge in [16, 24, 32, 48, 64]:
            for k in range(len(w) // edge):
                s = w[k * edge : (k + 1) * edge]
                want |= {("hex", s[: edge // 2].encode().hex()), ("base32", s.upper()), ("base64", s)}
    bands = {16: 0, 24: 1, 32: 2, 48: 3, 64: 4}
    tested = sorted((e, bands[len(s)], min(99, int(100 * plain_likelihood(s, ALPHABETS[e])))) for e, s in want)
    assert sorted(tuple(r) for r in windows.select("encoding", "band", "bin").collect()) == tested


def test_long_runs_and_short_ones_are_counted_alike(spark):
    rng, alphabet = random.Random(5), ALPHABETS["base64"]
    rows = ["".join(rng.choices(alphabet, k=n)) for n in (255, 256, 257, 5000)]
    got = spark.createDataFrame([(x,) for x in rows], "s string").select("s", likelihood(F.col("s"), alphabet).alias("p")).collect()
    assert [r.p for r in got] == [pytest.approx(plain_likelihood(r.s, alphabet), rel=1e-6, abs=1e-12) for r in got]


def prose(rng, n):
    parts = "tion ver ein ung schaft heit lich keit inter national ment able über con stra".split()
    words = ["".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(n)]
    return " ".join(w.capitalize() if rng.random() < 0.2 else w for w in words)


def test_random_tokens_are_found_and_prose_is_left_alone(spark):
    rng = random.Random(3)
    token = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    rows, planted = [(i, prose(rng, 80)) for i in range(250)], {}
    kinds = [(string.ascii_letters + string.digits, 40), (string.ascii_letters + string.digits + "-_", 43), ("0123456789ABCDEF", 32)]
    for i in range(250, 310):
        alphabet, n = kinds[i % 3]
        secret, left = token(alphabet, n), prose(rng, 20)
        planted[i] = f"random:{len(left) + 1}:{len(left) + 1 + n}"
        rows.append((i, f"{left} {secret} {prose(rng, 20)}"))
    got = scan(spark, rows)
    assert not any(got[i].spans for i in range(250))
    found = sum(got[i].spans == want for i, want in planted.items())
    assert found >= 50, found
    assert all(got[i].spans in ("", want) for i, want in planted.items())
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got.values())
    # words with digits and paths are writing, not secrets
    more = rows + [(400, "see Internationalment2024 and Konstraverschaft/ein/Lich2/Ungheit3"), (401, "AAAAAAAAAAAA1111111111bbbbbbbbbb")]
    assert not any(scan(spark, more)[i].spans for i in (400, 401))


def test_without_ordinary_writing_nothing_is_added(spark):
    secret = "".join(random.Random(1).choices(string.ascii_letters + string.digits, k=48))
    assert scan(spark, [(1, f"x {secret} y")])[1].spans == ""


def test_discoveries_are_controlled_by_length(spark):
    runs = spark.createDataFrame([("hex", 0, 50, 10), ("hex", 0, 0, 90), ("hex", 2, 50, 10)], "encoding string, band int, bin int, n_runs long")
    rows = [("hex", 0, 0, 800), ("hex", 0, 60, 200), ("hex", 2, 0, 999)]
    windows = spark.createDataFrame(rows, "encoding string, band int, bin int, n_windows long")
    # a fifth of the short windows look as random as the short runs; no long one does
    assert [tuple(r) for r in least_bins(runs, windows, 0.05).collect()] == [("hex", 2, 50)]
    assert least_bins(runs.limit(0), windows).isEmpty() and least_bins(runs, windows.limit(0)).isEmpty()


def test_rows_are_kept_as_they_come(spark):
    rows = [(None, "token=abcdefgh"), (1, "token=abcdefgh"), (1, "token=abcdefgh"), (2, None)]
    got = digests(find(documents(spark, rows))).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.spans) for r in got) == [(0, 1, "assign:0:14"), (1, 1, "assign:0:14"), (1, 1, "assign:0:14"), (2, 0, "")]
    assert digests(find(documents(spark, []))).collect() == []


def test_no_python_runs_in_the_plan(spark):
    df = digests(find(documents(spark, [(1, "token=abcdefgh")])))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|RDD", plan.replace("ExistingRDD", ""))
    assert secret_scan.KINDS[:3] == ["assign", "access", "hex"]
