"""Secrets in texts: three patterns, and a battery of randomness tests for what no pattern names.

All is column functions and joins of tables of bounded size; no text leaves the JVM. A text is cut by a pattern into
matches and the gaps between them; places are running sums of their lengths, made in as many rounds as the logarithm
of their number, so that a text of any number of matches costs little more than reading it. Only texts whose matches can be
spans are cut; most cost three searches, with classes that Java keeps as one table of bits.

The battery. Runs of 16 or more letters, digits and ``+/_=-`` that no pattern covers are given the smallest encoding that
explains them: hex (one case, with letters and digits), base32, base64 (with upper case, lower case and digits). Three
tests ask whether the symbols are independent and uniform over that alphabet: chi-squared of their counts, the
number of runs above and below the middle, and serial correlation as squared differences of neighbours in four levels.
Fisher's method makes one value of the three.

What counts as a discovery is judged against ordinary writing of the same length. The long words of all texts, joined
text by text, are cut to windows of each length band's least length, put into each encoding (as they are, in upper
case, as the hex of half of them) and given the same tests. A run's p is the share of windows that look at least as
random, by the best of its own and the shorter bands, whose windows look more random; Benjamini-Hochberg at ``RATE`` in
each band of each encoding keeps the share of ordinary runs among those reported below that rate. Runs and windows are
counted once, however often they come, and windows are tested once. Tables with too little ordinary writing to tell give
no further spans.

Defined cases: a null text counts as empty. A row gives a row, also where ids repeat or are null. Other columns are
ignored. No rows give no rows. Places are in code points, ends exclusive. Spans that the tests add have the kind ``random``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.functions.binding import let
from quoteflow.llm.common import cut

RATE = 0.01
BINS = 100
#: The least length of each band of runs.
EDGES = [16, 24, 32, 48, 64]
KINDS = ["assign", "access", "hex", "random"]

# Written out, a class is one lookup in a table of bits; ranges are compared one after the other.
_SYMBOL = f"[{string.ascii_lowercase}{string.ascii_uppercase}{string.digits}+/_=-]"
_VALUE = f"[{string.ascii_lowercase}{string.ascii_uppercase}{string.digits}+/_.=-]"
#: What opens an assignment; most places fail by their first letter.
_OPEN = r"""(?=[aApPsStT])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = f"{_OPEN}({_VALUE}+)"
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "[0123456789abcdef]{24,}+"
_RUN = f"(?<!{_SYMBOL}){_SYMBOL}{{14,}}+"
#: An assignment, or a run that stops where one begins.
_EITHER = rf"{ASSIGN}|(?<!{_SYMBOL})(?:(?!{_OPEN}{_VALUE}){_SYMBOL}){{14,}}+"
#: What every assignment has, from the last letter of its name on, and few texts.
_GIVEN = rf"""[dDtTnNyY]["']?\x20*[:=]\x20*["']?{_VALUE}"""

# fixed values: the alphabets of the encodings, in the order of their symbols' values
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern as an array of (begin, end, found), in the order of the text."""
    return _placed(F.split(text, pattern, -1), _all(text, pattern))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(gaps: Column, found: Column) -> Column:
    """Matches with their places, from the gaps between them."""
    parts = F.zip_with(
        gaps,
        found,
        lambda g, x: F.struct((F.length(g) + F.coalesce(F.length(x), F.lit(0))).alias("end"), F.length(x).alias("n"), x.alias("found")),
    )

    def summed(parts: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(parts))).cast("int"))

        def doubled(acc: Column, k: Column) -> Column:
            def add(x: Column, i: Column) -> Column:
                before = F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))
                return F.struct((x["end"] + F.coalesce(before["end"], F.lit(0))).alias("end"), x["n"].alias("n"), x["found"].alias("found"))

            return F.transform(acc, add)

        placed = F.filter(F.reduce(rounds, parts, doubled), lambda x: x["found"].isNotNull())
        return F.transform(placed, lambda x: F.struct((x["end"] - x["n"]).alias("begin"), x["end"].alias("end"), x["found"].alias("found")))

    return let(parts, summed)


def _if(condition: Column, found: Column) -> Column:
    return F.when(condition, found).otherwise(F.array().cast("array<struct<begin:int,end:int,found:string>>"))


def _spans(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x["begin"].alias("begin"), F.lit(rank).alias("kind"), x["end"].alias("end")))


def _encoding(run: Column) -> Column:
    """The smallest encoding that explains a run, or null."""
    body = F.regexp_replace(run, "=+$", "")
    digit, upper, lower = body.rlike("[0-9]"), body.rlike("[A-Z]"), body.rlike("[a-z]")
    return (
        F.when(body.rlike(r"^([0-9a-f]+|[0-9A-F]+)\z") & digit & (upper | lower), "hex")
        .when(body.rlike(r"^[A-Z2-7]+\z") & digit & upper, "base32")
        .when(body.rlike(r"^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)\z") & digit & upper & lower, "base64")
    )


def _encoded(run: Column) -> Column:
    """Whether a run is long enough and in an encoding, all of which have digits."""
    return (F.length(run) >= EDGES[0]) & run.rlike("[0-9]") & _encoding(run).isNotNull()


def _symbols(run: Column, encoding: Column) -> Column:
    body = F.regexp_replace(run, "=+$", "")
    return F.when(encoding == "hex", F.lower(body)).when(encoding == "base32", body).otherwise(F.translate(body, "-_", "+/"))


def _times(text: Column, part: str) -> Column:
    """How often a part is in a text, for parts that cannot overlap themselves."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def _beyond(z: Column) -> Column:
    """The logarithm of the share of a normal distribution above z, by a logistic curve."""
    return -F.log1p(F.exp(F.least(F.lit(700.0), 0.07056 * z * z * z + 1.5976 * z)))


def _normal_or(z: Column, known: Column) -> Column:
    return F.when(known, z).otherwise(F.lit(40.0))


def likelihood(symbols: Column, alphabet: str) -> Column:
    """How far symbols look independent and uniform over an alphabet: Fisher's value of three tests, 0 to 1."""
    size = len(alphabet)

    def counted(x: Column) -> Column:
        n = F.length(x["s"]).cast("double")
        # what is not in the symbols adds nothing; long runs are not made arrays
        held = F.when(F.length(x["s"]) <= 256, F.array_distinct(F.split(x["s"], ""))).otherwise(F.split(F.lit(alphabet), ""))
        each = F.transform(held, lambda c: n - F.length(F.replace(x["s"], c, F.lit(""))))
        squares = F.reduce(each, F.lit(0.0), lambda total, count: total + count * count)
        low, high = _times(x["half"], "0"), _times(x["half"], "1")
        runs = 1 + _times(x["half"], "01") + _times(x["half"], "10")
        steps = sum((a - b) ** 2 * _times(x["level"], f"{a}{b}") for a in range(4) for b in range(4) if a != b)
        expected = 2.0 * low * high / n + 1
        return F.struct(n.alias("n"), squares.alias("squares"), expected.alias("expected"), runs.alias("runs"), steps.alias("steps"))

    def tested(x: Column) -> Column:
        n, expected = x["n"], x["expected"]
        chi = (x["squares"] * size / n - n - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n)
        spread = (expected - 1) * (expected - 2) / (n - 1)
        runs_z = _normal_or(F.abs(x["runs"] - expected) / F.sqrt(spread), spread > 0)
        serial_z = F.abs(x["steps"] - 2.5 * (n - 1)) / F.sqrt(8.25 * (n - 1) + 2.0 * (n - 2))
        return F.struct(chi.alias("chi"), runs_z.alias("runs"), serial_z.alias("serial"))

    def together(x: Column) -> Column:
        one_sided, two_sided = _beyond(x["chi"]), [_beyond(z) + F.log(F.lit(2.0)) for z in (x["runs"], x["serial"])]
        y = -(one_sided + sum(F.least(F.lit(0.0), p) for p in two_sided))
        return let(y, lambda y: F.exp(-y) * (1 + y + y * y / 2))

    level = "".join(str(4 * i // size) for i in range(size))
    half = "".join(str(2 * i // size) for i in range(size))
    made = F.struct(symbols.alias("s"), F.translate(symbols, alphabet, level).alias("level"), F.translate(symbols, alphabet, half).alias("half"))
    # each step names what the next one uses several times
    return let(let(let(made, counted), tested), together)


def _tested(symbols: Column, encoding: Column) -> Column:
    """The bin of the tests' value, from 0 for what is surely not random."""
    value = F.lit(None).cast("double")
    for name, alphabet in ALPHABETS.items():
        value = F.when(encoding == name, likelihood(symbols, alphabet)).otherwise(value)
    return F.least(F.lit(BINS - 1), F.floor(value * BINS).cast("int"))


def _band(n: Column) -> Column:
    return sum((n >= edge).cast("int") for edge in EDGES) - 1


def _runs(runs: Column) -> Column:
    """Of the runs that no pattern covers, those in an encoding: place, encoding, band, bin and a code of what they are."""
    found = F.filter(runs, lambda x: (F.length(x["found"]) >= EDGES[0]) & ~x["found"].rlike(f"^{_OPEN}|[0-9a-f]{{24}}|{ACCESS}"))
    named = F.transform(found, lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), _encoding(x["found"]).alias("encoding"), x["found"].alias("found")))
    named = F.filter(named, lambda x: x["encoding"].isNotNull())
    spelled = F.transform(named, lambda x: x.withField("s", _symbols(x["found"], x["encoding"])))
    spelled = F.filter(spelled, lambda x: F.length(x["s"]) >= EDGES[0])
    return F.transform(
        spelled,
        lambda x: F.struct(
            x["begin"].alias("begin"),
            x["end"].alias("end"),
            x["encoding"].alias("encoding"),
            _band(F.length(x["s"])).alias("band"),
            _tested(x["s"], x["encoding"]).alias("bin"),
            F.xxhash64(x["s"]).alias("code"),
        ),
    )


def _ordinary(found: Column) -> Column:
    """The long words of a text, joined."""
    return F.array_join(F.filter(found, lambda w: w.rlike(r"^[A-Za-z]+\z")), "")


def _windows(words: DataFrame) -> DataFrame:
    """Different windows of the joined words of all texts, in each encoding: encoding, band and bin.

    They are made different before they are tested.
    """
    cut_up = F.concat(*[_all(F.col("words"), f".{{{edge}}}") for edge in EDGES])
    windows = words.filter(F.length("words") >= EDGES[0]).select(F.explode(cut_up).alias("w"))
    w = F.col("w")
    spelled = {"hex": F.lower(F.hex(F.substr(w, F.lit(1), F.expr("length(w) div 2").cast("int")))), "base32": F.upper(w), "base64": w}
    forms = F.array(*[F.struct(F.lit(k).alias("encoding"), s.alias("s")) for k, s in spelled.items()])
    rows = windows.select(F.explode(forms).alias("x")).select("x.encoding", "x.s").distinct()
    return rows.select("encoding", _band(F.length("s")).alias("band"), _tested(F.col("s"), F.col("encoding")).alias("bin"))


def _counts(rows: DataFrame, name: str) -> DataFrame:
    """How many different runs or windows fall into each encoding, band and bin; at most 3 x 5 x 100 rows."""
    return rows.groupBy("encoding", "band", "bin").agg(F.count("*").alias(name))


def least_bins(runs: DataFrame, windows: DataFrame, rate: float = RATE) -> DataFrame:
    """The least bin to report for each encoding and band, by Benjamini-Hochberg; strata with none are left out.

    ``runs`` has encoding, band, bin and n_runs, ``windows`` the same with n_windows; both are small.
    """
    up = Window.partitionBy("encoding", "band").orderBy(F.desc("bin"))
    runs = runs.withColumn("reported", F.sum("n_runs").over(up)).withColumn("n", F.sum("n_runs").over(Window.partitionBy("encoding", "band")))
    windows = windows.select("encoding", F.col("band").alias("shorter"), F.col("bin").alias("at"), "n_windows")
    beside = runs.join(F.broadcast(windows), "encoding", "left").filter("shorter is null or shorter <= band")
    share = beside.groupBy("encoding", "band", "bin", "reported", "n", "shorter").agg(
        ((1 + F.sum(F.expr("if(at >= bin, n_windows, 0)"))) / (1 + F.sum("n_windows"))).alias("p")
    )
    best = share.groupBy("encoding", "band", "bin", "reported", "n").agg(F.min("p").alias("p"))
    return best.filter(F.col("p") * F.col("n") <= rate * F.col("reported")).groupBy("encoding", "band").agg(F.min("bin").alias("least"))


def find(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id and the spans (begin, kind as a number of ``KINDS``, end) of every row, by begin, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    text = F.col("text")
    rows = rows.select("doc_id", "text", (text.rlike(_GIVEN) & text.rlike(ASSIGN)).alias("given"))
    rows = rows.select("*", F.when(F.col("given"), _all(text, _EITHER)).otherwise(_all(text, _RUN)).alias("found"))
    gaps = F.when(F.col("given"), F.split(text, _EITHER, -1)).otherwise(F.split(text, _RUN, -1))
    either = _if(F.col("given") | F.exists("found", _encoded), _placed(gaps, F.col("found")))
    # without assignments a key of hex digits is in one of the runs
    with_hex = F.when(F.col("given"), text.rlike(HEX)).otherwise(F.exists("found", lambda x: x.rlike(HEX)))
    access, hexes = _if(text.contains("AKIA"), matches(text, ACCESS)), _if(with_hex, matches(text, HEX))
    rows = rows.select("doc_id", either.alias("either"), access.alias("access"), hexes.alias("hex"), _ordinary(F.col("found")).alias("words"))
    assigned = F.filter("either", lambda x: F.length(F.regexp_extract(x["found"], f"^{ASSIGN}", 1)) >= 6)
    base = F.array_sort(F.concat(_spans(assigned, "assign"), _spans(F.col("access"), "access"), _spans(F.col("hex"), "hex")))
    found = cut(rows.select("doc_id", base.alias("base"), _runs(F.col("either")).alias("runs"), "words"), "secrets")
    runs = found.select(F.explode("runs").alias("x")).select("x.encoding", "x.band", "x.bin", "x.code").distinct()
    bins = least_bins(_counts(runs, "n_runs"), _counts(_windows(found), "n_windows"), rate)
    return _with_accepted(found, bins)


def _with_accepted(found: DataFrame, bins: DataFrame) -> DataFrame:
    least = {(r["encoding"], r["band"]): r["least"] for r in bins.collect()}  # at most a row for each encoding and band

    def accepted(x: Column) -> Column:
        out = F.lit(False)
        for (encoding, band), bin_ in sorted(least.items()):
            out = out | ((x["encoding"] == encoding) & (x["band"] == band) & (x["bin"] >= bin_))
        return out

    more = _spans(F.filter("runs", accepted), "random")
    return found.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the patterns' spans and all spans as text."""
    names = F.array(*map(F.lit, KINDS))

    def line(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["begin"].cast("string"), x["end"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")

    base, extra = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])], count(3).alias("n_random")
    return found.select("doc_id", *base, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), extra)
