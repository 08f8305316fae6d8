"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed scorer.

Each labeller calls a text junk or good, or abstains, which counts neither way. No true label is used. Texts are counted by the pattern of their
votes, over all rows; there are at most 3 ** labellers patterns, whatever the input. Expectation-maximisation over
those counts estimates each labeller's rates for junk and good texts and the share of junk, and gives every
pattern the posterior probability of junk. A logistic scorer over hashed word and shape features, averaged over a
text's words, is trained on posteriors of a bounded sample, ``SAMPLE`` texts in all, half of them the likely junk, in
one task. Every text is then scored.

Defined cases: a null text, or one without words, is rejected with score 1 and does not take part in learning.
Without any text to learn from nothing else is rejected. Repeated rows count as often as they come. Other columns
are ignored by the classifier and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import cut, flat, shipped, sliced
from quoteflow.llm.words import mix, runs, span_hashes, word_spans

#: Texts that the scorer is fitted on, at most.
SAMPLE = 6000
DIMENSIONS = 1 << 15
THRESHOLD = 0.5
#: Each labeller: a measure, junk from here on (above or below), good from here on, and the least words it votes on.
LABELLERS = (
    ("paired", ">", 0.10, 0.01, 4),
    ("bars", ">", 0.10, 0.01, 8),
    ("upper", ">", 0.30, 0.12, 4),
    ("commonest", ">", 0.20, 0.12, 20),
    ("fresh", "<", 0.60, 0.95, 20),
    ("distinct", "<", 0.30, 0.45, 20),
    ("stopped", "<", 0.03, 0.09, 20),
)
_MEASURES = [x[0] for x in LABELLERS]
_BINS = np.array([0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95])
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[ends[1:]] - total[ends[:-1]]


class Texts:
    """The words of a slice of texts, and what the labellers measure."""

    def __init__(self, column: pa.Array):
        data, ends = flat(column)
        begin, end = word_spans(data, ends)
        self.at = np.searchsorted(begin, ends)
        self.n = np.diff(self.at)
        self.hashes = span_hashes(data, begin, end)
        pair = np.zeros(len(data), bool)
        pair[:-1] = (data[:-1] == data[1:]) & _PUNCT[data[:-1]]
        pairs = np.concatenate(([0], np.cumsum(pair, dtype=np.int64)))
        self.paired = pairs[end - 1] > pairs[begin] if len(begin) else np.zeros(0, bool)
        last = data[end - 1] if len(begin) else data[:0]
        bar = (end - begin == 1) & (last == 124)
        stop = (last == 46) | (last == 44)
        n = np.maximum(self.n, 1)
        letters = np.maximum(_sums(_LETTER[data], ends), 1)
        self.measures = {
            "paired": _sums(self.paired, self.at) / n,
            "bars": _sums(bar, self.at) / n,
            "upper": _sums(_UPPER[data], ends) / letters,
            "stopped": _sums(stop, self.at) / n,
        }
        self._repeats()
        first = data[begin] if len(begin) else data[:0]
        size = np.minimum(end - begin, 15).astype(np.uint64)
        shape = last.astype(np.uint64) << np.uint64(8) | _class(first) << np.uint64(4) | size
        self.shapes = mix(shape << np.uint64(1) | self.paired.astype(np.uint64))

    def _repeats(self) -> None:
        three, lens = runs(self.hashes, self.at, 3)
        commonest, distinct, fresh, end = [], [], [], 0
        for a, b, k in zip(self.at[:-1].tolist(), self.at[1:].tolist(), lens.tolist(), strict=True):
            words = np.sort(self.hashes[a:b])
            edge = np.flatnonzero(words[1:] != words[:-1])
            runs_of = np.diff(np.concatenate(([-1], edge, [b - a - 1]))) if b > a else np.ones(1, int)
            commonest.append(runs_of.max() / max(1, b - a))
            distinct.append(len(runs_of) / max(1, b - a))
            grams = np.sort(three[end : end + k])
            fresh.append((np.count_nonzero(grams[1:] != grams[:-1]) + 1) / k if k else 1.0)
            end += k
        self.measures |= {x: np.array(y) for x, y in zip(("commonest", "distinct", "fresh"), (commonest, distinct, fresh), strict=True)}

    def patterns(self) -> np.ndarray:
        """The votes of all labellers as digits to base 3: 0 abstains, 1 good, 2 junk."""
        out = np.zeros(len(self.n), np.int32)
        for name, side, junk, good, least in LABELLERS:
            x = self.measures[name] if side == ">" else -self.measures[name]
            sign = 1 if side == ">" else -1
            vote = np.where(x >= sign * junk, 2, np.where(x <= sign * good, 1, 0))
            out = out * 3 + np.where(self.n >= least, vote, 0)
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word two classes, and for each text one class for each measure."""
        size = np.uint64(DIMENSIONS - 1)
        words = (mix(self.hashes ^ np.uint64(0x5A5A)) & size).astype(np.int64)
        shapes = (self.shapes & size).astype(np.int64)
        bins = []
        for i, (name, *_, least) in enumerate(LABELLERS):  # the last bin: too short to measure
            bin_ = np.where(self.n >= least, np.searchsorted(_BINS, self.measures[name]), len(_BINS) + 1)
            bins.append(bin_ + i * (len(_BINS) + 2))
        return words, shapes, np.stack(bins, 1) + DIMENSIONS


def _class(first: np.ndarray) -> np.ndarray:
    return (_UPPER[first] + 2 * _LETTER[first] + 4 * _PUNCT[first]).astype(np.uint64)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        found = Texts(batch.column("text"))
        columns = [batch.column("doc_id"), pa.array(found.n.astype(np.int64)), pa.array(found.patterns().astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "pattern"])


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The probability of junk for each pattern, by expectation-maximisation over how often each occurs."""
    m = len(LABELLERS)
    votes = patterns[:, None] // 3 ** np.arange(m - 1, -1, -1) % 3
    junk, good = (votes == 2).sum(1), (votes == 1).sum(1)
    p = np.where(junk >= 1, 0.5 + 0.5 * junk / np.maximum(junk + good, 1), 0.05)
    for _ in range(rounds):
        share = np.clip((counts * p).sum() / counts.sum(), 1e-4, 1 - 1e-4)
        log = np.tile(np.log([share, 1 - share]), (len(patterns), 1))
        for k, weight in enumerate((counts * p, counts * (1 - p))):
            for j in range(m):
                called = np.array([weight[votes[:, j] == v].sum() + 0.5 for v in (1, 2)])
                rate = np.log(called / called.sum())
                log[:, k] += np.where(votes[:, j] == 0, 0.0, rate[np.maximum(votes[:, j], 1) - 1])
        before, p = p, 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -500, 500)))
        if np.abs(p - before).max() < 1e-9:
            break
    return p


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sampled text's classes and their weights."""
    for batch in sliced(batches, "text"):
        found = Texts(batch.column("text"))
        words, shapes, bins = found.features()
        index, value = [], []
        for i, (a, b) in enumerate(zip(found.at[:-1].tolist(), found.at[1:].tolist(), strict=True)):
            both, count = np.unique(np.concatenate((words[a:b], shapes[a:b])), return_counts=True)
            index.append(np.concatenate((both, bins[i])).astype(np.int32).tobytes())
            value.append(np.concatenate((count / (b - a), np.ones(bins.shape[1]))).astype(np.float32).tobytes())
        columns = [batch.column("p"), pa.array(index, pa.binary()), pa.array(value, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["p", "idx", "val"])


def _size() -> int:
    return DIMENSIONS + len(_MEASURES) * (len(_BINS) + 2) + 1


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logistic regression of the posteriors, by full gradients with momentum."""
    p, index, value = [], [], []
    for batch in batches:
        p += batch.column("p").to_pylist()
        index += [np.frombuffer(x, np.int32) for x in batch.column("idx").to_pylist()]
        value += [np.frombuffer(x, np.float32) for x in batch.column("val").to_pylist()]
    if not p:
        return
    order = sorted(range(len(p)), key=lambda i: (p[i], index[i].tobytes()))  # rows come in any order
    p, index, value = np.array([p[i] for i in order]), [index[i] for i in order], [value[i] for i in order]
    lens = np.array([len(x) for x in index])
    begin, row = np.cumsum(lens) - lens, np.repeat(np.arange(len(p)), lens)
    idx, val = np.concatenate(index), np.concatenate(value).astype(np.float64)
    w = np.zeros(_size())
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 121):
        score = np.add.reduceat(w[idx] * val, begin) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(score, -500, 500))) - p) / len(p)
        slope = np.bincount(idx, val * error[row], len(w)) + 1e-5 * w
        slope[-1] = error.sum()
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= 0.1 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["weights"])


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights.value, np.float32).astype(np.float64)
        for batch in sliced(batches, "text"):
            found = Texts(batch.column("text"))
            words, shapes, bins = found.features()
            total = np.concatenate(([0.0], np.cumsum(w[words] + w[shapes])))
            mean = (total[found.at[1:]] - total[found.at[:-1]]) / np.maximum(found.n, 1)
            score = 1 / (1 + np.exp(-np.clip(mean + w[bins].sum(1) + w[-1], -500, 500)))
            score[found.n == 0] = 1.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def learn(docs: DataFrame, sample: int = SAMPLE) -> bytes:
    """The scorer's weights, from all votes and a bounded sample of texts."""
    spark = docs.sparkSession
    votes = cut(_texts(docs).mapInArrow(_votes, "doc_id long, n_words long, pattern int").filter("n_words > 0"), "votes")
    found = votes.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** labellers rows
    if not found:
        return np.zeros(_size(), np.float32).tobytes()
    p = posteriors(np.array([r[0] for r in found]), np.array([float(r[1]) for r in found]))
    known = spark.createDataFrame([(r[0], float(x)) for r, x in zip(found, p, strict=True)], "pattern int, p double")
    rated = votes.join(F.broadcast(known), "pattern").filter("doc_id is not null")
    half = sample // 2
    chosen = [rated.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id", "p").limit(half) for c in ("p >= 0.5", "p < 0.5")]
    ids = cut(chosen[0].unionByName(chosen[1]).groupBy("doc_id").agg(F.max("p").alias("p")), "sample")
    texts = _texts(docs).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"]).select("p", "text")
    rows = cut(texts.mapInArrow(_rows, "p double, idx binary, val binary"), "features")
    made = rows.coalesce(1).mapInArrow(_fit, "weights binary").first()  # at most ``sample`` rows
    return made["weights"]


def scored(docs: DataFrame, weights: bytes | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (the probability of junk) and keep, for every row."""
    weights = learn(docs) if weights is None else weights
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return _texts(docs).mapInArrow(_score(shared), "doc_id long, score double").withColumn("keep", F.col("score") < threshold)


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text is not rejected, with all their columns, in one reading of the texts."""
    weights = docs.sparkSession.sparkContext.broadcast(learn(docs))
    kept = _kept(weights, threshold)
    return shipped(docs).mapInArrow(kept, docs.schema)


def _kept(weights, threshold: float):
    score = _score(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            two = pa.RecordBatch.from_arrays([batch.column("text")] * 2, ["doc_id", "text"])
            parts = [x.column("score") for x in score(iter([two]))]
            keep = np.concatenate([x.to_numpy() for x in parts]) < threshold
            yield batch.filter(pa.array(keep))

    return run
