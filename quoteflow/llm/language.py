"""Language of documents as a mixture: proportions by expectation-maximisation, languages by penalised likelihood.

The model of a language is a smoothed distribution of letter trigrams, hashed into ``BUCKETS`` classes, counted over
all training texts. A word (a run of letters) gets a likelihood under every language from its trigrams, which
see the word's ends. A document is a mixture of languages over its words: expectation-maximisation gives the
proportions for a set of languages. The set grows from the best single language by the one with the largest
proportion in the full mixture, as long as the log-likelihood gains more than ``PENALTY * log(words + 1)``.

What is broadcast is one row of ``BUCKETS`` numbers for each language; texts are worked on in slices of whole rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text where there is nothing
to learn from. Equal proportions go to the language that comes first by name. Rows without a language, text or id
are not learned from. Repeated rows count as often as they come. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import shipped, sliced

BUCKETS = 1 << 16
PENALTY = 3.0
_ROUNDS = 10
_FLOOR = 60.0
_SLICE = 1 << 20
_U = np.uint64


@lru_cache(1)
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[c for c in range(len(out)) if chr(c).isalpha()]] = True
    return out


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A class for each letter's trigram, where words begin among them, and where texts' words begin and end."""
    lower = [t.lower() if t else "" for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    code = points[at - 1] * _U(0x9E3779B97F4A7C15) + points[at] * _U(0xC2B2AE3D27D4EB4F) + points[at + 1] * _U(0x165667B19E3779F9)
    code ^= code >> _U(29)
    code *= _U(0xBF58476D1CE4E5B9)
    first = np.flatnonzero(~letter[at - 1])
    ends = np.cumsum([0, *[len(t) + 1 for t in lower]])
    return (code >> _U(48)).astype(np.int64), first, np.searchsorted(at[first], ends)


def _count(languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in sliced(batches, "text", _SLICE):
            lang = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for x in set(lang):
                classes, _, _ = _trigrams([t for t, y in zip(texts, lang, strict=True) if y == x])
                counts[number[x]] += np.bincount(classes, minlength=BUCKETS)
        which, bucket = np.nonzero(counts)
        if len(which):
            columns = [which.astype(np.int32), bucket.astype(np.int32), counts[which, bucket]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["lang", "bucket", "n"])

    return run


class Model:
    """Log-probabilities of trigram classes, a column for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.table = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32))


def learn(docs: DataFrame) -> Model:
    """The model of all rows that have an id, a text and a language."""
    rows = shipped(docs).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        found = rows.mapInArrow(_count(languages), "lang int, bucket int, n long")
        table = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[table["lang"], table["bucket"]] = table["n"]
    return Model(languages, counts)


def _mixed(likely: np.ndarray, row: np.ndarray, begin: np.ndarray, size: np.ndarray, allowed: np.ndarray):
    """Proportions and log-likelihood of each text for the languages it is allowed."""
    share = allowed / allowed.sum(1, keepdims=True)
    share = share.astype(np.float32)
    for _ in range(_ROUNDS):
        part = likely * share[row]
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, begin) / size[:, None]
    whole = np.einsum("ij,ij->i", likely, share[row]).astype(np.float64)
    return share, np.add.reduceat(np.log(whole), begin)


def _within(rows: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts: their places, their text's number among those, and where each begins."""
    each = size[rows]
    at = np.cumsum(each) - each
    place = np.arange(int(each.sum())) + np.repeat(begin[rows] - at, each)
    return place, np.repeat(np.arange(len(rows)), each), at


def proportions(model: Model, texts: list[str | None]) -> np.ndarray:
    """A row for each text of its languages' shares; all zero where it has no letter."""
    k = len(model.languages)
    out = np.zeros((len(texts), k))
    classes, first, words_at = _trigrams(texts)
    size = np.diff(words_at)
    used = np.flatnonzero(size)
    if not len(used) or not k:
        return out
    log = np.add.reduceat(model.table[classes], first)
    log -= log.max(1, keepdims=True)
    np.maximum(log, -_FLOOR, out=log)
    likely = np.exp(log)
    begin, size = words_at[:-1][used], size[used]
    row = np.repeat(np.arange(len(used)), size)
    alone = np.add.reduceat(log.astype(np.float64), begin)
    allowed = np.zeros((len(used), k), bool)
    allowed[np.arange(len(used)), alone.argmax(1)] = True
    best, share = alone.max(1), allowed.astype(np.float64)
    full, _ = _mixed(likely, row, begin, size, np.ones((len(used), k)))
    open_ = np.flatnonzero(size > 1)
    for _ in range(k - 1):
        if not len(open_):
            break
        wanted = np.where(allowed[open_], -1, full[open_]).argmax(1)
        more = allowed[open_]
        more[np.arange(len(open_)), wanted] = True
        place, among, at = _within(open_, begin, size)
        got, value = _mixed(likely[place], among, at, size[open_], more)
        better = value - best[open_] > PENALTY * np.log(size[open_] + 1)
        open_, got, value, more = open_[better], got[better], value[better], more[better]
        allowed[open_], share[open_], best[open_] = more, got, value
    out[used] = share
    return out


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        names = np.array([*known.languages, "und"], object)
        for batch in sliced(batches, "text", _SLICE):
            shares = proportions(known, batch.column("text").to_pylist())
            top = shares.max(1) if shares.shape[1] else np.zeros(len(shares))
            which = np.where(top > 0, shares.argmax(1) if shares.shape[1] else 0, len(names) - 1)
            parts = [{names[i]: float(x[i]) for i in np.flatnonzero(x)} for x in shares]
            columns = [batch.column("doc_id"), pa.array(names[which].tolist(), pa.string())]
            columns += [pa.array(np.minimum(top, 1.0)), pa.array([list(x.items()) for x in parts], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "shares"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (its share) and the shares of all languages found, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, shares map<string,double>")
