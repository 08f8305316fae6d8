"""Ranked lexical search: documents that are the same bag of the queries' terms are scored once.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. Documents
are read once and restricted to the items' vocabulary: what stays is the number of all their terms and a packed
vector of (term, tf). Documents of equal vector and equal length factor m are one class; the classes are found by
grouping on the vectors themselves, so that equal hashes of different vectors stay apart. Each class is scored once
against all items, in blocks of classes, by sparse products in whole numbers. A task keeps each item's best classes
only: as classes of one score go by their least id, the first ``top`` classes hold the first ``top`` documents. At
the end the winning classes, and only their first ``top`` members by id, are written out as documents.

Items are taken in blocks of about a million (term, item) pairs and 16,384 items, and all documents are read for
each block; so what is broadcast has a bound, and an ordinary benchmark is one block. A block's vocabulary is three
numbers for each term: a 64-bit hash, its length and its first eight bytes, by all of which terms are told apart.
Texts are worked on in slices of a megabyte, also inside one text.

Defined cases: a null text has no terms. A document without any is not counted and never found. A document without
an id counts, and comes after others of its score. Repeated rows are documents of their own. Items without an id or
without terms find nothing; equal rows of the items are one item, unequal rows of one id rank on their own. Other
columns are ignored. A table without rows gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.llm.common import SLICE_BYTES, cut, flat, pieces, shipped, sliced
from quoteflow.llm.words import span_hashes, word_spans

TOP = 20
PAIRS, ITEMS = 1 << 20, 1 << 14
_CELLS = 1 << 22
_LOW = (1 << 20) - 1
_NO_ID = (1 << 63) - 1

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _parts(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` bytes that cut no term."""
    begin, n = 0, len(data)
    while begin < n:
        end = min(n, begin + most)
        while end < n and not _BREAK[data[end]]:
            gap = np.flatnonzero(_BREAK[data[end : end + most]])
            end = end + int(gap[0]) if len(gap) else min(n, end + most)
        yield begin, end
        begin = end


def _terms(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """For parts of a column of texts: each term's text, hash, length and first eight bytes."""
    data, ends = flat(column)
    for a, b in _parts(data, most):
        part = data[a:b]
        begin, end = word_spans(part, np.clip(ends - a, 0, b - a), _BREAK)
        if not len(begin):
            continue
        row = np.searchsorted(ends, begin + a, side="right") - 1
        place = begin[:, None] + np.arange(8)
        head = np.where(place < end[:, None], _FOLD[part[np.minimum(place, len(part) - 1)]], 0).astype(np.uint8)
        yield row, span_hashes(part, begin, end).view(np.int64), end - begin, head.view(np.int64)[:, 0]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        for row, code, size, head in _terms(batch.column("text")):
            keys, count = np.unique(np.stack([row, code, size, head]), axis=1, return_counts=True)
            item = batch.column("item").take(pa.array(keys[0]))
            yield pa.RecordBatch.from_arrays([item, *map(pa.array, (*keys[1:], count))], ["item", "code", "size", "head", "q"])


def _bags(shared):
    """doc_id, the number of all terms, and the vector of those in the vocabulary, as pairs of 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, size, head = shared.value
        for batch in sliced(batches, "text"):
            total = np.zeros(batch.num_rows, np.int64)
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, c, s, h in _terms(batch.column("text")):
                total += np.bincount(row, minlength=batch.num_rows)
                at = np.minimum(np.searchsorted(code, c), len(code) - 1)
                hit = (code[at] == c) & (size[at] == s) & (head[at] == h)
                found, n = np.unique(row[hit] * len(code) + at[hit], return_counts=True)
                keys.append(found)
                counts.append(n)
            key, which = np.unique(np.concatenate(keys), return_inverse=True)
            tf = np.zeros(len(key), np.int64)
            np.add.at(tf, which, np.concatenate(counts))
            pairs = np.stack([key % len(code), tf], axis=1).astype("<u4")
            at = np.searchsorted(key, np.arange(batch.num_rows + 1) * len(code))
            offsets = pa.py_buffer((8 * at).astype(np.int32).tobytes())
            vec = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(pairs.tobytes())])
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total), vec], ["doc_id", "n", "vec"])
            yield out.filter(pa.array(total > 0))

    return run


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed vectors each pair's term and tf, and where each vector begins and the last ends."""
    data, ends = flat(column)
    pairs = np.frombuffer(data.tobytes(), "<u4").reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1], ends // 8


def _holding(terms: int):
    """How many documents hold each term, over the classes of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms)
        for batch in batches:
            term, _, at = _vectors(batch.column("vec"))
            df += np.bincount(term, np.repeat(batch.column("copies").to_numpy(), np.diff(at)), terms)
        (held,) = np.nonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held].astype(np.int64))], ["term", "df"])

    return run


def _scores(known: dict, term: np.ndarray, tf: np.ndarray, row: np.ndarray, m: np.ndarray, rows: int) -> np.ndarray:
    """The scores of some classes for all items, exact: products are summed in two parts below 2**53."""
    value = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
    each = known["begin"][term + 1] - known["begin"][term]
    ends = np.cumsum(each)
    high, low = np.zeros(rows * known["items"]), np.zeros(rows * known["items"])
    a = 0
    while a < len(term):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + _CELLS, side="right")))
        n = each[a:b]
        place = np.arange(ends[b - 1] - done) + np.repeat(known["begin"][term[a:b]] - (ends[a:b] - n - done), n)
        cell = np.repeat(row[a:b], n) * known["items"] + known["item"][place]
        product = np.repeat(value[a:b], n) * known["weight"][place]
        high += np.bincount(cell, product >> 20, len(high))
        low += np.bincount(cell, product & _LOW, len(low))
        a = b
    return ((high.astype(np.int64) << 20) + low.astype(np.int64)).reshape(rows, known["items"])


def _first(best: list[np.ndarray], top: int) -> list[np.ndarray]:
    """Of (item, score, least id, class) the first of each item."""
    item, score, first, _ = best
    order = np.lexsort((first, -score, item))
    item = item[order]
    starts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
    rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
    order = order[rank < top]
    return [x[order] for x in best]


def _best(shared, top: int):
    """Each item's best classes among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        best = [np.zeros(0, np.int64)] * 4
        least = np.ones(known["items"], np.int64)
        step = max(1, _CELLS // known["items"])
        for batch in batches:
            term, tf, at = _vectors(batch.column("vec"))
            m = batch.column("m").to_numpy()
            first = batch.column("first_id").fill_null(_NO_ID).to_numpy()
            number = batch.column("class_id").to_numpy()
            for a in range(0, batch.num_rows, step):
                b = min(batch.num_rows, a + step)
                row = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
                score = _scores(known, term[at[a] : at[b]], tf[at[a] : at[b]], row, m[a:b], b - a)
                floor = least if b - a <= top else np.maximum(least, np.partition(score, b - a - top, axis=0)[b - a - top])
                r, item = np.nonzero(score >= floor)
                if len(r):
                    new = [item, score[r, item], first[a + r], number[a + r]]
                    best = _first([np.concatenate(x) for x in zip(best, new, strict=True)], top)
                    full = np.bincount(best[0], minlength=known["items"]) == top
                    last = np.flatnonzero(np.append(best[0][1:] != best[0][:-1], True))
                    least[full] = best[1][last][full[best[0][last]]]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, best)), ["item", "score", "first_id", "class_id"])

    return run



def _block(docs: DataFrame, items: DataFrame, terms: DataFrame, top: int) -> DataFrame | None:
    """The best documents of a bounded block of items."""
    context = docs.sparkSession.sparkContext
    terms = terms.toPandas()
    if terms.empty:
        return None
    table = terms[["code", "size", "head"]].drop_duplicates().sort_values("code").to_numpy(np.int64)
    if len(np.unique(table[:, 0])) < len(table):
        raise RuntimeError("two terms of the items have one hash")
    code = np.ascontiguousarray(table[:, 0])
    vocabulary = context.broadcast(tuple(np.ascontiguousarray(x) for x in table.T))
    bags = cut(docs.mapInArrow(_bags(vocabulary), "doc_id long, n long, vec binary"), "bags")
    n_docs, n_terms = bags.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    bags = bags.filter("octet_length(vec) > 0").withColumn("m", F.expr(f"75L + (25L * n * {n_docs}L) div {n_terms}L"))
    classes = bags.groupBy("m", "vec").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    held = classes.select("vec", "copies").mapInArrow(_holding(len(code)), "term long, df long")
    held = held.groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    weight = np.zeros(len(code), np.int64)
    for term, df in zip(held["term"], held["df"], strict=True):
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1)))
    names = sorted(terms["item"].unique())
    terms["term"] = np.searchsorted(code, terms["code"].to_numpy())
    terms["number"] = np.searchsorted(np.array(names), terms["item"].to_numpy())
    terms = terms.sort_values(["term", "number"])
    known = {
        "items": len(names),
        "begin": np.searchsorted(terms["term"].to_numpy(), np.arange(len(code) + 1)),
        "item": terms["number"].to_numpy(np.int64),
        "weight": terms["q"].to_numpy(np.int64) * weight[terms["term"].to_numpy()],
    }
    shared = context.broadcast(known)
    found = classes.select("class_id", "m", "vec", "first_id")
    found = found.mapInArrow(_best(shared, top), "item long, score long, first_id long, class_id long")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "first_id")
    best = found.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= top)
    best = best.select(F.col("item").alias("number"), "score", "class_id")
    best = cut(best.join(classes.select("class_id", "m", "vec"), "class_id"), "best-classes")
    # the winners' hashes are at most ``top`` for each item of the block; their members are trimmed before they move
    code_of = F.xxhash64("m", "vec").alias("bag")
    members = bags.select("doc_id", "m", "vec", code_of).join(F.broadcast(best.select(code_of).distinct()), "bag", "left_semi")
    by_id = Window.partitionBy("bag", "m", "vec").orderBy(F.asc_nulls_last("doc_id"))
    members = members.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= top).drop("place", "bag")
    # at most as many rows as the block has items
    number = docs.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(names)], "number long, item long")
    out = best.join(members, ["m", "vec"]).join(number, "number").join(items.select("item", "item_id"), "item")
    by_rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = out.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top)
    return out.select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, top: int = TOP, pairs: int = PAIRS, most: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` best documents; ``queries`` has item_id and text."""
    spark = docs.sparkSession
    docs = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("item_id is not null and text is not null").distinct()
    items = cut(items.withColumn("item", F.monotonically_increasing_id()), "items")
    terms = items.select("item", "text").mapInArrow(_item_terms, "item long, code long, size long, head long, q long")
    terms = cut(terms.groupBy("item", "code", "size", "head").agg(F.sum("q").alias("q")), "item-terms")
    n_pairs, n_items = terms.agg(F.count("*"), F.count_distinct("item")).first()
    blocks = max(pieces(n_pairs, pairs), pieces(n_items, most))
    place = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = [_block(docs, items, terms.filter(place == i), top) for i in range(blocks)]
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, [x for x in found if x is not None], none)
