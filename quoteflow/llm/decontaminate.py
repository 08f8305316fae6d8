"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item is contained in a document when the document has at least ``num / den`` of the item's distinct word
n-grams. Documents are far longer than items, so the sketch is the item's: its least hashes. If an item of n
n-grams may miss at most m of them, then of any m + c of them a document that contains it has c. Items are
partitioned by size, and each partition asks for its own c (``ASKED``): long items are held against a document only
when several sketch values meet in it. No contained item is missed.

Documents are read once. A bitmap of the items' hashes, of bounded size (``MOST_BITS``) however many items there
are, leaves the n-grams that can belong to an item; beyond that size it only lets more n-grams through. Those are
joined with the sketches by hash; candidates are verified by exact containment, each pair once.

Defined cases: n-grams are taken over words as in ``words``; an item with fewer than n words is looked for as its
whole sequence; an item without words is never found. Null and empty texts contain nothing. Rows of one id, of
documents or of items, count together as one. Rows with a null id are ignored. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.llm.common import cut, shipped, sliced
from quoteflow.llm.words import runs, shingles, words

#: From how many n-grams on an item's sketch must meet a document how often.
ASKED = ((1, 1), (12, 2), (48, 4), (192, 8))
#: Bits of the largest bitmap, 32 MB.
MOST_BITS = 1 << 28
_SLICES = 64


def _item_grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            hashes, at = words(batch.column("text"))
            sets = [np.unique(x) for x in shingles(hashes, at, n)]
            lens = [len(x) for x in sets]
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), lens)
            length = np.repeat(np.minimum(np.diff(at), n), lens).astype(np.int32)
            columns = [ids, length, np.concatenate(sets).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["item_id", "w", "h"])

    return run


def _bitmap(bits: int):
    each = bits // _SLICES // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            place = _place(batch.column("h").to_numpy().view(np.uint64), bits)
            np.bitwise_or.at(field, place >> 3, (1 << (place & 7)).astype(np.uint8))
        parts = field.reshape(_SLICES, each)
        used = [i for i in range(_SLICES) if parts[i].any()]
        if used:
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["part", "field"]
            )

    return run


def _either(table: pa.Table) -> pa.Table:
    fields = [np.frombuffer(x, np.uint8) for x in table.column("field").to_pylist()]
    field = np.bitwise_or.reduce(fields).tobytes()
    return pa.table([table.column("part")[:1].cast(pa.int32()), pa.array([field], pa.binary())], ["part", "field"])


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _hits(field, bits: int, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(field.value, np.uint8)
        for batch in sliced(batches, "text"):
            hashes, at = words(batch.column("text"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            keys, found = [], []
            for n in lengths:
                grams, lens = runs(hashes, at, n)
                place = _place(grams, bits)
                hit = np.flatnonzero((known[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                keys.append(ids[np.searchsorted(np.cumsum(lens), hit, side="right")])
                found.append(grams[hit].view(np.int64))
            rows = np.unique(np.rec.fromarrays([np.concatenate(keys), np.concatenate(found)], names="doc_id,h"))
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(rows["doc_id"])), pa.array(np.ascontiguousarray(rows["h"]))], ["doc_id", "h"]
                )

    return run


def _known(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return shipped(df).select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")
    ).filter("id is not null and text is not null")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    n: int = 5,
    num: int = 4,
    den: int = 5,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, item_id, n_shingles of the item, n_shared and containment, for every contained item."""
    spark = docs.sparkSession
    grams = _known(items, item_id, text).mapInArrow(_item_grams(n), "item_id long, w int, h long").distinct()
    grams = grams.join(grams.groupBy("item_id").agg(F.count("*").cast("int").alias("n")), "item_id")
    asked = F.lit(1)
    for size, c in ASKED:
        asked = F.when(F.col("n") >= size, c).otherwise(asked)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("h"))
    grams = grams.withColumn("asked", asked).withColumn("missed", F.expr(f"n - cast(ceil({num}D * n / {den}) as int)"))
    grams = cut(grams.withColumn("sketch", rank <= F.col("missed") + F.col("asked")), "items")
    facts = grams.agg(F.count("*").alias("grams"), F.collect_set("w").alias("lengths")).first()
    if not facts["grams"]:
        return spark.createDataFrame([], "doc_id long, item_id long, n_shingles long, n_shared long, containment double")
    bits = min(MOST_BITS, max(1 << 16, 1 << (32 * facts["grams"]).bit_length()))
    parts = grams.select("h").mapInArrow(_bitmap(bits), "part int, field binary")
    parts = parts.groupBy("part").applyInArrow(_either, "part int, field binary")
    field = bytearray(bits // 8)
    size = len(field) // _SLICES
    for row in parts.toLocalIterator():  # at most MOST_BITS in all
        field[row["part"] * size : (row["part"] + 1) * size] = row["field"]
    shared = spark.sparkContext.broadcast(bytes(field))
    found = _known(docs, doc_id, text).mapInArrow(_hits(shared, bits, sorted(facts["lengths"])), "doc_id long, h long")
    hits = cut(found, "hits")

    sketch = grams.filter("sketch").select("item_id", "h", "asked")
    candidates = (
        hits.join(sketch, "h")
        .groupBy("doc_id", "item_id", "asked")
        .agg(F.countDistinct("h").alias("met"))
        .filter("met >= asked")
        .select("doc_id", "item_id")
    )
    return (
        candidates.join(grams.select("item_id", "h", "n"), "item_id")
        .join(hits.distinct(), ["doc_id", "h"])
        .groupBy("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"))
        .agg(F.count("*").alias("n_shared"))
        .filter(f"{den} * n_shared >= {num} * n_shingles")
        .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    )


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents that contain no item."""
    held = contained_items(docs, items, **how).select(F.col("doc_id").alias("__held")).distinct()
    held = cut(held, "held")  # its size is known then: small lists are broadcast, large ones joined
    key = F.col(f"`{how.get('doc_id', 'doc_id')}`").cast("long")
    return docs.join(held, key == F.col("__held"), "left_anti")
