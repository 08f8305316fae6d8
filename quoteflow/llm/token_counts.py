"""Token counts of texts of any length: overlapping chunks, spliced where their encodings provably agree.

A text is cut into chunks of ``chunk`` bytes that overlap by ``overlap``. Each chunk is a row of its own, wherever
its document came from, and is encoded with the offsets of its tokens. Neighbours are spliced at a place in their
overlap where both have a token boundary and a letter is followed by something else, or a number by something that
is none, in any script. The pattern that splits text before merging takes letters, and numbers, as whole runs with
nothing behind them, so every reading of the text, whatever lies further left or right, has a boundary there: the
tokens before it and behind it are those of the whole text. Characters count as letters, numbers or others only where
Unicode has said so since its version 3.2, as libraries have versions of their own. Where an overlap has no such place
the document is done again with chunks and overlaps twice as wide, at last as one chunk.

The counts are those of the ``tokenizers`` library for the .json file, with the strings of special tokens read as
those tokens. Texts whose characters are all in ``PLAIN`` are encoded from the same vocabulary's rank file, several
times faster and to the same ids; any other text, on which Unicode versions of the two libraries might differ,
goes through ``tokenizers`` itself.

Defined cases: a null text counts as empty: no bytes, no tokens. Repeated rows come back as often as they came.
A null id stays null. Other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.llm.common import cut, shipped
from quoteflow.llm.pieces import model_path

MODEL, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 64 << 10, 1 << 10
LIMIT = 1024
#: Characters on which every version of Unicode agrees: printable ASCII and Latin letters, tab and line ends.
PLAIN = "\t\n\r\x20-\x7e¡-ɏ–—‘-”•…€"

_plain = re.compile(f"[{PLAIN}]*").fullmatch
_MARKS = "array<struct<at:bigint,n:bigint>>"
_ENCODED = f"row long, k long, last boolean, tokens long, left_marks {_MARKS}, right_marks {_MARKS}"


class Encoder:
    """Ids of byte strings, by the faster library where both are known to agree."""

    def __init__(self, model: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = model_path(model)
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        with open(model_path(ranks), "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special)
        self.special = list(special)
        size = max([*known.values(), *special.values()]) + 1
        self.bytes = np.zeros(size, np.int64)
        for x, i in [*known.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes[i] = len(x)

    def ids(self, text: str) -> list[int]:
        if not _plain(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self.plain.encode(text, allowed_special="all")
        return self.plain.encode_ordinary(text)


@lru_cache(2)
def encoder(model: str, ranks: str) -> Encoder:
    return Encoder(model, ranks)


@lru_cache(1)
def _classes() -> np.ndarray:
    """1 for letters, 2 for numbers, 3 for other characters, 0 where versions of Unicode may differ."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x30000):
        now, then = unicodedata.category(chr(c))[0], unicodedata.ucd_3_2_0.category(chr(c))
        if then != "Cn" and then != "Cs" and {"L": 1, "N": 2}.get(now, 3) == {"L": 1, "N": 2}.get(then[0], 3):
            out[c] = {"L": 1, "N": 2}.get(now, 3)
    return out


def _edges(text: str) -> np.ndarray:
    """Where, in bytes, a letter or number of a text is followed by a character of another class."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    at = np.flatnonzero((kind[:-1] % 3 > 0) & (kind[1:] > 0) & (kind[1:] != kind[:-1])) + 1
    widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return (np.cumsum(widths) - widths)[at]


def _marks(edges: np.ndarray, ends: np.ndarray, low: int, high: int, base: int) -> list[dict]:
    """The ``edges`` from ``low`` to ``high`` where this reading has a boundary, and the tokens before each."""
    places = edges[(edges >= low) & (edges < high)]
    count = np.searchsorted(ends, places, side="right")
    sure = (count > 0) & (ends[np.maximum(count, 1) - 1] == places)
    return [{"at": base + int(p), "n": int(c)} for p, c in zip(places[sure], count[sure], strict=True)]


def _encoded(model: str, ranks: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(model, ranks)
        for batch in batches:
            tokens, left, right = [], [], []
            ks, lasts = batch.column("k").to_pylist(), batch.column("last").to_pylist()
            for k, last, part in zip(ks, lasts, batch.column("part"), strict=True):
                raw, base = part.as_py(), k * (chunk - overlap)
                skip = 0
                while k and skip < min(4, len(raw)) and raw[skip] & 0xC0 == 0x80:
                    skip += 1
                body = raw[skip:]
                text = body.decode("utf-8", "ignore")  # of a chunk's end, at most a part of a character is left out
                ids = known.ids(text)
                tokens.append(len(ids))
                if k == 0 and last:
                    left.append([])
                    right.append([])
                    continue
                edges, ends = _edges(text), np.cumsum(known.bytes[ids])
                left.append(_marks(edges, ends, 1, overlap, base + skip) if k else [])
                right.append([] if last else _marks(edges, ends, chunk - overlap - skip, len(raw), base + skip))
            columns = [batch.column("row"), batch.column("k"), batch.column("last"), pa.array(tokens, pa.int64())]
            kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
            columns += [pa.array(left, kind), pa.array(right, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "k", "last", "tokens", "left_marks", "right_marks"])

    return run


def _parts(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    step = chunk - overlap
    ahead = f"greatest(0, cast(ceil((octet_length(text) - {overlap}) / {step}) as int) - 1)"
    return (
        rows.select("row", "text", F.explode(F.expr(f"sequence(0L, cast({ahead} as bigint))")).alias("k"), F.expr(ahead).alias("end"))
        .select(
            "row",
            "k",
            F.expr("k = end").alias("last"),
            F.expr(f"substring(cast(text as binary), cast(k * {step} + 1 as int), {chunk})").alias("part"),
        )
    )


def _spliced(encoded: DataFrame) -> DataFrame:
    """row and tokens of texts in several chunks; tokens is null where an overlap has no common place."""
    before = F.lag("right_marks").over(Window.partitionBy("row").orderBy("k"))
    joined = encoded.withColumn("before", before).withColumn(
        "at", F.expr("array_min(array_intersect(transform(left_marks, x -> x.at), transform(before, x -> x.at)))")
    )
    joined = joined.withColumn(
        "more", F.expr("get(filter(before, x -> x.at = at), 0).n - get(filter(left_marks, x -> x.at = at), 0).n")
    )
    return joined.groupBy("row").agg(
        F.sum("more").alias("spliced"),
        F.sum(F.expr("if(last, tokens, 0)")).alias("end"),
        F.sum(F.expr("cast(k > 0 and at is null as int)")).alias("failed"),
    ).select("row", F.expr("if(failed = 0, coalesce(spliced, 0) + end, null)").alias("tokens"))


def token_counts(
    docs: DataFrame, model: str = MODEL, ranks: str = RANKS, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    rows = shipped(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    long = F.octet_length("text") > chunk
    short = rows.filter(~long).select(F.octet_length("text").cast("long").alias("n_bytes"), "doc_id", "text")
    whole = short.mapInArrow(_counted(model, ranks), "doc_id long, n_bytes long, n_tokens long")
    # equal texts are the same row of work; what comes back is joined to every document that has the text
    rest = rows.filter(long).withColumn("row", F.xxhash64("text", F.octet_length("text")))
    texts, done = rest.select("row", "text").dropDuplicates(["row"]), None
    while True:
        encoded = _parts(texts, chunk, overlap).mapInArrow(_encoded(model, ranks, chunk, overlap), _ENCODED)
        found = cut(_spliced(cut(encoded, "chunks")), "spliced")
        good = found.filter("tokens is not null")
        done = good if done is None else done.unionByName(good)
        if found.filter("tokens is null").isEmpty():
            break
        texts = texts.join(found.filter("tokens is null").select("row"), "row", "left_semi")
        chunk, overlap = 2 * chunk, 2 * overlap
    counted = rest.select("doc_id", "row", F.octet_length("text").cast("long").alias("n_bytes")).join(done, "row")
    return whole.unionByName(counted.select("doc_id", "n_bytes", F.col("tokens").alias("n_tokens"))).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


def _counted(model: str, ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(model, ranks)
        for batch in batches:
            counts = [len(known.ids(t)) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    return run
