"""Packed training rows of token ids: best-fit-decreasing, with a segment tree that finds the fullest row that fits.

Texts are encoded and ended with ``end_id``. A document longer than a row is split into full rows and a rest, so no id
is lost. The pieces of a shard, about ``SHARD`` ids that one task gathers, go by falling length each into the row
with the least room that still takes it. The tree has a leaf for each amount of room and finds the least amount that
is large enough and present in log(length) steps. Nothing is shuffled: a shard is packed where its texts are read,
and holds thousands of rows, so little room is left over.

A row of the result is a row of the id matrix: ``ids`` (little-endian, two bytes while the vocabulary allows, else four;
padded to the row's length), its cumulative segment lengths, where positions start again at 0, and
for each segment its document and where in the document's ids it begins.

``write_matrices`` writes shards as raw little-endian files that a trainer maps into memory: ``ids``, rows times length
of one width; ``cu``, all rows' cumulative lengths as 32-bit numbers, and ``at``, the 64-bit place in it where each row's
begin and the last one's end; ``resets``, a row's cumulative lengths without the last; ``docs``, ``named`` (0 where a
document's id is null) and ``begins``, a number for each segment. A shard's files have a name of their own in every
attempt of a task. Which shards count stands in the table ``manifest``, that Spark commits as a whole after the last
task, so what a lost executor left behind is never read.

Defined cases: null and empty texts have no ids and no segment, not even the end. Equal lengths keep the order of the
texts. Rows whose id is null are packed with a null id. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.llm.common import cut, scratch, shipped, sliced
from quoteflow.llm.pieces import MODEL, encode, model_path, vocabulary

LENGTH = 2048
SHARD = 2 << 20
END = 2
_SCHEMA = (
    "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, doc_begins array<long>"
)
_MANIFEST = "shard string, first long, rows long, length int, width int, segments long, n_tokens long"
#: Rows that a reader of matrices holds.
_AT_ONCE = 1024


class Room:
    """Open rows by the room they have left; ``take`` finds the one with the least that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(self.size)]
        self.count = [0] * (2 * self.size)

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = room + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row), taken out, or None."""
        k = need + self.size
        while not self.count[k]:  # up to the first subtree on the right that has a row, then down its left side
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.size
        row = self.rows[room].pop()
        while k:
            self.count[k] -= 1
            k >>= 1
        return room, row


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """The numbers of the sizes that go into each row."""
    room, rows = Room(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = room.take(sizes[i])
        if found is None:
            rows.append([i])
            left, row = length - sizes[i], len(rows) - 1
        else:
            left, row = found[0] - sizes[i], found[1]
            rows[row].append(i)
        if left:
            room.put(left, row)
    return rows


def _packed(docs: list[tuple[int | None, np.ndarray]], length: int, kind, pad: int, first: int) -> pa.RecordBatch:
    pieces = [(key, k, ids[k : k + length]) for key, ids in docs for k in range(0, len(ids), length)]
    rows = best_fit([len(x) for *_, x in pieces], length)
    out: list[list] = [[] for _ in range(7)]
    for n, row in enumerate(rows):
        parts = [pieces[i] for i in row]
        edges = np.cumsum([0, *[len(x) for *_, x in parts]])
        ids = np.full(length, pad, kind)
        ids[: edges[-1]] = np.concatenate([x for *_, x in parts])
        whole = edges.tolist()
        values = (first + n, whole[-1], ids.tobytes(), whole, whole[:-1], [p[0] for p in parts], [p[1] for p in parts])
        for x, value in zip(out, values, strict=True):
            x.append(value)
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = (pa.int64(), pa.int32(), pa.binary(), ints, ints, longs, longs)
    names = ["pack_id", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "doc_begins"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def _packer(model: str, length: int, shard: int, end: int | None, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path(model))
        kind = np.dtype("<u2") if v.size <= 1 << 16 else np.dtype("<u4")
        tail = np.array([] if end is None else [end], kind)
        held, size, first = [], 0, TaskContext.get().partitionId() << 33
        for batch in sliced(batches, "text"):
            keys = batch.column("id").to_pylist()
            ids, at = encode(v, batch.column("text").to_pylist())
            ids, edges = ids.astype(kind), at.tolist()
            for key, a, b in zip(keys, edges[:-1], edges[1:], strict=True):
                if b > a:
                    held.append((key, np.concatenate((ids[a:b], tail))))
                    size += len(held[-1][1])
            if size >= shard:
                made = _packed(held, length, kind, pad, first)
                yield made
                held, size, first = [], 0, first + made.num_rows
        if held:
            yield _packed(held, length, kind, pad, first)

    return run


def _system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder, and its name there."""
    if re.match("file:/|/", path):
        return pa.fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return pa.fs.FileSystem.from_uri(path)


def _shards(pack: Callable, path: str, length: int):
    """Write every packed shard to files of its own, and give its row of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(path)
        system.create_dir(base, recursive=True)
        for made in pack(batches):
            name = uuid.uuid4().hex
            cu, docs = made.column("cu_seqlens"), made.column("doc_ids").flatten()
            at = np.cumsum([0, *cu.value_lengths().to_pylist()])
            ids = b"".join(made.column("ids").to_pylist())
            files = {
                "ids": ids,
                "cu": cu.flatten().to_numpy().astype("<i4"),
                "at": at.astype("<i8"),
                "resets": made.column("resets").flatten().to_numpy().astype("<i4"),
                "docs": docs.fill_null(0).to_numpy().astype("<i8"),
                "named": docs.is_valid().to_numpy(zero_copy_only=False).astype("u1"),
                "begins": made.column("doc_begins").flatten().to_numpy().astype("<i8"),
            }
            for part, data in files.items():
                with system.open_output_stream(f"{base}/{name}.{part}") as out:
                    out.write(data if part == "ids" else data.tobytes())
            rows, tokens = made.num_rows, sum(made.column("n_tokens").to_pylist())
            row = (name, made.column("pack_id")[0].as_py(), rows, length, len(ids) // (rows * length), len(docs), tokens)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            names = ["shard", "first", "rows", "length", "width", "segments", "n_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    return run


def _stretch(system: pa.fs.FileSystem, name: str, kind: str, begin: int, end: int) -> np.ndarray:
    """Numbers from a place to another of a raw file."""
    size = np.dtype(kind).itemsize
    with system.open_input_file(name) as file:
        return np.frombuffer(file.read_at((end - begin) * size, begin * size), kind)


def _read_shards(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(path)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        kinds = (pa.int64(), pa.int32(), pa.binary(), ints, ints, longs, longs)
        names = ["pack_id", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "doc_begins"]
        for shard in (row for batch in batches for row in batch.to_pylist()):
            name, wide = f"{base}/{shard['shard']}", shard["length"] * shard["width"]
            at = _stretch(system, f"{name}.at", "<i8", 0, shard["rows"] + 1)
            for i in range(0, shard["rows"], _AT_ONCE):
                j = min(i + _AT_ONCE, shard["rows"])
                ids = _stretch(system, f"{name}.ids", "u1", i * wide, j * wide).reshape(j - i, wide)
                cu = _stretch(system, f"{name}.cu", "<i4", int(at[i]), int(at[j]))
                some = [_stretch(system, f"{name}.{p}", k, int(at[i]) - i, int(at[j]) - j) for p, k in
                        (("resets", "<i4"), ("docs", "<i8"), ("named", "u1"), ("begins", "<i8"))]
                resets, docs, named, begins = some
                edge = (at[i : j + 1] - at[i]).astype(np.int32)
                inner = pa.array(edge - np.arange(j - i + 1, dtype=np.int32))  # a row has one segment less than edges
                lists = [
                    pa.ListArray.from_arrays(pa.array(edge), pa.array(cu)),
                    pa.ListArray.from_arrays(inner, pa.array(resets)),
                    pa.ListArray.from_arrays(inner, pa.array(docs, mask=named == 0)),
                    pa.ListArray.from_arrays(inner, pa.array(begins)),
                ]
                first = shard["first"] + np.arange(i, j)
                columns = [pa.array(first), pa.array(cu[edge[1:] - 1]), pa.array([x.tobytes() for x in ids], pa.binary()), *lists]
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def packed(
    docs: DataFrame, model: str = MODEL, length: int = LENGTH, shard: int = SHARD, end_id: int | None = END, pad_id: int = 0
) -> DataFrame:
    """The packed rows of all texts."""
    return _texts(docs).mapInArrow(_packer(model, length, shard, end_id, pad_id), _SCHEMA)


def _texts(docs: DataFrame) -> DataFrame:
    return shipped(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def write_matrices(
    docs: DataFrame, path: str | None = None, model: str = MODEL, length: int = LENGTH, shard: int = SHARD, end_id: int | None = END,
    pad_id: int = 0,
) -> str:
    """Write the packed rows of all texts as raw files and a manifest; the folder, one in scratch space without a path.

    The folder must be reachable by that name from all executors. One that has a manifest is refused.
    """
    path = path or scratch(docs.sparkSession, "matrices")
    files = _shards(_packer(model, length, shard, end_id, pad_id), f"{path}/shards", length)
    _texts(docs).mapInArrow(files, _MANIFEST).write.mode("errorifexists").parquet(f"{path}/manifest")
    return path


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The rows of matrices that were written, a shard at a time in slices, as ``packed`` gives them."""
    manifest = shipped(spark.read.schema(_MANIFEST).parquet(f"{path}/manifest"))
    dealt = manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    return dealt.mapInArrow(_read_shards(f"{path}/shards"), _SCHEMA)


def write_packed(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write the packed rows as Parquet and read them back; without a path to scratch space."""
    if path is None:
        return cut(packed(docs, **how), "packed")
    packed(docs, **how).write.mode("errorifexists").parquet(path)
    return docs.sparkSession.read.parquet(path)


def position_ids(rows: DataFrame) -> DataFrame:
    """The rows with the position of every id in its segment."""
    each = "flatten(transform(resets, (r, i) -> sequence(0, cu_seqlens[i + 1] - r - 1)))"
    return rows.withColumn("position_ids", F.expr(each))
