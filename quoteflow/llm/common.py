"""What the operators of this subpackage share: tables, scratch space and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts are worked on in slices of about so many bytes, which bounds what a Python worker holds.
SLICE_BYTES = 1 << 20
#: Rows that Spark hands to a Python worker at once while ``cut`` writes, at most.
ROWS_AT_ONCE = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_sent: set[str] = set()
_lock, _before = threading.Lock(), {"writers": 0, "rows": None}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(df: DataFrame) -> DataFrame:
    """The same table, after this package has been handed to the application's executors, once for each application.

    What runs in tasks, and what is broadcast to them, refers to modules of the package; executors need not have it.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId not in _sent:
        package = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(path))  # the driver serves it to executors, it is not looked for in their folders
        _sent.add(context.applicationId)
    return df


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder that every executor reaches: below ``spark.checkpoint.dir``.

    Only where that is unset and everything runs in one local process, a temporary folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/llm-{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to shared scratch space and read it back.

    The plan is cut there, and the files outlive the executors that wrote them.
    """
    path = scratch(df.sparkSession, purpose)
    with _small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to Python workers in batches of a few megabytes; afterwards the session is as it was."""
    with _lock:
        if not _before["writers"]:
            _before["rows"] = spark.conf.getAll.get(_ROWS)
            now = int(spark.conf.get(_ROWS))
            spark.conf.set(_ROWS, str(min(now, ROWS_AT_ONCE) if now > 0 else ROWS_AT_ONCE))
        _before["writers"] += 1
    try:
        yield
    finally:
        with _lock:
            _before["writers"] -= 1
            if not _before["writers"]:
                if _before["rows"] is None:
                    spark.conf.unset(_ROWS)
                else:
                    spark.conf.set(_ROWS, _before["rows"])


def pieces(amount: float, each: float, least: int = 1) -> int:
    """How many parts of a size make an amount."""
    return max(least, math.ceil(amount / each))


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        ends = _offsets(column)
        begin, n = 0, batch.num_rows
        while begin < n:
            end = int(np.searchsorted(ends, ends[begin] + most, side="right")) - 1
            end = min(n, max(begin + 1, end))
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def give_back() -> None:
    """Return free memory of this process to the system: a Python worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()[1]
    if raw is None:
        return np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(raw, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one array of UTF-8 bytes, and where each begins and the last ends.

    A null text counts as an empty one.
    """
    if column.null_count:
        column = column.fill_null("")
    ends = _offsets(column)
    data = column.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(ends[-1] - ends[0]), int(ends[0])), ends - ends[0]
