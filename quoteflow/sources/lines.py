"""Lines of text files with the place of each: the byte where it begins.

Spark's own file source lists the files, as a table or as a stream, and gives names and lengths only. Long files are cut
into ranges of bytes; a line belongs to the range that it begins in, so where the cuts are makes no difference. Files
must be reachable by name from the executors, as on a shared file system, or by an address that Arrow's file
systems know (``hdfs``, ``s3``, ``gs``).

Lines end with LF, CR LF or CR, the last one also with the file. A byte order mark at the start of a file is left out.
Bytes that are not UTF-8 become replacement characters. Compressed files are not cut; places count their text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules["quoteflow"])  # executors need no installation

#: Bytes of a range, and of what is read from a file at once.
RANGE, CHUNK = 64 << 20, 1 << 20
_FILES = "path string, modificationTime timestamp, length long, content binary"
_LINES = "path string, modified timestamp, place long, raw string"
_PACKED = "[.](gz|bz2|zst|lz4)$"
_BREAK = re.compile(rb"\r\n|\n|\r")
_MARK = b"\xef\xbb\xbf"


def lines(file: BinaryIO, begin: int, end: int | None, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin at ``begin`` or later and before ``end``; the file stands where it is told to.

    With ``begin`` above 0 the file must stand one byte before it, as that byte says whether a line begins there.
    """
    at = max(0, begin - 1)  # the place of the first byte held
    start = 0 if not begin else None
    held, seen = b"", 0
    while True:
        more = file.read(max(chunk, len(held)))  # a long line is read in steps that grow with it
        held += more
        for found in _BREAK.finditer(held, seen):
            if found.end() == len(held) and found.group() == b"\r" and more:
                break  # the next byte says whether the break goes on
            if start is not None:
                yield start, _unmarked(held[start - at : found.start()], start)
            start = at + found.end()
            if end is not None and start >= end:
                return
        if not more:
            if start is not None and start < at + len(held):
                yield start, _unmarked(held[start - at :], start)
            return
        keep = len(held) - 1 if start is None else start - at
        keep = min(keep, len(held))
        held, at = held[keep:], at + keep
        seen = max(0, len(held) - 1)


def _unmarked(line: bytes, place: int) -> bytes:
    return line.removeprefix(_MARK) if not place else line


def _opened(path: str, begin: int) -> pa.NativeFile:
    if re.match("file:/|/", path):
        system, name = pa.fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    else:
        system, name = pa.fs.FileSystem.from_uri(path)
    if re.search(_PACKED, name):
        return system.open_input_stream(name, compression="detect")
    file = system.open_input_file(name)
    file.seek(max(0, begin - 1))
    return file


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(path: str, modified: pa.Scalar, places: list, texts: list) -> pa.RecordBatch:
        count = len(places)
        columns = [pa.repeat(pa.scalar(path), count), pa.repeat(modified, count), pa.array(places, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], ["path", "modified", "place", "raw"])

    for batch in batches:
        rows = zip(*[batch.column(c) for c in ("path", "modified", "begin", "end")], strict=True)
        for path, modified, begin, end in rows:
            places, texts, size = [], [], 0
            with _opened(path.as_py(), begin.as_py()) as file:
                for place, line in lines(file, begin.as_py(), end.as_py()):
                    places.append(place)
                    texts.append(line.decode("utf-8", "replace"))
                    size += len(line) + 16
                    if size >= CHUNK:
                        yield made(path.as_py(), modified, places, texts)
                        places, texts, size = [], [], 0
            if places:
                yield made(path.as_py(), modified, places, texts)


def text_lines(
    spark: SparkSession, path: str, stream: bool = False, max_files_per_trigger: int | None = None, cut: int = RANGE
) -> DataFrame:
    """path, modified, place and raw of every line. An empty file has none."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").schema(_FILES)
    if stream and max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length").filter("length > 0")
    begin = F.when(F.col("path").rlike(_PACKED), F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(cut).cast("long"))
    )
    ranges = files.select("path", "modified", F.explode(begin).alias("begin"))
    end = F.when(~F.col("path").rlike(_PACKED), F.col("begin") + cut)
    ranges = ranges.withColumn("end", end).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.mapInArrow(_read, _LINES)
