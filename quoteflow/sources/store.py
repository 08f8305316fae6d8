"""The table of stored ticks, and the ledger that says which batches count.

Files are laid out by event day, so queries by time read only the days they need, and below that by
batch and attempt. A write adds the files of a new attempt and then one row to the ledger; readers see a
batch's rows only if its latest ledger row says so. A batch is therefore there as a whole or not at all,
over all its days, and writing it again, or giving it up, is one row more.

So is compaction: the batches of closed days are written once more, as one batch of few files in order of time, whose
ledger row replaces them all. What no longer holds is removed later, when no reader can still be at it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.config import SinkOptions
from quoteflow.schemas import STORE, STORE_COLUMNS, STORE_LAYOUT, STORE_PARTITIONS

# A sink takes a batch and its id, and raises if the batch is not stored as a whole.
Sink = Callable[[DataFrame, int], None]

STORED, DROPPED = "stored", "dropped"

LEDGER_ROWS = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("replaces", T.ArrayType(T.LongType())),
        T.StructField("at", T.LongType()),
        T.StructField("number", T.LongType()),
    ]
)

# Compacted batches count from here, beyond the ids of micro-batches and of batch runs.
FIRST_COMPACTED = 1 << 50

_numbers: dict[str, int] = {}  # the last number this process gave out in each ledger


class StoreMissing(RuntimeError):
    """The store was never created; it is not created on the way of a write."""


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, without listing what is in it."""
    files, where = _files(spark, path)
    return files.exists(where)


def move_path(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file or folder; the folder it goes to is made if it isn't there."""
    files, where = _files(spark, new)
    files.mkdirs(where.getParent())
    if not files.rename(_files(spark, old)[1], where):
        raise OSError(f"cannot move {old} to {new}")


def new_attempt() -> str:
    return uuid.uuid4().hex


def _remove_older(spark: SparkSession, paths: Sequence[str], retention: timedelta) -> int:
    """Remove files and folders that were last written longer ago than the retention; how many were."""
    gone, now = 0, time.time() * 1000
    for path in paths:
        files, where = _files(spark, path)
        if files.exists(where) and files.getFileStatus(where).getModificationTime() <= now - retention.total_seconds() * 1000:
            gone += files.delete(where, True)
    return gone


@dataclass(frozen=True)
class Ledger:
    """One row for every time a batch was stored or given up; the one with the highest number holds.

    Numbers count up from what the ledger has, whatever the clock says. A batch id has one writer at a time.
    """

    path: str

    def settle(self, spark: SparkSession, batch_id: int, attempt: str, status: str, replaces: Sequence[int] = ()) -> None:
        """Add one row, which is one file, so it is there or it is not."""
        if self.path not in _numbers:
            _numbers[self.path] = self.rows(spark).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
        _numbers[self.path] += 1
        row = (batch_id, attempt, status, list(replaces), time.time_ns(), _numbers[self.path])
        spark.createDataFrame([row], LEDGER_ROWS).coalesce(1).write.mode("append").parquet(self.path)

    def fold(self, spark: SparkSession, retention: timedelta) -> None:
        """Put the rows that hold into one more file and remove files from before the retention.

        In between some rows are there twice, which says nothing new.
        """
        if not path_exists(spark, self.path):
            return
        rows = self.rows(spark)
        before = rows.inputFiles()
        _latest(rows).coalesce(1).write.mode("append").parquet(self.path)
        _remove_older(spark, before, retention)

    def rows(self, spark: SparkSession) -> DataFrame:
        if not path_exists(spark, self.path):
            return spark.createDataFrame([], LEDGER_ROWS)
        return spark.read.schema(LEDGER_ROWS).parquet(self.path)

    def current(self, spark: SparkSession) -> DataFrame:
        """batch_id, attempt, status and replaces as they stand, without batches that another one replaced."""
        latest = _latest(self.rows(spark)).select("batch_id", "attempt", "status", "replaces")
        gone = latest.filter(F.col("status") == STORED).select(F.explode("replaces").alias("batch_id"))
        return latest.join(gone, "batch_id", "left_anti")

    def visible(self, df: DataFrame, status: str) -> DataFrame:
        """The rows, with batch_id and attempt, of attempts that hold with that status."""
        spark = df.sparkSession
        holding = self.current(spark).filter(F.col("status") == status).select("batch_id", "attempt")
        return df.join(holding, ["batch_id", "attempt"], "left_semi")

    def replaced(self, spark: SparkSession, batch_id: int) -> bool:
        named = F.array_contains("replaces", F.lit(batch_id).cast("bigint"))
        return not self.rows(spark).filter((F.col("status") == STORED) & named).isEmpty()


def _latest(rows: DataFrame) -> DataFrame:
    """Of each batch the row that holds."""
    last = F.max_by(F.struct(*LEDGER_ROWS.fieldNames()), "number").alias("x")
    return rows.groupBy(F.col("batch_id").alias("of")).agg(last).select("x.*")


@dataclass(frozen=True)
class TickStore:
    path: str

    @property
    def ledger(self) -> Ledger:
        return Ledger(f"{self.path}_ledger")

    def create(self, spark: SparkSession) -> TickStore:
        """Lay down an empty table unless there is one already."""
        if not self.exists(spark):
            spark.createDataFrame([], STORE).write.parquet(self.path)
        return self

    def exists(self, spark: SparkSession) -> bool:
        return path_exists(spark, self.path)

    def truncate(self, spark: SparkSession) -> None:
        """Remove every row and keep the table."""
        self._require(spark)
        spark.createDataFrame([], LEDGER_ROWS).write.mode("overwrite").parquet(self.ledger.path)
        spark.createDataFrame([], STORE).write.mode("overwrite").parquet(self.path)

    def scan(self, spark: SparkSession) -> DataFrame:
        """All rows, five columns, with the partition columns at hand for pruning."""
        self._require(spark)
        return self.ledger.visible(spark.read.schema(STORE_LAYOUT).parquet(self.path), STORED)

    def rows(self, spark: SparkSession) -> DataFrame:
        return self.scan(spark).select(STORE_COLUMNS)

    def write(
        self, batch: DataFrame, batch_id: int, *, files_per_batch: int | None = None,
        max_records_per_file: int | None = None, replaces: Sequence[int] = (),
    ) -> None:
        """Write a batch in place of what it was before, and of the batches it ``replaces``."""
        spark, attempt = batch.sparkSession, new_attempt()
        self._require(spark)
        rows = batch.select(
            *STORE_COLUMNS,
            F.to_date("ts").alias("event_date"),
            F.lit(batch_id).cast("bigint").alias("batch_id"),
            F.lit(attempt).alias("attempt"),
        )
        if files_per_batch is not None:
            rows = rows.coalesce(files_per_batch)
        writer = rows.write.mode("append")
        if max_records_per_file is not None:
            writer = writer.option("maxRecordsPerFile", max_records_per_file)
        writer.partitionBy(*STORE_PARTITIONS).parquet(self.path)
        self.ledger.settle(spark, batch_id, attempt, STORED, replaces)

    def compact(self, spark: SparkSession, before: date, rows_per_file: int = 1_000_000) -> int:
        """Write all batches that end before a day as one, in files of about ``rows_per_file`` ordered by time.

        Gives the number of batches that were merged. The days must be closed: a batch that is still to be written
        again would be counted out by ``Ledger.replaced``. Files of one time lie together, so that reads by time
        skip the others by their least and greatest.
        """
        rows = self.scan(spark)
        ends = rows.groupBy("batch_id").agg(F.max("event_date").alias("last"), F.count(F.lit(1)).alias("n"))
        ids = ends.filter(F.col("last") < F.lit(before)).select("batch_id", "n").collect()  # one row for each batch since the last time
        if len(ids) < 2:
            return 0
        merged, total = [r["batch_id"] for r in ids], sum(r["n"] for r in ids)
        number = max([FIRST_COMPACTED - 1, *merged]) + 1
        chosen = spark.createDataFrame([(i,) for i in merged], "batch_id long")
        place = ["event_date", "ts", "source", "ticker"]
        ordered = rows.join(F.broadcast(chosen), "batch_id", "left_semi").select(*STORE_COLUMNS, "event_date")
        ordered = ordered.repartitionByRange(-(-total // rows_per_file), *place).sortWithinPartitions(*place)
        before_them = self.ledger.current(spark).filter(F.col("batch_id").isin(merged)).select(F.explode("replaces")).collect()
        self.write(ordered, number, replaces=sorted({*merged, *(r[0] for r in before_them)}))
        return len(merged)

    def vacuum(self, spark: SparkSession, retention: timedelta = timedelta(days=1)) -> int:
        """Remove the files of attempts that do not hold and were written before the retention, and fold the ledger.

        The retention must outlast every write that is under way and every reader that has begun. Gives the number
        of folders removed.
        """
        self._require(spark)
        there = spark.read.schema(STORE_LAYOUT).parquet(self.path).select(*STORE_PARTITIONS).distinct()
        holding = self.ledger.current(spark).filter(F.col("status") == STORED).select("batch_id", "attempt")
        dead = there.join(holding, ["batch_id", "attempt"], "left_anti").collect()  # folders, one for each day and attempt
        folders = [f"{self.path}/event_date={r.event_date}/batch_id={r.batch_id}/attempt={r.attempt}" for r in dead]
        gone = _remove_older(spark, folders, retention)
        self.ledger.fold(spark, retention)
        return gone

    def sink(self, files_per_batch: int | None = None, max_records_per_file: int | None = None) -> Sink:
        """``write`` as a sink. ``files_per_batch`` bounds a batch's files per day without a shuffle."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.write(batch, batch_id, files_per_batch=files_per_batch, max_records_per_file=max_records_per_file)

        return write

    def ddl(self, table: str) -> str:
        """SQL that puts the store's files into a catalog, for engines that plan against one.

        Which batches hold is in the ledger; join it on batch_id and attempt.
        """
        columns = ",\n  ".join(
            f"{f.name} {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL")
            for f in STORE_LAYOUT.fields
        )
        return (
            f"CREATE TABLE IF NOT EXISTS {table} (\n  {columns}\n)\n"
            f"USING parquet PARTITIONED BY ({', '.join(STORE_PARTITIONS)})\nLOCATION '{self.path}'"
        )

    def _require(self, spark: SparkSession) -> None:
        if not self.exists(spark):
            raise StoreMissing(f"no tick table at {self.path}; create it first")


def jdbc_sink(url: str, table: str = "ticks", batch_size: int = SinkOptions.batch_size, **properties: str) -> Sink:
    """Append to a database table. The table must exist.

    Rows are committed per Spark partition and not per batch, so a batch that is retried after a
    partial failure can leave copies; the file store does not have that weakness.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.select(STORE_COLUMNS)
            .write.mode("append")
            .option("batchsize", batch_size)
            .jdbc(url, table, properties=properties)
        )

    return write


def read_jdbc(spark: SparkSession, url: str, table: str = "ticks", **properties: str) -> DataFrame:
    return spark.read.jdbc(url, table, properties=properties).select(STORE_COLUMNS)
