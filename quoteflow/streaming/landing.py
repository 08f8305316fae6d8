"""Landing: the normalized frames of a micro-batch as one folder that is there as a whole or not at all.

A batch is written aside and moved into place by one rename, so a batch that is replayed finds its folder and
does nothing. Neither side keeps a log that grows with every file: the table is what its folders hold, and the
query that reads it on is Spark's own file source, which forgets files by age and can archive what it has taken.

While a batch is written Spark observes its newest arrival and what became of its frames. That goes into a journal of one
row for each batch, and the newest arrival of all batches before, ``heard``, is written beside every row: how far
behind the stream a tick arrived is then known wherever it goes. The rename has to be atomic, as it is on a
distributed or local file system; the batches of one folder belong to one checkpoint.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.schemas import CLASSIFIED, STATUS_IGNORED, STATUS_PARSE_ERROR, STATUS_TICK, TICKS
from quoteflow.sources.store import move_path, path_exists

LANDED = T.StructType([*CLASSIFIED.fields, T.StructField("heard", T.TimestampType())])
JOURNAL = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("newest", T.TimestampType()),
        T.StructField("ticks", T.LongType()),
        T.StructField("parse_errors", T.LongType()),
        T.StructField("ignored", T.LongType()),
        T.StructField("at", T.TimestampType()),  # by the driver's clock
    ]
)


class Lander:
    """A ``foreachBatch`` function that lands classified frames in files of at most ``rows_per_file`` rows."""

    def __init__(self, path: str, journal: str, rows_per_file: int | None = None) -> None:
        self.path, self.journal, self.rows_per_file = path, journal, rows_per_file
        self.heard: datetime | None = None
        self.known = -1  # the batch up to which ``heard`` is known

    def __call__(self, classified: DataFrame, batch_id: int) -> None:
        spark, place = classified.sparkSession, f"batch_id={batch_id}"
        if path_exists(spark, f"{self.path}/{place}"):
            return  # landed before; what was recorded of it is in the journal
        if self.known != batch_id - 1:
            row = read_journal(spark, self.journal).filter(F.col("batch_id") < batch_id).agg(F.max("newest")).first()
            self.heard = row[0]
        seen = Observation()
        status = F.col("status")
        rows = classified.withColumn("heard", F.lit(self.heard).cast("timestamp")).observe(
            seen,
            F.max("arrival_ts").alias("newest"),
            F.count_if(status == STATUS_TICK).alias("ticks"),
            F.count_if(status == STATUS_PARSE_ERROR).alias("parse_errors"),
            F.count_if(status == STATUS_IGNORED).alias("ignored"),
        )
        writer = rows.write.mode("overwrite")
        if self.rows_per_file is not None:
            writer = writer.option("maxRecordsPerFile", self.rows_per_file)
        aside = f"{self.path}/_aside/{place}"
        writer.partitionBy("status").parquet(aside)
        got = seen.get
        row = (batch_id, got["newest"], got["ticks"], got["parse_errors"], got["ignored"], datetime.now(UTC))
        spark.createDataFrame([row], JOURNAL).coalesce(1).write.mode("append").parquet(self.journal)
        move_path(spark, aside, f"{self.path}/{place}")
        self.known = batch_id
        self.heard = max(filter(None, [self.heard, got["newest"]]), default=None)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """What was observed of each batch; of one that was written again, the last time."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], JOURNAL)
    last = F.max_by(F.struct(*JOURNAL.fieldNames()), "at").alias("x")
    return spark.read.schema(JOURNAL).parquet(path).groupBy(F.col("batch_id").alias("of")).agg(last).select("x.*")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Every frame that landed, as a table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], LANDED)
    return spark.read.schema(LANDED).parquet(path).select(LANDED.fieldNames())


def stream_landed(spark: SparkSession, path: str, max_files: int | None = None, **options: str) -> DataFrame:
    """Landed ticks as a stream, with ``heard``. Only ticks' files are listed and read.

    ``options`` are those of the file source, such as ``maxFileAge``, or ``cleanSource`` and ``sourceArchiveDir``.
    """
    reader = spark.readStream.schema(LANDED).option("basePath", path).options(**options)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    ticks = reader.parquet(f"{path}/batch_id=*/status={STATUS_TICK}")
    return ticks.select(*TICKS.fieldNames(), "heard")
