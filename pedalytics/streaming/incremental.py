"""Newly arrived source files -> raw table, as a Structured Streaming file source.

* The stream lists the dataset's folder (file names only; content is not
  read by the stream) and remembers processed files in its checkpoint, so
  every file is loaded once across runs.
* Each micro-batch runs the batch loader on its new files on the
  executors and writes them into the raw table under a partition of its
  own batch id.  A micro-batch that is retried after a failure overwrites
  that same partition (dynamic partition overwrite), so retries never
  duplicate rows.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pedalytics import schemas as K
from pedalytics.session import checkpoint_root, configure
from pedalytics.sources import loaders

# fixed schema of Spark's binaryFile source
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"

RAW_TABLE = {"signup_month": "raw_signup_month", "ride_month": "raw_ride_month",
             "station_usage_month": "raw_station_usage_month",
             "station_snapshot": "raw_station_snapshot"}
BATCH_COLUMN = "ingest_batch"
FILES_PER_BATCH = 1000  # file names that one micro-batch hands to the driver


def _matches(dataset: str, path: str) -> bool:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    parent = path.rstrip("/").rsplit("/", 2)[-2] if path.count("/") > 1 else ""
    pattern = K.DATASET_FILES[dataset][1]
    logical = parent if name.startswith("part-") else name
    return fnmatch.fnmatchcase(logical, pattern)


def _load(spark: SparkSession, dataset: str, paths: list[str], loaded_at: str | None) -> DataFrame:
    if dataset == "station_snapshot":
        return loaders.load_raw_station_snapshot(spark, None, loaded_at, paths=paths)
    return loaders.load_csv_files(spark, paths, dataset, loaded_at)


def ingest_new_files(spark: SparkSession, source_root: str, dataset: str, table_root: str,
                     checkpoint: str | None = None, loaded_at: str | None = None,
                     available_now: bool = True) -> StreamingQuery:
    """Start the incremental load of one dataset; returns the running query."""
    configure(spark)
    folder = f"{source_root.rstrip('/')}/{K.DATASET_FILES[dataset][0]}"
    ext = "*.xlsx" if dataset == "station_snapshot" else "*.csv"
    table = RAW_TABLE[dataset]
    target = f"{table_root.rstrip('/')}/{table}"
    month = K.MONTH_COLUMN[table]
    ckpt = checkpoint or f"{checkpoint_root(spark)}/stream-{table}"
    listing = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
               .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", FILES_PER_BATCH)
               .option("pathGlobFilter", ext).load(folder).select("path"))

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        # the new file names of this batch (metadata only, at most FILES_PER_BATCH)
        paths = sorted(r["path"] for r in batch.collect() if _matches(dataset, r["path"]))
        if not paths:
            return
        rows = _load(batch.sparkSession, dataset, paths, loaded_at)
        (rows.withColumn(BATCH_COLUMN, F.lit(batch_id).cast("long")).hint("rebalance", month).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BATCH_COLUMN, month).parquet(target))

    writer = listing.writeStream.foreachBatch(load_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_ingested(spark: SparkSession, table_root: str, dataset: str) -> DataFrame:
    """The raw table written by the incremental load, without the batch column."""
    table = RAW_TABLE[dataset]
    return spark.read.parquet(f"{table_root.rstrip('/')}/{table}").drop(BATCH_COLUMN)
