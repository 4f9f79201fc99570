"""Source files -> raw tables.

Text columns are stripped and every missing value becomes the text
``'nan'`` (what the original loader stored); count and month columns are
parsed leniently to nullable integers.  ``loaded_at`` is the load time
unless a fixed value is given (tests).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalytics import schemas as K
from pedalytics.functions import columns as C
from pedalytics.session import scratch_dir
from pedalytics.sources import files, landing, xlsx

SKIP_ROWS = K.SNAPSHOT_SKIP_ROWS


def _loaded_at(loaded_at: str | None) -> Column:
    return F.lit(loaded_at) if loaded_at is not None else C.now_text()


def _normalise(df: DataFrame, schema, loaded_at: str | None) -> DataFrame:
    out = []
    for f in schema.fields:
        if f.name == "source_file":
            out.append(F.col("_source_file").alias("source_file"))
        elif f.name == "loaded_at":
            out.append(_loaded_at(loaded_at).alias("loaded_at"))
        elif f.name in K.INT_RAW_COLUMNS or f.name == "snapshot_ym":
            out.append(C.to_int_coerce(f.name).try_cast(f.dataType).alias(f.name))
        else:
            out.append(C.null_tokens(f.name).alias(f.name))
    return df.select(*out)


CSV_DATASETS = {
    "signup_month": (K.SIGNUP_SOURCE_COLUMNS, K.RAW_SIGNUP),
    "ride_month": (K.RIDE_SOURCE_COLUMNS, K.RAW_RIDE),
    "station_usage_month": (K.USAGE_SOURCE_COLUMNS, K.RAW_USAGE),
}


def load_csv_files(spark: SparkSession, paths: list[str], dataset: str,
                   loaded_at: str | None = None) -> DataFrame:
    """Given CSV files (or part folders) of one dataset -> its raw table."""
    mapping, schema = CSV_DATASETS[dataset]
    return _normalise(files.read_dataset_csv(spark, paths, mapping), schema, loaded_at)


def load_landed(spark: SparkSession, root: str, dataset: str, entries: list[dict], loaded_at: str | None = None) -> DataFrame:
    """Landed files of one dataset -> its raw table; the source files are not read again."""
    rows = landing.landed(spark, root, dataset, [e for e in entries if e["dataset"] == dataset])
    return _normalise(files.stop_on_problem(rows), CSV_DATASETS[dataset][1], loaded_at)


def load_csv_dataset(spark: SparkSession, root: str, dataset: str, loaded_at: str | None = None) -> DataFrame:
    return load_csv_files(spark, files.find_files(spark, root, dataset), dataset, loaded_at)


def load_raw_signup_month(spark, root, loaded_at=None) -> DataFrame:
    """S16."""
    return load_csv_dataset(spark, root, "signup_month", loaded_at)


def load_raw_ride_month(spark, root, loaded_at=None) -> DataFrame:
    """S17 (with the schema-drift resolver for the distance column)."""
    return load_csv_dataset(spark, root, "ride_month", loaded_at)


def load_raw_station_usage_month(spark, root, loaded_at=None) -> DataFrame:
    """S19."""
    return load_csv_dataset(spark, root, "station_usage_month", loaded_at)


def workbook_rows(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """Sheet rows of every snapshot workbook, with the logical file name and snapshot month."""
    if paths is None:
        paths = files.find_files(spark, root, "station_snapshot")
    if not paths:
        return spark.createDataFrame([], xlsx.SHEET_ROWS).select(
            "*", F.lit(None).cast("string").alias("file_name"),
            F.lit(None).cast("int").alias("snapshot_ym"))
    wb = spark.read.format("binaryFile").load(paths)
    rows = xlsx.sheet_rows(wb)
    name = files.logical_file_name(F.col("path"))
    return rows.select("*", name.alias("file_name"),
                       C.snapshot_ym_from_name(name).alias("snapshot_ym"))


def positional(rows: DataFrame) -> DataFrame:
    """Data rows (after the skipped rows) as the 10 positional snapshot columns."""
    cols = [F.try_element_at("cells", F.lit(i + 1)).alias(c)
            for i, c in enumerate(K.SNAPSHOT_POSITIONAL_COLUMNS)]
    return rows.filter(F.col("row_idx") >= SKIP_ROWS).select("snapshot_ym", "file_name", "dates", *cols)


MIDNIGHT = " 00:00:00"


def date_columns(data: DataFrame) -> DataFrame:
    """Per file and positional column 0 (cells as they stand), 1 (a column of moments) or 2 (of dates).

    A column whose cells are all dates is one of moments, shown as dates where
    the kept rows hold midnight only; in any other column a date cell is a
    moment among texts and numbers.
    """
    told = []
    for i, c in enumerate(K.SNAPSHOT_POSITIONAL_COLUMNS):
        dated = F.array_contains("dates", F.lit(i))
        timed = dated & C.is_numeric_text("station_id_raw") & ~F.endswith(F.col(c), F.lit(MIDNIGHT))
        whole = (F.count(c) > 0) & (F.count(c) == F.count(F.when(dated, 1)))
        told.append(F.when(~whole, 0).when(F.count(F.when(timed, 1)) > 0, 1).otherwise(2).alias(f"_{c}"))
    return data.groupBy("file_name").agg(*told)


def load_raw_station_snapshot(spark: SparkSession, root: str | None, loaded_at: str | None = None,
                              paths: list[str] | None = None) -> DataFrame:
    """Positional read -> drop empty rows -> keep numeric ids -> text normalisation.

    The parsed rows are stored, since how a column shows its dates depends on
    all its cells; the workbooks are read once.
    """
    rows = workbook_rows(spark, root, paths).withColumn("_problem", F.col("error")) \
        .withColumn("_source_file", F.col("file_name"))
    data = positional(files.stop_on_problem(rows)).na.drop("all", subset=list(K.SNAPSHOT_POSITIONAL_COLUMNS))
    path = scratch_dir(spark, "sheet-rows")
    data.write.parquet(path)
    data = spark.read.schema(data.schema).parquet(path)
    data = data.join(F.broadcast(date_columns(data)), "file_name").filter(C.is_numeric_text("station_id_raw"))
    out = [F.col("snapshot_ym").cast("int").alias("snapshot_ym"),
           F.col("file_name").alias("source_file")]
    for c in K.SNAPSHOT_POSITIONAL_COLUMNS:
        shown = F.when(F.col(f"_{c}") == 2, F.substring(c, 1, 10)).otherwise(F.col(c))
        out.append(F.when((F.col(f"_{c}") > 0) & F.col(c).isNull(), "NaT").otherwise(C.null_tokens(shown)).alias(c))
    out.append(_loaded_at(loaded_at).alias("loaded_at"))
    return data.select(*out)


def load_raw_tables(spark: SparkSession, root: str, loaded_at: str | None = None) -> dict[str, DataFrame]:
    return {
        "raw_signup_month": load_raw_signup_month(spark, root, loaded_at),
        "raw_ride_month": load_raw_ride_month(spark, root, loaded_at),
        "raw_station_snapshot": load_raw_station_snapshot(spark, root, loaded_at),
        "raw_station_usage_month": load_raw_station_usage_month(spark, root, loaded_at),
    }
