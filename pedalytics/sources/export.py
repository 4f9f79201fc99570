"""Write raw tables out as source files (CSV in the source encodings, XLSX workbooks).

Used to exercise the file ingest on data derived from the driver tables.
CSV files are written by Spark's CSV writer, one folder of part files per
source file; workbooks by one Python call per task (Spark has no writer for
them), as ``part-<partition>-<k>.xlsx``, so a retried task overwrites its own
output.  No file, group or table passes through the driver or a single task.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pedalytics import schemas as K
from pedalytics.sources import files, fs, xlsx

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("rows", T.LongType())])
WORKBOOK_ROWS = 100_000  # rows of one workbook; the format holds 1,048,576

# dataset -> (raw table, [(source header, raw column)], month column)
CSV_LAYOUT = {
    "signup_month": ("raw_signup_month", [
        ("가입년월", "signup_ym"), ("회원구분", "member_type_raw"), ("연령대", "age_band_raw"),
        ("성별", "gender_raw"), ("가입건수", "signup_cnt_raw")]),
    "ride_month": ("raw_ride_month", [
        ("대여일자", "ride_ym"), ("대여소번호", "station_id_raw"), ("대여소명", "station_name_raw"),
        ("대여구분코드", "pass_type_raw"), ("성별", "gender_raw"), ("연령대코드", "age_band_raw"),
        ("이용건수", "ride_cnt_raw"), ("운동량", "exercise_amt_raw"), ("탄소량", "carbon_amt_raw"),
        ("이동거리(M)", "distance_m_raw"), ("이용시간(분)", "duration_min_raw")]),
    "station_usage_month": ("raw_station_usage_month", [
        ("자치구", "district_raw"), ("대여소명", "station_name_raw"), ("기준년월", "usage_ym"),
        ("대여건수", "checkout_cnt_raw"), ("반납건수", "return_cnt_raw")]),
}
# the oldest ride files name the distance column differently (schema drift)
DRIFT_HEADER = "이용거리(M)"
DRIFT_BEFORE_YM = 202401
# the 2025 usage file is UTF-8 with a byte-order mark, every other file cp949
# (files are yearly, so both rules hold for whole files)
BOM_USAGE_YEAR = 2025


def _groups(dataset: str, ym: Column) -> list[tuple[Column, str, bool]]:
    """(rows, encoding, drifted header) of the files that are written alike."""
    if dataset == "station_usage_month":
        bom = (ym / 100).cast("int") == BOM_USAGE_YEAR
        return [(bom, "utf-8-sig", False), (~bom, "cp949", False)]
    if dataset == "ride_month":
        return [(ym < DRIFT_BEFORE_YM, "cp949", True), (ym >= DRIFT_BEFORE_YM, "cp949", False)]
    return [(F.lit(True), "cp949", False)]


def export_csv(raw: DataFrame, dataset: str, root: str, ordered: bool = False) -> None:
    """Write one raw table as the dataset's CSV files.

    ``ordered``: rows sorted by file and all columns over the whole table, so
    that a file's first part begins with its least rows.
    """
    spark = raw.sparkSession
    _, layout = CSV_LAYOUT[dataset]
    folder = f"{files.qualified(spark, root)}/{K.DATASET_FILES[dataset][0]}"
    ym = F.col({"signup_month": "signup_ym", "ride_month": "ride_ym", "station_usage_month": "usage_ym"}[dataset])
    for rows, encoding, drift in _groups(dataset, ym):
        headers = [DRIFT_HEADER if drift and h == "이동거리(M)" else h for h, _ in layout]
        if encoding == "utf-8-sig":
            headers[0] = "\ufeff" + headers[0]
        part = raw.filter(rows).select(F.col("source_file").alias("_file"), *[
            F.col(c).cast("string").alias(h) for h, (_, c) in zip(headers, layout, strict=True)])
        if ordered:
            part = part.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in part.columns])
        out = f"{folder}/_written-{uuid.uuid4().hex[:12]}"
        (part.write.partitionBy("_file").option("header", True).option("escape", '"')
         .option("encoding", files.SPARK_ENCODING[encoding])
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out))
        _publish(spark, out, folder)


def _publish(spark, out: str, folder: str) -> None:
    """Give each partition folder ``_file=NAME`` the name of its source file (metadata only)."""
    hadoop, path = files._hadoop(spark, out)
    for status in hadoop.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("_file="):
            target = files._hadoop(spark, f"{folder}/{name[len('_file='):]}")[1]
            if not hadoop.rename(status.getPath(), target):
                raise OSError(f"cannot place {target}")


def _xlsx_writer(folder: str):
    """Workbooks of up to WORKBOOK_ROWS rows per task and snapshot file (a workbook cannot be appended to)."""
    def write(it):
        rows: dict[str, list] = {}
        count: dict[str, int] = {}

        def flush(name):
            k = count[name] = count.get(name, -1) + 1
            path = f"{folder}/{name}/part-{TaskContext.get().partitionId():05d}-{k:03d}.xlsx"
            own = rows.pop(name)
            fs.write_bytes(path, xlsx.write_workbook(own))
            return pd.DataFrame([(path, len(own))], columns=["path", "rows"])

        for pdf in it:
            for name, g in pdf.groupby("_file", sort=False):
                for at in range(0, len(g), WORKBOOK_ROWS):
                    part = g[list(K.SNAPSHOT_POSITIONAL_COLUMNS)].iloc[at:at + WORKBOOK_ROWS]
                    rows.setdefault(name, []).extend(part.itertuples(index=False, name=None))
                    if len(rows[name]) >= WORKBOOK_ROWS:
                        yield flush(name)
        for name in list(rows):
            yield flush(name)
    return write


def export_xlsx(raw_snapshot: DataFrame, root: str) -> None:
    """Write the snapshot table as workbooks, one folder per snapshot file name."""
    folder = f"{files.qualified(raw_snapshot.sparkSession, root)}/{K.DATASET_FILES['station_snapshot'][0]}"
    src = raw_snapshot.select(F.col("source_file").alias("_file"),
                              *[F.col(c).cast("string") for c in K.SNAPSHOT_POSITIONAL_COLUMNS])
    src.mapInPandas(_xlsx_writer(folder), MANIFEST).agg(F.sum("rows")).collect()


DATASET_TABLES = {"signup_month": "raw_signup_month", "ride_month": "raw_ride_month",
                  "station_usage_month": "raw_station_usage_month",
                  "station_snapshot": "raw_station_snapshot"}


def export_dataset(raw: DataFrame, dataset: str, root: str, ordered: bool = False) -> None:
    if dataset == "station_snapshot":
        export_xlsx(raw, root)
    else:
        export_csv(raw, dataset, root, ordered)
