"""Landing of CSV files: each file is parsed once and stored with what is wrong with its rows.

A run of the landing writes the rows of all new or changed files in one pass,
canonical columns as text, with ``_problem`` for rows that are not what the
file holds.  The file check is one aggregate over what was written, kept per
file in the manifest, so files that did not change are neither read nor
counted again.  Only files whose split scan met broken rows are looked at once
more: where a quoted field runs over a line break they are read part by part.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalytics import schemas as K
from pedalytics.operators.staging import literal_rows
from pedalytics.sources import files

MANIFEST = {"dataset": "string", "file_name": "string", "path": "string", "mark": "string", "run": "string",
            "encoding": "string", "columns": "string", "error": "string", "row_count": "bigint", "bad": "bigint",
            "problem": "string", "period_min": "bigint", "period_max": "bigint", "doubts": "string"}
MAPPINGS = {"signup_month": K.SIGNUP_SOURCE_COLUMNS, "ride_month": K.RIDE_SOURCE_COLUMNS,
            "station_usage_month": K.USAGE_SOURCE_COLUMNS}


def manifest_path(root: str) -> str:
    return f"{root.rstrip('/')}/landed_files"


def rows_path(root: str, dataset: str) -> str:
    return f"{root.rstrip('/')}/landed_{dataset}"


def file_mark(spark: SparkSession, path: str) -> str:
    """Changes with the content of a logical file: number, bytes and latest time of its parts (metadata only)."""
    fs, p = files._hadoop(spark, path)
    parts = fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)]
    seen = [(s.getLen(), s.getModificationTime()) for s in parts if not s.getPath().getName().startswith(("_", "."))]
    return f"{len(seen)}:{sum(n for n, _ in seen)}:{max((t for _, t in seen), default=0)}"


def manifest(spark: SparkSession, root: str) -> list[dict]:
    """One entry per landed logical file (as many as there are source files)."""
    if not files.exists(spark, f"{manifest_path(root)}/_SUCCESS"):
        return []
    return [r.asDict() for r in spark.read.parquet(manifest_path(root)).collect()]


def period(column: Column) -> Column:
    """The number in a period cell (NULL where it is none)."""
    v = F.trim(column).try_cast("double")
    return F.when(~F.isnan(v), v)


def period_stats(period_column: str = "_period") -> list[Column]:
    """The mergeable check of a file's rows: counts add up, ends of the period are least and greatest."""
    return [F.count(F.lit(1)).alias("row_count"), F.count("_problem").alias("bad"), F.max("_problem").alias("problem"),
            F.min(period_column).try_cast("bigint").alias("period_min"),
            F.max(period_column).try_cast("bigint").alias("period_max")]


def _write(spark: SparkSession, root: str, dataset: str, found: list[files.SourceFile], run: str) -> dict[tuple, str]:
    """Parse and store the given files under ``run``; doubts about the columns of each (encoding, header, kind)."""
    frames, doubts = [], {}
    for group in files.csv_groups(found):
        header = group[0].header
        at = f"c{header.index(K.PERIOD_COLUMNS[dataset])}" if K.PERIOD_COLUMNS[dataset] in header else None
        scan = files.read_csv_group(spark, group).withColumn("_period", period(F.col(at)) if at else F.lit(None).cast("double"))
        rows, unsure = files.canonical(scan, header, MAPPINGS[dataset])
        frames.append(rows)
        doubts |= {f.name: json.dumps(unsure, ensure_ascii=False) if unsure else None for f in group}
    if frames:
        reduce(lambda a, b: a.unionByName(b), frames).hint("rebalance", "_source_file").withColumn("_run", F.lit(run)) \
            .write.mode("append").partitionBy("_run", "_source_file").parquet(rows_path(root, dataset))
    return doubts


def landed(spark: SparkSession, root: str, dataset: str, entries: list[dict]) -> DataFrame:
    """Stored rows of the given manifest entries; whole folders of other files and earlier runs are skipped."""
    columns = ", ".join(f"`{c}` string" for c in MAPPINGS[dataset])
    schema = f"{columns}, _problem string, _period double, _run string, _source_file string"
    if not files.exists(spark, rows_path(root, dataset)):
        return spark.createDataFrame([], schema)
    chosen = F.lit(False)
    for run in sorted({e["run"] for e in entries if e["run"]}):
        names = [e["file_name"] for e in entries if e["run"] == run]
        chosen = chosen | ((F.col("_run") == run) & F.col("_source_file").isin(names))
    return spark.read.schema(schema).parquet(rows_path(root, dataset)).filter(chosen)


def _check(spark: SparkSession, root: str, dataset: str, entries: list[dict]) -> None:
    """Fill the counts of the given entries from their stored rows, by one aggregate."""
    counts = {r["_source_file"]: r.asDict() for r in landed(spark, root, dataset, entries).groupBy("_source_file").agg(
        *period_stats()).collect()}
    for e in entries:
        own = counts.get(e["file_name"], {"row_count": 0, "bad": 0, "problem": None, "period_min": None, "period_max": None})
        e.update({k: v for k, v in own.items() if k in MANIFEST})


def land(spark: SparkSession, source_root: str, root: str) -> list[dict]:
    """Land all new or changed CSV files below ``source_root`` and return the manifest of all that are there now.

    A file keeps its entry as long as its name, bytes and times stay; a file
    that is gone leaves the manifest (its stored rows are no longer read).
    """
    known = {(e["dataset"], e["file_name"]): e for e in manifest(spark, root)}
    entries, fresh = [], []
    for dataset in K.PERIOD_COLUMNS:
        for path in files.find_files(spark, source_root, dataset):
            entry = {c: None for c in MANIFEST} | {"dataset": dataset, "file_name": files.leaf_name(path), "path": path,
                                                   "mark": file_mark(spark, path)}
            old = known.get((dataset, entry["file_name"]))
            entries.append(old if old and old["mark"] == entry["mark"] and old["path"] == path else entry)
            if entries[-1] is entry:
                fresh.append(entry)
    if fresh:
        run = f"r{uuid.uuid4().hex[:12]}"
        looked_at = files.mark_open_quotes(spark, files.detect_all(spark, [e["path"] for e in fresh]))
        found = dict(zip((e["path"] for e in fresh), looked_at, strict=True))
        for dataset in K.PERIOD_COLUMNS:
            own = [e for e in fresh if e["dataset"] == dataset]
            _land_dataset(spark, root, dataset, own, [found[e["path"]] for e in own], run)
    literal_rows(spark, [tuple(e[c] for c in MANIFEST) for e in entries], list(MANIFEST), list(MANIFEST.values())) \
        .coalesce(1).write.mode("overwrite").parquet(manifest_path(root))
    return entries


def _land_dataset(spark: SparkSession, root: str, dataset: str, own: list[dict], found: list[files.SourceFile], run: str) -> None:
    doubts = _write(spark, root, dataset, found, run)
    for e, f in zip(own, found, strict=True):
        e.update(encoding=f.encoding, error=f.error, columns=", ".join(f.header) if f.encoding else None,
                 run=None if f.error else run, doubts=doubts.get(f.name))
    _check(spark, root, dataset, [e for e in own if e["run"]])


def rejected_rows(spark: SparkSession, root: str, entries: list[dict]) -> DataFrame:
    """Stored rows that are not what their file holds: dataset, file, problem and the row's cells as JSON."""
    frames = [landed(spark, root, ds, [e for e in entries if e["dataset"] == ds and e["bad"]]).filter("_problem IS NOT NULL")
              .select(F.lit(ds).alias("dataset"), F.col("_source_file").alias("file_name"), F.col("_problem").alias("problem"),
                      F.to_json(F.struct(*MAPPINGS[ds])).alias("cells")) for ds in K.PERIOD_COLUMNS]
    return reduce(lambda a, b: a.unionByName(b), frames)


def header_doubts(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Columns for which several header cells would do: the one taken and the others."""
    rows = [(e["dataset"], e["file_name"], column, taken, ", ".join(others))
            for e in entries for column, taken, others in json.loads(e["doubts"] or "[]")]
    return literal_rows(spark, rows, ["dataset", "file_name", "column_name", "taken", "others"], ["string"] * 5)


def require_clean(entries: list[dict]) -> None:
    """Stop where a file could not be read or holds rows that are not what it says."""
    faults = [f"{e['path']} ({e['error'] or str(e['bad']) + ' rows: ' + e['problem']})" for e in entries if e["error"] or e["bad"]]
    if faults:
        raise files.UnreadableFiles("unreadable source files: " + "; ".join(faults))
