"""Load checks over the source files.

A failed file is a result row with a status text, never an exception
that stops the other files.
"""

from __future__ import annotations

import itertools
import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalytics import schemas as K
from pedalytics.functions import columns as C
from pedalytics.operators.staging import literal_rows
from pedalytics.sources import files, landing
from pedalytics.sources.loaders import workbook_rows

CSV_CHECK_COLUMNS = ["dataset", "file_name", "encoding", "row_count", "columns", "period_min",
                     "period_max", "status"]


def csv_file_check(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """L1: per source file: encoding, rows, header, period min/max, status, straight from the source files.

    A file that cannot be opened or decoded, or holds malformed rows, is a
    row with a status that says so; a file with a header only has 0 rows.
    """
    name = K.PERIOD_COLUMNS[dataset]
    found = files.mark_open_quotes(spark, files.detect_all(spark, files.find_files(spark, root, dataset)))
    info = literal_rows(spark, [(dataset, f.name, f.encoding, ", ".join(f.header) if f.encoding else None, f.error)
                                for f in found], ["dataset", "file_name", "encoding", "columns", "error"], ["string"] * 5)
    frames = [spark.range(0).select(F.lit("").alias("_source_file"), F.lit(None).cast("double").alias("_period"),
                                    F.lit(None).cast("string").alias("_problem"))]
    for group in files.csv_groups(found):
        header = group[0].header
        cell = F.col(f"c{header.index(name)}") if name in header else F.lit(None).cast("string")
        frames.append(files.read_csv_group(spark, group).select(
            "_source_file", landing.period(cell).alias("_period"), "_problem"))
    stats = reduce(lambda a, b: a.unionByName(b), frames).groupBy(F.col("_source_file").alias("file_name")).agg(
        *landing.period_stats())
    return _csv_rows(info.join(stats, "file_name", "left"))


def landed_file_checks(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """L1 for landed files: what their manifest entries tell; no source file is read."""
    return _csv_rows(literal_rows(spark, [tuple(e[c] for c in landing.MANIFEST) for e in entries],
                                  list(landing.MANIFEST), list(landing.MANIFEST.values())))


def _csv_rows(files_found: DataFrame) -> DataFrame:
    """Check rows from detection results and counts; a file that fails late keeps its encoding."""
    error = F.coalesce(F.col("error"), F.when(F.col("bad") > 0, F.concat(
        F.col("bad").cast("string"), F.lit(" rows: "), F.col("problem"))))
    ok = error.isNull()
    labels = F.create_map(*[F.lit(x) for ds in K.PERIOD_COLUMNS for x in (ds, K.DATASET_LABELS[ds])])
    return files_found.select(
        F.element_at(labels, F.col("dataset")).alias("dataset"), "file_name",
        F.coalesce("encoding", F.lit("READ_FAILED")).alias("encoding"),
        F.when(ok, F.coalesce("row_count", F.lit(0))).alias("row_count"),
        F.when(ok, F.col("columns")).alias("columns"), F.when(ok, F.col("period_min")).alias("period_min"),
        F.when(ok, F.col("period_max")).alias("period_max"),
        F.when(ok, F.lit("ok")).otherwise(F.concat(F.lit("fail: "), error)).alias("status"))


def csv_file_checks(spark: SparkSession, root: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b),
                  [csv_file_check(spark, root, ds) for ds in K.PERIOD_COLUMNS])


def header_rows(rows: DataFrame) -> DataFrame:
    """Per workbook file, the row (among the first 20) holding most header keywords; first wins."""
    preview = rows.filter(F.col("row_idx") < K.HEADER_SCAN_ROWS).select(
        "path", "file_name", "row_idx",
        C.keyword_score(F.array_join("cells", " ")).alias("score"))
    return preview.groupBy("path", "file_name").agg(
        F.max_by("row_idx", F.struct("score", -F.col("row_idx"))).alias("header_row"))


def _clean(c):
    return F.replace(F.trim(c), F.lit("\n"), F.lit(" "))


def xlsx_file_check(spark: SparkSession, root: str) -> DataFrame:
    """Per workbook: snapshot month, sheets, header row, data rows, header columns."""
    rows = workbook_rows(spark, root)
    hdr = header_rows(rows.filter(F.col("error").isNull()))
    r = rows.join(hdr, ["path", "file_name"], "left")
    width = F.max(F.size("cells"))
    header_cells = F.max(F.when(F.col("row_idx") == F.col("header_row"), F.col("cells")))
    per_path = r.groupBy("path", "file_name", "snapshot_ym").agg(
        F.max("sheet_names").alias("sheet_names"), F.max("used_sheet").alias("used_sheet"),
        F.max("header_row").alias("header_row"),
        F.count(F.when((F.col("row_idx") > F.col("header_row"))
                       & F.try_element_at("cells", F.lit(1)).isNotNull(), 1)).alias("data_rows"),
        width.alias("width"), header_cells.alias("header_cells"),
        F.max("error").alias("error"))
    names = F.transform(F.sequence(F.lit(0), F.greatest(F.col("width") - 1, F.lit(0))),
                        lambda i: F.coalesce(_clean(F.try_element_at("header_cells", i + 1)),
                                             F.concat(F.lit("Unnamed: "), i.cast("string"))))
    per_path = per_path.select("*", F.array_join(names, ", ").alias("columns"))
    ok = F.col("_errors") == 0
    return per_path.groupBy("file_name", "snapshot_ym").agg(
        F.max("sheet_names").alias("sheet_names"), F.max("used_sheet").alias("used_sheet"),
        F.max("header_row").alias("header_row_0_based"), F.sum("data_rows").alias("rows"),
        F.max("columns").alias("columns"), F.count("error").alias("_errors"),
        F.max("error").alias("_error"),
    ).select(
        F.lit(K.DATASET_LABELS["station_snapshot"]).alias("dataset"), "file_name", "snapshot_ym",
        F.when(ok, F.col("sheet_names")).alias("sheet_names"),
        F.when(ok, F.col("used_sheet")).alias("used_sheet"),
        F.when(ok, F.col("header_row_0_based")).alias("header_row_0_based"),
        F.when(ok, F.col("rows")).alias("row_count_after_header"),
        F.when(ok, F.col("columns")).alias("columns"),
        F.when(ok, F.lit("ok")).otherwise(F.concat(F.lit("fail: "), F.col("_error"))).alias("status"))


def dataset_summary(csv_checks: DataFrame, xlsx_checks: DataFrame) -> DataFrame:
    """Per dataset: files, rows (missing -> 0), period range, all files ok."""
    x = xlsx_checks.select("dataset", "file_name", F.col("row_count_after_header").alias("row_count"),
                           F.col("snapshot_ym").cast("bigint").alias("period_min"),
                           F.col("snapshot_ym").cast("bigint").alias("period_max"), "status")
    c = csv_checks.select("dataset", "file_name", "row_count", "period_min", "period_max", "status")
    return c.unionByName(x).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum(F.coalesce("row_count", F.lit(0))).alias("total_rows"),
        F.min("period_min").alias("period_min"), F.max("period_max").alias("period_max"),
        F.bool_and(F.col("status") == "ok").alias("all_status_ok"))


PREVIEW = ["dataset_key", "file_name", "encoding", "columns", "sample_json"]
PREVIEW_LINES = 64      # lines of a CSV file that its first three records are taken from
TYPED_ROWS = 3          # rows whose cells decide a column's type
_INTEGER = re.compile(r"\s*[+-]?[0-9]+\s*")
_REAL = re.compile(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*")


def typed_column(cells: list[str | None]) -> list:
    """Cells as integers, reals (also integers with gaps), truth values or text, whichever fits them all."""
    told = [c for c in cells if c is not None]
    if told and all(_INTEGER.fullmatch(c) and abs(int(c)) < 1 << 63 for c in told):
        return [int(c) for c in cells] if len(told) == len(cells) else [None if c is None else float(c) for c in cells]
    if told and all(_REAL.fullmatch(c) for c in told):
        return [None if c is None else float(c) for c in cells]
    if len(told) == len(cells) and {c.lower() for c in told} <= {"true", "false"}:
        return [c.lower() == "true" for c in told]
    return cells


def json_records(header: list[str], rows: list[list[str | None]], shown: int) -> str:
    """The first ``shown`` rows as JSON records; the types of their columns come from all given rows."""
    wide = [[*r, *[None] * len(header)][:len(header)] for r in rows]
    columns = [typed_column([r[i] for r in wide]) for i in range(len(header))]
    records = [{h: c[k] for h, c in zip(header, columns, strict=True)} for k in range(min(shown, len(rows)))]
    return json.dumps(records, ensure_ascii=False, separators=(",", ":")).replace("/", "\\/")


def _csv_preview(f: files.SourceFile, lines: list[bytes], shown: int) -> tuple:
    """The header and first rows of a file's first lines (a quoted field may hold line breaks)."""
    if f.error:
        return f.name, f.encoding, None, f"failed: {f.error}"
    try:
        text = [x.decode(f.encoding) for x in lines] or [""]
    except UnicodeDecodeError as e:
        return f.name, f.encoding, None, f"failed: {e}"
    records = files.csv_rows([text[0].lstrip("\ufeff"), *text[1:]])
    header = list(next(records, []))
    rows = [[None if c in C.PANDAS_NA_TOKENS else c for c in r] for r in itertools.islice(filter(None, records), TYPED_ROWS)]
    return f.name, f.encoding, ", ".join(header), json_records(header, rows, shown)


def sample_preview(spark: SparkSession, root: str, n: int = 2) -> DataFrame:
    """First file of each dataset: encoding, columns, first ``n`` rows as JSON records.

    The first rows are those of the file's first part.  Numbers are numbers:
    three rows decide each column's type.  A file that cannot be read keeps
    the encoding found, has no columns and tells the error in place of the
    rows.  Workbook rows are those below the detected header.
    """
    first = {ds: path for ds in K.PERIOD_COLUMNS for path in files.find_files(spark, root, ds)[:1]}
    found = dict(zip(first, files.detect_all(spark, list(first.values())), strict=True))
    parts = {ds: files.first_part(spark, path) for ds, path in first.items() if found[ds].error is None}
    lines = files.first_lines(spark, list(parts.values()), PREVIEW_LINES)
    out = [(ds, *_csv_preview(f, lines.get(parts.get(ds), []), n)) for ds, f in found.items()]
    for path in files.find_files(spark, root, "station_snapshot")[:1]:
        out.append(("station_snapshot", *_workbook_preview(spark, path, n)))
    return literal_rows(spark, out, PREVIEW, ["string"] * 5)


def _workbook_preview(spark: SparkSession, path: str, shown: int) -> tuple:
    """The first workbook's rows below its header, keyed by the header's cells (four rows are collected)."""
    name = files.leaf_name(path)
    rows = workbook_rows(spark, "", [files.first_part(spark, path)]).withColumn("file_name", F.lit(name))
    head = rows.join(header_rows(rows.filter(F.col("error").isNull())), ["path", "file_name"], "left")
    top = head.filter(F.col("error").isNotNull() | F.col("row_idx").between(F.col("header_row"), F.col("header_row") + TYPED_ROWS)) \
        .select("error", "cells", "row_idx", "header_row").collect()
    error = next((r["error"] for r in top if r["error"]), None) if top else "no header row"
    if error:
        return name, "xlsx", None, f"failed: {error}"
    cells = {r["row_idx"] - r["header_row"]: r["cells"] for r in top}
    width = max(map(len, cells.values()))
    header = [c or f"Unnamed: {i}" for i, c in enumerate([*cells[0], *[None] * width][:width])]
    last = max(cells)  # rows without cells before it are rows of gaps
    return name, "xlsx", ", ".join(h.strip() for h in header), json_records(
        header, [cells.get(i, []) for i in range(1, last + 1)], shown)
