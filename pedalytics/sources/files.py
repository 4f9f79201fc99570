"""Source-file discovery, encoding detection, CSV scans and lineage.

* Discovery lists the files matching a dataset's name pattern with the
  cluster's Hadoop filesystem (metadata only).  A matched entry, a logical
  file, may be a single file or a folder of part files; both read the same way.
* The encodings of all logical files are found by one job from the first lines
  of their first parts, read by Spark's text source.  They are only a proposal:
  the scan that loads a file fails on any character that does not decode.
* Logical files that share encoding and header are read by one Spark CSV scan,
  with all columns as text, and aligned by name (``unionByName``), which also
  absorbs schema drift between files.
* The scans are split.  Only files with a line break inside quotes, found by
  their lines, are read by a scan that takes each part as a whole.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pedalytics import schemas as K
from pedalytics.functions import columns as C

HEAD_ROWS = 5            # data rows that must decode (plus the header)

# Python codec name -> Spark CSV ``encoding`` option
SPARK_ENCODING = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp949": "cp949",
                  "euc-kr": "EUC-KR"}
CORRUPT = "_corrupt_record"
REPLACED = "�"      # what the decoder puts in place of bytes that fit no character
# a line that ends inside a quoted field which began at a field's start (a quote byte is never part of a longer character)
OPEN_QUOTE = r'(?:^|,)"(?:[^"]++|"")*+$'


class UnreadableFiles(ValueError):
    """Source files that cannot be read; the message names them."""


@dataclass(frozen=True)
class SourceFile:
    path: str
    name: str
    encoding: str | None
    header: tuple[str, ...] = ()
    error: str | None = None
    multiline: bool = False     # holds line breaks inside quotes


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the cluster's filesystem."""
    fs, p = _hadoop(spark, path)
    return str(fs.makeQualified(p).toString())


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _hadoop(spark, pattern)
    return sorted(str(s.getPath().toString()) for s in (fs.globStatus(p) or []))


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return bool(fs.exists(p))


def _glob_escape(s: str) -> str:
    return "".join("\\" + ch if ch in "{}[]\\" else ch for ch in s)


def find_files(spark: SparkSession, root: str, dataset: str) -> list[str]:
    """Files of a dataset in ``root/<folder>``, else in ``root`` itself, sorted."""
    folder, pattern = K.DATASET_FILES[dataset]
    root = root.rstrip("/")
    base = f"{root}/{folder}" if exists(spark, f"{root}/{folder}") else root
    return _glob(spark, f"{_glob_escape(base)}/{pattern}")


def leaf_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def first_part(spark: SparkSession, path: str) -> str:
    """The file itself, or the first data file of a folder of part files."""
    fs, p = _hadoop(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        return path
    parts = sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if s.getLen() > 0)
    parts = [x for x in parts if not leaf_name(x).startswith(("_", "."))]
    if not parts:
        raise UnreadableFiles(f"no data file in {path}")
    return parts[0]


def csv_rows(lines: list[str]) -> Iterator[list[str]]:
    """Records of a file's first lines; a quoted line break joins two lines."""
    return csv.reader(io.StringIO("\n".join(x.rstrip("\r") for x in lines), newline=""), strict=False)


def detect_one(lines: list[bytes], candidates=K.ENCODING_CANDIDATES) -> tuple[str | None, tuple[str, ...]]:
    """First candidate codec that decodes the given first lines, and the header's columns."""
    for enc in candidates:
        try:
            text = [codecs.decode(x, enc) for x in lines] or [""]
        except (UnicodeDecodeError, LookupError):
            continue
        return enc, tuple(next(csv_rows([text[0].lstrip("\ufeff"), *text[1:]]), []))
    return None, ()


@contextmanager
def _one_split_per_task(spark: SparkSession):
    """Scans planned inside put every split into a task of its own."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _path_key(path: str) -> str:
    return re.sub("^([a-z0-9]+):/+", r"\1:/", path)


def first_lines(spark: SparkSession, paths: list[str], lines: int = HEAD_ROWS + 1) -> dict[str, list[bytes]]:
    """The first lines of each file (no folders), by one job.

    Every split is a task; a task of a file's first split stops after
    ``lines`` lines, any other at its first line, and only those lines come
    to the driver.
    """
    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = lines
        for batch in batches:
            if not len(batch) or batch.column("start")[0].as_py() != 0:
                return
            yield batch.slice(0, left).select(["path", "line"])
            left -= min(left, len(batch))
            if not left:
                return

    found: dict[str, list[bytes]] = {_path_key(p): [] for p in paths}
    if paths:
        with _one_split_per_task(spark):
            scan = spark.read.text([_glob_escape(p) for p in paths]).select(
                F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                F.col("value").cast("binary").alias("line"))
            for r in scan.mapInArrow(head, "path string, line binary").collect():
                found[_path_key(unquote(r["path"]))].append(bytes(r["line"]))
    return {p: found[_path_key(p)] for p in paths}


def logical_path(path: str) -> str:
    """The folder of a part file (``name.csv/part-00000.csv``), else the path itself."""
    return path.rstrip("/").rsplit("/", 1)[0] if leaf_name(path).startswith("part-") else path


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).splitlines()[0]}"


def detect_all(spark: SparkSession, paths: list[str]) -> list[SourceFile]:
    """One entry per path; the first six lines of each logical file decide, read by one job for all.

    A file that cannot be read keeps its error.  Where a file breaks the
    common job, each is looked at by itself.
    """
    first: dict[str, str] = {}
    errors: dict[str, str] = {}
    for p in paths:
        if logical_path(p) not in first | errors:
            try:
                first[logical_path(p)] = first_part(spark, p)
            except (PySparkException, UnreadableFiles) as e:
                errors[logical_path(p)] = _told(e)
    try:
        heads = first_lines(spark, list(first.values()))
    except PySparkException:
        heads = {}
        for logical, part in first.items():
            try:
                heads |= first_lines(spark, [part])
            except PySparkException as e:
                errors[logical] = _told(e)
    known: dict[str, SourceFile] = {}
    for logical, part in first.items():
        if logical not in errors:
            enc, header = detect_one(heads[part])
            known[logical] = SourceFile(logical, "", enc, header, None if enc else "cannot detect encoding")
    known |= {logical: SourceFile(logical, "", None, error=e) for logical, e in errors.items()}
    return [replace(known[logical_path(p)], path=p, name=leaf_name(logical_path(p))) for p in paths]


def mark_open_quotes(spark: SparkSession, found: list[SourceFile]) -> list[SourceFile]:
    """The files with ``multiline`` set where a line ends inside a quoted field.

    One text scan, split like any other, with one row per part.  A part of
    such a file with an odd number of quotes has one that never ends: the
    rows behind it cannot be told apart, so the file gets an error.
    """
    readable = [f for f in found if f.error is None]
    if not readable:
        return found
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    parts = spark.read.text([_glob_escape(f.path) for f in readable]).select(
        scan_file_name().alias("file"), F.col("_metadata.file_path").alias("part"), (F.contains("value", F.lit('"')) & F.col("value").rlike(OPEN_QUOTE)).alias("open"),
        quotes.cast("long").alias("quotes")).groupBy("file", "part").agg(
            F.max("open").alias("open"), (F.sum("quotes") % 2).alias("odd"))
    open_ = {r["file"]: r["odd"] for r in parts.groupBy("file").agg(
        F.max("open").alias("open"), F.max("odd").alias("odd")).filter("open").collect()}
    return [f if f.error or f.name not in open_ else replace(
        f, multiline=True, error="a quote that never ends" if open_[f.name] else None) for f in found]


def logical_file_name(path: Column) -> Column:
    """The source file name of a row.

    For a folder of part files (``name.csv/part-00000.csv``) it is the
    folder's name, otherwise the file's own name.  Plain substring search,
    no regex: this runs once per scanned row.
    """
    leaf = F.substring_index(path, "/", -1)
    parent = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return F.when(leaf.startswith("part-"), parent).otherwise(leaf)


def scan_file_name() -> Column:
    """Source file name of the row being scanned (the scan reports URL-encoded paths)."""
    return C.decoded_file_name(logical_file_name(F.col("_metadata.file_path")))


# characters that headers of the same column differ in
_HEADER_BLANKS = str.maketrans("", "", " \n\r\t")


class HeaderIndex:
    """Header cells by their text without blanks; finds the cell that stands for a canonical column.

    ``doubts`` lists the columns for which more than one cell would do: the
    column, the cell taken and the others.
    """

    def __init__(self, header: tuple[str, ...] | list[str]):
        self.cells = [(h.translate(_HEADER_BLANKS), h) for h in header]
        self.doubts: list[tuple[str, str, list[str]]] = []

    def find(self, wanted: tuple[str, ...]) -> str | None:
        """An equal cell before one that contains or is contained; then the order of ``wanted``, then the header's."""
        keys = [w.translate(_HEADER_BLANKS) for w in wanted]
        ranked = [(0 if k == c else 1, i, cell) for i, k in enumerate(keys) for c, cell in self.cells
                  if c and (k == c or k in c or c in k)]
        best = [cell for r in [min(ranked, key=lambda x: x[:2], default=None)] if r
                for rank, i, cell in ranked if (rank, i) == r[:2]]
        if len(best) > 1:
            self.doubts.append((wanted[0], best[0], best[1:]))
        return best[0] if best else None


def tidy_header(name: str) -> str:
    """A header cell on one line, without surrounding blanks."""
    return " ".join(part.strip() for part in name.splitlines()).strip() if name else ""


def read_csv_group(spark: SparkSession, group: list[SourceFile]) -> DataFrame:
    """S3: scan of logical files sharing encoding and header; all columns as text, by position ``c0, c1 ...``.

    Adds ``_source_file`` and ``_problem``: why a row is not what the file
    holds (wrong number of fields, bytes that do not decode), else NULL.  A
    part whose header differs from the first part's stops the scan.  Files
    marked ``multiline`` are read part by part, all others in splits.
    """
    header = group[0].header
    # the scan checks each part's header against these names, so they stay as written
    names = [h if h and header.index(h) == i else f"_c{i}" for i, h in enumerate(header)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    df = (spark.read.schema(schema).option("header", True).option("enforceSchema", len(set(header)) < len(header))
          .option("encoding", SPARK_ENCODING[group[0].encoding]).option("quote", '"').option("escape", '"')
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
          .option("multiLine", group[0].multiline).option("columnPruning", False).csv([_glob_escape(f.path) for f in group]))
    cols = [F.col(f"`{n}`") for n in names]
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.contains(c, F.lit(REPLACED)), F.lit(False)) for c in cols])
    problem = F.when(F.col(CORRUPT).isNotNull(), "malformed row").when(bad, "bytes that do not decode")
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)], scan_file_name().alias("_source_file"),
                     problem.alias("_problem"))


def csv_groups(found: list[SourceFile]) -> list[list[SourceFile]]:
    """Readable files grouped by encoding, header and kind of scan."""
    groups: dict[tuple, list[SourceFile]] = {}
    for f in found:
        if f.error is None:
            groups.setdefault((f.encoding, f.header, f.multiline), []).append(f)
    return [groups[k] for k in sorted(groups)]


def stop_on_problem(df: DataFrame) -> DataFrame:
    """The rows of ``df`` without ``_problem``; a row that has one stops the job and names its file.

    The test is a filter, so no later choice of columns can drop it.
    """
    told = F.raise_error(F.concat(F.lit("unreadable source file "), F.col("_source_file"), F.lit(": "),
                                  F.col("_problem")))
    return df.filter(F.when(F.col("_problem").isNull(), F.lit(True)).otherwise(told.cast("boolean"))).drop("_problem")


def require_readable(found: list[SourceFile]) -> None:
    if bad := [f"{f.path} ({f.error})" for f in found if f.error]:
        raise UnreadableFiles("unreadable source files: " + "; ".join(bad))


def canonical(df: DataFrame, header: tuple[str, ...], mapping: dict[str, tuple[str, ...]]
              ) -> tuple[DataFrame, list[tuple[str, str, list[str]]]]:
    """Columns of a group's scan by their canonical names (NULL where the header has none), and doubts about them."""
    tidy = [tidy_header(h) for h in header]
    index, places = HeaderIndex(tidy), {h: f"c{i}" for i, h in reversed(list(enumerate(tidy)))}
    cells = {target: index.find(wanted) for target, wanted in mapping.items()}
    return df.select(*[(F.col(places[c]) if c is not None else F.lit(None).cast("string")).alias(t) for t, c in cells.items()],
                     *[c for c in df.columns if c.startswith("_")]), index.doubts


def read_dataset_csv(spark: SparkSession, files: list[str],
                     mapping: dict[str, tuple[str, ...]]) -> DataFrame:
    """Read a dataset's CSV files into canonical column names (text), plus ``_source_file``.

    A file without a fitting encoding or with a quote that never ends stops
    the load at once; a row that is malformed or does not decode stops it when
    the row is read.  A column that a group lacks becomes NULL.
    """
    found = mark_open_quotes(spark, detect_all(spark, files))
    require_readable(found)
    frames = [canonical(stop_on_problem(read_csv_group(spark, group)), group[0].header, mapping)[0]
              for group in csv_groups(found)]
    if not frames:
        schema = ", ".join(f"`{c}` string" for c in [*mapping, "_source_file"])
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
