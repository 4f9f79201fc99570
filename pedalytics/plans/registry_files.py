"""Registered queries over source files and written tables.

The raw tables derived from the driver data are first written out as
source files (CSV in cp949 / UTF-8 with BOM, with the distance-header
drift, and XLSX workbooks) into a fresh folder under the checkpoint
root; the queries then run the file ingest and checks on them.  Their
oracles compute the expected result straight from the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalytics import schemas as K
from pedalytics.functions import columns as C
from pedalytics.operators import checks, filecheck
from pedalytics.plans import oracle_ctes as O
from pedalytics.plans import stages
from pedalytics.plans.context import Tables
from pedalytics.plans.registry import FLAGS, query
from pedalytics.sources import driver_tables, export, files, loaders

LOADED_AT = driver_tables.LOADED_AT
_NA_SQL = ", ".join("'" + x.replace("'", "''") + "'" for x in C.PANDAS_NA_TOKENS)


def norm(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} IN ({_NA_SQL}) THEN 'nan' ELSE TRIM({x}) END"


def _select_norm(cols, text_cols) -> str:
    return ", ".join(f"{norm(c)} AS {c}" if c in text_cols else c for c in cols)


_SIGNUP_TEXT = ("member_type_raw", "age_band_raw", "gender_raw")
_RIDE_TEXT = ("station_id_raw", "station_name_raw", "pass_type_raw", "gender_raw", "age_band_raw",
              "exercise_amt_raw", "carbon_amt_raw", "distance_m_raw", "duration_min_raw")
_USAGE_TEXT = ("district_raw", "station_name_raw")


# ---------------------------------------------------------------------------
# Loaders (S16-S19)
# ---------------------------------------------------------------------------
@query("raw_signup_month", f"SELECT {_select_norm(K.RAW_SIGNUP.fieldNames(), _SIGNUP_TEXT)} "
       "FROM raw_signup_month", "raw_signup_month")
def _raw_signup(t: Tables) -> DataFrame:
    return loaders.load_raw_signup_month(t.spark, t.source_files("signup_month"), LOADED_AT)


@query("raw_ride_month", f"SELECT {_select_norm(K.RAW_RIDE.fieldNames(), _RIDE_TEXT)} FROM raw_ride_month",
       "raw_ride_month")
def _raw_ride(t: Tables) -> DataFrame:
    return loaders.load_raw_ride_month(t.spark, t.source_files("ride_month"), LOADED_AT)


@query("raw_station_usage_month", f"SELECT {_select_norm(K.RAW_USAGE.fieldNames(), _USAGE_TEXT)} "
       "FROM raw_station_usage_month", "raw_station_usage_month")
def _raw_usage(t: Tables) -> DataFrame:
    return loaders.load_raw_station_usage_month(t.spark, t.source_files("station_usage_month"), LOADED_AT)


@query("raw_station_snapshot", f"SELECT {_select_norm(K.RAW_SNAPSHOT.fieldNames(), K.SNAPSHOT_POSITIONAL_COLUMNS)} "
       "FROM raw_station_snapshot", "raw_station_snapshot")
def _raw_snapshot(t: Tables) -> DataFrame:
    return loaders.load_raw_station_snapshot(t.spark, t.source_files("station_snapshot"), LOADED_AT)


@query("src_csv_multi_encoding", f"""
SELECT source_file, usage_ym, {norm('district_raw')} AS district_raw,
       CASE WHEN starts_with(station_name_raw, 'Station ') AND usage_ym // 100 % 2 = 1
            THEN replace(station_name_raw, ' ', chr(10)) ELSE {norm('station_name_raw')} END AS station_name_raw,
       checkout_cnt_raw, return_cnt_raw
FROM raw_station_usage_month""", "raw_station_usage_month")
def _src_csv_multi_encoding(t: Tables) -> DataFrame:
    # the files of odd years, one of either encoding, get names with a line break inside
    name, root = F.col("station_name_raw"), t.scratch("line-breaks")
    broken = F.startswith(name, F.lit("Station ")) & (F.floor(F.col("usage_ym") / 100) % 2 == 1)
    raw = t["raw_station_usage_month"].withColumn(
        "station_name_raw", F.when(broken, F.replace(name, F.lit(" "), F.lit("\n"))).otherwise(name))
    export.export_dataset(raw, "station_usage_month", root)
    return loaders.load_raw_station_usage_month(t.spark, root, LOADED_AT).drop("loaded_at")


# ---------------------------------------------------------------------------
# Discovery, encodings, lineage, drift
# ---------------------------------------------------------------------------
_DATASET_RAW = {"signup_month": "raw_signup_month", "ride_month": "raw_ride_month",
                "station_snapshot": "raw_station_snapshot",
                "station_usage_month": "raw_station_usage_month"}


@query("src_discover_files", "\nUNION ALL\n".join(
    f"SELECT DISTINCT '{ds}' AS dataset, source_file AS file_name FROM {raw}"
    for ds, raw in _DATASET_RAW.items()), *_DATASET_RAW.values())
def _src_discover_files(t: Tables) -> DataFrame:
    root = t.source_files()
    rows = [(ds, p.rstrip("/").rsplit("/", 1)[-1]) for ds in _DATASET_RAW
            for p in files.find_files(t.spark, root, ds)]
    return t.spark.createDataFrame(rows, "dataset string, file_name string")


_ENC_SQL = """
SELECT DISTINCT source_file AS file_name, 'cp949' AS encoding FROM raw_signup_month
UNION ALL SELECT DISTINCT source_file, 'cp949' FROM raw_ride_month
UNION ALL SELECT DISTINCT source_file,
       CASE WHEN usage_ym BETWEEN 202501 AND 202512 THEN 'utf-8-sig' ELSE 'cp949' END
FROM raw_station_usage_month"""


@query("src_detect_encoding", _ENC_SQL, "raw_signup_month", "raw_ride_month", "raw_station_usage_month")
def _src_detect_encoding(t: Tables) -> DataFrame:
    root = t.source_files(*K.PERIOD_COLUMNS)
    paths = [p for ds in K.PERIOD_COLUMNS for p in files.find_files(t.spark, root, ds)]
    found = files.detect_all(t.spark, paths)
    return t.spark.createDataFrame([(f.name, f.encoding) for f in found], "file_name string, encoding string")


@query("src_lineage", """
SELECT source_file, '2026-01-01 00:00:00' AS loaded_at, COUNT(*) AS row_count
FROM raw_ride_month GROUP BY source_file""", "raw_ride_month")
def _src_lineage(t: Tables) -> DataFrame:
    r = loaders.load_raw_ride_month(t.spark, t.source_files("ride_month"), LOADED_AT)
    return r.groupBy("source_file", "loaded_at").agg(F.count(F.lit(1)).alias("row_count"))


@query("src_schema_drift", f"""
SELECT source_file, COUNT(*) AS row_count,
       CAST(SUM(CASE WHEN {norm('distance_m_raw')} <> 'nan' THEN 1 ELSE 0 END) AS BIGINT) AS distance_rows
FROM raw_ride_month GROUP BY source_file""", "raw_ride_month")
def _src_schema_drift(t: Tables) -> DataFrame:
    r = loaders.load_raw_ride_month(t.spark, t.source_files("ride_month"), LOADED_AT)
    return r.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.when(F.col("distance_m_raw") != "nan", 1).otherwise(0)).alias("distance_rows"))


# ---------------------------------------------------------------------------
# Workbooks
# ---------------------------------------------------------------------------
@query("src_xlsx_snapshot", """
SELECT source_file AS file_name, snapshot_ym, COUNT(*) AS data_rows
FROM raw_station_snapshot GROUP BY source_file, snapshot_ym""", "raw_station_snapshot")
def _src_xlsx_snapshot(t: Tables) -> DataFrame:
    data = loaders.positional(loaders.workbook_rows(t.spark, t.source_files("station_snapshot")))
    return data.na.drop("all", subset=list(K.SNAPSHOT_POSITIONAL_COLUMNS)) \
        .groupBy("file_name", "snapshot_ym").agg(F.count(F.lit(1)).alias("data_rows"))


@query("src_header_row", """
SELECT DISTINCT source_file AS file_name, 2 AS header_row FROM raw_station_snapshot""",
       "raw_station_snapshot")
def _src_header_row(t: Tables) -> DataFrame:
    h = filecheck.header_rows(loaders.workbook_rows(t.spark, t.source_files("station_snapshot")))
    return h.groupBy("file_name").agg(F.max("header_row").alias("header_row"))


@query("src_snapshot_ym", """
SELECT DISTINCT source_file AS file_name, snapshot_ym FROM raw_station_snapshot""",
       "raw_station_snapshot")
def _src_snapshot_ym(t: Tables) -> DataFrame:
    return loaders.workbook_rows(t.spark, t.source_files("station_snapshot")).select("file_name", "snapshot_ym").distinct()


_XLSX_COLUMNS = ("대여소 번호, 보관소(대여소)명, 자치구, 상세주소, 위도, 경도, 설치 시기, 설치형태, "
                 "Unnamed: 8, 운영 방식")
_XLSX_SQL = f"""
SELECT '대여소 정보' AS dataset, source_file AS file_name, snapshot_ym, '대여소현황' AS sheet_names,
       '대여소현황' AS used_sheet, 2 AS header_row_0_based, COUNT(*) AS row_count_after_header,
       '{_XLSX_COLUMNS}' AS columns, 'ok' AS status
FROM raw_station_snapshot GROUP BY source_file, snapshot_ym"""


@query("chk_xlsx_files", _XLSX_SQL, "raw_station_snapshot")
def _chk_xlsx_files(t: Tables) -> DataFrame:
    return filecheck.xlsx_file_check(t.spark, t.source_files("station_snapshot"))


# ---------------------------------------------------------------------------
# Load checks
# ---------------------------------------------------------------------------
_SIGNUP_COLS = "가입년월, 회원구분, 연령대, 성별, 가입건수"
_RIDE_COLS = "대여일자, 대여소번호, 대여소명, 대여구분코드, 성별, 연령대코드, 이용건수, 운동량, 탄소량, {d}, 이용시간(분)"
_USAGE_COLS = "자치구, 대여소명, 기준년월, 대여건수, 반납건수"
_CSV_SQL = f"""
SELECT '신규가입자 정보(월별)' AS dataset, source_file AS file_name, 'cp949' AS encoding,
       COUNT(*) AS row_count, '{_SIGNUP_COLS}' AS columns, CAST(MIN(signup_ym) AS BIGINT) AS period_min,
       CAST(MAX(signup_ym) AS BIGINT) AS period_max, 'ok' AS status
FROM raw_signup_month GROUP BY source_file
UNION ALL
SELECT '이용정보(월별)', source_file, 'cp949', COUNT(*),
       CASE WHEN MIN(ride_ym) < 202401 THEN '{_RIDE_COLS.format(d="이용거리(M)")}'
            ELSE '{_RIDE_COLS.format(d="이동거리(M)")}' END,
       CAST(MIN(ride_ym) AS BIGINT), CAST(MAX(ride_ym) AS BIGINT), 'ok'
FROM raw_ride_month GROUP BY source_file
UNION ALL
SELECT '대여소별 이용정보(월별)', source_file,
       CASE WHEN MIN(usage_ym) BETWEEN 202501 AND 202512 THEN 'utf-8-sig' ELSE 'cp949' END, COUNT(*),
       '{_USAGE_COLS}', CAST(MIN(usage_ym) AS BIGINT), CAST(MAX(usage_ym) AS BIGINT), 'ok'
FROM raw_station_usage_month GROUP BY source_file"""


@query("chk_csv_files", _CSV_SQL, "raw_signup_month", "raw_ride_month", "raw_station_usage_month")
def _chk_csv_files(t: Tables) -> DataFrame:
    return filecheck.csv_file_checks(t.spark, t.source_files(*K.PERIOD_COLUMNS))


@query("chk_dataset_summary", f"""
SELECT dataset, COUNT(*) AS file_count, CAST(SUM(row_count) AS BIGINT) AS total_rows,
       MIN(period_min) AS period_min, MAX(period_max) AS period_max, bool_and(status = 'ok') AS all_status_ok
FROM ({_CSV_SQL}
UNION ALL
SELECT dataset, file_name, NULL, row_count_after_header, NULL, CAST(snapshot_ym AS BIGINT),
       CAST(snapshot_ym AS BIGINT), status FROM ({_XLSX_SQL}) x) f
GROUP BY dataset""", "raw_signup_month", "raw_ride_month", "raw_station_usage_month", "raw_station_snapshot")
def _chk_dataset_summary(t: Tables) -> DataFrame:
    root = t.source_files()
    return filecheck.dataset_summary(filecheck.csv_file_checks(t.spark, root),
                                     filecheck.xlsx_file_check(t.spark, root))


def _preview_sql(ds: str, table: str, header: str, columns: list[str]) -> str:
    """First two rows, in the order of all columns, of the dataset's first file; three rows decide the types."""
    order = ", ".join(f"CAST({c} AS VARCHAR) NULLS FIRST" for c in columns)
    cells = ", ".join(f"CASE WHEN CAST({c} AS VARCHAR) NOT IN ({_NA_SQL}) THEN CAST({c} AS VARCHAR) END AS v{i}"
                      for i, c in enumerate(columns))
    kinds = ", ".join(
        f"CASE WHEN count(v{i}) OVER () = 0 THEN 0 WHEN bool_and(regexp_full_match(v{i}, ' *[-+]?[0-9]+ *')) OVER () "
        f"THEN CASE count(v{i}) OVER () WHEN count(*) OVER () THEN 2 ELSE 1 END "
        f"WHEN count(v{i}) OVER () = count(TRY_CAST(v{i} AS DOUBLE)) OVER () THEN 1 ELSE 0 END AS k{i}"
        for i in range(len(columns)))
    values = " || ',' || ".join(
        f"""'"{h}":' || coalesce(CASE k{i} WHEN 2 THEN CAST(CAST(v{i} AS BIGINT) AS VARCHAR)
            WHEN 1 THEN CAST(to_json(CAST(v{i} AS DOUBLE)) AS VARCHAR) ELSE CAST(to_json(v{i}) AS VARCHAR) END, 'null')"""
        for i, h in enumerate(header.split(", ")))
    return f"""
SELECT '{ds}' AS dataset_key, any_value(source_file) AS file_name, 'cp949' AS encoding, '{header}' AS columns,
       replace('[' || string_agg('{{' || {values} || '}}', ',' ORDER BY rn) || ']', '/', '\\/') AS sample_json
FROM (SELECT *, {kinds} FROM (
      SELECT source_file, {cells}, row_number() OVER (ORDER BY {order}) AS rn FROM {table}
      WHERE source_file = (SELECT min(source_file) FROM {table}) QUALIFY rn <= 3))
WHERE rn <= 2"""


# header cells of the exported workbooks; below them stand the second header row and an empty one
_BOOK_CELLS = ["대여소|번호", "보관소(대여소)명", "자치구", "상세주소", "위도", "경도", "설치|시기", "설치형태", "Unnamed: 8", "운영|방식"]
_BOOK_ROW = "{" + ",".join('"' + c.replace("|", "\\n") + '":' + {"설치형태": '"LCD"', "Unnamed: 8": '"QR"'}.get(c, "null")
                           for c in _BOOK_CELLS) + "}"
_BOOK_GAP = "{" + ",".join('"' + c.replace("|", "\\n") + '":null' for c in _BOOK_CELLS) + "}"
_BOOK_PREVIEW_SQL = f"""
SELECT 'station_snapshot', min(source_file), 'xlsx', replace('{", ".join(_BOOK_CELLS)}', '|', chr(10)),
       '[{_BOOK_ROW},{_BOOK_GAP}]' FROM raw_station_snapshot"""


@query("src_sample_json", "\nUNION ALL\n".join((
    _preview_sql("signup_month", "raw_signup_month", _SIGNUP_COLS,
                 ["signup_ym", "member_type_raw", "age_band_raw", "gender_raw", "signup_cnt_raw"]),
    _preview_sql("ride_month", "raw_ride_month", _RIDE_COLS.format(d="이용거리(M)"), [
        "ride_ym", "station_id_raw", "station_name_raw", "pass_type_raw", "gender_raw", "age_band_raw", "ride_cnt_raw",
        "exercise_amt_raw", "carbon_amt_raw", "distance_m_raw", "duration_min_raw"]),
    _preview_sql("station_usage_month", "raw_station_usage_month", _USAGE_COLS, [
        "district_raw", "station_name_raw", "usage_ym", "checkout_cnt_raw", "return_cnt_raw"]), _BOOK_PREVIEW_SQL)),
    "raw_signup_month", "raw_ride_month", "raw_station_usage_month", "raw_station_snapshot")
def _src_sample_json(t: Tables) -> DataFrame:
    return filecheck.sample_preview(t.spark, t.source_files(ordered=True))


# ---------------------------------------------------------------------------
# Sinks and table scans
# ---------------------------------------------------------------------------
@query("sink_append", "SELECT * FROM raw_ride_month", "raw_ride_month")
def _sink_append(t: Tables) -> DataFrame:
    root, old = t.scratch("sink-append"), F.coalesce(F.col("ride_ym") < K.WINDOW_START, F.lit(False))
    stages.write_table(t["raw_ride_month"], f"{root}/given", "raw_ride_month")
    raw = stages.read_table(t.spark, f"{root}/given", "raw_ride_month")
    stages.write_table(raw.filter(old), root, "raw_ride_month", "append")
    stages.write_table(raw.filter(~old), root, "raw_ride_month", "append")
    return stages.read_table(t.spark, root, "raw_ride_month")


@query("sink_overwrite", f"""
SELECT * FROM stg_ride_month WHERE month_ym BETWEEN {K.WINDOW_START} AND {K.WINDOW_END}""", "stg_ride_month")
def _sink_overwrite(t: Tables) -> DataFrame:
    # a table of all months, refreshed in full with those of the window only: the others must go
    root = t.scratch("sink-overwrite")
    stages.write_table(t["stg_ride_month"], root, "stg_ride_month")
    stages.write_table(t["stg_ride_month"].filter(F.col("month_ym").between(K.WINDOW_START, K.WINDOW_END)),
                       root, "stg_ride_month")
    return stages.read_table(t.spark, root, "stg_ride_month")


@query("sink_reload_months", "SELECT * FROM stg_ride_month", "stg_ride_month")
def _sink_reload_months(t: Tables) -> DataFrame:
    # the window's months are written with wrong counts, then reloaded; all other months stay
    root, window = t.scratch("sink-reload"), F.col("month_ym").between(K.WINDOW_START, K.WINDOW_END)
    wrong = F.when(window, F.lit(-1)).otherwise(F.col("ride_cnt")).cast("bigint")
    stages.write_table(t["stg_ride_month"].withColumn("ride_cnt", wrong), root, "stg_ride_month")
    stages.reload_months(t["stg_ride_month"].filter(window), root, "stg_ride_month")
    return stages.read_table(t.spark, root, "stg_ride_month")


@query("refresh_months", "SELECT * FROM mart_growth_month", "mart_growth_month")
def _refresh_months(t: Tables) -> DataFrame:
    # one month is built with wrong counts and another without rides, then both are refreshed
    root, raw = t.scratch("refresh"), t.many(*K.RAW_TABLES)
    wrong = F.when(F.col("ride_ym") == 202405, F.col("ride_cnt_raw") + 1).otherwise(F.col("ride_cnt_raw"))
    rides = raw["raw_ride_month"].withColumn("ride_cnt_raw", wrong).filter("ride_ym <> 202410")
    stages.run(t.spark, root, raw=raw | {"raw_ride_month": rides}, gates=False)
    stages.run(t.spark, root, raw=raw, months=[202405, 202410])
    return stages.read_table(t.spark, root, "mart_growth_month")


@query("src_table_scan", """
SELECT month_ym, station_id, pass_group, ride_cnt FROM stg_ride_month
WHERE month_ym BETWEEN 202401 AND 202512""", "stg_ride_month")
def _src_table_scan(t: Tables) -> DataFrame:
    root = t.scratch("table-scan")
    stages.write_table(t["stg_ride_month"], root, "stg_ride_month")
    return stages.read_table(t.spark, root, "stg_ride_month") \
        .filter(F.col("month_ym").between(K.WINDOW_START, K.WINDOW_END)) \
        .select("month_ym", "station_id", "pass_group", "ride_cnt")


@query("chk_required_tables", "\nUNION ALL\n".join(
    [f"SELECT '{n}' AS table_name, true AS present, count(*) AS row_count FROM {n}" for n in K.RAW_TABLES]
    + [f"SELECT '{n}', false, NULL" for n in K.STG_TABLES]), *K.RAW_TABLES)
def _chk_required_tables(t: Tables) -> DataFrame:
    # raw stage written, staging not yet
    root = t.scratch("gate")
    for n in K.RAW_TABLES:
        stages.write_table(t[n], root, n)
    rows = {n: stages.read_table(t.spark, root, n) for n in stages.existing_tables(t.spark, root)}
    return checks.required_tables(t.spark, [*K.RAW_TABLES, *K.STG_TABLES], rows)


def _check_results_sql() -> str:
    parts = []
    for n in K.STG_TABLES:
        parts.append(f"SELECT 'staging' AS stage, 'row_count' AS check_name, '{n}' AS table_name, "
                     f"'rows' AS item, CAST(COUNT(*) AS DOUBLE) AS value FROM {n}")
    for n in K.STG_TABLES[:4]:
        c = K.MONTH_COLUMN[n]
        parts.append(f"SELECT 'staging', 'month_count', '{n}', 'months', "
                     f"CAST(COUNT(DISTINCT {c}) AS DOUBLE) FROM {n}")
    for tb, c in checks.NULL_RULES:
        parts.append(f"SELECT 'staging', 'null_count', '{tb}', '{c}', "
                     f"CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS DOUBLE) FROM {tb}")
    for tb, rule in (("stg_signup_month", "signup_cnt <= 0"), ("stg_ride_month", "ride_cnt <= 0"),
                     ("stg_station_snapshot", "rack_cnt <= 0"),
                     ("stg_station_usage_month", "checkout_cnt < 0"),
                     ("stg_station_usage_month", "return_cnt < 0")):
        parts.append(f"SELECT 'staging', 'issue_count', '{tb}', '{rule}', "
                     f"CAST(COUNT(*) AS DOUBLE) FROM {tb} WHERE {rule}")
    for n in K.MART_TABLES:
        parts.append(f"SELECT 'mart', 'row_count', '{n}', 'rows', CAST(COUNT(*) AS DOUBLE) FROM {n}")
    for n in K.MART_TABLES:
        parts.append(f"SELECT 'mart', 'month_count', '{n}', 'months', "
                     f"CAST(COUNT(DISTINCT month_ym) AS DOUBLE) FROM {n}")
    for n, c in (("stg_signup_month", "gender"), ("stg_ride_month", "gender"), ("stg_signup_month", "age_band"),
                 ("stg_ride_month", "age_band"), ("stg_ride_month", "pass_group")):
        parts.append(f"SELECT 'staging', '{c}_rows', '{n}', {c}, CAST(count(*) AS DOUBLE) FROM {n} GROUP BY {c}")
    parts.append("SELECT 'staging', 'pass_group_rides', 'stg_ride_month', pass_group, CAST(sum(ride_cnt) AS DOUBLE) "
                 "FROM stg_ride_month GROUP BY pass_group")
    parts.append("SELECT 'staging', 'station_count', 'stg_station_snapshot', CAST(snapshot_ym AS VARCHAR), "
                 "CAST(count(*) AS DOUBLE) FROM stg_station_snapshot GROUP BY snapshot_ym")
    for check, n, src, num, stage in (
            ("join_success_pct", "stg_ride_month", "join_matched", "matched_station_id", "staging"),
            ("id_extraction_pct", "stg_station_usage_month", "stg_station_usage_month", "station_id", "staging"),
            ("station_match_pct", "mart_station_efficiency_month", "station_joined", "rack_cnt", "mart")):
        parts.append(f"SELECT '{stage}', '{check}', '{n}', CAST(month_ym AS VARCHAR), "
                     f"{O.round_ratio(f'count({num})', 'count(*)', 2, 100)} FROM {src} GROUP BY month_ym")
    parts.append("SELECT 'mart', 'growth_validity', 'mart_growth_month', 'row_count', CAST(count(*) AS DOUBLE) "
                 "FROM mart_growth_month")
    parts += [f"SELECT 'mart', 'growth_validity', 'mart_growth_month', '{name}', "
              f"CAST(count(*) FILTER ({rule}) AS DOUBLE) FROM mart_growth_month" for name, rule in FLAGS.items()]
    parts.append(f"""SELECT * FROM (
        SELECT 'mart', 'top_rides_per_rack', 'mart_station_efficiency_month', month_ym || '|' || station_id,
               {O.round_ratio('total_ride_cnt', 'rack_cnt', 2)} AS value FROM station_joined WHERE rack_cnt > 0
        ORDER BY value DESC, month_ym, station_id LIMIT 20) top""")
    return "\nUNION ALL\n".join(parts)


@query("sink_check_results", _check_results_sql(), *K.STG_TABLES, *K.MART_TABLES, "join_matched", "station_joined")
def _sink_check_results(t: Tables) -> DataFrame:
    # staging and marts are stored once, and the checks read what is stored
    root = t.scratch("checks")
    stages.build(t.spark, root, raw=t, gates=False)
    return stages.read_table(t.spark, root, "check_results")
