"""Stage runner: raw -> staging -> marts -> checks, each stage written out.

Every stage is written as Parquet under ``out_root`` and the next stage
reads what was written.  That cuts the lineage at each stage boundary: a
lost executor costs at most a recomputation of the current stage, never
a replay from the source files.  Monthly tables are partitioned by their
month column, so month filters prune whole folders, and a re-run of
some months replaces just those partitions (dynamic partition overwrite).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pedalytics import schemas as K
from pedalytics.operators import checks as Q
from pedalytics.operators import filecheck
from pedalytics.operators import marts as M
from pedalytics.operators.staging import literal_rows
from pedalytics.plans.context import Tables
from pedalytics.sources import files, landing, loaders
from pedalytics.session import configure

# tables written partitioned by their month column
PARTITIONED = {"raw_signup_month": "signup_ym", "raw_ride_month": "ride_ym", "raw_station_usage_month": "usage_ym",
               "growth_base_month": "month_ym", **{n: "month_ym" for n in (
                   "stg_signup_month", "stg_ride_month", "stg_station_usage_month", *K.MART_TABLES)}}
# monthly raw tables and the staging tables made of them, month by month
MONTHLY = {"raw_signup_month": "stg_signup_month", "raw_ride_month": "stg_ride_month",
           "raw_station_usage_month": "stg_station_usage_month"}


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> str:
    """S20 (append) / S21 (full refresh: nothing of the old table stays) / S23 as a Parquet write."""
    return _write(df, root, name, mode, "static")


def reload_months(df: DataFrame, root: str, name: str) -> str:
    """Replace the months that ``df`` holds rows of, and only those, in a table partitioned by month."""
    if name not in PARTITIONED:
        raise ValueError(f"{name} is not partitioned by month")
    return _write(df, root, name, "overwrite", "dynamic")


def replace_months(df: DataFrame, root: str, name: str, months: list[int]) -> str:
    """Replace the given months by the rows that ``df`` holds of them; a month without rows leaves the table."""
    spark, part = df.sparkSession, PARTITIONED[name]
    path = reload_months(df.filter(F.col(part).isin(months)), root, name)
    found = {r[0] for r in read_table(spark, root, name).filter(F.col(part).isin(months)).select(part).distinct().collect()}
    if found:  # months that the write did not touch still hold what was there before
        kept = {r[0] for r in df.filter(F.col(part).isin(sorted(found))).select(part).distinct().collect()}
        for month in found - kept:
            fs, p = files._hadoop(spark, f"{path}/{part}={month}")
            fs.delete(p, True)
    return path


# month numbers (year * 12 + month) that one bitmap holds
BITMAP_BITS = 32_768


def observed_counts(month: str) -> list:
    """Aggregates of a table that can be taken while it is written: rows, first and last month, months as bits."""
    number = F.floor(F.col(month) / 100) * 12 + F.col(month) % 100
    inside = F.when(number.between(0, BITMAP_BITS - 1), number)
    return [F.count(F.lit(1)).alias("row_count"), F.min(month).alias("min_ym"), F.max(month).alias("max_ym"),
            F.count(F.when(F.col(month).isNotNull() & inside.isNull(), 1)).alias("odd"),
            F.bitmap_construct_agg(F.coalesce(inside, F.lit(0)).cast("long")).alias("bits")]


def write_counted(df: DataFrame, root: str, name: str) -> dict:
    """``write_table`` with the table's rows and months, counted in the same pass."""
    month = K.MONTH_COLUMN.get(name, "month_ym")
    seen = Observation()
    write_table(df.observe(seen, *observed_counts(month)), root, name)
    got = seen.get
    months = sum(bin(b).count("1") for b in bytes(got["bits"])[:BITMAP_BITS // 8]) - (bytes(got["bits"])[0] & 1)
    if got["odd"]:  # months that are none: count them as they stand
        months = read_table(df.sparkSession, root, name).agg(F.count_distinct(month)).first()[0]
    return {"table_name": name, **{k: got[k] for k in ("row_count", "min_ym", "max_ym")}, "month_count": months}


COUNTS = {"table_name": "string", "row_count": "bigint", "min_ym": "int", "max_ym": "int", "month_count": "bigint"}


def counts_table(spark: SparkSession, counts: list[dict]) -> DataFrame:
    return literal_rows(spark, [tuple(c[k] for k in COUNTS) for c in counts], list(COUNTS), list(COUNTS.values()))


def build_marts(spark: SparkSession, root: str) -> list[dict]:
    """All marts from the stored staging tables, and their counts (D11, D12) as they are written.

    The growth mart's segment months are stored on their own, so that later
    runs of some months need only those months' rides and sign-ups.
    """
    t = stored_tables(spark, root, K.STG_TABLES)
    write_table(M.growth_base(t["stg_signup_month"], t["stg_ride_month"]), root, "growth_base_month")
    growth = M.growth_from_base(read_table(spark, root, "growth_base_month"))
    return [write_counted(growth if n == "mart_growth_month" else t[n], root, n) for n in K.MART_TABLES]


def refresh(spark: SparkSession, root: str, raw: dict[str, DataFrame], months: list[int]) -> dict[str, str]:
    """Bring the given months of the monthly raw tables, and all that depends on them, up to date.

    ``raw`` holds the monthly raw tables (or those that changed); only their
    rows of ``months`` are used, and they replace what was stored.  Staging
    tables and marts are made again for these months alone, from rows of these
    months alone; the growth mart also for the months whose windows reach back
    to them (``reached_months``).  Snapshots do not change here.
    """
    months = sorted(set(months))
    for n, df in raw.items():
        if n not in MONTHLY:
            raise ValueError(f"{n} is not a monthly table")
        replace_months(df, root, n, months)
    own = Tables(spark, lambda n: read_table(spark, root, n).filter(F.col(PARTITIONED[n]).isin(months))
                 if n in MONTHLY else read_table(spark, root, n))
    for n in raw:
        replace_months(own[MONTHLY[n]], root, MONTHLY[n], months)

    def stored(n: str) -> DataFrame | None:
        if n not in K.STG_TABLES:
            return None
        df = read_table(spark, root, n)
        return df.filter(F.col("month_ym").isin(months)) if n in MONTHLY.values() else df

    t = Tables(spark, lambda n: read_table(spark, root, n), stored=stored)
    replace_months(M.growth_base(t["stg_signup_month"], t["stg_ride_month"]), root, "growth_base_month", months)
    for n in K.MART_TABLES:
        if n != "mart_growth_month":
            replace_months(t[n], root, n, months)
    base = read_table(spark, root, "growth_base_month")
    reached = sorted({*months, *(r[0] for r in M.reached_months(base, months).collect())})
    replace_months(M.growth_from_base(base), root, "mart_growth_month", reached)
    paths = {n: table_path(root, n) for n in (*raw, *K.STG_TABLES, "growth_base_month", *K.MART_TABLES)}
    t = stored_tables(spark, root, [*K.STG_TABLES, *K.MART_TABLES])
    paths["check_results"] = write_table(check_results(t), root, "check_results")
    marts = Q.union_all([t[n].agg(F.count(F.lit(1)).alias("row_count"), F.min("month_ym").alias("min_ym"),
                                  F.max("month_ym").alias("max_ym"), F.count_distinct("month_ym").alias("month_count"))
                         .select(F.lit(n).alias("table_name"), "*") for n in K.MART_TABLES])
    paths["table_counts"] = write_table(marts, root, "table_counts")
    return paths


def _write(df: DataFrame, root: str, name: str, mode: str, replaced: str) -> str:
    path = table_path(root, name)
    part = PARTITIONED.get(name)
    # REBALANCE lets AQE size the written files: rows of one month meet in
    # few tasks (no file per task per month), a month bigger than the
    # advisory size is split over several tasks, small outputs are coalesced.
    df = df.hint("rebalance", part) if part else df.hint("rebalance")
    w = df.write.mode(mode).option("partitionOverwriteMode", replaced)
    if part:
        w = w.partitionBy(part)
    w.parquet(path)
    return path


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan of a written table (partition columns come back as columns)."""
    return spark.read.parquet(table_path(root, name))


def existing_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the tables completely written under ``root`` (metadata listing)."""
    fs, p = files._hadoop(spark, root)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p)
                  if s.isDirectory() and files.exists(spark, f"{s.getPath().toString()}/_SUCCESS"))


def check_results(t: Tables) -> DataFrame:
    """Staging and mart checks as one long table (stage, check_name, table_name, item, value).

    The counts of a table (rows, months, NULLs, rule violations) come from one
    scan of it; distributions and rates from one grouped scan each.
    """
    def long(check: str, table: str, df: DataFrame, item: list, value: str) -> DataFrame:
        return df.select(F.lit(check).alias("check_name"), F.lit(table).alias("table_name"),
                         F.concat_ws("|", *[F.col(c).cast("string") for c in item]).alias("item"),
                         F.col(value).cast("double").alias("value"))

    stg, marts = t.many(*K.STG_TABLES), t.many(*K.MART_TABLES)
    ride, station = stg["stg_ride_month"], marts["mart_station_efficiency_month"]
    passes = Q.pass_group_distribution(ride)
    growth = Q.growth_metrics(marts["mart_growth_month"])
    match = Q.station_match(station)
    staging = [Q.profile(df, n, K.MONTH_COLUMN.get(n) if n in K.STG_TABLES[:4] else None) for n, df in stg.items()] + [
        long("station_count", "stg_station_snapshot", Q.stations_per_snapshot(stg["stg_station_snapshot"]),
             ["snapshot_ym"], "station_count"),
        *[long(f"{c}_rows", n, Q.distribution({n: stg[n]}, c), [c], "row_count")
          for c in ("gender", "age_band") for n in ("stg_signup_month", "stg_ride_month")],
        long("pass_group_rows", "stg_ride_month", passes, ["pass_group"], "row_count"),
        long("pass_group_rides", "stg_ride_month", passes, ["pass_group"], "ride_cnt_sum"),
        long("join_success_pct", "stg_ride_month", Q.join_success(
            ride, stg["stg_station_snapshot"], stg["stg_month_station_snapshot_map"]),
            ["month_ym"], "join_success_rate_pct"),
        long("id_extraction_pct", "stg_station_usage_month", Q.id_extraction(stg["stg_station_usage_month"]),
             ["month_ym"], "extract_success_rate_pct")]
    mart = [Q.profile(df, n, "month_ym") for n, df in marts.items()] + [
        long("growth_validity", "mart_growth_month", growth.unpivot([], growth.columns, "metric", "value"),
             ["metric"], "value"),
        long("station_match_pct", "mart_station_efficiency_month", match, ["month_ym"], "matched_rate_pct"),
        long("top_rides_per_rack", "mart_station_efficiency_month", Q.top_rides_per_rack(station),
             ["month_ym", "station_id"], "rides_per_rack")]
    return Q.union_all([f.select(F.lit(stage).alias("stage"), "*") for stage, own in (("staging", staging), ("mart", mart))
                        for f in own])


def stored_tables(spark: SparkSession, root: str, names) -> Tables:
    """Tables read from what is written under ``root``; others are derived from those."""
    have = set(names)
    return Tables(spark, lambda n: read_table(spark, root, n),
                  stored=lambda n: read_table(spark, root, n) if n in have else None)


def require(spark: SparkSession, root: str, names: tuple[str, ...]) -> None:
    """Stop unless all named tables are written under ``root`` and hold rows."""
    rows = {n: read_table(spark, root, n) for n in existing_tables(spark, root) if n in names}
    Q.stop_if_any("missing or empty tables", Q.required_tables(spark, list(names), rows)
                  .filter("NOT present OR row_count = 0"))


def build(spark: SparkSession, out_root: str, raw: Tables | None = None, gates: bool = True) -> dict[str, str]:
    """Staging, marts and checks from the raw tables under ``out_root`` (or given ones), every stage written."""
    paths: dict[str, str] = {}
    if raw is None:
        if gates:
            require(spark, out_root, K.RAW_TABLES)
        raw = stored_tables(spark, out_root, K.RAW_TABLES)
    for n in K.STG_TABLES:
        paths[n] = write_table(raw[n], out_root, n)
    t = stored_tables(spark, out_root, paths)
    if gates:
        require(spark, out_root, K.STG_TABLES)
        Q.stop_if_any("missing months", Q.completeness_gate(spark, t.many(*K.STG_TABLES)))
        Q.stop_if_any("repeated keys", Q.unique_keys(t["stg_station_snapshot"], t["stg_month_station_snapshot_map"]))
    counts = build_marts(spark, out_root)
    paths |= {n: table_path(out_root, n) for n in ("growth_base_month", *K.MART_TABLES)}
    paths["table_counts"] = write_table(counts_table(spark, counts), out_root, "table_counts")
    t = stored_tables(spark, out_root, paths)
    paths["check_results"] = write_table(check_results(t), out_root, "check_results")
    return paths


def run(spark: SparkSession, out_root: str, raw: dict[str, DataFrame] | None = None,
        source_root: str | None = None, loaded_at: str | None = None, gates: bool = True,
        months: list[int] | None = None) -> dict[str, str]:
    """Load (from files or given raw frames), stage, build marts, check; every stage written.

    With ``months`` only these are brought up to date in an ``out_root`` that
    an earlier run has filled (see ``refresh``).

    With ``gates`` the run stops before the next stage on a missing or empty
    table, a missing month or a repeated key.  Loads from files also store the
    file checks and previews.
    """
    configure(spark)
    paths = {}
    if raw is None:
        raw, paths = load(spark, out_root, source_root, loaded_at)
    if months is not None:
        return paths | refresh(spark, out_root, {n: df for n, df in raw.items() if n in MONTHLY}, months)
    paths |= {n: write_table(df, out_root, n) for n, df in raw.items()}
    return paths | build(spark, out_root, gates=gates)


def load(spark: SparkSession, out_root: str, source_root: str, loaded_at: str | None = None
         ) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Land the source files, store their checks and preview, and return the raw tables over what has landed.

    CSV files are parsed once; a later run into the same ``out_root`` parses
    only files that are new or changed.  Stops, after the checks and rejected
    rows are stored, where a file could not be read or holds broken rows.
    """
    entries = landing.land(spark, source_root, out_root)
    tables = {"check_csv_files": filecheck.landed_file_checks(spark, entries),
              "check_workbooks": filecheck.xlsx_file_check(spark, source_root),
              "check_header_doubts": landing.header_doubts(spark, entries),
              "check_preview": filecheck.sample_preview(spark, source_root),
              "rejected_rows": landing.rejected_rows(spark, out_root, entries)}
    paths = {n: write_table(df, out_root, n) for n, df in tables.items()}
    stored = [read_table(spark, out_root, n) for n in ("check_csv_files", "check_workbooks")]
    paths["check_datasets"] = write_table(filecheck.dataset_summary(*stored), out_root, "check_datasets")
    landing.require_clean(entries)
    raw = {f"raw_{ds}": loaders.load_landed(spark, out_root, ds, entries, loaded_at) for ds in K.PERIOD_COLUMNS}
    return raw | {"raw_station_snapshot": loaders.load_raw_station_snapshot(spark, source_root, loaded_at)}, paths
