"""Stage runner from source files: files -> raw -> staging -> marts -> checks, all written."""

import pytest
from pyspark.sql import functions as F

from pedalytics import schemas as K
from pedalytics.operators import checks as Q
from pedalytics.plans import stages
from pedalytics.plans.context import Tables
from pedalytics.session import scratch_dir
from pedalytics.sources.driver_tables import LOADED_AT

from .conftest import SF_SMALL


def _rows(df):
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_runner_from_files_matches_direct_marts(spark):
    t = Tables.from_driver(spark, SF_SMALL)
    src = t.source_files()
    out = scratch_dir(spark, "runner-test")
    paths = stages.run(spark, out, source_root=src, loaded_at=LOADED_AT)
    assert set(paths) >= set(K.RAW_TABLES) | set(K.STG_TABLES) | set(K.MART_TABLES) | {"check_results"}
    for name in K.MART_TABLES:
        written = stages.read_table(spark, out, name)
        assert _rows(written) == _rows(t[name]), name
    checks = stages.read_table(spark, out, "check_results")
    rows = {(r.stage, r.check_name, r.table_name, r.item): r.value for r in checks.collect()}
    assert rows[("mart", "row_count", "mart_growth_month", "rows")] == t["mart_growth_month"].count()
    assert rows[("staging", "issue_count", "stg_ride_month", "ride_cnt <= 0")] == \
        t["stg_ride_month"].filter(F.col("ride_cnt") <= 0).count()
    assert {"check_csv_files", "check_workbooks", "check_datasets", "check_preview"} <= set(paths)
    assert stages.read_table(spark, out, "check_preview").count() == 4
    plans = stages.check_results(stages.stored_tables(spark, out, paths))._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plans


def test_full_refresh_leaves_no_old_month_and_reload_only_replaces_its_own(spark):
    root = scratch_dir(spark, "refresh-test")
    rides = Tables.from_driver(spark, SF_SMALL)["stg_ride_month"]
    two = rides.filter("month_ym IN (202401, 202402)")
    n = {m: rides.filter(f"month_ym = {m}").count() for m in (202401, 202402)}
    stages.write_table(two, root, "stg_ride_month")
    stages.reload_months(two.filter("month_ym = 202402").limit(1), root, "stg_ride_month")
    assert stages.read_table(spark, root, "stg_ride_month").count() == n[202401] + 1
    stages.write_table(two.filter("month_ym = 202402"), root, "stg_ride_month")
    got = stages.read_table(spark, root, "stg_ride_month")
    assert got.count() == n[202402] and got.filter("month_ym = 202401").isEmpty()
    with pytest.raises(ValueError):
        stages.reload_months(two, root, "raw_station_snapshot")


def test_gates_stop_the_run(spark):
    t = Tables.from_driver(spark, SF_SMALL)
    raw = t.many(*K.RAW_TABLES)
    out = scratch_dir(spark, "gate-test")
    with pytest.raises(Q.GateFailed, match="raw_station_snapshot"):
        stages.run(spark, out, raw={n: df for n, df in raw.items() if n != "raw_station_snapshot"})
    assert not set(stages.existing_tables(spark, out)) & set(K.STG_TABLES)
    out = scratch_dir(spark, "gate-test")
    with pytest.raises(Q.GateFailed, match="missing months.*202405"):
        stages.run(spark, out, raw=raw | {"raw_ride_month": raw["raw_ride_month"].filter("ride_ym <> 202405")})
    out = scratch_dir(spark, "gate-test")
    snap = raw["raw_station_snapshot"]
    with pytest.raises(Q.GateFailed, match="repeated keys.*stg_station_snapshot"):
        stages.run(spark, out, raw=raw | {"raw_station_snapshot": snap.unionByName(snap.limit(1))})
    assert not set(stages.existing_tables(spark, out)) & set(K.MART_TABLES)
