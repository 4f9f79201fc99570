"""Runs of some months, counts taken while writing, row order of ordered checks, load time text."""

import re

import pytest
from pyspark.sql import functions as F

from pedalytics import schemas as K
from pedalytics.functions import columns as C
from pedalytics.operators import marts as M
from pedalytics.plans import registry, stages
from pedalytics.plans.context import Tables
from pedalytics.session import scratch_dir

from .conftest import SF_SMALL
from .test_marts import ride, signup

MONTHS = [202310, 202312, 202401, 202402, 202403, 202406, 202407, 202408, 202411]


def fixture(spark, without=None, more=0):
    """Segments with gaps; ``without``: a month that has no rows at all; ``more``: added to all its counts."""
    s, r = [], []
    for i, ym in enumerate(MONTHS):
        if ym == without:
            continue
        plus = more if ym == 202403 else 0
        if ym >= 202401 and i % 2:
            s.append((ym, "F", "20대", 10 + i + plus))
        r.append((ym, "F", "20대", K.SUBSCRIPTION, 5 + i * i + plus, 1, 0))
        if i % 3 != 1:
            r.append((ym, "M", "30대", K.SUBSCRIPTION, 50 - i + plus, 2, 0))
        if i in (2, 5):
            r.append((ym, "M", "70대~", K.NON_SUBSCRIPTION, 3 + plus, 1, 0))
    return signup(spark, s), ride(spark, r)


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(str, df.select(*cols).collect()))


def test_reached_months_are_enough_for_every_month(spark):
    full = M.growth_base(*fixture(spark))
    want = {str(r) for r in M.growth_from_base(full).collect()}
    for month in MONTHS:
        old = {str(r) for r in M.growth_from_base(M.growth_base(*fixture(spark, without=month))).collect()}
        differ = {int(re.search(r"month_ym=(\d+)", x).group(1)) for x in want ^ old}
        reached = {r[0] for r in M.reached_months(full, [month]).collect()}
        assert differ <= reached | {month}, month
        assert len(reached) <= 5  # three rows in each segment, not all that follow
    both = {r[0] for r in M.reached_months(full, [202401, 202402]).collect()}
    assert {202403, 202406, 202407} <= both


@pytest.fixture(scope="module")
def driver(spark):
    return Tables.from_driver(spark, SF_SMALL)


def test_a_run_of_some_months_equals_a_full_one(spark, driver):
    raw = driver.many(*K.RAW_TABLES)
    changed = dict(raw)
    changed["raw_ride_month"] = raw["raw_ride_month"].filter("ride_ym <> 202406").withColumn(
        "ride_cnt_raw", F.when(F.col("ride_ym") == 202409, F.col("ride_cnt_raw") * 3).otherwise(F.col("ride_cnt_raw")))
    changed["raw_signup_month"] = raw["raw_signup_month"].filter("signup_ym <> 202406")
    months = [202406, 202409]
    want, got = scratch_dir(spark, "full"), scratch_dir(spark, "some")
    stages.run(spark, want, raw=changed, gates=False)
    stages.run(spark, got, raw=raw, gates=False)
    before = {n: stages.read_table(spark, got, n).filter("month_ym = 202403").select(F.input_file_name()).distinct().collect()
              for n in K.MART_TABLES}
    stages.run(spark, got, raw=changed, months=months)
    for n in (*stages.MONTHLY, *stages.MONTHLY.values(), "growth_base_month", *K.MART_TABLES, "check_results"):
        a, b = stages.read_table(spark, got, n), stages.read_table(spark, want, n)
        assert rows(a) == rows(b), n
    for n in K.MART_TABLES:  # other months were not written again
        assert stages.read_table(spark, got, n).filter("month_ym = 202403").select(
            F.input_file_name()).distinct().collect() == before[n]
    counts = [rows(stages.read_table(spark, r, "table_counts")) for r in (want, got)]
    assert counts[0] == counts[1]
    with pytest.raises(ValueError, match="not a monthly table"):
        stages.refresh(spark, got, {"raw_station_snapshot": raw["raw_station_snapshot"]}, months)


def test_counts_taken_while_writing(spark):
    root = scratch_dir(spark, "counted")
    df = spark.createDataFrame([(202401, 1), (202401, 2), (202512, 3), (None, 4)], "month_ym int, n int")
    assert stages.write_counted(df, root, "mart_growth_month") == {
        "table_name": "mart_growth_month", "row_count": 4, "min_ym": 202401, "max_ym": 202512, "month_count": 2}
    odd = spark.createDataFrame([(99_999_999, 1), (202401, 1), (-5, 1)], "month_ym int, n int")
    assert stages.write_counted(odd, root, "mart_growth_month")["month_count"] == 3
    none = stages.write_counted(df.limit(0), root, "mart_growth_month")
    assert (none["row_count"], none["min_ym"], none["month_count"]) == (0, None, 0)


def test_marts_are_counted_in_one_scan_of_each_source(spark, monkeypatch):
    scans = []
    write = stages.write_table

    def told(df, root, name, *more):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        scans.extend(t for t in ("l_shipdate", "o_orderdate") if t in plan)
        return write(df, root, name, *more)
    monkeypatch.setattr(stages, "write_table", told)
    counts = registry.QUERIES["dq_mart_coverage"](Tables.from_driver(spark, SF_SMALL))
    assert counts.count() == 4
    # the rides' table and the usage table, the sign-ups' table; no mart goes back to a source
    assert scans.count("l_shipdate") == 2 and scans.count("o_orderdate") == 1


# ordered checks: (columns, descending) in the order that their rows must have
ORDERED = {
    "dq_stations_per_snapshot": ["snapshot_ym"], "dq_gender_dist": ["dataset", "gender"],
    "dq_age_band_dist": ["dataset", "age_band"], "dq_pass_group_dist": ["pass_group"], "dq_join_success": ["month_ym"],
    "dq_id_extraction": ["month_ym"], "dq_station_match": ["month_ym"],
    "topk_rides_per_rack": ["-rides_per_rack", "month_ym", "station_id"],
    "topk_growth_sample": ["month_ym", "gender", "age_band"]}


@pytest.mark.parametrize("name", ORDERED)
def test_rows_of_ordered_checks_come_in_order(driver, name):
    got = registry.QUERIES[name](driver).collect()
    keys = [tuple((r[c] is not None, r[c]) if c[0] != "-" else (r[c[1:]] is None, -(r[c[1:]] or 0)) for c in ORDERED[name])
            for r in got]
    assert len(got) > 1 and keys == sorted(keys)


def test_load_time_is_text_and_one_for_all_rows(spark):
    df = spark.range(0, 100_000, 1, 8).select(C.now_text().alias("t"))
    got = [r.t for r in df.distinct().collect()]
    assert len(got) == 1 and re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", got[0])
    two = df.unionByName(df).distinct().collect()
    assert len(two) == 1
