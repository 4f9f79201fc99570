"""Physical-plan properties that matter at scale (checked on the executed plan text)."""

import pytest

from pedalytics.operators import checks as Q
from pedalytics.plans import stages
from pedalytics.plans.context import Tables
from pedalytics.session import scratch_dir

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark):
    return Tables.from_driver(spark, SF_SMALL)


def test_growth_mart_scans_each_base_table_once(t):
    p = plan(t["mart_growth_month"])
    assert p.count("lineitem.parquet") == 1 and p.count("orders.parquet") == 1
    assert "Window" in p


def test_station_mart_hash_aggregates_ride_rows(t):
    p = plan(t["mart_station_efficiency_month"])
    # the aggregate right above the scan is a hash aggregate; the string max runs on reduced rows
    lines = [x.strip() for x in p.splitlines()]
    first_agg = [x for x in lines if "Aggregate" in x][-1]
    assert "HashAggregate" in first_agg
    assert "BroadcastHashJoin" in p  # the fixed 24-row month lookup


def test_lookup_is_a_jvm_literal(t):
    p = plan(t["stg_month_station_snapshot_map"])
    assert "ExistingRDD" not in p and "PythonRDD" not in p


def test_written_tables_prune_partitions_and_columns(spark, t):
    root = scratch_dir(spark, "plan-test")
    stages.write_table(t["stg_ride_month"], root, "stg_ride_month")
    df = stages.read_table(spark, root, "stg_ride_month") \
        .filter("month_ym BETWEEN 202401 AND 202512").select("month_ym", "ride_cnt")
    p = plan(df)
    assert "PartitionFilters: [isnotnull(month_ym" in p and "202401" in p
    assert "ReadSchema: struct<ride_cnt:bigint>" in p


def test_raw_scan_reads_only_needed_columns(t):
    p = plan(t["mart_signup_segment_month"])
    read = p[p.index("ReadSchema: struct<"):]
    read = read[:read.index(">")]
    assert "o_orderdate" in read and "o_custkey" not in read and "o_orderkey" not in read


def test_join_check_shuffles_bit_sets(t):
    p = plan(Q.join_success(t["stg_ride_month"], t["stg_station_snapshot"], t["stg_month_station_snapshot_map"]))
    assert "partial_bit_or" in p and "SortAggregate" not in p
    # ride rows are hash-aggregated to words of 64 ids before their first exchange
    lines = p.splitlines()
    scan = next(k for k, x in enumerate(lines) if "lineitem.parquet" in x)
    above = [x for x in lines[:scan] if "Exchange hashpartitioning" in x][-1]
    assert "station_id" not in above and "month_ym" in above
