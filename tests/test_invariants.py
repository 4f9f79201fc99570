"""Invariants that hold on any input (published-report relations, SURVEY section 5)."""

import random

import pytest
from pyspark.sql import functions as F

from pedalytics import schemas as K
from pedalytics.operators import checks as Q
from pedalytics.plans.context import Tables

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def t(spark):
    return Tables.from_driver(spark, SF_SMALL)


def test_signup_mart_total_equals_filtered_staging(t):
    stg = t["stg_signup_month"].filter(F.col("month_ym").between(K.WINDOW_START, K.WINDOW_END))
    assert t["mart_signup_segment_month"].agg(F.sum("signup_cnt")).first()[0] == \
        stg.agg(F.sum("signup_cnt")).first()[0]


def test_station_mart_sub_plus_non_sub_is_total(t):
    m = t["mart_station_efficiency_month"]
    assert m.filter(F.col("sub_ride_cnt") + F.col("non_sub_ride_cnt") != F.col("total_ride_cnt")).count() == 0


def test_join_check_totals_equal_station_mart(t):
    js = Q.join_success(t["stg_ride_month"], t["stg_station_snapshot"], t["stg_month_station_snapshot_map"])
    m = t["mart_station_efficiency_month"]
    a = js.agg(F.sum("ride_station_count"), F.sum("matched_station_count")).first()
    assert a[0] == m.count()
    assert a[1] == m.agg(F.sum("station_snapshot_matched")).first()[0]


def test_growth_keys_are_unique_and_inside_window(t):
    g = t["mart_growth_month"]
    assert g.groupBy("month_ym", "gender", "age_band").count().filter("count > 1").count() == 0
    assert g.filter(~F.col("month_ym").between(K.WINDOW_START, K.WINDOW_END)).count() == 0
    assert g.filter((F.col("subscription_share") < 0) | (F.col("subscription_share") > 1)).count() == 0


def test_staging_preserves_row_counts(t):
    for stg, (raw, _) in [("stg_signup_month", ("raw_signup_month", None)),
                          ("stg_ride_month", ("raw_ride_month", None)),
                          ("stg_station_usage_month", ("raw_station_usage_month", None))]:
        assert t[stg].count() == t[raw].count()


def test_join_success_counts_pairs_as_a_left_join_does(spark):
    """Ids that are negative, far apart, null or ends of a word; stations that a snapshot repeats; an unknown month."""
    rng = random.Random(4)
    ids = [None, -1, -64, -65, 0, 1, 63, 64, 127, 2**40, -2**62, 2**63 - 1, *range(200, 240)]
    rides = [(rng.choice([202401, 202402, 202403]), rng.choice(ids), rng.choice([0, 0, 0, 1])) for _ in range(400)]
    snaps = [(rng.choice([202312, 202406]), rng.choice(ids)) for _ in range(60)]
    lookup = {202401: 202312, 202402: 202406}
    got = Q.join_success(spark.createDataFrame(rides, "month_ym int, station_id long, is_ops_excluded int"),
                         spark.createDataFrame(snaps, "snapshot_ym int, station_id long"),
                         spark.createDataFrame(list(lookup.items()), "month_ym int, snapshot_ym int"))
    want = []
    for month, snap in lookup.items():
        own = {s for m, s, ops in rides if m == month and s is not None and not ops}
        found = [sum(x == (snap, s) for x in snaps) for s in own]
        want.append((month, snap, sum(max(n, 1) for n in found), sum(found)))
    assert any(n > 1 for n in found)
    assert [tuple(r)[:4] for r in got.collect()] == want


def test_id_sets_hold_every_distinct_id_once(spark):
    ids = [None, -1, -1, 0, 63, 64, 64, -64, -2**63, 2**63 - 1]
    df = spark.createDataFrame([(i % 2, x) for i, x in enumerate(ids * 3)], "k int, x long")
    got = dict(Q.id_sets(df, ["k"], "x").groupBy("k").agg(F.sum(F.bit_count("bits"))).collect())
    want = dict(df.groupBy("k").agg(F.count_distinct("x")).collect())
    assert got == want
    assert Q.id_sets(df.limit(0), ["k"], "x").count() == 0
