"""Mart and check semantics on small literal frames (windows, spine, joins, checks)."""

from pyspark.sql import functions as F

from pedalytics import schemas as K
from pedalytics.operators import checks as Q
from pedalytics.operators import marts as M
from pedalytics.operators import staging as ST


def signup(spark, rows):
    return spark.createDataFrame(
        [("f", ym, f"{ym // 100}-{ym % 100:02d}-01", None, a, g, n, "t") for ym, g, a, n in rows],
        K.STG_SIGNUP)


def ride(spark, rows):
    out = []
    for ym, g, a, grp, n, sid, ops in rows:
        out.append(("f", ym, f"{ym // 100}-{ym % 100:02d}-01", sid, "n", f"S{sid}", "p", grp, g, a, n,
                    None, None, float(n), float(2 * n), ops, "t"))
    return spark.createDataFrame(out, K.STG_RIDE)


def test_growth_window_is_positional_and_uses_warmup(spark):
    s = signup(spark, [(202401, "F", "20대", 10)])
    r = ride(spark, [
        (202311, "F", "20대", K.SUBSCRIPTION, 4, 1, 0),
        (202312, "F", "20대", K.SUBSCRIPTION, 8, 1, 0),
        (202401, "F", "20대", K.SUBSCRIPTION, 6, 1, 0),
        (202401, "F", "20대", K.NON_SUBSCRIPTION, 2, 1, 0),
        # gap: no 202402 row for the segment
        (202403, "F", "20대", K.SUBSCRIPTION, 9, 1, 0),
        (202401, "M", "30대", K.NON_SUBSCRIPTION, 5, 1, 0),
    ])
    g = {(x.month_ym, x.gender): x for x in M.mart_growth_month(s, r).collect()}
    assert set(g) == {(202401, "F"), (202403, "F"), (202401, "M")}
    jan = g[(202401, "F")]
    assert (jan.signup_cnt, jan.sub_ride_cnt, jan.total_ride_cnt) == (10, 6, 8)
    assert jan.activation_proxy == 0.6 and jan.subscription_share == 0.75
    assert jan.retention_proxy_mom == 6 / 8                 # previous row = warm-up December
    assert jan.rolling_3m_persistence == 6 / 6.0            # mean of the two earlier rows (4, 8)
    mar = g[(202403, "F")]
    assert mar.retention_proxy_mom == 9 / 6                 # gap: compares with January
    assert mar.rolling_3m_persistence == 9 / ((4 + 8 + 6) / 3)
    m = g[(202401, "M")]
    assert m.activation_proxy is None and m.retention_proxy_mom is None
    assert m.rolling_3m_persistence is None and m.subscription_share == 0.0


def test_station_mart_match_flag_and_ops_exclusion(spark):
    r = ride(spark, [
        (202401, "F", "20대", K.SUBSCRIPTION, 6, 1, 0),
        (202401, "F", "20대", K.NON_SUBSCRIPTION, 4, 1, 0),
        (202401, "F", "20대", K.SUBSCRIPTION, 3, 2, 0),     # station 2 not in the snapshot
        (202401, "F", "20대", K.SUBSCRIPTION, 3, 9980, 1),  # operations station: excluded
        (202401, "F", "20대", K.SUBSCRIPTION, 3, None, 0),  # no station id: excluded
        (202312, "F", "20대", K.SUBSCRIPTION, 3, 1, 0),     # outside the window
    ])
    snap = spark.createDataFrame(
        [(202312, "x", 1, "Snap 1", "D", "a", 37.5, 127.0, None, 5, None, "LCD", 5, "t")],
        K.STG_SNAPSHOT)
    out = {x.station_id: x for x in M.mart_station_efficiency_month(
        r, snap, ST.month_snapshot_map(spark)).collect()}
    assert set(out) == {1, 2}
    a, b = out[1], out[2]
    assert (a.snapshot_ym, a.station_name, a.rack_cnt, a.total_ride_cnt) == (202312, "Snap 1", 5, 10)
    assert (a.sub_ride_cnt, a.non_sub_ride_cnt, a.rides_per_rack) == (6, 4, 2.0)
    assert a.station_snapshot_matched == 1 and a.subscription_share == 0.6
    assert b.station_snapshot_matched == 0 and b.rides_per_rack is None and b.station_name == "S2"


def test_sum_of_all_null_is_null_and_count_sum_semantics(spark):
    r = ride(spark, [(202401, "F", "20대", K.SUBSCRIPTION, 1, 1, 0)]) \
        .withColumn("distance_m", F.lit(None).cast("double"))
    m = M.mart_ride_segment_month(r).first()
    assert m.total_distance_m is None and m.avg_distance_m_per_ride is None
    empty = r.filter(F.lit(False))
    row = Q.growth_metrics(empty.select(
        F.lit(1).alias("signup_cnt"), F.lit(1).alias("sub_ride_cnt"), F.lit(1).alias("total_ride_cnt"),
        F.lit(1.0).alias("activation_proxy"), F.lit(1.0).alias("subscription_share"))).first()
    assert row.row_count == 0 and row.negative_signup_cnt is None


def test_unique_keys_reports_duplicates(spark):
    snap = spark.createDataFrame(
        [(202312, "x", 1, "a", "D", "a", 1.0, 1.0, None, 1, 1, "QR", 1, "t")] * 2, K.STG_SNAPSHOT)
    out = Q.unique_keys(snap, ST.month_snapshot_map(spark)).collect()
    assert [(r.table_name, r.key, r.n) for r in out] == [("stg_station_snapshot", "202312|1", 2)]


def test_completeness_gate_lists_gaps(spark):
    s = signup(spark, [(ym, "F", "20대", 1) for ym in range(202401, 202413) if ym != 202405]
               + [(ym, "F", "20대", 1) for ym in range(202501, 202513)])
    r = ride(spark, [(ym, "F", "20대", K.SUBSCRIPTION, 1, 1, 0)
                     for ym in [202310, 202311, 202312, *range(202401, 202413), *range(202501, 202513)]])
    u = spark.createDataFrame([("f", 202401, "d", "d", "n", 1, "n", 1, 1, "t")], K.STG_USAGE)
    snap = spark.createDataFrame(
        [(m, "x", 1, "a", "D", "a", 1.0, 1.0, None, 1, 1, "QR", 1, "t") for m in K.SNAPSHOT_MONTHS[:4]],
        K.STG_SNAPSHOT)
    gaps = Q.completeness_gate(spark, {"stg_signup_month": s, "stg_ride_month": r,
                                       "stg_station_usage_month": u, "stg_station_snapshot": snap})
    got = sorted((x.table_name, x.month_ym) for x in gaps.collect())
    assert ("stg_signup_month", 202405) in got
    assert ("stg_station_snapshot", 202512) in got
    assert len([g for g in got if g[0] == "stg_station_usage_month"]) == 23
    assert not [g for g in got if g[0] == "stg_ride_month"]


def test_expected_months_crosses_years(spark):
    got = [r.month_ym for r in Q.expected_months(spark, 202310, 202402).collect()]
    assert got == [202310, 202311, 202312, 202401, 202402]
