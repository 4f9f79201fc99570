"""Staging -> marts.

Shape of every mart: filter on the month key (pushed to the scan),
aggregate with map-side partial aggregation (group keys are few, so the
exchange carries a few rows per key per task even when one key holds a
third of the rows), then join small aggregated frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedalytics import schemas as K
from pedalytics.functions import columns as C

SEGMENT = ["month_ym", "month_date", "gender", "age_band"]


def _in_window(start: int = K.WINDOW_START, end: int = K.WINDOW_END):
    return F.col("month_ym").between(start, end)


def signup_by_segment(stg_signup: DataFrame, start: int = K.WINDOW_START,
                      end: int = K.WINDOW_END) -> DataFrame:
    return stg_signup.filter(_in_window(start, end)).groupBy(*SEGMENT) \
        .agg(F.sum("signup_cnt").alias("signup_cnt"))


def mart_signup_segment_month(stg_signup: DataFrame) -> DataFrame:
    """M1: signups by month x gender x age band."""
    return signup_by_segment(stg_signup)


def mart_ride_segment_month(stg_ride: DataFrame) -> DataFrame:
    """M2: rides by month x gender x age band x pass group, with per-ride means."""
    agg = stg_ride.filter(_in_window()).groupBy(
        *SEGMENT, F.col("pass_group").alias("ride_type")).agg(
        F.sum("ride_cnt").alias("ride_cnt"),
        F.sum("distance_m").alias("total_distance_m"),
        F.sum("duration_min").alias("total_duration_min"))
    return agg.select(
        *SEGMENT, "ride_type", "ride_cnt", "total_distance_m", "total_duration_min",
        C.safe_ratio("total_distance_m", "ride_cnt").alias("avg_distance_m_per_ride"),
        C.safe_ratio("total_duration_min", "ride_cnt").alias("avg_duration_min_per_ride"))


def ride_by_segment(stg_ride: DataFrame, start: int = K.WARMUP_START,
                    end: int = K.WINDOW_END) -> DataFrame:
    """Subscription and total rides per segment, warm-up months included."""
    return stg_ride.filter(_in_window(start, end)).groupBy(*SEGMENT).agg(
        F.sum(F.when(F.col("pass_group") == K.SUBSCRIPTION, F.col("ride_cnt"))
              .otherwise(F.lit(0).cast("bigint"))).alias("sub_ride_cnt"),
        F.sum("ride_cnt").alias("total_ride_cnt"))


def growth_base(stg_signup: DataFrame, stg_ride: DataFrame) -> DataFrame:
    """Every segment-month present in signups or rides, zero-filled.

    The reference builds a distinct key spine (UNION) and left-joins both
    aggregates to it.  Both sides are already aggregated to unique
    (month, gender, age band) keys that are never NULL (the standardisers
    map missing values to UNKNOWN, the window filter drops NULL months), so
    one full outer join yields exactly the spine with its values, and each
    base table is scanned once instead of twice.
    """
    on = ["month_ym", "gender", "age_band"]
    s = signup_by_segment(stg_signup).select(
        *on, F.col("month_date").alias("_sd"), F.col("signup_cnt").alias("_signup_cnt"))
    r = ride_by_segment(stg_ride).select(
        *on, F.col("month_date").alias("_rd"), F.col("sub_ride_cnt").alias("_sub"),
        F.col("total_ride_cnt").alias("_tot"))
    zero = F.lit(0).cast("bigint")
    return s.join(r, on, "full_outer").select(
        "month_ym", F.coalesce("_sd", "_rd").alias("month_date"), "gender", "age_band",
        F.coalesce("_signup_cnt", zero).alias("signup_cnt"),
        F.coalesce("_sub", zero).alias("sub_ride_cnt"),
        F.coalesce("_tot", zero).alias("total_ride_cnt"))


def segment_window() -> Window:
    return Window.partitionBy("gender", "age_band").orderBy("month_ym")


def with_growth_windows(base: DataFrame) -> DataFrame:
    """W1 + W2: previous row and mean of up to three previous rows per segment.

    Positional (ROWS) frames: a segment with a gap compares to its last
    present month, exactly like the SQL it mirrors.
    """
    w = segment_window()
    return base.select(
        "*",
        F.lag("sub_ride_cnt").over(w).alias("prev_sub_ride_cnt"),
        F.avg("sub_ride_cnt").over(w.rowsBetween(-3, -1)).alias("prev_3m_avg_sub_ride_cnt"))


def growth_from_base(base: DataFrame) -> DataFrame:
    """M3 from the zero-filled segment months (warm-up months included)."""
    return with_growth_windows(base).select(
        *SEGMENT, "signup_cnt", "sub_ride_cnt", "total_ride_cnt",
        C.safe_ratio("sub_ride_cnt", "signup_cnt").alias("activation_proxy"),
        C.safe_ratio("sub_ride_cnt", "total_ride_cnt").alias("subscription_share"),
        C.safe_ratio("sub_ride_cnt", "prev_sub_ride_cnt").alias("retention_proxy_mom"),
        C.safe_ratio("sub_ride_cnt", "prev_3m_avg_sub_ride_cnt").alias("rolling_3m_persistence"),
    ).filter(_in_window())  # after the window: warm-up months feed lag/avg, then drop


def mart_growth_month(stg_signup: DataFrame, stg_ride: DataFrame) -> DataFrame:
    """M3: activation, subscription share, month-over-month retention, 3-month persistence."""
    return growth_from_base(growth_base(stg_signup, stg_ride))


def reached_months(base: DataFrame, changed: list[int], ahead: int = 3) -> DataFrame:
    """Months of ``base`` whose growth rows a change of the given months can alter (``month_ym``).

    The windows count rows, not months: in each segment the ``ahead`` next
    rows after a changed month look back on it, however many months they are
    away.  Whether a changed month had or has a row does not matter: rows of
    other changed months are not counted, so none is missed.
    """
    before = F.array_max(F.filter(F.array(*[F.lit(m) for m in sorted(changed)]), lambda m: m < F.col("month_ym")))
    rows = base.filter(~F.col("month_ym").isin(changed)).withColumn("_after", before).filter("_after IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("gender", "age_band", "_after").orderBy("month_ym"))
    return rows.withColumn("_place", place).filter(F.col("_place") <= ahead).select("month_ym").distinct()


def ride_by_station(stg_ride: DataFrame) -> DataFrame:
    """Rides per (month, station) inside the window, operations stations excluded.

    ``MAX(station_name)`` over text would force a sort-based aggregate over
    every ride row.  The rows are therefore first reduced with a hash
    aggregate keyed by (month, station, name) -- map-side partial
    aggregation included -- and the max is taken over that small result.
    """
    sub = F.when(F.col("pass_group") == K.SUBSCRIPTION, F.col("ride_cnt")) \
        .otherwise(F.lit(0).cast("bigint"))
    non = F.when(F.col("pass_group") == K.NON_SUBSCRIPTION, F.col("ride_cnt")) \
        .otherwise(F.lit(0).cast("bigint"))
    keys = ["month_ym", "month_date", "station_id"]
    per_name = stg_ride.filter(_in_window() & F.col("station_id").isNotNull()
                               & (F.col("is_ops_excluded") == 0)) \
        .groupBy(*keys, "station_name").agg(
            F.sum("ride_cnt").alias("t"), F.sum(sub).alias("s"), F.sum(non).alias("n"),
            F.sum("distance_m").alias("d"), F.sum("duration_min").alias("m"))
    return per_name.groupBy(*keys).agg(
        F.max("station_name").alias("station_name_from_ride"),
        F.sum("t").alias("total_ride_cnt"),
        F.sum("s").alias("sub_ride_cnt"),
        F.sum("n").alias("non_sub_ride_cnt"),
        F.sum("d").alias("total_distance_m"),
        F.sum("m").alias("total_duration_min"))


def station_joined(stg_ride: DataFrame, stg_snapshot: DataFrame, month_map: DataFrame) -> DataFrame:
    """Month -> snapshot month -> station attributes (two left joins).

    The lookup has a fixed 24 rows, so it is broadcast explicitly.  The
    snapshot side grows with the number of stations; its strategy is left
    to the planner, which broadcasts only below the measured-size threshold
    and otherwise sort-merges on (snapshot_ym, station_id).
    """
    r = ride_by_station(stg_ride)
    m = F.broadcast(month_map.select("month_ym", "snapshot_ym"))
    s = stg_snapshot.select(
        F.col("snapshot_ym").alias("_snap"), F.col("station_id").alias("_sid"),
        F.col("station_name").alias("_sname"), "district", "lat", "lon", "rack_cnt")
    rm = r.join(m, "month_ym", "left")
    j = rm.join(s, (rm.snapshot_ym == s._snap) & (rm.station_id == s._sid), "left")
    return j.select(
        "month_ym", "month_date", "snapshot_ym", "station_id",
        F.coalesce("_sname", "station_name_from_ride").alias("station_name"),
        "district", "lat", "lon", "rack_cnt", "total_ride_cnt", "sub_ride_cnt",
        "non_sub_ride_cnt", "total_distance_m", "total_duration_min")


def mart_station_efficiency_month(stg_ride: DataFrame, stg_snapshot: DataFrame,
                                  month_map: DataFrame) -> DataFrame:
    """M4: per station-month rides per rack, subscription share, per-ride means, match flag."""
    j = station_joined(stg_ride, stg_snapshot, month_map)
    return j.select(
        "month_ym", "month_date", "snapshot_ym", "station_id", "station_name", "district",
        "lat", "lon", "rack_cnt", "total_ride_cnt", "sub_ride_cnt", "non_sub_ride_cnt",
        C.safe_ratio("sub_ride_cnt", "total_ride_cnt").alias("subscription_share"),
        C.safe_ratio("total_ride_cnt", "rack_cnt").alias("rides_per_rack"),
        "total_distance_m", "total_duration_min",
        C.safe_ratio("total_distance_m", "total_ride_cnt").alias("avg_distance_m_per_ride"),
        C.safe_ratio("total_duration_min", "total_ride_cnt").alias("avg_duration_min_per_ride"),
        F.when(F.col("rack_cnt").isNull(), F.lit(0)).otherwise(F.lit(1))
        .alias("station_snapshot_matched"))
