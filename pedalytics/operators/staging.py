"""Raw -> staging.

Every staging table is a single ``select`` over its raw table: map-only,
no shuffle, one whole-stage-codegen span.  Filters written later on
``month_ym`` are pushed through these projections to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalytics import schemas as K
from pedalytics.functions import columns as C
from pedalytics.session import session_key


def stg_signup_month(raw: DataFrame) -> DataFrame:
    ym = F.col("signup_ym").cast("int")
    return raw.select(
        "source_file",
        ym.alias("month_ym"),
        C.month_date(ym).alias("month_date"),
        C.blank_to_null("member_type_raw").alias("member_type"),
        C.age_band("age_band_raw").alias("age_band"),
        C.gender("gender_raw").alias("gender"),
        F.col("signup_cnt_raw").cast("bigint").alias("signup_cnt"),
        "loaded_at",
    )


def _cleaned(c: str) -> F.Column:
    """Trim -> blank to NULL -> drop commas (the text part of T6)."""
    return C.strip_commas(C.blank_to_null(c))


def stg_ride_month(raw: DataFrame) -> DataFrame:
    # Two projections: the cleaned texts are computed once, and the lenient
    # casts (which read their input several times) refer to them as plain
    # columns.  Catalyst keeps the projections apart instead of copying the
    # text expressions into every use, so the generated code stays small.
    ym = F.col("ride_ym").cast("int")
    text = raw.select(
        "source_file", ym.alias("month_ym"), "station_id_raw",
        F.trim("station_name_raw").alias("station_name_raw"),
        F.trim("pass_type_raw").alias("pass_type"), "gender_raw", "age_band_raw",
        F.col("ride_cnt_raw").cast("bigint").alias("ride_cnt"),
        *[_cleaned(f"{c}_raw").alias(f"_{c}") for c in NUMBERS],
        "loaded_at")
    typed = text.select(
        "source_file", "month_ym", C.month_date("month_ym").alias("month_date"),
        C.lenient_long("station_id_raw").alias("station_id"),
        "station_name_raw",
        C.station_name_from_name("station_name_raw").alias("station_name"),
        "pass_type",
        C.pass_group("pass_type").alias("pass_group"),
        C.gender("gender_raw").alias("gender"),
        C.age_band("age_band_raw").alias("age_band"),
        "ride_cnt",
        *[C.lenient_double(f"_{c}").alias(c) for c in NUMBERS],
        "loaded_at")
    return typed.select(
        "source_file", "month_ym", "month_date", "station_id", "station_name_raw", "station_name",
        "pass_type", "pass_group", "gender", "age_band", "ride_cnt", *NUMBERS,
        C.ops_flag("station_id", "station_name_raw").alias("is_ops_excluded"), "loaded_at")


NUMBERS = ("exercise_amt", "carbon_amt", "distance_m", "duration_min")


def stg_station_snapshot(raw: DataFrame) -> DataFrame:
    text = raw.select(
        F.col("snapshot_ym").cast("int").alias("snapshot_ym"),
        "source_file", "station_id_raw",
        F.trim("station_name_raw").alias("station_name"),
        F.trim("district_raw").alias("district"),
        F.trim("address_raw").alias("address"),
        _cleaned("lat_raw").alias("_lat"), _cleaned("lon_raw").alias("_lon"),
        C.blank_to_null("installed_at_raw").alias("installed_at_raw"),
        _cleaned("rack_lcd_raw").alias("_lcd"), _cleaned("rack_qr_raw").alias("_qr"),
        F.trim("operation_type_raw").alias("operation_type"),
        "loaded_at",
    )
    base = text.select(
        "snapshot_ym", "source_file", C.lenient_long("station_id_raw").alias("station_id"),
        "station_name", "district", "address",
        C.lenient_double("_lat").alias("lat"), C.lenient_double("_lon").alias("lon"),
        "installed_at_raw", C.lenient_long("_lcd").alias("rack_lcd"),
        C.lenient_long("_qr").alias("rack_qr"), "operation_type", "loaded_at")
    return base.filter(F.col("station_id").isNotNull()).select(
        "snapshot_ym", "source_file", "station_id", "station_name", "district", "address",
        "lat", "lon", "installed_at_raw", "rack_lcd", "rack_qr", "operation_type",
        C.rack_cnt("operation_type", "rack_lcd", "rack_qr").alias("rack_cnt"),
        "loaded_at",
    )


def stg_station_usage_month(raw: DataFrame) -> DataFrame:
    ym = F.col("usage_ym").cast("int")
    text = raw.select(
        "source_file", ym.alias("month_ym"), F.trim("district_raw").alias("district"),
        F.trim("station_name_raw").alias("station_name_raw"),
        F.col("checkout_cnt_raw").cast("bigint").alias("checkout_cnt"),
        F.col("return_cnt_raw").cast("bigint").alias("return_cnt"), "loaded_at")
    return text.select(
        "source_file", "month_ym", C.month_date("month_ym").alias("month_date"), "district",
        "station_name_raw",
        C.station_id_from_name("station_name_raw").alias("station_id"),
        C.station_name_from_name("station_name_raw").alias("station_name"),
        "checkout_cnt", "return_cnt", "loaded_at",
    )


def literal_rows(spark: SparkSession, rows, names: list[str], types: list[str]) -> DataFrame:
    """A small literal table planned as a JVM-side local relation (no Python round trip)."""
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types)]) for r in rows]
    if not structs:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in zip(names, types)])
    return spark.range(1).select(F.inline(F.array(*structs)))


_MAPS: dict[tuple[int, str], DataFrame] = {}


def month_snapshot_map(spark: SparkSession) -> DataFrame:
    """The 24-row month -> snapshot lookup (primary key month_ym, checked by D19)."""
    key = session_key(spark)
    if key not in _MAPS:
        _MAPS[key] = literal_rows(spark, K.MONTH_SNAPSHOT_MAP, ["month_ym", "snapshot_ym"],
                                  ["int", "int"])
    return _MAPS[key]


STAGING = {
    "stg_signup_month": ("raw_signup_month", stg_signup_month),
    "stg_ride_month": ("raw_ride_month", stg_ride_month),
    "stg_station_snapshot": ("raw_station_snapshot", stg_station_snapshot),
    "stg_station_usage_month": ("raw_station_usage_month", stg_station_usage_month),
}
