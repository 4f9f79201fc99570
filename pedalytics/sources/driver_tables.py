"""Raw tables derived from the driver's TPC-H-style tables.

The public monthly extracts are not available here, so the four raw
tables are derived from ``orders`` / ``lineitem`` / ``supplier`` /
``nation``.  The mapping plants the awkward values the staging rules
exist for (numeric text like '12.0', 'nan' ids, thousands separators,
blanks around values, quotes and commas inside names, operations stations,
gap months, stations missing from a snapshot, zero racks).  Every row of the
ride and sign-up sources is used: gaps arise by relabelling, never by a filter.

Scale notes: signup and ride are map-only scans of one table each (no
join); usage pre-aggregates lineitem to (month, supplier) before it meets
``supplier``, and the snapshot is ``supplier`` (+ 25-row ``nation``) times
five months.  Join strategies are left to Catalyst/AQE, which broadcast by
measured size only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalytics import schemas as K

LOADED_AT = "2026-01-01 00:00:00"
YEAR_SHIFT = 28  # moves 1995-2001 ship dates onto 2023-2029


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ym(ts: Column) -> Column:
    return ((F.year(ts) + YEAR_SHIFT) * 100 + F.month(ts)).cast("int")


def _yearly_file(prefix: str, ts: Column) -> Column:
    return F.concat(F.lit(prefix), (F.year(ts) + YEAR_SHIFT).cast("string"), F.lit(".csv"))


def _txt(c: Column) -> Column:
    return c.cast("bigint").cast("string")


def _signup_age(priority: Column, status: Column, month: Column) -> Column:
    """Age band by order priority; two bands lack some months or a whole gender, so windows meet gaps."""
    return (F.when((priority == "5-LOW") & (month == 6), "20대")
            .when((priority == "1-URGENT") & (status == "P"), " 30대 ")
            .when(priority == "1-URGENT", "20대").when(priority == "2-HIGH", " 30대 ")
            .when(priority == "3-MEDIUM", "~10대").when(priority == "4-NOT SPECIFIED", "nan")
            .otherwise("기타"))


def _ride_age(d: Column, month: Column) -> Column:
    """Age band by discount; the last band has no rides in June."""
    return (F.when((d >= 0.075) & (month == 6), "20대").when(d < 0.015, "20대").when(d < 0.035, " 30대 ")
            .when(d < 0.055, "~10대").when(d < 0.075, "nan").otherwise("기타"))


def raw_signup_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_driver(spark, sf_dir, "orders").select(
        "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice")
    keyed = o.select(
        _yearly_file("서울특별시 공공자전거 신규가입자 정보(월별)_", F.col("o_orderdate"))
        .alias("source_file"),
        _ym(F.col("o_orderdate")).alias("signup_ym"),
        F.when(F.col("o_totalprice") >= 250000, "단체").otherwise("개인").alias("member_type_raw"),
        _signup_age(F.col("o_orderpriority"), F.col("o_orderstatus"), F.month("o_orderdate")).alias("age_band_raw"),
        F.when(F.col("o_orderstatus") == "F", "f").when(F.col("o_orderstatus") == "O", " M")
        .otherwise("nan").alias("gender_raw"),
    )
    keys = ["source_file", "signup_ym", "member_type_raw", "age_band_raw", "gender_raw"]
    return keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("signup_cnt_raw")) \
        .select(*keys, "signup_cnt_raw", F.lit(LOADED_AT).alias("loaded_at"))


def raw_ride_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_driver(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    supp = _txt(F.col("l_suppkey"))
    qty = F.floor("l_quantity").cast("bigint")
    price = F.floor("l_extendedprice").cast("bigint")
    distance = F.when(F.col("l_extendedprice") >= 1000, F.concat(
        _txt(F.floor(F.col("l_extendedprice") / 1000)), F.lit(","),
        F.lpad((price % 1000).cast("string"), 3, "0"))).otherwise(price.cast("string"))
    return li.select(
        _yearly_file("서울특별시 공공자전거 이용정보(월별)_", F.col("l_shipdate")).alias("source_file"),
        _ym(F.col("l_shipdate")).alias("ride_ym"),
        F.when(F.col("l_suppkey") % 25 == 24, "9980")
        .when(F.col("l_linenumber") == 7, F.concat(supp, F.lit(".0")))
        .when(F.col("l_partkey") % 97 == 0, "nan")
        .when(F.col("l_partkey") % 89 == 0, F.concat(supp, F.lit("D")))
        .when(F.col("l_partkey") % 83 == 0, "9007199254740993").otherwise(supp).alias("station_id_raw"),
        F.when(F.col("l_partkey") % 50 == 0, "중랑 as센터")
        .when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("Station "), supp))
        .otherwise(F.concat(F.lit(" "), supp, F.lit(". Station "), supp, F.lit("."),
                            _txt(F.col("l_partkey") % 3), F.lit(" "))).alias("station_name_raw"),
        F.when(F.col("l_returnflag") == "N", " 정기권").when(F.col("l_returnflag") == "A", "DAY_MEMBER")
        .otherwise("DAY_GUEST").alias("pass_type_raw"),
        F.when(F.col("l_linestatus") == "F", "m").when(F.col("l_orderkey") % 3 == 0, "nan")
        .otherwise("F ").alias("gender_raw"),
        _ride_age(F.col("l_discount"), F.month("l_shipdate")).alias("age_band_raw"),
        qty.alias("ride_cnt_raw"),
        F.when(F.col("l_linenumber") == 1, "nan").otherwise(F.concat(qty.cast("string"), F.lit(".5")))
        .alias("exercise_amt_raw"),
        F.when(F.col("l_linenumber") == 2, "").otherwise(".25").alias("carbon_amt_raw"),
        distance.alias("distance_m_raw"),
        (qty * 7).cast("string").alias("duration_min_raw"),
        F.lit(LOADED_AT).alias("loaded_at"),
    )


def snapshot_file_name(snapshot_ym: Column) -> Column:
    """'공공자전거 대여소 정보(YY.M월 기준).xlsx' for a yyyymm snapshot month."""
    return F.concat(F.lit("공공자전거 대여소 정보("), F.substring(snapshot_ym.cast("string"), 3, 2),
                    F.lit("."), (snapshot_ym % 100).cast("string"), F.lit("월 기준).xlsx"))


def raw_station_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_driver(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    n = read_driver(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    months = F.array(*[F.lit(m) for m in K.SNAPSHOT_MONTHS])
    sn = s.join(n, s.s_nationkey == n.n_nationkey).select(
        "s_suppkey", "s_acctbal", "n_name", F.explode(months).alias("snapshot_ym"))
    # stations opened after mid-2024 and stations closed before the last snapshot
    sn = sn.filter(~((F.col("snapshot_ym") <= 202406) & (F.col("s_acctbal") < 0))
                   & ~((F.col("snapshot_ym") == 202512) & (F.col("s_acctbal") > 9000)))
    k = F.col("s_suppkey")
    sk = _txt(k)
    return sn.select(
        F.col("snapshot_ym").cast("int").alias("snapshot_ym"),
        snapshot_file_name(F.col("snapshot_ym")).alias("source_file"),
        sk.alias("station_id_raw"),
        F.concat(F.lit(" Station "), sk).alias("station_name_raw"),
        F.col("n_name").alias("district_raw"),
        F.concat(F.lit("addr "), sk).alias("address_raw"),
        F.concat(F.lit("37."), sk).alias("lat_raw"),
        F.concat(F.lit("127."), sk).alias("lon_raw"),
        F.when(k % 3 == 0, F.concat(F.lit("2020-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"),
                                    F.when(k % 2 == 0, " 09:30:00").otherwise(" 00:00:00")))
        .when(k % 3 == 1, _txt(k % 100 + 43831)).otherwise("2020-01-01").alias("installed_at_raw"),
        F.when(k % 5 == 0, "nan").otherwise(_txt(k % 7)).alias("rack_lcd_raw"),
        F.when(k % 5 == 1, "nan").otherwise(_txt(k % 9 + 5)).alias("rack_qr_raw"),
        F.when(k % 5 == 0, "QR").when(k % 5 == 1, "LCD").when(k % 5 == 2, "LCD,QR")
        .when(k % 5 == 3, " QR ").otherwise("OTHER").alias("operation_type_raw"),
        F.lit(LOADED_AT).alias("loaded_at"),
    )


def raw_station_usage_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_driver(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    qty = F.floor("l_quantity").cast("bigint")
    # aggregate to (month, station) before meeting the dimension tables
    per_station = li.groupBy(
        _yearly_file("서울특별시 공공자전거 대여소별 이용정보(월별)_", F.col("l_shipdate")).alias("source_file"),
        _ym(F.col("l_shipdate")).alias("usage_ym"), F.col("l_suppkey"),
    ).agg(F.sum(qty).alias("checkout_cnt_raw"),
          F.sum(F.when(F.col("l_returnflag") == "R", qty).otherwise(F.lit(0).cast("bigint")))
          .alias("return_cnt_raw"))
    s = read_driver(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_driver(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = per_station.join(s, per_station.l_suppkey == s.s_suppkey) \
        .join(n, s.s_nationkey == n.n_nationkey)
    sk = _txt(F.col("s_suppkey"))
    return j.select(
        "source_file", "usage_ym", F.col("n_name").alias("district_raw"),
        F.when(F.col("s_suppkey") % 10 == 9, F.concat(F.lit("Station "), sk))
        .when(F.col("s_suppkey") % 10 == 8, F.concat(sk, F.lit('. "Station" '), sk, F.lit(', "east"')))
        .otherwise(F.concat(sk, F.lit(". Station "), sk)).alias("station_name_raw"),
        "checkout_cnt_raw", "return_cnt_raw", F.lit(LOADED_AT).alias("loaded_at"),
    )


RAW_BUILDERS = {
    "raw_signup_month": raw_signup_month,
    "raw_ride_month": raw_ride_month,
    "raw_station_snapshot": raw_station_snapshot,
    "raw_station_usage_month": raw_station_usage_month,
}


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: build(spark, sf_dir) for name, build in RAW_BUILDERS.items()}
