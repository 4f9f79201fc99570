"""Data-quality checks over staging and mart tables.

Each check is a DataFrame.  Where the reference scans one table once per
UNION ALL branch, these compute all metrics of a table in one aggregate
and ``unpivot`` the row, so every table is scanned once per check.
Counts are exact (no approximate aggregates).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalytics import schemas as K
from pedalytics.functions import columns as C
from pedalytics.operators.staging import literal_rows


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def count_if_sum(pred: Column) -> Column:
    """SUM(CASE WHEN p THEN 1 ELSE 0 END) -- NULL on empty input, unlike count_if."""
    return F.sum(F.when(pred, F.lit(1)).otherwise(F.lit(0)))


def pct(num: Column, den: Column, digits: int = 2) -> Column:
    """ROUND(100.0 * num / den, digits) as double."""
    return F.round(F.lit(100.0) * num.cast("double") / den.cast("double"), digits)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) per table."""
    return union_all([df.agg(F.count(F.lit(1)).alias("row_count"))
                      .select(F.lit(name).alias("table_name"), "row_count")
                      for name, df in tables.items()])


def coverage(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """min/max/distinct count of the month column per table."""
    return union_all([
        df.agg(F.min(col).alias("min_ym"), F.max(col).alias("max_ym"),
               F.count_distinct(col).alias("month_count"))
        .select(F.lit(name).alias("table_name"), "min_ym", "max_ym", "month_count")
        for name, (df, col) in tables.items()])


def stations_per_snapshot(stg_snapshot: DataFrame) -> DataFrame:
    """D3."""
    return stg_snapshot.groupBy("snapshot_ym").agg(F.count(F.lit(1)).alias("station_count")) \
        .orderBy("snapshot_ym")


def distribution(frames: dict[str, DataFrame], column: str) -> DataFrame:
    """(dataset, value, row_count) per dataset, sorted by dataset and value."""
    return union_all([df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
                      .select(F.lit(name).alias("dataset"), column, "row_count")
                      for name, df in frames.items()]).orderBy("dataset", column)


def pass_group_distribution(stg_ride: DataFrame) -> DataFrame:
    """D5."""
    return stg_ride.groupBy("pass_group").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("ride_cnt").alias("ride_cnt_sum")) \
        .orderBy("pass_group")


def _unpivot_metrics(df: DataFrame, table: str, metrics: dict[str, Column],
                     key_name: str, value_name: str) -> DataFrame:
    row = df.agg(*[m.alias(f"m{i}") for i, m in enumerate(metrics.values())])
    long = row.unpivot([], [f"m{i}" for i in range(len(metrics))], "_k", value_name)
    labels = F.create_map(*[x for i, k in enumerate(metrics) for x in (F.lit(f"m{i}"), F.lit(k))])
    return long.select(F.lit(table).alias("table_name"),
                       F.element_at(labels, F.col("_k")).alias(key_name), value_name)


# (table, column) pairs checked for NULLs, as in the staging quality notebook
NULL_RULES = (
    ("stg_signup_month", "month_ym"),
    ("stg_signup_month", "signup_cnt"),
    ("stg_ride_month", "station_id"),
    ("stg_ride_month", "ride_cnt"),
    ("stg_station_snapshot", "station_id"),
    ("stg_station_snapshot", "rack_cnt"),
)

# (table, rule label, predicate) counted as zero/negative issues
NONPOSITIVE_RULES = (
    ("stg_signup_month", "signup_cnt <= 0", lambda: F.col("signup_cnt") <= 0),
    ("stg_ride_month", "ride_cnt <= 0", lambda: F.col("ride_cnt") <= 0),
    ("stg_station_snapshot", "rack_cnt <= 0", lambda: F.col("rack_cnt") <= 0),
    ("stg_station_usage_month", "checkout_cnt < 0", lambda: F.col("checkout_cnt") < 0),
    ("stg_station_usage_month", "return_cnt < 0", lambda: F.col("return_cnt") < 0),
)


def _grouped_by_table(rules):
    out: dict[str, list] = {}
    for r in rules:
        out.setdefault(r[0], []).append(r)
    return out


def null_counts(tables: dict[str, DataFrame], rules=NULL_RULES) -> DataFrame:
    """NULL count per (table, column); one scan per table."""
    frames = []
    for table, rs in _grouped_by_table(rules).items():
        metrics = {col: count_if_sum(F.col(col).isNull()) for _, col in rs}
        frames.append(_unpivot_metrics(tables[table], table, metrics, "column_name", "null_count"))
    return union_all(frames)


def nonpositive_counts(tables: dict[str, DataFrame], rules=NONPOSITIVE_RULES) -> DataFrame:
    """Rows violating each rule; one scan per table."""
    frames = []
    for table, rs in _grouped_by_table(rules).items():
        metrics = {label: F.count(F.when(pred(), F.lit(1))) for _, label, pred in rs}
        frames.append(_unpivot_metrics(tables[table], table, metrics, "check_item", "issue_count"))
    return union_all(frames)


def id_sets(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """A3: the distinct ids of each key as bit sets: ``keys, word, bits``, 64 neighbouring ids in a row.

    Bits are or-ed in a hash aggregate before the shuffle, so what is
    shuffled follows from the range of ids (sparse ids: one row each, as for
    a distinct), not from the rows.  Negative ids are fine; null ids are in
    no set.  ``sum(bit_count(bits))`` is the exact distinct count.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(id_col).bitwiseAND(63).cast("int"))
    return df.filter(F.col(id_col).isNotNull()).groupBy(*keys, F.shiftright(id_col, 6).alias("word")) \
        .agg(F.bit_or(bit).alias("bits"))


def join_success(stg_ride: DataFrame, stg_snapshot: DataFrame, month_map: DataFrame) -> DataFrame:
    """Share of distinct (month, station) pairs of rides found in the month's snapshot.

    Both sides meet as bit sets.  A station that a snapshot repeats counts
    once for each of its rows, as in a left join.
    """
    rides = id_sets(stg_ride.filter(F.col("is_ops_excluded") == 0), ["month_ym"], "station_id") \
        .join(F.broadcast(month_map), "month_ym", "inner")
    rows = stg_snapshot.filter(F.col("station_id").isNotNull()).groupBy("snapshot_ym", "station_id") \
        .agg((F.count(F.lit(1)) - 1).alias("more"))
    spot = F.struct(F.col("station_id").bitwiseAND(63).cast("int").alias("at"), "more")
    snapshots = id_sets(rows, ["snapshot_ym"], "station_id").withColumnRenamed("bits", "known")
    again = rows.filter("more > 0").groupBy("snapshot_ym", F.shiftright("station_id", 6).alias("word")) \
        .agg(F.collect_list(spot).alias("again"))  # at most 64 in a list
    j = rides.join(snapshots, ["snapshot_ym", "word"], "left").join(again, ["snapshot_ym", "word"], "left")
    extra = F.coalesce(F.aggregate("again", F.lit(0).cast("long"), lambda n, x: n + F.when(
        F.getbit(F.col("bits"), x["at"]) == 1, x["more"]).otherwise(0)), F.lit(0))
    pairs = F.sum(F.bit_count("bits") + extra)
    matched = F.sum(F.coalesce(F.bit_count(F.col("bits").bitwiseAND(F.col("known"))), F.lit(0)) + extra)
    return j.groupBy("month_ym", "snapshot_ym").agg(
        pairs.alias("ride_station_count"), matched.alias("matched_station_count"),
        pct(matched, pairs).alias("join_success_rate_pct")).orderBy("month_ym")


def id_extraction(stg_usage: DataFrame) -> DataFrame:
    """Share of usage rows whose station id could be split off the name."""
    ok = count_if_sum(F.col("station_id").isNotNull())
    return stg_usage.groupBy("month_ym").agg(
        F.count(F.lit(1)).alias("row_count"), ok.alias("station_id_extracted_count"),
        pct(ok, F.count(F.lit(1))).alias("extract_success_rate_pct")).orderBy("month_ym")


def growth_metrics(growth: DataFrame) -> DataFrame:
    """Validity metrics of the growth mart in one row."""
    share = F.col("subscription_share")
    return growth.agg(
        F.count(F.lit(1)).alias("row_count"),
        count_if_sum(F.col("signup_cnt") < 0).alias("negative_signup_cnt"),
        count_if_sum(F.col("sub_ride_cnt") < 0).alias("negative_sub_ride_cnt"),
        count_if_sum(F.col("total_ride_cnt") < 0).alias("negative_total_ride_cnt"),
        count_if_sum(F.col("activation_proxy").isNull()).alias("null_activation_proxy"),
        count_if_sum(share.isNull()).alias("null_subscription_share"),
        count_if_sum((share < 0) | (share > 1)).alias("invalid_subscription_share"))


def station_match(station: DataFrame) -> DataFrame:
    """Snapshot match rate and rack problems per month."""
    matched = F.sum("station_snapshot_matched")
    return station.groupBy("month_ym").agg(
        F.count(F.lit(1)).alias("station_month_count"),
        matched.alias("matched_count"),
        pct(matched, F.count(F.lit(1))).alias("matched_rate_pct"),
        count_if_sum(F.col("rack_cnt").isNull()).alias("null_rack_cnt_count"),
        count_if_sum(F.col("rack_cnt") <= 0).alias("zero_or_negative_rack_cnt_count"),
    ).orderBy("month_ym")


def top_rides_per_rack(station: DataFrame, k: int = 20) -> DataFrame:
    """Top-k station-months by rides per rack (racks > 0).

    Sorted by the rounded value like the SQL (output alias wins), with
    (month_ym, station_id) as tie-breakers so the result is deterministic.
    ``orderBy + limit`` plans as TakeOrderedAndProject: each task keeps k rows.
    """
    return station.filter(F.col("rack_cnt") > 0).select(
        "month_ym", "station_id", "station_name", "district", "total_ride_cnt", "rack_cnt",
        C.round_half_up("rides_per_rack", 2).alias("rides_per_rack"),
        C.round_half_up("subscription_share", 3).alias("subscription_share"),
    ).orderBy(F.col("rides_per_rack").desc_nulls_last(), "month_ym", "station_id").limit(k)


def growth_sample(growth: DataFrame, k: int = 20) -> DataFrame:
    """First k growth rows in key order."""
    return growth.orderBy("month_ym", "gender", "age_band").limit(k)


# tables with a declared key, as in the original table definitions
UNIQUE_KEYS = {"stg_month_station_snapshot_map": ("month_ym",), "stg_station_snapshot": ("snapshot_ym", "station_id")}


def key_counts(tables: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """Per table its rows, distinct keys and keys that occur more than once."""
    frames = []
    for name, (df, key) in tables.items():
        per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        frames.append(per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                                  F.count(F.lit(1)).alias("key_count"),
                                  F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_keys"))
                      .select(F.lit(name).alias("table_name"), "*"))
    return union_all(frames)


def unique_keys(stg_snapshot: DataFrame, month_map: DataFrame) -> DataFrame:
    """Keys that occur more than once (empty when the keys are unique)."""
    dup_map = month_map.groupBy("month_ym").agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") > 1).select(
            F.lit("stg_month_station_snapshot_map").alias("table_name"),
            F.col("month_ym").cast("string").alias("key"), "n")
    dup_snap = stg_snapshot.groupBy("snapshot_ym", "station_id").agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") > 1).select(
            F.lit("stg_station_snapshot").alias("table_name"),
            F.concat_ws("|", F.col("snapshot_ym").cast("string"),
                        F.col("station_id").cast("string")).alias("key"), "n")
    return dup_map.unionByName(dup_snap)


def expected_months(spark: SparkSession, start: int, end: int) -> DataFrame:
    """Months start..end (yyyymm) as a DataFrame, generated from a range."""
    y0, m0, y1, m1 = start // 100, start % 100, end // 100, end % 100
    n = (y1 - y0) * 12 + (m1 - m0) + 1
    i = F.col("id")
    ym = ((F.lit(y0) + F.floor((F.lit(m0 - 1) + i) / 12)) * 100
          + (F.lit(m0 - 1) + i) % 12 + 1).cast("int")
    return spark.range(0, max(n, 0), 1, 1).select(ym.alias("month_ym"))


def completeness(spark: SparkSession, stg: dict[str, DataFrame], start: int = K.WINDOW_START,
                 ride_start: int = K.WARMUP_START) -> DataFrame:
    """Every expected month of each table with its row count and whether there are rows.

    Sign-ups and usage must cover the window, rides the warm-up months as
    well, and the snapshots the five snapshot months.
    """
    frames = []
    for name, first in (("stg_signup_month", start), ("stg_ride_month", ride_start),
                        ("stg_station_usage_month", start), ("stg_station_snapshot", None)):
        if first is None:
            want = literal_rows(spark, [(m,) for m in K.SNAPSHOT_MONTHS], ["month_ym"], ["int"])
        else:
            want = expected_months(spark, first, K.WINDOW_END)
        seen = stg[name].groupBy(F.col(K.MONTH_COLUMN[name]).alias("month_ym")).agg(F.count(F.lit(1)).alias("n"))
        frames.append(want.join(seen, "month_ym", "left").select(
            F.lit(name).alias("table_name"), "month_ym", F.coalesce("n", F.lit(0)).alias("row_count"),
            F.col("n").isNotNull().alias("present")))
    return union_all(frames)


def completeness_gate(spark: SparkSession, stg: dict[str, DataFrame]) -> DataFrame:
    """Expected months without rows (empty when the gate passes)."""
    return completeness(spark, stg).filter(~F.col("present")).select("table_name", "month_ym")


def required_tables(spark: SparkSession, required: list[str], rows: dict[str, DataFrame]) -> DataFrame:
    """Every required table with whether it exists and its row count (NULL where it does not)."""
    req = literal_rows(spark, [(t,) for t in required], ["table_name"], ["string"])
    have = literal_rows(spark, [], ["table_name"], ["string"]).withColumn("row_count", F.lit(0).cast("long"))
    if rows:
        have = row_counts(rows)
    return req.join(have, "table_name", "left").select(
        "table_name", F.col("row_count").isNotNull().alias("present"), "row_count")


class GateFailed(RuntimeError):
    """A stage's input is not fit for the next stage; the message lists the first faults."""


def stop_if_any(gate: str, faults: DataFrame, shown: int = 20) -> None:
    """Stop the run where a gate has faults; at most ``shown`` of them are read."""
    found = faults.limit(shown).collect()
    if found:
        raise GateFailed(f"{gate}: " + "; ".join(str(r.asDict()) for r in found))


def profile(df: DataFrame, table: str, month: str | None) -> DataFrame:
    """All stored counts of one table from one scan: rows, months, NULLs and rule violations."""
    metrics: dict[tuple[str, str], Column] = {("row_count", "rows"): F.count(F.lit(1))}
    if month:
        metrics["month_count", "months"] = F.count_distinct(month)
    metrics |= {("null_count", c): F.count(F.when(F.col(c).isNull(), 1)) for t, c in NULL_RULES if t == table}
    metrics |= {("issue_count", label): F.count(F.when(pred(), 1)) for t, label, pred in NONPOSITIVE_RULES if t == table}
    row = df.agg(*[m.cast("double").alias(f"m{i}") for i, m in enumerate(metrics.values())])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), F.lit(item).alias("item"),
                 F.col(f"m{i}").alias("value")) for i, (check, item) in enumerate(metrics)])))
