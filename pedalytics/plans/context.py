"""Lazy table context: raw -> staging -> marts as DataFrames.

A ``Tables`` object hands out the DataFrame of any pipeline table.  Raw
tables come from a provider (the driver tables, files on disk, or tables
already written by the stage runner); everything downstream is derived
lazily, so asking for one mart plans only what that mart needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pedalytics import schemas as K
from pedalytics.operators import marts as M
from pedalytics.operators import staging as ST
from pedalytics.session import scratch_dir
from pedalytics.sources import driver_tables, export


class Tables:
    def __init__(self, spark: SparkSession, raw: Callable[[str], DataFrame],
                 stored: Callable[[str], DataFrame | None] | None = None):
        self.spark = spark
        self._raw = raw
        self._stored = stored or (lambda name: None)
        self._memo: dict[str, DataFrame] = {}
        self._files: dict[bool, tuple[str, set[str]]] = {}

    @classmethod
    def from_driver(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        return cls(spark, lambda name: driver_tables.RAW_BUILDERS[name](spark, sf_dir))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._memo:
            df = self._stored(name)
            self._memo[name] = df if df is not None else self._build(name)
        return self._memo[name]

    def _build(self, name: str) -> DataFrame:
        if name in K.RAW_TABLES:
            return self._raw(name)
        if name == "stg_month_station_snapshot_map":
            return ST.month_snapshot_map(self.spark)
        if name in ST.STAGING:
            raw_name, fn = ST.STAGING[name]
            return fn(self[raw_name])
        if name == "mart_signup_segment_month":
            return M.mart_signup_segment_month(self["stg_signup_month"])
        if name == "mart_ride_segment_month":
            return M.mart_ride_segment_month(self["stg_ride_month"])
        if name == "mart_growth_month":
            return M.mart_growth_month(self["stg_signup_month"], self["stg_ride_month"])
        if name == "mart_station_efficiency_month":
            return M.mart_station_efficiency_month(
                self["stg_ride_month"], self["stg_station_snapshot"],
                self["stg_month_station_snapshot_map"])
        raise KeyError(name)

    def source_files(self, *datasets: str, ordered: bool = False) -> str:
        """Folder holding this context's raw tables written out as source files.

        Only the requested datasets (default: all) are written, each once;
        ``ordered`` files begin with their least rows.
        """
        root, done = self._files.setdefault(ordered, (scratch_dir(self.spark, "source-files"), set()))
        for ds in datasets or tuple(export.DATASET_TABLES):
            if ds not in done:
                export.export_dataset(self[export.DATASET_TABLES[ds]], ds, root, ordered)
                done.add(ds)
        return root

    def scratch(self, label: str) -> str:
        return scratch_dir(self.spark, label)

    def many(self, *names: str) -> dict[str, DataFrame]:
        return {n: self[n] for n in names}
