"""Helpers shared by the operators: table access and stored intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# the six characters that separate words, as a regular expression class
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; local sessions without one get their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _LOCAL:
        _LOCAL["root"] = os.path.join(tempfile.mkdtemp(prefix="run-"), "shared")
    return _LOCAL["root"]


_LOCAL: dict[str, str] = {}


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm-{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def learned_rows(doc_id: Column, modulus: int, held: int = 2) -> Column:
    """True where crc32 of the id's decimal text leaves another remainder than ``held``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) != held
