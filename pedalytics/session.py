"""Session settings and the shared scratch folder.

The settings the pipeline relies on are applied to whatever session the
caller hands in (``configure``); ``local_session`` builds a small local
session for tests and benchmarks only.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# SQL settings the pipeline relies on
PIPELINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # cp949 / euc-kr source files need the JVM's legacy charset list
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in PIPELINE_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


_SHIPPED: set[tuple[int, str]] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers (``addPyFile``), once per session.

    The zip goes to the shared folder, from which every executor fetches it.
    A cluster that names none can run all queries that need no Python workers.
    """
    key = session_key(spark)
    if key in _SHIPPED:
        return
    if _named_root(spark) or _is_local(spark):
        pkg = os.path.dirname(os.path.abspath(__file__))
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in sorted(os.walk(pkg)):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        data = buf.getvalue()
        path = f"{checkpoint_root(spark)}/pyfiles/pedalytics-{hashlib.sha1(data).hexdigest()[:16]}.zip"
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(target):
            stream = fs.create(target)
            stream.write(bytearray(data))
            stream.close()
        spark.sparkContext.addPyFile(str(fs.makeQualified(target).toString()))
    _SHIPPED.add(key)


def local_session(cores: int | str = 8, shuffle_partitions: int = 8,
                  app: str = "pedalytics") -> SparkSession:
    """A local session for tests and benchmarks (UI off, small shuffle)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("PEDALYTICS_DRIVER_MEMORY", "16g"))
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               # call-site capture on every Column call makes building the
               # (expression-heavy) plans several times slower
               .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    for k, v in PIPELINE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)



def session_key(spark: SparkSession) -> tuple[int, str]:
    """Identity of a live session, for reusing plans built on it."""
    return id(spark), spark.sparkContext.applicationId


def _is_local(spark: SparkSession) -> bool:
    return (spark.conf.get("spark.master", None) or "local").split("[")[0] == "local"


def _named_root(spark: SparkSession) -> str | None:
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root.rstrip("/") if root else None


_LOCAL_ROOTS: dict[tuple[int, str], str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a fresh folder of its own; on
    a cluster that would be a different disk on every machine, so there the
    missing setting is an error.
    """
    if root := _named_root(spark):
        return root
    if not _is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = session_key(spark)
    if key not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[key] = os.path.join(tempfile.mkdtemp(prefix="run-"), "shared")
    return _LOCAL_ROOTS[key]


def scratch_dir(spark: SparkSession, label: str = "run") -> str:
    """A new, unique sub-folder of the checkpoint root (never reused, never cleared)."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
