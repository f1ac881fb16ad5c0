"""Session helpers: shipping this package to executors, the shared folder, a local builder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers (once for an application)."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="sectorlake-")  # of the driver, which serves the file to executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "sectorlake.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for place, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(place, name)
                        z.write(full, os.path.join("sectorlake", os.path.relpath(full, root)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def local_session(cores: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, where it is
    unset (one machine, tests) a folder beside the warehouse."""
    have = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return (have or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's JVM ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def keep(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and
    survives the loss of any executor.  The folder goes when the driver ends."""
    path = fresh_path(df.sparkSession, "kept")
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
