"""The node table's periodic dump and its restore."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


def _versions(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = [p for p in found if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return fs, sorted(done, key=lambda p: int(p.getName()[2:]))


def save(nodes: DataFrame, path: str, keep: int = 2) -> None:
    """Write a new version; it counts once it is whole, and then older ones than the last ``keep`` go."""
    spark = nodes.sparkSession
    nodes.write.parquet(f"{path}/v={time.time_ns()}")
    fs, done = _versions(spark, path)
    for old in done[:-keep]:
        fs.delete(old, True)


def restore(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version, or None."""
    done = _versions(spark, path)[1]
    return spark.read.parquet(done[-1].toString()) if done else None
