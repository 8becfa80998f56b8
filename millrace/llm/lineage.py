"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests, local mode)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def stage(df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back. tidy: waits until the shuffle files of finished jobs
    are gone, so that they and those of the next job do not stand on disk together."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _OWN.append((spark, path))
    for _ in range(2 * tidy):  # the context cleaner follows the collector in the background; some references take two turns
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def drop(*staged: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in staged:
        path = getattr(df, "_millrace_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _OWN[:] = [x for x in _OWN if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_OWN):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have ended before
            return
