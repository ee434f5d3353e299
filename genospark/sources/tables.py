"""Written tables: results that later steps read again instead of computing them anew."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; unset, a local session takes one under /tmp."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file:///tmp/genospark-tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that iterations don't add up to one plan and a lost executor takes nothing along.

    The files go with `erase`, or when the session's Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/genospark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_erase, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def erase(*tables: DataFrame) -> None:
    """Delete tables that `written` has returned; nothing may read them any more."""
    for df in tables:
        _erase(df.sparkSession, df.written_at)


def _erase(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before Python does
        pass
