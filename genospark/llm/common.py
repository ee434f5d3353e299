"""Shared plumbing: tables, intermediate tables in the shared folder, words."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; unset, a local session takes one under /tmp."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file:///tmp/genospark-shared-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's Python process ends."""
    path = f"{shared_dir(spark)}/genospark/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


#: A write is a query of its own, so its shuffle files may go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder (in folders by a column, if named) and read it back: lineage is cut by files every executor sees.

    The files go with `drop`, or when the session's Python process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that `stored` has returned; nothing may read them any more."""
    for df in tables:
        if df is not None:
            _delete(df.sparkSession, df.stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before Python does
        pass


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece has about `most` bytes of text, or one row."""
    for b in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0), dtype=np.int64) if b.num_rows else []
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if b.num_rows > start:
            yield b.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc_bucket(column, n: int):
    """crc32 of the value as text, modulo n (null: as the empty text)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % n
