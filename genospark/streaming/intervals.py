"""Streams of breakpoints: windowed counts with late data, and intervals closed by the next breakpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERVALS = "locus long, start long, end long, nbps long, tidx long"


def windowed_counts(points: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, locus, n: breakpoints in tumbling windows of event time; rows later than the watermark are dropped by the engine."""
    at = points.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", width), "locus").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "locus", "n")


def closing_intervals(points: DataFrame) -> DataFrame:
    """Intervals of each locus as they are closed: the last breakpoint and the number of intervals are kept as state."""

    def close(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        out = []
        for at in sorted({int(p) for b in batches for p in b["position"]}):
            if last is not None and at > last:
                out.append((key[0], last, at, at - last, n))
                n += 1
            last = at if last is None else max(last, at)
        state.update((last, n))
        yield pd.DataFrame(out, columns=["locus", "start", "end", "nbps", "tidx"])

    return points.select("locus", "position").groupBy("locus").applyInPandasWithState(close, INTERVALS, "last long, n long", "append", "NoTimeout")
