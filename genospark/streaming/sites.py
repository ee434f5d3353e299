"""Streams of calls: sites are given out once all samples have come, or when their time is over; sessions of breakpoints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SITES = "locus long, site long, ncalls long, nalleles long, complete boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Completion(StatefulProcessor):
    """State of a site: the allele of each sample that has come (the first one counts), and whether the site was given out."""

    def __init__(self, samples: int, patience: int) -> None:
        self.samples, self.patience = samples, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "sample long", "allele long")
        self.given = handle.getValueState("given", "n long")

    def _row(self, key: tuple, complete: bool) -> pd.DataFrame:
        alleles = [a[0] for a in self.seen.values()]
        return pd.DataFrame({"locus": [key[0]], "site": [key[1]], "ncalls": [len(alleles)], "nalleles": [len({a for a in alleles if a is not None})], "complete": [complete]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given, known = self.given.exists(), self.seen.exists()
        for batch in rows:
            if not known and not given and len(batch):
                self.handle.registerTimer(int(batch["at"].min().timestamp() * 1000) + self.patience)
                known = True
            if given:
                continue
            for sample, allele in zip(batch["sample"], batch["allele"], strict=True):
                if not self.seen.containsKey((int(sample),)):
                    self.seen.updateValue((int(sample),), (None if pd.isna(allele) else int(allele),))
        if not given and known and len(list(self.seen.keys())) >= self.samples:
            yield self._row(key, True)
            self.given.update((1,))
            self.seen.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            yield self._row(key, False)
        self.seen.clear()
        self.given.clear()

    def close(self) -> None:
        pass


def completed_sites(calls: DataFrame, samples: int, patience: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """locus, site, ncalls, nalleles (distinct, without missing ones), complete: each site once, as soon as `samples` samples have come, else when the watermark has
    passed its first call's time by `patience`.

    calls: locus, site, sample, allele, ts.  The watermark is `late` behind the newest call; calls behind it are dropped by the engine.  Repeated calls of a sample
    count once; a missing allele is a call.  Calls of a site that come more than `patience` after it was closed open it again.
    """
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)
    at = calls.select("locus", "site", F.col("sample").cast("long").alias("sample"), F.col("allele").cast("long").alias("allele"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    return at.groupBy("locus", "site").transformWithStateInPandas(Completion(samples, wait), outputStructType=SITES, outputMode="Append", timeMode="EventTime")


def sessions(points: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """locus, session_start, session_end, n: breakpoints of a locus that follow each other within less than `gap`; the end is the last one's time plus the gap.

    Of a batch or a stream; a stream gives a session out when the watermark, `late` behind the newest breakpoint, has passed its end.
    """
    at = points.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    each = at.groupBy("locus", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return each.select("locus", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
