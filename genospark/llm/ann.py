"""Approximate nearest neighbours by cosine: inverted lists with an adaptive dimension scan.

Index.  Unit vectors are dealt to the lists of a spherical k-means fitted on a bounded sample (`sample` rows);
every vector is indexed.  The number of probed lists is the smallest that reaches `recall` on a part of the sample that the lists were not
fitted on.

Scan.  Vectors are turned by one random rotation and compared in column blocks.  After k of d
dimensions a candidate is abandoned if sqrt(d/k) times its partial distance exceeds (1 + eps/sqrt(k)) times the
distance of the k-th best so far: a test of the hypothesis that the full distance is within reach.  A query scans its nearest list
first; the k-th best found there is the threshold that it takes to its other lists.
Survivors are scored exactly, in double precision, on the original vectors.  Queries that find fewer than `top` while there are
more candidates (their lists hold few vectors) scan all lists.

Skew.  Of equal vectors only the top + 1 smallest ids can ever be returned, so no more are candidates; equal
queries are searched once.  Lists are cut into blocks of bounded size, and so are the queries of a list.

Edge cases.  Vectors that are null, zero, or hold null or non-finite components take no part.  Vectors of different lengths have no
cosine: each length is searched for itself, one after the other.  Queries with fewer candidates get all of them.
Rows that share a vec_id are one vector if equal, else each is a candidate under that id.  Empty tables give
an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

FOUND = "qk1 long, qk2 long, vec_id long, score double"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), k1, k2 (digest of the vector) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), F.reverse("v"))})


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so that squares don't overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 7) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(steps):
        near = (x @ c.T).argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        size = np.sqrt((new * new).sum(axis=1))
        c[size > 0] = new[size > 0] / size[size > 0, None]
    return c


def probes_needed(x: np.ndarray, c: np.ndarray, top: int, recall: float, queries: np.ndarray) -> int:
    """The smallest number of lists whose vectors hold `recall` of the true neighbours of the sample's rows `queries`."""
    near = (x @ c.T).argmax(axis=1)
    sims = x[queries] @ x.T
    sims[np.arange(len(queries)), queries] = -2
    best = np.argpartition(-sims, min(top, len(x) - 1) - 1, axis=1)[:, :top]
    place = np.empty((len(queries), len(c)), dtype=np.int64)
    order = np.argsort(-(x[queries] @ c.T), axis=1)
    np.put_along_axis(place, order, np.arange(len(c))[None, :], axis=1)
    need = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    return int(need[min(len(need) - 1, math.ceil(recall * len(need)))]) + 1


def scan(q: np.ndarray, c: np.ndarray, turn: np.ndarray, top: int, block: int, eps: float, reach: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query: indices of the surviving candidates, and their exact cosines.

    reach: the distance of each query's `top`-th best so far (infinite: none yet).
    """
    d = c.shape[1]
    uq, uc = unit(q), unit(c)
    rq, rc = (uq @ turn).astype(np.float32), (uc @ turn).astype(np.float32)
    cuts = [*range(0, d, block), d]
    first = slice(cuts[0], cuts[1])
    begun = ((rq[:, None, first] ** 2).sum(axis=2) + (rc[None, :, first] ** 2).sum(axis=2)) - 2 * rq[:, first] @ rc[:, first].T
    out = []
    for i in range(len(q)):
        part, alive, near = begun[i], np.arange(len(c)), math.inf if reach is None else float(reach[i])
        if len(c) > top:
            # the worst of the `top` that look nearest after the first block are a threshold too
            seed = np.argpartition(part, top - 1)[:top]
            near = min(near, math.sqrt(max(0.0, float(((rq[i] - rc[seed]) ** 2).sum(axis=1).max()))))
        if near < math.inf:
            for lo, hi in zip(cuts[1:-1], cuts[2:], strict=True):
                # squared, with room for the rounding of single-precision sums
                keep = part * (d / lo) <= (near * (1 + eps / math.sqrt(lo))) ** 2 + 1e-5
                alive, part = alive[keep], part[keep]
                part = part + ((rq[i, lo:hi] - rc[alive, lo:hi]) ** 2).sum(axis=1)
            if len(alive) > top:
                keep = part <= np.partition(part, top - 1)[top - 1] + 1e-5
                alive = alive[keep]
        out.append((alive, (uc[alive] * uq[i]).sum(axis=1)))
    return out


def search(vectors: DataFrame, queries: DataFrame, top: int = 5, lists: int | None = None, probes: int | None = None, recall: float = 0.99, sample: int = 20_000, block: int = 16, eps: float = 3.0, most: int = 4096, most_queries: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest vectors of each query, never the query's own id."""
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = stored(valid(vectors), "ann-vectors"), stored(valid(queries), "ann-queries")
    size = F.size("v")
    for r in rows.groupBy(size.alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():
        out = out.unionByName(_search(rows.where(size == r["d"]), asked.where(size == r["d"]), r["d"], r["n"], top, lists, probes, recall, sample, block, eps, most, most_queries))
    return out


def _search(rows: DataFrame, asked: DataFrame, d: int, n: int, top: int, lists: int | None, probes: int | None, recall: float, sample: int, block: int, eps: float, most: int, most_queries: int) -> DataFrame:
    """search() among vectors of one length."""
    # rows beyond the first top + 1 of equal vectors can't be among the nearest
    equal = W.partitionBy("k1", "k2").orderBy("vec_id")
    few = rows.dropDuplicates(["k1", "k2", "vec_id"]).withColumn("n", F.row_number().over(equal)).where(F.col("n") <= top + 1).drop("n")
    once = asked.groupBy("k1", "k2").agg(F.first("v").alias("v"))
    # bounded by `sample` vectors
    some = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()])
    some = np.unique(unit(some), axis=0)
    some = some[np.random.default_rng(11).permutation(len(some))]
    k = min(lists or max(1, min(4096, round(math.sqrt(n)))), max(1, len(some) // 4))
    # the last vectors of the sample are left to measure on
    kept = min(400, len(some) // 5)
    centres = kmeans(some[: len(some) - kept], k)
    p = min(k, probes or (probes_needed(some, centres, top, recall, np.arange(len(some) - kept, len(some))) if kept else k))
    turn = rotation(d)

    def assign(n_lists: int):
        def run(batches):
            for b in batches:
                if not len(b):
                    continue
                near = unit(np.stack(b["v"].to_numpy())) @ centres.T
                best = np.argpartition(-near, n_lists - 1, axis=1)[:, :n_lists] if n_lists < k else np.tile(np.arange(k), (len(b), 1))
                # the nearest list first
                at = np.argsort(-np.take_along_axis(near, best, axis=1), axis=1, kind="stable")
                best = np.take_along_axis(best, at, axis=1)
                yield b.loc[b.index.repeat(n_lists)].assign(list=best.ravel().astype("int32"), nth=np.tile(np.arange(n_lists, dtype="int32"), len(b)))

        return run

    kinds = "k1 long, k2 long, v array<double>, list int, nth int"
    cands = stored(few.select("vec_id", "k1", "k2", "v").mapInPandas(assign(1), "vec_id long, " + kinds).drop("k1", "k2", "nth"), "ann-lists")
    # one row a list: at most 4096
    sizes = cands.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias("cn"))

    def compare(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"qk1": [], "qk2": [], "vec_id": [], "score": []})
        ids = c["vec_id"].to_numpy()
        vc, vq, keys = np.stack(c["v"].to_numpy()), np.stack(q["v"].to_numpy()), q[["k1", "k2"]].to_numpy()
        reach = q["reach"].fillna(math.inf).to_numpy()
        step, parts = max(1, (1 << 22) // (len(c) * 4)), []
        for lo in range(0, len(q), step):
            for (k1, k2), (at, score) in zip(keys[lo : lo + step], scan(vq[lo : lo + step], vc, turn, top + 1, block, eps, reach[lo : lo + step]), strict=True):
                pick = np.lexsort((ids[at], -score))[: top + 1]
                parts.append((np.full(len(pick), k1), np.full(len(pick), k2), ids[at][pick], score[pick]))
        return pd.DataFrame(dict(zip(("qk1", "qk2", "vec_id", "score"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    order = lambda *by: W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")

    def found(probing: DataFrame) -> DataFrame:
        """The best top + 1 of each query (k1, k2, v, list, reach) in its lists."""
        counts = F.broadcast(sizes.join(probing.groupBy("list").agg(F.ceil(F.count("*") / most_queries).cast("int").alias("qn")), "list"))
        left = cands.join(counts, "list").withColumns({"c": F.pmod(F.xxhash64("vec_id"), "cn").cast("int"), "q": F.explode(F.sequence(F.lit(0), F.col("qn") - 1))})
        right = probing.join(counts, "list").withColumns({"q": F.pmod(F.xxhash64("k1", "k2"), "qn").cast("int"), "c": F.explode(F.sequence(F.lit(0), F.col("cn") - 1))})
        got = left.select("list", "c", "q", "vec_id", "v").groupBy("list", "c", "q").cogroup(right.select("list", "c", "q", "k1", "k2", "v", "reach").groupBy("list", "c", "q")).applyInPandas(compare, FOUND)
        return stored(best_of(got), "ann-found")

    def best_of(got: DataFrame) -> DataFrame:
        return got.groupBy("qk1", "qk2", "vec_id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(order("qk1", "qk2"))).where(F.col("n") <= top + 1).drop("n")

    probing = stored(once.mapInPandas(assign(p), kinds), "ann-probes")
    none = F.lit(None).cast("double")
    got = found(probing.where("nth = 0").withColumn("reach", none))
    if p > 1:
        # unit vectors: the distance of a cosine
        far = got.groupBy("qk1", "qk2").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") > top)
        far = far.select(F.col("qk1").alias("k1"), F.col("qk2").alias("k2"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s"))).alias("reach"))
        got = got.unionByName(found(probing.where("nth > 0").join(far, ["k1", "k2"], "left")))
    got = stored(best_of(got), "ann-found")
    # queries with too few: there are fewer candidates, or their lists hold too few
    short = once.join(got.groupBy("qk1", "qk2").agg(F.count("*").alias("n")).where(F.col("n") > top), (F.col("k1") == F.col("qk1")) & (F.col("k2") == F.col("qk2")), "left_anti")
    if p < k and short.limit(1).count():
        got = best_of(got.unionByName(found(short.mapInPandas(assign(k), kinds).withColumn("reach", none))))
    # the equal queries come back
    ids = asked.select(F.col("vec_id").alias("query_id"), F.col("k1").alias("qk1"), F.col("k2").alias("qk2")).dropDuplicates()
    every = ids.join(got, ["qk1", "qk2"]).where("vec_id <> query_id")
    return every.withColumn("rank", F.row_number().over(order("query_id")).cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
