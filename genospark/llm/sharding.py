"""Shards by a hierarchical weighted hash tree (law `key`).

A key descends region, rack and shard.  At each level every child of the chosen node draws
-ln(u)/weight from a hash of the key and the child's name, and the smallest draw wins, so a child is
chosen with probability weight / sum of weights, and a changed weight moves only keys into or out
of the subtrees whose weights change.  The first `base` shards are laid out in regions and racks; each
later shard opens a region of its own, so that one more shard takes keys only into itself.

Slots number the rows of a shard from 0 without gaps, in the order of doc_id, checksum, size.  Rows
equal in all three are counted before the shuffle and numbered as one run; long runs are cut before they become rows again.  The
numbering works on ranges of doc_id (of checksums, for rows without an id), whose totals are summed up per shard; no task holds a shard.

Edge cases.  A null doc_id is a key of its own; a null text has no bytes, so size 8 and checksum 0;
repeated rows get the same shard and different slots; an empty table gives an empty result.
Columns other than doc_id and text are not read by `digest`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored


def layout(n: int, base: int = 24, regions: int = 3, racks: int = 2, weights: dict[int, float] | None = None) -> dict:
    """{region: {rack: {shard: weight}}} of n shards."""
    weights = weights or {}
    first = min(n, base)
    tree: dict = {}
    for s in range(n):
        if s < first:
            per_region = -(-base // regions)
            per_rack = -(-per_region // racks)
            region, rack = s // per_region, s % per_region // per_rack
        else:
            region, rack = regions + s - base, 0
        tree.setdefault(region, {}).setdefault(rack, {})[s] = float(weights.get(s, 1.0))
    return tree


def total(tree) -> float:
    return sum(map(total, tree.values())) if isinstance(tree, dict) else tree


def _winner(key: Column, children: Column) -> Column:
    """The node of the child with the smallest exponential draw; ties go to the smaller node.

    A child is a struct (name, weight, node).  md5 makes the draws the same in any engine.
    """

    def draw(c: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), c["name"])), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["node"].alias("node"))

    return F.array_min(F.transform(children, draw))["node"]


def shard_of(key: Column, tree: dict) -> Column:
    """The shard (int) of a key column."""
    key = F.coalesce(key.cast("string"), F.lit("\x00null"))
    kids = lambda xs: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("node")) for n, w, i in xs if w > 0])
    if total(tree) <= 0:
        raise ValueError("a shard tree needs a positive weight")
    regions = [(g, t) for g, t in sorted(tree.items()) if total(t) > 0]
    racks = [(g, r, t) for g, rs in regions for r, t in sorted(rs.items()) if total(t) > 0]
    rack_at = {(g, r): i for i, (g, r, _) in enumerate(racks)}
    region = _winner(key, kids([(f"g{g}", total(t), i) for i, (g, t) in enumerate(regions)]))
    racks_of = F.array(*[kids([(f"g{g}r{r}", total(t), rack_at[g, r]) for r, t in sorted(rs.items()) if total(t) > 0]) for g, rs in regions])
    rack = _winner(key, F.element_at(racks_of, region + 1))
    shards_of = F.array(*[kids([(f"s{s}", w, s) for s, w in sorted(t.items())]) for _, _, t in racks])
    return _winner(key, F.element_at(shards_of, rack + 1)).cast("int")


def digest(docs: DataFrame, shards: int = 24, rows_per_range: int = 200_000, run: int = 100_000, tree: dict | None = None, grown: dict | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    tree, grown = tree or layout(shards), grown or layout(shards + 1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # the texts are read once; what is kept has some 30 bytes a row
    same = stored(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "shard-digest")
    count, most = same.agg(F.sum("n"), F.max("n")).first()
    # each range is numbered in each shard apart
    parts = min(2000, max(1, -(-(count or 0) // (rows_per_range * shards))))
    # boundaries of doc_id ranges with about as many rows each: at most 2000 numbers; the result doesn't depend on them
    cuts = same.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    # rows without an id come first, in 256 ranges of their checksums
    part = F.coalesce(_range_of(F.col("doc_id"), cuts), (F.floor(F.col("text_crc32") / (1 << 24)) - 256).cast("int"))
    placed = same.withColumns({"shard": shard_of(F.col("doc_id"), tree), "part": part})
    totals = placed.groupBy("shard", "part").agg(F.sum("n").alias("rows"))
    # one number a shard and range; ordered before the numbering of its range
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("shard", "part").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    runs = placed.withColumn("skip", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "part"])
    runs = runs.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("skip")).alias("slot"), "n", shard_of(F.col("doc_id"), grown).alias("grown_shard"))
    if (most or 0) > run:
        # many equal rows: their run is cut into pieces, which are dealt out before they become rows
        piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / run)))
        runs = runs.withColumn("k", piece).withColumns({"slot": F.col("slot") + F.col("k") * run, "n": F.least(F.lit(run), F.col("n") - F.col("k") * run)}).repartition("doc_id", "text_crc32", "k")
    return runs.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence("slot", F.col("slot") + F.col("n") - 1)).alias("slot"), "grown_shard")


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts lie at or below the value; null for null.  Two levels: some 2 sqrt(n) comparisons."""
    if not cuts:
        return F.when(value.isNotNull(), F.lit(0))
    step = max(1, round(len(cuts) ** 0.5))
    below = lambda xs: F.aggregate(xs, F.lit(0), lambda a, c: a + F.when(c <= value, 1).otherwise(0))
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    coarse = below(longs(cuts[step - 1 :: step]))
    fine = F.array(*[longs([*cuts[i : i + step - 1], *[(1 << 63) - 1] * (step - 1 - len(cuts[i : i + step - 1])), (1 << 63) - 1]) for i in range(0, len(cuts) + 1, step)])
    return F.when(value.isNotNull(), coarse * step + below(F.element_at(fine, coarse + 1)))


def write_shards(docs: DataFrame, path: str, shards: int = 24, tree: dict | None = None, file_rows: int = 100_000) -> None:
    """Write whole rows as Parquet under shard=<n>, many files a shard."""
    tree = tree or layout(shards)
    docs.withColumn("shard", shard_of(F.col("doc_id"), tree)).write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
