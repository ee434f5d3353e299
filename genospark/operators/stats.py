"""Summaries of the result table (intervals) and statistics of calls."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bases import jukes_cantor

PATTERN = 4


def locus_summary(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("locus").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("nbps").alias("nbps"), F.sum("nsnps").alias("nsnps"))


def trees_per_locus(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("locus").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_trees"), F.count("*").alias("nloci"))


def interval_stats(intervals: DataFrame, by: str) -> DataFrame:
    return intervals.groupBy(by).agg(F.count("*").alias("n"), F.avg("nbps").alias("mean"), F.stddev_samp("nbps").alias("std"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, lo, hi, n, density over equal widths from min to max; the last bin is closed.  Empty bins are listed."""
    span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"), F.count(column).alias("total")).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    one = F.broadcast(span)
    k = F.least(F.floor((F.col(column) - F.col("lo")) / F.col("width")), F.lit(bins - 1))
    counts = df.where(F.col(column).isNotNull()).crossJoin(one).groupBy(F.coalesce(k, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").alias("bin")).crossJoin(one)
    n = F.coalesce("n", F.lit(0))
    return all_bins.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("hi"), n.alias("n"), (n / (F.col("total") * F.col("width"))).alias("density"))


def empty_loci(intervals: DataFrame) -> DataFrame:
    """How many loci have no SNP, of how many, in per cent."""
    per = intervals.groupBy("locus").agg(F.sum("nsnps").alias("n"))
    return per.agg(F.count_if(F.col("n") == 0).alias("nempty"), F.count("*").alias("nloci"), (100.0 * F.count_if(F.col("n") == 0) / F.count("*")).alias("percent"))


def breakpoint_intervals(points: DataFrame) -> DataFrame:
    """locus, start, end, nbps, tidx between consecutive distinct breakpoints."""
    w = W.partitionBy("locus").orderBy("position")
    return points.select("locus", "position").distinct().withColumns({"end": F.lead("position").over(w), "tidx": F.row_number().over(w) - 1}).where("end is not null").select("locus", F.col("position").alias("start"), "end", (F.col("end") - F.col("position")).alias("nbps"), "tidx")


def carried(points: DataFrame, marks: DataFrame, by: list[str], at: str, column: str, width: int = 10_000, levels: int = 2) -> DataFrame:
    """points (by, at) with `column` of the last of the marks (by, at, column) at or before each; null where there is none.

    Both are laid out in bins of `width` whole positions and carried along within a bin; what a bin begins with is the last mark of the bins before, found
    in the same way with bins as positions.  So a task holds a bin of one group, or all bins of bins, and never a whole group.
    """
    kind = marks.schema[column].dataType
    rows = points.select(*by, at, F.lit(1).alias("__point"), F.lit(None).cast(kind).alias(column)).unionByName(marks.select(*by, at, F.lit(0).alias("__point"), column))
    if not levels:
        last = F.last(column, ignorenulls=True).over(W.partitionBy(*by).orderBy(at, "__point").rowsBetween(W.unboundedPreceding, 0))
        return rows.withColumn(column, last).where("__point = 1").drop("__point")
    # bins are positions of the next level
    b, nth = f"__bin{levels}", F.floor(F.col(at) / width).cast("long")
    rows = rows.withColumn(b, nth)
    inside = F.last(column, ignorenulls=True).over(W.partitionBy(*by, b).orderBy(at, "__point").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn(column, inside).where("__point = 1").drop("__point")
    ends = marks.select(*by, nth.alias(b), at, column).groupBy(*by, b).agg(F.max_by(column, at).alias(column))
    open_ = rows.where(F.col(column).isNull()).select(*by, (F.col(b) - 1).alias(b)).distinct()
    before = carried(open_, ends, by, b, column, width, levels - 1).select(*by, (F.col(b) + 1).alias(b), F.col(column).alias("__before"))
    return rows.join(before, [*by, b], "left").withColumn(column, F.coalesce(column, "__before")).drop(b, "__before")


def site_to_tree(sites: DataFrame, intervals: DataFrame) -> DataFrame:
    """The interval [start, end) that covers each (locus, site).  Intervals of a locus don't overlap; empty ones cover nothing.

    Distinct sites and starts are merged, and each site has the last start before it: no site meets all intervals of its locus.
    """
    marks = intervals.where("end > start").select("locus", F.col("start").cast("long").alias("site"), F.struct("start", "end", "tidx").alias("__i"))
    points = sites.select("locus", F.col("site").cast("long").alias("site")).distinct()
    held = carried(points, marks, ["locus"], "site", "__i").where(F.col("site") < F.col("__i.end"))
    return sites.join(held.select("locus", "site", F.col("__i.start").alias("start"), F.col("__i.end").alias("end"), F.col("__i.tidx").alias("tidx")), ["locus", "site"])


def site_windows(calls: DataFrame, width: int) -> DataFrame:
    """Tumbling windows of sites: sites and variable sites (missing is a state) of each."""
    state = F.coalesce("allele", F.lit(9))
    sites = calls.groupBy("locus", "site").agg((F.min(state) != F.max(state)).alias("varies"))
    return sites.groupBy("locus", F.floor(F.col("site") / width).alias("window")).agg(F.min("site").alias("start"), (F.max("site") + 1).alias("end"), F.count_if("varies").alias("nvariable"))


def consensus(calls: DataFrame) -> DataFrame:
    """pop, locus, site, allele: each population's most frequent allele, ties to the smaller code."""
    n = calls.where("allele is not null").groupBy("pop", "locus", "site", "allele").agg(F.count("*").alias("n"))
    best = W.partitionBy("pop", "locus", "site").orderBy(F.desc("n"), "allele")
    return n.withColumn("r", F.row_number().over(best)).where("r = 1").select("pop", "locus", "site", "allele")


def wide(calls: DataFrame, key: str, names: list, by: list[str]) -> DataFrame:
    """One row a `by` with s0, s1, ..: the alleles of the named samples or populations; rows lacking one are dropped."""
    cols = [F.max(F.when(F.col(key) == v, F.col("allele"))).alias(f"s{i}") for i, v in enumerate(names)]
    return calls.where(F.col(key).isin(names)).groupBy(*by).agg(*cols).where(" and ".join(f"s{i} is not null" for i in range(len(names))))


def abba(a="s0", b="s1", c="s2", d="s3") -> Column:
    return (F.col(a) == F.col(d)) & (F.col(b) == F.col(c)) & (F.col(a) != F.col(b))


def baba(a="s0", b="s1", c="s2", d="s3") -> Column:
    return (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)) & (F.col(a) != F.col(b))


def fixed(a="s0", b="s1", c="s2", d="s3") -> Column:
    return (F.col(a) == F.col(b)) & (F.col(b) == F.col(c)) & (F.col(c) == F.col(d))


def _n(weight: str | None, on: Column | None = None) -> Column:
    """The number of sites for which `on` holds; rows may stand for `weight` sites each."""
    if weight is None:
        return F.count("*") if on is None else F.count_if(on)
    return F.coalesce(F.sum(weight if on is None else F.when(on, F.col(weight))), F.lit(0))


def site_patterns(quads: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """row = 4 s0 + s1, col = 4 s2 + s3, n."""
    return quads.groupBy(*(by or []), (PATTERN * F.col("s0") + F.col("s1")).alias("row"), (PATTERN * F.col("s2") + F.col("s3")).alias("col")).agg(_n(weight).alias("n"))


def dense(patterns: DataFrame) -> DataFrame:
    """The 16 x 16 matrix as array<array<long>> from row, col, n."""
    cells = F.map_from_entries(F.collect_list(F.struct((16 * F.col("row") + F.col("col")).alias("k"), F.col("n").alias("v"))))
    at = lambda i, j: F.coalesce(F.try_element_at("m", F.lit(16 * i + j).cast("long")), F.lit(0).cast("long"))
    return patterns.select(F.col("row").cast("long"), F.col("col").cast("long"), "n").agg(cells.alias("m")).select(F.array(*[F.array(*[at(i, j) for j in range(16)]) for i in range(16)]).alias("matrix"))


def d_statistic(quads: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """abba, baba, fixed, nsites, dstat ((abba - baba) / (abba + baba), 0 without either), abs_dstat."""
    counts = quads.groupBy(*(by or [])).agg(_n(weight, abba()).alias("abba"), _n(weight, baba()).alias("baba"), _n(weight, fixed()).alias("fixed"), _n(weight).alias("nsites"))
    both = F.col("abba") + F.col("baba")
    d = F.when(both > 0, (F.col("abba") - F.col("baba")) / both).otherwise(0.0)
    return counts.withColumns({"dstat": d, "abs_dstat": F.abs(d)})


def patterns(calls: DataFrame, key: str) -> DataFrame:
    """p (struct k, a: the key and allele of all that aren't missing, in order), n: the distinct columns of an alignment, and how many sites have each."""
    packed = calls.where("allele is not null").groupBy("locus", "site").agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("allele").alias("a")))).alias("p"))
    return packed.groupBy("p").agg(F.count("*").alias("n"))


def quartets(calls: DataFrame, key: str) -> DataFrame:
    """For all a < b < c < d: q0..q3, s0..s3, n: the alleles of four at n sites.  Quartets are drawn from the distinct columns, not from the sites.

    n samples make n (n-1)(n-2)(n-3)/24 quartets a column: meant for population representatives.
    """
    out = patterns(calls, key)
    for i in range(4):
        after = F.lit(0) if i == 0 else F.col(f"i{i - 1}") + 1
        # the last start leaves room for the samples still to come
        size = F.size("p") - (3 - i)
        out = out.withColumn("from", after).where(F.col("from") < size).withColumn(f"i{i}", F.explode(F.sequence(F.col("from"), size - 1)))
    return out.select(*[F.col("p")[F.col(f"i{i}")]["k"].alias(f"q{i}") for i in range(4)], *[F.col("p")[F.col(f"i{i}")]["a"].alias(f"s{i}") for i in range(4)], "n")


def pairwise(calls: DataFrame, model: str | None = None, block: int = 63, tile: int = 256, together: int = 8, deep: int = 32) -> DataFrame:
    """s0 < s1, nsites, ndiff, dist of all pairs of samples, over the sites that both have; missing is a state.

    Calls are packed as bit masks for blocks of 63 sites (which sites there are, and the state in three bits), and up to `together` blocks are one row, so that a pair meets once
    for some 500 sites.  About `tile` samples are packed in one row of a tile, which is shuffled once; a task pairs two parts of some `deep` tiles at most, which it reads
    from where they lie.  So tasks grow with the square of the samples, and what is shuffled grows with the samples.
    Only alignments of more sites add up their pairs' counts, in a shuffle of pairs.  model None: proportion of differing sites; "JC": Jukes-Cantor distance.
    """
    if model not in (None, "JC", "JC69"):
        raise NotImplementedError(f"no distance model {model}")
    calls = calls.where("sample is not null")
    samples, last = calls.agg(F.approx_count_distinct("sample"), F.max("site")).first()
    tiles, blocks = max(1, -(-samples // tile)), int(last or 0) // block + 1
    width = min(together, blocks)
    # few bytes make many pairs: two parts a task, and twice the usual number of tasks, as half of them have few pairs where tiles are few
    tasks = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(tiles, max(math.ceil(math.sqrt(2 * tasks)), -(-tiles // deep)))
    bit = F.expr(f"shiftleft(1L, cast(site % {block} as int))")
    at, state = F.floor(F.col("site") / block), F.coalesce("allele", F.lit(7))
    planes = {"h": F.lit(True), **{f"p{k}": state.bitwiseAND(F.lit(1 << k)) > 0 for k in range(3)}}
    names = [f"{p}_{w}" for w in range(width) for p in planes]
    masks = [F.bit_or(F.when((at % width == w) & on, bit).otherwise(F.lit(0).cast("long"))).alias(f"{p}_{w}") for w in range(width) for p, on in planes.items()]
    packed = calls.groupBy("sample", F.floor(at / width).alias("b")).agg(*masks).withColumn("t", F.pmod(F.xxhash64("sample"), F.lit(tiles)).cast("int"))
    rows = packed.groupBy("b", "t").agg(F.collect_list(F.struct("sample", *names)).alias("rows")).repartitionById(parts, F.col("t") % parts)
    a, z = (rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns]) for p in "az")
    # two tiles meet once, a tile with itself too; then a unit has each pair once, in any order of names
    units = a.join(z.hint("shuffle_replicate_nl"), (F.col("a_t") <= F.col("z_t")) & (F.col("a_b") == F.col("z_b")))
    met = units.select((F.col("a_t") < F.col("z_t")).alias("two"), "z_rows", F.explode("a_rows").alias("a")).select("two", "a", F.explode("z_rows").alias("z")).where(F.col("two") | (F.col("a.sample") < F.col("z.sample")))
    both = lambda w: F.col(f"a.h_{w}").bitwiseAND(F.col(f"z.h_{w}"))
    differ = lambda w: functools.reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"a.p{k}_{w}").bitwiseXOR(F.col(f"z.p{k}_{w}")) for k in range(3)])
    total = lambda parts: functools.reduce(lambda x, y: x + y, [F.bit_count(p).cast("long") for p in parts])
    pairs = met.select(F.least("a.sample", "z.sample").alias("s0"), F.greatest("a.sample", "z.sample").alias("s1"), total(both(w) for w in range(width)).alias("nsites"), total(both(w).bitwiseAND(differ(w)) for w in range(width)).alias("ndiff"))
    if blocks > width:
        pairs = pairs.groupBy("s0", "s1").agg(F.sum("nsites").alias("nsites"), F.sum("ndiff").alias("ndiff"))
    pairs = pairs.where("nsites > 0")
    p = F.col("ndiff") / F.col("nsites")
    return pairs.select("s0", "s1", "nsites", "ndiff", (p if model is None else jukes_cantor(p)).alias("dist"))


def base_freq(calls: DataFrame) -> DataFrame:
    return calls.groupBy("pop", "allele").agg(F.count("*").alias("n"))


def pattern_cube(quads: DataFrame) -> DataFrame:
    """Site counts by locus and by class (abba, baba, fixed, other), with all totals."""
    kind = F.when(abba(), "abba").when(baba(), "baba").when(fixed(), "fixed").otherwise("other")
    return quads.withColumn("kind", kind).cube("locus", "kind").agg(F.count("*").alias("n"))
