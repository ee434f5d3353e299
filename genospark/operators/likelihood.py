"""Coalescent likelihoods and waiting distances, in log space and without Python workers.

Relations: species (node, parent, height, up_height, ne; the root has no up_height), members (node, sample), genes
(tree, gnode, parent, height; leaves are named as samples).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written
from . import nested
from .nested import large, spread
from .trees import root_paths

EARLIEST = 1e-4


def pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def coal_intervals(times: DataFrame) -> DataFrame:
    """tree, k (lineages), npairs, time, waited: intervals between the sorted coalescent times of a tree."""
    w = W.partitionBy("tree").orderBy("time")
    n = F.count("*").over(W.partitionBy("tree")) + 1
    k = n - F.row_number().over(w) + 1
    return times.select("tree", "time", k.alias("k"), (F.col("time") - F.lag("time", 1, 0.0).over(w)).alias("waited")).withColumn("npairs", pairs(F.col("k")))


def kingman_loglik(intervals: DataFrame, ne: Column, by: list[str] | None = None) -> DataFrame:
    """tree, logp: sum of ln(r) - r C(k,2) t with r = 1 / 2Ne."""
    r = 1 / (2 * ne)
    return intervals.groupBy(*(by or []), "tree").agg(F.sum(F.ln(r) - r * F.col("npairs") * F.col("waited")).alias("logp"))


def kingman_grid(intervals: DataFrame, grid: DataFrame) -> DataFrame:
    """ne, loss: negated composite log-likelihood of all trees at each Ne of a grid.

    Only the number of intervals and the sum of npairs * waited are needed, so the grid never meets the intervals.
    """
    s = intervals.agg(F.count("*").alias("n"), F.sum(F.col("npairs") * F.col("waited")).alias("area"))
    r = 1 / (2 * F.col("ne"))
    return grid.crossJoin(F.broadcast(s)).select("ne", (-(F.col("n") * F.ln(r) - r * F.col("area"))).alias("loss"))


def _over(species: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample, node): species nodes over a sample; (node, below): nodes in the subtree of a node."""
    up = root_paths(species.select(F.lit(0).alias("tree"), "node", "parent")).select(F.col("node").alias("below"), F.col("ancestor").alias("node"))
    over = members.select(F.col("node").alias("below"), "sample").join(up, "below").select("sample", "node")
    return F.broadcast(over), F.broadcast(up)  # one row a sample or node and level of a species tree


def contained(species: DataFrame, members: DataFrame, genes: DataFrame) -> DataFrame:
    """tree, gnode, ntips, node: species nodes that hold all tips of a gene node.

    Species tips are numbered so that each species node holds a range of numbers.  A gene node has the least and the largest number of its tips, and is held by the
    species nodes over its least one whose range reaches the largest.
    """
    over, _ = _over(species, members)
    numbers = nested.labels(species.select(F.lit(0).alias("tree"), "node", "parent")).select("node", "pre", "last")
    numbers = F.broadcast(numbers)  # one row a species node
    tips = F.broadcast(members.join(numbers, "node").select(F.col("sample").alias("gnode"), F.col("pre").alias("lo")))  # one row a sample
    inner = spread(genes).where("parent is not null").select("tree", F.col("parent").alias("gnode"), F.lit(1).alias("inner")).distinct()
    rows = spread(genes).select("tree", "gnode", "parent").join(large(inner), ["tree", "gnode"], "left").join(tips, "gnode", "left")
    tip = F.col("inner").isNull()
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    rows = rows.select("tree", F.col("gnode").alias("node"), "parent", one(tip).alias("ntips"), one(tip & F.col("lo").isNotNull()).alias("known"), F.when(tip, F.col("lo")).alias("lo"), F.when(tip, F.col("lo")).alias("hi"))
    span = nested.folded(rows, {"ntips": "sum", "known": "sum", "lo": "min", "hi": "max"}).where("known = ntips").withColumnRenamed("node", "gnode")
    holders = over.join(members.select("sample", F.col("node").alias("tip")), "sample").select("tip", "node").distinct().join(numbers.select(F.col("node").alias("tip"), F.col("pre").alias("lo")), "tip").join(numbers.select("node", F.col("last")), "node")
    return span.join(F.broadcast(holders.select("lo", "node", "last")), "lo").where("hi <= last").select("tree", "gnode", "ntips", "node")


def coalescences(species: DataFrame, members: DataFrame, genes: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """tree, node, gnode, height: the species node in which each gene node coalesces."""
    held = contained(species, members, genes) if held is None else held
    st = F.broadcast(species.select("node", F.col("height").alias("lo"), F.coalesce("up_height", F.lit(float("inf"))).alias("hi")))
    return held.where("ntips > 1").join(large(spread(genes).select("tree", "gnode", "height")), ["tree", "gnode"]).join(st, "node").where((F.col("height") > F.col("lo") + EARLIEST) & (F.col("height") < F.col("hi"))).select("tree", "node", "gnode", "height")


def embed_msc(species: DataFrame, members: DataFrame, genes: DataFrame, coal: DataFrame | None = None) -> DataFrame:
    """tree, node, dist (null at the root), neff, nedges_in, nedges_out, coals (successive waiting lengths).

    Lineages leaving a node are its samples less the coalescences in its subtree, so no recursion is needed.
    """
    over, up = _over(species, members)
    coal = coalescences(species, members, genes) if coal is None else coal
    samples = over.groupBy("node").agg(F.count("*").alias("samples"))
    frame = spread(genes.select("tree")).distinct().crossJoin(F.broadcast(species.join(samples, "node", "left")))
    below = coal.select("tree", F.col("node").alias("below")).join(up, "below").groupBy("tree", "node").agg(F.count("*").alias("gone"))
    own = coal.groupBy("tree", "node").agg(F.count("*").alias("own"), F.sort_array(F.collect_list("height")).alias("hs"))
    out = frame.join(large(below), ["tree", "node"], "left").join(large(own), ["tree", "node"], "left")
    left = F.coalesce("samples", F.lit(0)) - F.coalesce("gone", F.lit(0))
    hs = F.coalesce("hs", F.array().cast("array<double>"))
    waits = F.transform(hs, lambda x, i: x - F.when(i == 0, F.col("height")).otherwise(F.get(hs, i - 1)))
    return out.select("tree", "node", (F.col("up_height") - F.col("height")).alias("dist"), F.col("ne").alias("neff"), (left + F.coalesce("own", F.lit(0))).alias("nedges_in"), left.alias("nedges_out"), waits.alias("coals"))


def censored_logp(neff: Column, nin: Column, nout: Column, dist: Column, coals: str) -> Column:
    """Log density of the coalescences in one species node, and of none in what is left of it."""
    r = 1 / (2 * neff)
    part = F.aggregate(F.transform(coals, lambda t, i: F.ln(r) - r * pairs(nin - i) * t), F.lit(0.0), lambda a, x: a + x)
    rest = dist - F.aggregate(F.col(coals), F.lit(0.0), lambda a, x: a + x)
    return part + F.when((nout > 1) & dist.isNotNull(), -r * pairs(nout) * rest).otherwise(0.0)


def msc_loglik(table: DataFrame) -> DataFrame:
    """tree, loss: negated log probability of a gene tree in its species tree."""
    return table.groupBy("tree").agg((-F.sum(censored_logp(F.col("neff"), F.col("nedges_in"), F.col("nedges_out"), F.col("dist"), "coals"))).alias("loss"))


def embed_smc(species: DataFrame, members: DataFrame, genes: DataFrame, coal: DataFrame | None = None) -> DataFrame:
    """tree, node, start, stop (null at the top), neff, nedges, dist: species edges split at coalescences."""
    table = embed_msc(species, members, genes, coal).join(F.broadcast(species.select("node", "height", "up_height")), "node")
    ends = F.concat(F.array("height"), F.transform(F.sequence(F.lit(1), F.size("coals")), lambda i: F.col("height") + F.aggregate(F.slice("coals", 1, i), F.lit(0.0), lambda a, x: a + x)))
    ends = F.when(F.size("coals") > 0, ends).otherwise(F.array("height"))
    rows = table.withColumn("ends", ends).select("tree", "node", "neff", "nedges_in", "up_height", "ends", F.posexplode("ends").alias("i", "start"))
    stop = F.when(F.col("i") < F.size("ends") - 1, F.get("ends", F.col("i") + 1)).otherwise(F.col("up_height"))
    return rows.select("tree", "node", "start", stop.alias("stop"), "neff", (F.col("nedges_in") - F.col("i")).alias("nedges"), (stop - F.col("start")).alias("dist"))


def edge_path(species: DataFrame, members: DataFrame, genes: DataFrame) -> DataFrame:
    """tree, edge, i, start, stop, node, neff, nedges, dist: epochs along every gene edge, from its lower end up."""
    held = written(contained(species, members, genes), "held")
    coal = written(coalescences(species, members, genes, held), "coalescences")
    epochs = embed_smc(species, members, genes, coal)
    genes = spread(genes)
    up = genes.select("tree", F.col("gnode").alias("parent"), F.col("height").alias("top"))
    edges = genes.where("parent is not null").join(large(up), ["tree", "parent"]).select("tree", F.col("gnode").alias("edge"), "parent", F.col("height").alias("low"), "top")
    at = edges.join(large(held.select("tree", F.col("gnode").alias("edge"), "node")), ["tree", "edge"]).join(large(epochs), ["tree", "node"])
    # sums of waiting lengths differ from heights by rounding
    inside = at.where((F.col("start") >= F.col("low") - 1e-6) & (F.col("stop") <= F.col("top") + 1e-6) & (F.col("dist") > 1e-9))
    w = W.partitionBy("tree", "edge").orderBy("start")
    return inside.select("tree", "edge", "parent", (F.row_number().over(w) - 1).alias("i"), "start", "stop", "node", "neff", "nedges", "dist")


def path_terms(path: DataFrame) -> DataFrame:
    """a, n, T, h and C (hazard passed before the row) of the rows of a path."""
    h = F.col("nedges") * F.col("dist") / (2 * F.col("neff"))
    before = W.partitionBy("tree", "edge").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    rows = path.select("tree", "edge", "i", "start", "stop", F.col("nedges").cast("double").alias("a"), (2 * F.col("neff")).alias("n"), F.col("dist").alias("T"), h.alias("h"))
    return rows.withColumn("C", F.coalesce(F.sum("h").over(before), F.lit(0.0)))


def edge_unchanged(path: DataFrame) -> DataFrame:
    """tree, edge, length, p: probability that a recombination on the edge leaves the tree unchanged."""
    # what the epochs above hold, seen from the top of each: S(i) = q(i+1) + exp(-h(i+1)) S(i+1), with q = (1 - exp(-h)) / a
    row = lambda c: F.sort_array(F.collect_list(F.struct(F.col("i"), F.col("a"), F.col("n"), F.col("T"), F.col("h"))), asc=c)
    edges = path_terms(path).groupBy("tree", "edge").agg(row(False).alias("down"), F.sum("T").alias("length"))
    q = lambda x: (1 - F.exp(-x["h"])) / x["a"]
    each = lambda s, x: x["T"] / x["a"] + x["n"] * q(x) * (s - 1 / x["a"])
    step = lambda acc, x: F.struct((q(x) + F.exp(-x["h"]) * acc["s"]).alias("s"), (acc["sum"] + each(acc["s"], x)).alias("sum"))
    total = F.aggregate("down", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("sum")), step)["sum"]
    return edges.select("tree", "edge", "length", (total / F.col("length")).alias("p"))


def edge_unchanged_at(path: DataFrame, share: float = 0.5) -> DataFrame:
    """tree, edge, time, p: the same for a recombination at a point of the edge, `share` of the way up."""
    rows = path_terms(path)
    whole = W.partitionBy("tree", "edge")
    rows = rows.withColumn("time", F.min("start").over(whole) + share * (F.max("stop").over(whole) - F.min("start").over(whole)))
    at = rows.where("start <= time and time < stop").select("tree", "edge", "time", F.col("i").alias("j"), (F.col("a") * (F.col("stop") - F.col("time")) / F.col("n")).alias("first"), (F.col("C") + F.col("h")).alias("passed"))
    both = rows.drop("time").join(large(at), ["tree", "edge"]).where("i >= j")
    p = F.when(F.col("i") == F.col("j"), (1 - F.exp(-F.col("first"))) / F.col("a")).otherwise(F.exp(-(F.col("first") + F.col("C") - F.col("passed"))) * (1 - F.exp(-F.col("h"))) / F.col("a"))
    return both.groupBy("tree", "edge", "time").agg(F.sum(p).alias("p"))


def tree_unchanged(edges: DataFrame) -> DataFrame:
    """tree, sumlen, p: edge probabilities weighted by length."""
    return edges.groupBy("tree").agg(F.sum("length").alias("sumlen"), (F.sum(F.col("length") * F.col("p")) / F.sum("length")).alias("p"))


def topo_unchanged(path: DataFrame) -> DataFrame:
    """tree, edge, length, p: probability that a recombination on the edge leaves the topology unchanged.

    The rows of an edge are continued by those of its parent edge (above the root: one lineage without end); m is the
    first row shared with the sibling.
    """
    own = path.select("tree", "edge", "parent", F.lit(0).alias("part"), "i", "start", "node", "neff", F.col("nedges").cast("double").alias("a"), F.col("dist").alias("T"))
    edges = own.select("tree", "edge", "parent").distinct()
    par = path.select("tree", F.col("edge").alias("parent"), "i", "start", "node", "neff", F.col("nedges").cast("double").alias("a"), F.col("dist").alias("T"))
    up = edges.join(large(par), ["tree", "parent"]).select("tree", "edge", "parent", F.lit(1).alias("part"), "i", "start", "node", "neff", "a", "T")
    top = edges.join(large(par.select("tree", "parent").distinct()), ["tree", "parent"], "left_anti").select("tree", "edge", "parent", F.lit(1).alias("part"), F.lit(0).alias("i"), F.lit(float("inf")).alias("start"), F.lit("").alias("node"), F.lit(0.5).alias("neff"), F.lit(1.0).alias("a"), F.lit(float("inf")).alias("T"))
    rows = own.unionByName(up).unionByName(top)
    w = W.partitionBy("tree", "edge").orderBy("part", "i")
    h = F.col("a") * F.col("T") / (2 * F.col("neff"))
    rows = rows.withColumns({"x": F.row_number().over(w) - 1, "h": h}).withColumn("C", F.coalesce(F.sum("h").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    sibling = own.select("tree", "parent", F.col("edge").alias("other"), "node", "start")
    shared = rows.where("part = 0").join(large(sibling), ["tree", "parent", "node", "start"]).where("edge <> other").groupBy("tree", "edge").agg(F.min("x").alias("m"))
    size = rows.where("part = 0").groupBy("tree", "edge").agg(F.count("*").alias("ib"), F.sum("T").alias("length"))
    left = rows.where("part = 0").select("tree", "edge", F.col("x").alias("i"), "a", "T", (2 * F.col("neff")).alias("n"), "h", "C")
    right = rows.select("tree", "edge", F.col("x").alias("k"), F.col("a").alias("ka"), F.col("h").alias("kh"), F.col("C").alias("kC"))
    both = left.join(large(right), ["tree", "edge"]).where("k >= i").join(large(size), ["tree", "edge"]).join(large(shared), ["tree", "edge"], "left").withColumn("m", F.coalesce("m", "ib"))
    s = F.when(F.col("k") == F.col("i"), -1 / F.col("a")).otherwise(F.exp(-(F.col("kC") - F.col("C") - F.col("h"))) * (1 - F.exp(-F.col("kh"))) / F.col("ka"))
    k, m, ib = F.col("k"), F.col("m"), F.col("ib")
    times = F.when(F.col("i") < m, 1 + F.when((k >= m) & (k < ib), 1).otherwise(0)).otherwise(F.when(k < ib, 2).otherwise(1))
    inner = both.groupBy("tree", "edge", "i").agg(F.sum(s * times).alias("b"), *[F.first(c).alias(c) for c in ("a", "T", "n", "h", "m", "length")])
    c = F.when(F.col("i") < m, 1.0).otherwise(2.0)
    each = (c * F.col("T") + F.col("n") * (1 - F.exp(-F.col("h"))) * F.col("b")) / F.col("a")
    return inner.groupBy("tree", "edge").agg(F.first("length").alias("length"), (F.sum(each) / F.first("length")).alias("p"))


def expected_distance(trees: DataFrame, recomb: float) -> DataFrame:
    """tree, sumlen, p, expected: base pairs until the tree changes."""
    return trees.withColumn("expected", 1 / (recomb * (1 - F.col("p")) * F.col("sumlen")))


def distance_likelihood(observed: Column, expected: Column) -> Column:
    """Normal density with mean E and standard deviation E squared."""
    sd = expected * expected
    return F.exp(-((observed - expected) * (observed - expected)) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))


def compared(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """tree, start, obs_dist, exp_wait, lambda_, likelihood, logliks (negated logarithm) of simulated intervals and expected distances.

    observed: tree, start, nbps; expected: tree, expected.  The logarithm is taken of the density's formula, so that it never underflows.
    """
    both = observed.join(large(expected.select("tree", "expected")), "tree")
    e = F.col("expected")
    z = (F.col("nbps") - e) / (e * e)
    return both.select(
        "tree", "start", F.col("nbps").alias("obs_dist"), e.alias("exp_wait"), (1 / e).alias("lambda_"),
        distance_likelihood(F.col("nbps").cast("double"), e).alias("likelihood"), (z * z / 2 + F.ln(e * e) + math.log(2 * math.pi) / 2).alias("logliks"),
    )


def distances_by_node(species: DataFrame, members: DataFrame, genes: DataFrame, expected: DataFrame) -> DataFrame:
    """node, tree, expected: expected distances of the gene trees in which the samples of an inner species node form a clade."""
    inner = species.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    over, _ = _over(species, members)
    f = [x.alias(f"f{i}") for i, x in enumerate(nested.fingerprint(F.col("sample")))]
    own = over.join(F.broadcast(inner), "node").select("node", "sample").distinct().select("node", *f).groupBy("node").agg(F.count("*").alias("ntips"), F.sum("f0").alias("f0"), F.sum("f1").alias("f1"))
    clades = nested.clades(genes.select("tree", F.col("gnode").alias("node"), "parent")).select("tree", "ntips", "f0", "f1").distinct()
    return clades.join(F.broadcast(own), ["ntips", "f0", "f1"]).join(large(expected.select("tree", "expected")), "tree").select("node", "tree", "expected")


def theta_table(species: DataFrame, mu: float = 1.0) -> DataFrame:
    return species.select("node", (4 * F.col("ne") * mu).alias("theta"))
