"""Sequence evolution along a tree from its root to its tips, under HKY or any rate matrix, with rates that differ between sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hky, markov
from ..functions.rng import categorical, open_uniform
from ..sources.newick import Node


def normal(*keys) -> Column:
    """A standard normal draw from the keys (Box and Muller)."""
    return F.sqrt(-2 * F.ln(open_uniform("radius", *keys))) * F.cos(2 * 3.141592653589793 * open_uniform("angle", *keys))


def gamma(shape: float, *keys, tries: int = 12) -> Column:
    """A gamma draw of mean 1 from the keys: the first accepted try of Marsaglia and Tsang's method.

    A try is accepted with a probability of over 0.95, so that all fail about once in 10**15 draws; then it is 1.
    """
    at = shape if shape >= 1 else shape + 1
    d, c = at - 1 / 3, 1 / (3 * (at - 1 / 3) ** 0.5)
    out = []
    for i in range(tries):
        x = normal("gamma", i, *keys)
        v = (1 + c * x) * (1 + c * x) * (1 + c * x)
        ok = (v > 0) & (F.ln(open_uniform("accept", i, *keys)) < 0.5 * x * x + d - d * v + d * F.ln(F.greatest(v, F.lit(1e-300))))
        out.append(F.when(ok, d * v))
    draw = F.coalesce(*out, F.lit(at))
    if shape < 1:
        draw = draw * F.pow(open_uniform("boost", *keys), F.lit(1 / shape))
    return draw / shape


def site_rates(sites: DataFrame, shape: float | None, bins: int | None, seed) -> DataFrame:
    """The sites (locus, site) with a rate: 1, a gamma draw of mean 1, or the mean of the draws in its bin of equal width."""
    if shape is None:
        return sites.withColumn("rate", F.lit(1.0))
    drawn = sites.withColumn("rate", gamma(shape, seed, F.col("locus"), F.col("site")))
    if not bins:
        return drawn
    edge = drawn.groupBy("locus").agg(F.min("rate").alias("lo"), F.max("rate").alias("hi"))
    at = drawn.join(edge, "locus").withColumn("bin", F.least(F.floor((F.col("rate") - F.col("lo")) / F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-300))), F.lit(bins - 1)))
    mean = at.groupBy("locus", "bin").agg(F.avg("rate").alias("mean"))
    return at.join(mean, ["locus", "bin"]).select(*sites.columns, F.col("mean").alias("rate"))


def evolved(sites: DataFrame, tree: Node, mut: float, kappa: float, pi: list[float], seed, shape: float | None = None, bins: int | None = None, matrix=None) -> tuple[DataFrame, DataFrame]:
    """Calls (locus, sample, site, allele) of the tree's tips, and the ancestral states (locus, site, anc).

    matrix: the rate matrix of any number of states, instead of HKY's; kappa is not used then.

    A site is one row while its states are drawn from parent to child; the tree is a model's or a genealogy's, with as many
    columns as nodes.
    """
    rates = site_rates(sites, shape, bins, seed)
    k, freq = F.lit(float(kappa)), [F.lit(float(p)) for p in pi]
    key = (F.col("locus"), F.col("site"))
    rows = rates.withColumn("n0", categorical(freq, seed, "root", *key))
    number, names = {id(tree): 0}, {}
    for node in reversed(list(tree.walk())):
        i = number[id(node)]
        if not node.children:
            names[node.name] = i
        made = {}
        for child in node.children:
            j = number[id(child)] = len(number)
            t = F.col("rate") * float(child.dist * mut)
            if matrix is not None:
                # without rates a branch's matrix is known beforehand
                row = F.get(markov.literal(markov.matrix_at(matrix, child.dist * mut)), F.col(f"n{i}")) if shape is None else markov.transition_row(markov.literal(matrix), t, F.col(f"n{i}"), len(pi))
                made[f"n{j}"] = markov.drawn(row, seed, j, *key)
                continue
            states = [categorical([hky.probability(k, freq, t, a, b) for b in range(4)], seed, j, *key) for a in range(4)]
            made[f"n{j}"] = F.when(F.col(f"n{i}") == 0, states[0]).when(F.col(f"n{i}") == 1, states[1]).when(F.col(f"n{i}") == 2, states[2]).otherwise(states[3])
        if made:
            rows = rows.withColumns(made)
    tips = F.explode(F.array(*[F.struct(F.lit(n).alias("sample"), F.col(f"n{i}").alias("allele")) for n, i in sorted(names.items())])).alias("c")
    calls = rows.select("locus", "site", tips).select("locus", "c.sample", "site", "c.allele")
    return calls, rows.select("locus", "site", F.col("n0").alias("anc"))
