"""Coalescent simulation: one locus is one unit of work, and its draws depend on (seed, locus) alone.

Backwards in time, k lineages of a population of size N coalesce at rate C(k,2) / 2N; populations merge at splits, lineages
may move at pulses or, during migration intervals, at constant rates.  With recombination, trees along a locus follow the
sequentially Markov approximation SMC': the next event lies an exponential distance ahead, a uniform point of
the tree is cut, and the cut lineage coalesces again with the lineages present, its own old branch included.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.newick import Node, write

TREES = "locus long, start long, end long, nbps long, nsnps long, tidx int, genealogy string"
ANCESTRY = ("hudson", "smc_prime")
MUTATIONS = "locus long, sample string, site long, derived int"


@dataclass(frozen=True)
class Demography:
    """sizes by population; events sorted by (time, type); tips: (sample, population, time)."""

    sizes: dict[str, float]
    events: list[tuple]  # (time, type, ...): split children parent | pulse source dest rate | migration source dest rate
    tips: list[tuple[str, str, float]]


@dataclass
class _Tree:
    parent: dict[int, int] = field(default_factory=dict)
    height: dict[int, float] = field(default_factory=dict)
    pop: dict[int, list[tuple[float, str]]] = field(default_factory=dict)  # (since, population) along the edge above
    names: dict[int, str] = field(default_factory=dict)

    def children(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for c, p in self.parent.items():
            out.setdefault(p, []).append(c)
        return out

    def length(self) -> float:
        return sum(self.height[p] - self.height[c] for c, p in self.parent.items())

    def pop_at(self, node: int, t: float) -> str:
        return [p for since, p in self.pop[node] if since <= t][-1]

    def newick(self, precision: int) -> str:
        kids, made = self.children(), {}
        for n in sorted(self.height, key=lambda n: (self.height[n], n)):
            if n in self.names or n in kids:
                made[n] = Node(self.names.get(n, ""), self.height[self.parent[n]] - self.height[n] if n in self.parent else 0.0, [made[c] for c in kids.get(n, [])])
        root = next(n for n in made if n not in self.parent)
        return write(made[root], precision)


def generator(seed: int, *keys: int) -> np.random.Generator:
    return np.random.default_rng([int(seed) & 0x7FFFFFFF, *keys])


def _coalesce(d: Demography, rng: np.random.Generator, tree: _Tree, moving: list[int], fixed, t: float) -> tuple[int, float] | None:
    """Run lineages `moving` back in time until one is left (fixed is None) or, with an existing tree, until the single
    moving lineage meets one of fixed(t), the (node, population) edges present at t with the next time they change; the
    edge and the time are returned then."""
    late = sorted((x for x in d.tips if x[2] > t), key=lambda x: x[2]) if fixed is None else []
    where = {n: tree.pop[n][-1][1] for n in moving}
    rates: dict[tuple[str, str], float] = {}
    events = [e for e in d.events if e[0] >= t]
    for e in (e for e in d.events if e[0] < t and e[1] == "migration"):
        rates[e[2], e[3]] = e[4]
    merged = {c: e[3] for e in d.events if e[0] < t and e[1] == "split" for c in e[2]}

    def now(pop: str) -> str:
        while pop in merged:
            pop = merged[pop]
        return pop

    for n in where:
        where[n] = now(where[n])
    nxt = max(tree.height, default=-1) + 1
    while True:
        if fixed is None and len(where) == 1 and not late:
            return
        near, change = fixed(t) if fixed is not None else ([], math.inf)
        mine: dict[str, list[int]] = {}
        for n, p in where.items():
            mine.setdefault(p, []).append(n)
        total = []
        for p, ns in mine.items():
            k = len(ns)
            if k > 1:
                total.append((k * (k - 1) / 2 / (2 * d.sizes[p]), ("own", p)))
            if near:
                m = sum(1 for _, q in near if q == p)
                total.append((k * m / (2 * d.sizes[p]), ("join", p)))
            total += [(k * r, ("move", a, b)) for (a, b), r in rates.items() if a == p and r > 0]
        rate = sum(r for r, _ in total)
        wait = rng.exponential(1 / rate) if rate > 0 else math.inf
        limit = min(events[0][0] if events else math.inf, change, late[0][2] if late else math.inf)
        if t + wait >= limit:
            if limit == math.inf:
                raise ValueError("lineages can never meet: populations are not connected")
            t = limit
            while late and late[0][2] <= t:
                name, pop, at = late.pop(0)
                n = next(i for i, x in tree.names.items() if x == name)
                where[n] = now(pop)
            while events and events[0][0] <= t:
                e = events.pop(0)
                if e[1] == "split":
                    merged.update(dict.fromkeys(e[2], e[3]))
                    moves = [n for n, p in where.items() if p in e[2]]
                    to = e[3]
                elif e[1] == "pulse":
                    moves = [n for n, p in where.items() if p == now(e[2]) and rng.random() < e[4]]
                    to = now(e[3])
                else:
                    rates[e[2], e[3]] = e[4]
                    moves, to = [], ""
                for n in moves:
                    where[n] = to
                    tree.pop[n].append((t, to))
            continue
        t += wait
        pick, what = rng.random() * rate, None
        for r, what in total:
            pick -= r
            if pick < 0:
                break
        if what[0] == "move":
            n = mine[what[1]][rng.integers(len(mine[what[1]]))]
            where[n] = what[2]
            tree.pop[n].append((t, what[2]))
        elif what[0] == "own":
            a, b = rng.choice(len(mine[what[1]]), 2, replace=False)
            for n in (mine[what[1]][a], mine[what[1]][b]):
                tree.parent[n] = nxt
                del where[n]
            tree.height[nxt], tree.pop[nxt] = t, [(t, what[1])]
            where[nxt] = what[1]
            nxt += 1
        else:  # the moving lineage meets an edge of the tree
            others = [n for n, p in near if p == what[1]]
            return others[rng.integers(len(others))], t


def first_tree(d: Demography, rng: np.random.Generator) -> _Tree:
    tree = _Tree()
    for i, (name, pop, at) in enumerate(d.tips):
        tree.names[i], tree.height[i], tree.pop[i] = name, at, [(at, pop)]
    start = min(at for _, _, at in d.tips)
    _coalesce(d, rng, tree, [i for i, (_, _, at) in enumerate(d.tips) if at <= start], None, start)
    return tree


def next_tree(d: Demography, rng: np.random.Generator, old: _Tree) -> tuple[_Tree, bool]:
    """The tree after a recombination, and whether it differs from the old one."""
    edges = list(old.parent)
    lengths = np.array([old.height[old.parent[e]] - old.height[e] for e in edges])
    cut = edges[int(rng.choice(len(edges), p=lengths / lengths.sum()))]
    at = old.height[cut] + rng.random() * (old.height[old.parent[cut]] - old.height[cut])
    tree = _Tree(dict(old.parent), dict(old.height), {n: list(p) for n, p in old.pop.items()}, dict(old.names))
    # the cut lineage floats above its node; its old edge stays as a candidate
    floating = max(tree.height) + 1
    tree.height[floating], tree.pop[floating] = at, [(at, old.pop_at(cut, at))]

    def present(t: float):
        here = [(n, old.pop_at(n, t)) for n in old.pop if old.height[n] <= t < old.height.get(old.parent.get(n, -1), math.inf)]
        later = [h for h in old.height.values() if h > t] + [s for ps in old.pop.values() for s, _ in ps if s > t]
        return here, min(later, default=math.inf)

    target, t = _coalesce(d, rng, tree, [floating], present, at)
    if target == cut:
        return old, False
    above = [x for x in tree.pop.pop(floating) if x[0] > at]
    del tree.height[floating]
    # the cut lineage leaves its parent, whose other child takes the parent's edge over
    gone = tree.parent.pop(cut)
    sibling = next(n for n, p in tree.parent.items() if p == gone)
    grand = tree.parent.pop(gone, None)
    tree.pop[sibling] = tree.pop[sibling] + [x for x in tree.pop[gone] if x[0] > tree.height[gone]]
    if grand is None:
        del tree.parent[sibling]
    else:
        tree.parent[sibling] = grand
    if target == gone:
        target = sibling
    # the freed node joins the cut lineage to the edge it met
    pop = above[-1][1] if above else old.pop_at(cut, at)
    tree.height[gone] = t
    tree.pop[gone] = [(t, pop), *(x for x in tree.pop[target] if x[0] > t)]
    tree.pop[target] = [x for x in tree.pop[target] if x[0] <= t]
    tree.pop[cut] = [x for x in tree.pop[cut] if x[0] <= at] + above
    if target in tree.parent:
        tree.parent[gone] = tree.parent[target]
    tree.parent[target] = tree.parent[cut] = gone
    return tree, True


def intervals(d: Demography, rng: np.random.Generator, nsites: int, recomb) -> list[tuple[int, int, _Tree]]:
    """(start, end, tree) along a locus.  recomb: a rate, or a list of (position, rate) steps."""
    tree, at, out = first_tree(d, rng), 0, []
    start = 0
    while True:
        rate = recomb if not isinstance(recomb, list) else max(r for _, r in recomb)
        total = rate * tree.length()
        step = rng.exponential(1 / total) if total > 0 else math.inf
        if at + step >= nsites:
            out.append((start, nsites, tree))
            return out
        at += step
        if isinstance(recomb, list) and rng.random() * rate > [r for p, r in recomb if p <= at][-1]:
            continue
        new, moved = next_tree(d, rng, tree)
        if moved and (cut := math.ceil(at)) < nsites:
            if cut > start:
                out.append((start, cut, tree))
                start = cut
            tree = new


def mutate(tree: _Tree, rng: np.random.Generator, start: int, end: int, mu: float, probs: np.ndarray, root: np.ndarray) -> tuple[dict[int, int], list[tuple[str, int, int]], dict[int, int]]:
    """Ancestral states at hit sites, (sample, site, allele) of samples that end up with another allele, hits a site.

    probs: transition matrix of a substitution; root: distribution of ancestral states.
    """
    edges = list(tree.parent)
    lengths = np.array([tree.height[tree.parent[e]] - tree.height[e] for e in edges])
    n = rng.poisson(mu * lengths.sum() * (end - start)) if edges else 0
    where = rng.choice(len(edges), n, p=lengths / lengths.sum()) if n else []
    sites = rng.integers(start, end, n)
    times = [tree.height[edges[e]] + rng.random() * lengths[e] for e in where]
    kids, hits = tree.children(), {}
    for e, s, t in zip(where, sites, times, strict=True):
        hits.setdefault(int(s), []).append((t, edges[e]))
    anc, calls = {}, []
    for s in sorted(hits):
        anc[s] = int(rng.choice(len(root), p=root))
        on: dict[int, list[float]] = {}
        for t, e in hits[s]:
            on.setdefault(e, []).append(t)
        stack = [(next(n for n in tree.height if n not in tree.parent), anc[s])]
        while stack:
            node, a = stack.pop()
            for _ in on.get(node, []):
                a = int(rng.choice(len(root), p=probs[a]))
            if node in tree.names and a != anc[s]:
                calls.append((tree.names[node], s, a))
            stack += [(c, a) for c in kids.get(node, [])]
    return anc, calls, {s: len(h) for s, h in hits.items()}


def _loci(spark: SparkSession, n: int, first: int = 0) -> DataFrame:
    return spark.range(first, first + n, numPartitions=max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).select(F.col("id").alias("locus"))


def _intervals(model: str):
    """The trees along a locus under a named ancestry model."""
    from . import ancestry

    if model not in ANCESTRY:
        raise ValueError(f"unknown ancestry model {model}; supported: {', '.join(ANCESTRY)}")
    return intervals if model == "smc_prime" else ancestry.intervals


def sim_trees(spark: SparkSession, d: Demography, nloci: int, nsites: int, recomb, seed: int, precision: int = 14, ancestry_model: str = "smc_prime") -> DataFrame:
    """The result table (D4) without mutations."""
    intervals = _intervals(ancestry_model)

    def run(batches):
        for b in batches:
            out = []
            for locus in b["locus"]:
                for i, (start, end, tree) in enumerate(intervals(d, generator(seed, locus), nsites, recomb)):
                    out.append((locus, start, end, end - start, 0, i, tree.newick(precision)))
            yield pd.DataFrame(out, columns=["locus", "start", "end", "nbps", "nsnps", "tidx", "genealogy"])

    return _loci(spark, nloci).mapInPandas(run, TREES)


LOCI = TREES + ", sites array<struct<site: long, anc: int, nmut: int>>, calls array<struct<sample: string, site: long, allele: int>>"


def sim_loci(spark: SparkSession, d: Demography, nloci: int, nsites: int, mu: float, recomb, seeds: tuple[int, int], probs: np.ndarray, root: np.ndarray, precision: int = 14, ancestry_model: str = "smc_prime") -> DataFrame:
    """The result table with, for each interval, the hit sites and the samples' derived alleles."""
    intervals = _intervals(ancestry_model)

    def run(batches):
        for b in batches:
            out = []
            for locus in b["locus"]:
                rng = generator(seeds[1], locus, 1)
                for i, (start, end, tree) in enumerate(intervals(d, generator(seeds[0], locus), nsites, recomb)):
                    anc, calls, hits = mutate(tree, rng, start, end, mu, probs, root)
                    out.append((locus, start, end, end - start, len(hits), i, tree.newick(precision), [{"site": s, "anc": a, "nmut": hits[s]} for s, a in anc.items()], [{"sample": n, "site": s, "allele": a} for n, s, a in calls]))
            yield pd.DataFrame(out, columns=["locus", "start", "end", "nbps", "nsnps", "tidx", "genealogy", "sites", "calls"])

    return _loci(spark, nloci).mapInPandas(run, LOCI)


def sim_snps(spark: SparkSession, d: Demography, nsnps: int, mu: float, seeds: tuple[int, int], probs: np.ndarray, root: np.ndarray, min_alleles: int = 2, max_alleles: int | None = None, min_mutations: int = 1, max_mutations: int | None = None, repeat_on_trees: bool = False, precision: int = 14, batch: int | None = None, most_candidates: int | None = None) -> DataFrame:
    """nsnps unlinked SNPs by rejection: candidates are numbered and the first accepted ones are taken, so that
    the result doesn't depend on partitions.  The search goes on until all are found, in steps that follow the share accepted so far;
    with `most_candidates` it ends there with an error.  repeat_on_trees: mutations are drawn again on the same tree (biased)."""
    most_a, most_m = max_alleles or 100_000, max_mutations or 100_000
    if min_mutations < 1 or most_m < min_mutations:
        raise ValueError("min_mutations must be positive and at most max_mutations")

    def run(batches):
        for b in batches:
            out = []
            for k in b["locus"]:
                rng = generator(seeds[1], k, 2)
                tree = first_tree(d, generator(seeds[0], k))
                for _ in range(100_000 if repeat_on_trees else 1):
                    anc, calls, hits = mutate(tree, rng, 0, 1, mu, probs, root)
                    states = {a for _, _, a in calls} | ({anc[0]} if anc and len(calls) < len(tree.names) else set())
                    if min_mutations <= hits.get(0, 0) <= most_m and min_alleles <= len(states) <= most_a:
                        out.append((k, 0, 1, 1, 1, 0, tree.newick(precision), [{"site": 0, "anc": anc[0], "nmut": hits[0]}], [{"sample": n, "site": 0, "allele": a} for n, _, a in calls]))
                        break
            yield pd.DataFrame(out, columns=["locus", "start", "end", "nbps", "nsnps", "tidx", "genealogy", "sites", "calls"])

    if mu <= 0:
        raise ValueError("SNPs need a mutation rate")
    # about as many candidates as SNPs need at the rate of an average tree
    hit = mu * _mean_length(d, seeds[0])
    first, found, step, parts = 0, 0, batch or min(1_000_000, max(64, math.ceil(1.5 * nsnps / max(1e-6, 1 if repeat_on_trees else min(1.0, hit))))), []
    while found < nsnps:
        part = _loci(spark, step, first).mapInPandas(run, LOCI).cache()
        parts.append(part)
        got = part.count()
        found, first = found + got, first + step
        if most_candidates is not None and first >= most_candidates and found < nsnps:
            raise ValueError(f"{found} of {nsnps} SNPs among {first} candidates")
        step = min(1_000_000, max(step, math.ceil(1.2 * (nsnps - found) * step / max(got, 1))))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    from pyspark.sql import Window as W

    taken = every.orderBy("locus").limit(nsnps)
    return taken.withColumn("locus", (F.row_number().over(W.orderBy("locus")) - 1).cast("long"))


def _mean_length(d: Demography, seed: int, trees: int = 20) -> float:
    """Mean length of a few trees of the model."""
    return float(np.mean([first_tree(d, generator(seed, k)).length() for k in range(trees)]))


def table(loci: DataFrame) -> DataFrame:
    """The seven columns of the result table."""
    return loci.select("locus", "start", "end", "nbps", "nsnps", "tidx", "genealogy")


def derived(loci: DataFrame) -> DataFrame:
    """locus, sample, site, derived."""
    return loci.select("locus", F.explode("calls").alias("c")).select("locus", "c.sample", "c.site", F.col("c.allele").alias("derived"))


def hit_sites(loci: DataFrame) -> DataFrame:
    """locus, site, anc, nmut."""
    return loci.select("locus", F.explode("sites").alias("s")).select("locus", "s.site", "s.anc", "s.nmut")
