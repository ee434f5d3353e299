"""Likelihood of alignments on trees, and the trees of largest likelihood.

An alignment is reduced to its distinct columns (site patterns).  Felsenstein's pruning runs over the patterns of a locus in array functions: a tip has the vector of its
state, an inner node the product of what its children's vectors become along their branches, and the logarithms of the root's sums add up over patterns.
Branch lengths are climbed one after the other, by factors that get smaller; that too is one expression over the row of a locus and a tree.

Relations: seqs (locus, name, seq; of equal length within a locus), candidates (locus, tree: a Newick string).  Sequences are compared under Jukes and Cantor's model, or
under any rate matrix over A, C, G, T.  Other letters are missing: any state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markov import dot, let, literal, transition
from ..sources.newick import Node, parse, write
from ..sources.tables import erase, written
from .inference import gene_trees

BASES = "ACGT"
SHAPE = "locus long, tree string, ntips int, nodes array<struct<children: array<int>, edges: array<int>>>, lengths array<double>"


def columns(seqs: DataFrame) -> DataFrame:
    """locus, names (in order), sites: the distinct columns as struct(states: 0 to 3, -1 for missing, in the order of the names; n: how many sites have them)."""
    rows = seqs.groupBy("locus").agg(F.sort_array(F.collect_list(F.struct("name", "seq"))).alias("all"))
    place = F.explode(F.sequence(F.lit(1), F.greatest(F.length(F.get("all", F.lit(0))["seq"]), F.lit(1)))).alias("at")
    letters = F.array_join(F.transform("all", lambda s: F.substring(s["seq"], F.col("at"), F.lit(1))), "")
    each = rows.select("locus", "all", place).select("locus", F.transform("all", lambda s: s["name"]).alias("names"), letters.alias("column"))
    some = each.groupBy("locus", "names", "column").agg(F.count("*").alias("n"))
    # a letter's place among the bases; others are -1
    states = F.transform(F.sequence(F.lit(1), F.size("names")), lambda i: F.position(F.upper(F.substring("column", i, F.lit(1))), F.lit(BASES)) - 1)
    return some.where("length(column) > 0").select("locus", "names", F.struct(states.alias("states"), F.col("n")).alias("site")).groupBy("locus", "names").agg(F.collect_list("site").alias("sites"))


def unrooted(tree: Node) -> Node:
    """A root of two children is no node of an unrooted tree: the inner one of them takes the other as a child."""
    if len(tree.children) != 2 or not any(c.children for c in tree.children):
        return tree
    inner, other = sorted(tree.children, key=lambda c: not c.children)
    return Node(children=[*inner.children, Node(other.name, (inner.dist or 0.0) + (other.dist or 0.0), other.children)])


def shape(tree: Node) -> tuple[int, list[dict], list[float]]:
    """The number of tips, inner nodes (children, edges) from the tips up, and branch lengths; tips are numbered in the order of their names, then inner nodes."""
    names = sorted(n.name for n in tree.leaves())
    number, nodes, lengths = {}, [], []
    for node in tree.walk():
        if node.children:
            edges = range(len(lengths), len(lengths) + len(node.children))
            lengths += [max(float(c.dist or 0.0), 1e-6) for c in node.children]
            number[id(node)] = len(names) + len(nodes)
            nodes.append({"children": [number[id(c)] for c in node.children], "edges": list(edges)})
        else:
            number[id(node)] = names.index(node.name)
    return len(names), nodes, lengths


def _with_lengths(tree: Node, lengths) -> Node:
    k = 0
    for node in tree.walk():
        for c in node.children:
            c.dist, k = float(lengths[k]), k + 1
    return tree


def neighbours(tree: Node) -> list[str]:
    """The trees that one interchange across an inner edge gives."""
    out = []
    inner = [(p, c) for p in tree.walk() for c in p.children if c.children]
    for p, c in inner:
        sibling = next(s for s in p.children if s is not c)
        for k in range(len(c.children)):
            i = next(i for i, s in enumerate(p.children) if s is sibling)
            p.children[i], c.children[k] = c.children[k], sibling
            out.append(write(tree, 8))
            p.children[i], c.children[k] = sibling, p.children[i]
    return out


def topologies(names: list[str]) -> list[str]:
    """All unrooted binary trees of some names."""
    trees = [Node(children=[Node(n, 0.1) for n in names[:3]])]
    for name in names[3:]:
        grown = []
        for tree in trees:
            for k in range(sum(len(n.children) for n in tree.walk())):
                copy = parse(write(tree, 8))
                spots = [(n, i) for n in copy.walk() for i in range(len(n.children))]
                node, i = spots[k]
                node.children[i] = Node(dist=0.1, children=[node.children[i], Node(name, 0.1)])
                grown.append(copy)
        trees = grown
    return [write(t, 8) for t in trees]


def _log_likelihood(lengths: Column, q: Column | None, pi: list[float]) -> Column:
    """Of the row's nodes and sites, with given branch lengths."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    if q is None:
        # what each branch keeps; the rest is dealt evenly
        branches = F.transform(lengths, lambda t: F.exp(-4.0 / 3.0 * t))
        along = lambda v, e: let(total(v), lambda s: F.transform(v, lambda x: (1 - e) / 4 * s + e * x))
    else:
        branches = F.transform(lengths, lambda t: transition(q, t, len(pi)))
        along = lambda v, p: F.transform(p, lambda row: dot(row, v))
    n = len(pi)
    tip = lambda s: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when((s < 0) | (s == j), 1.0).otherwise(0.0))

    def site(states: Column, b: Column) -> Column:
        def up(a: Column, node: Column) -> Column:
            parts = F.zip_with(node["children"], node["edges"], lambda c, e: along(F.get(a["v"], c), F.get(b, e)))
            joint = F.aggregate(parts, literal([1.0] * n), lambda x, y: F.zip_with(x, y, lambda u, w: u * w))
            # scaled, so that large trees don't underflow
            return let(joint, lambda v: let(total(v), lambda s: F.struct(F.concat(a["v"], F.array(F.transform(v, lambda x: x / s))).alias("v"), (a["log"] + F.ln(s)).alias("log"))))

        start = F.struct(F.transform(states, tip).alias("v"), F.lit(0.0).alias("log"))
        return let(F.aggregate("nodes", start, up), lambda a: F.ln(dot(F.element_at(a["v"], -1), literal(pi))) + a["log"])

    return let(branches, lambda b: F.aggregate("sites", F.lit(0.0), lambda sum_, x: sum_ + x["n"] * site(x["states"], b)))


#: By what branch lengths are multiplied and divided in turn: from far to the optimum, and near a tree whose lengths are there.
FACTORS = [4.0, 2.0, 1.5, 1.2, 1.1, 1.05, 1.02, 1.01, 1.003, 1.001]
NEAR = [3.0, 1.5, 1.2, 1.07]


def scored(candidates: DataFrame, sites: DataFrame, climb: bool = True, sweeps: int = 3, factors: list[float] | None = None, q: Column | None = None, pi: list[float] | None = None) -> DataFrame:
    """candidates with lengths (in the order of `shape`) and loglik; with `climb` the lengths are those of largest likelihood, else the trees' own."""
    pi, factors = pi or [0.25] * 4, factors or FACTORS

    def run(batches):
        for b in batches:
            rows = [(*r, *shape(parse(r[1]))) for r in zip(b["locus"], b["tree"], strict=True)]
            yield pd.DataFrame(rows, columns=["locus", "tree", "ntips", "nodes", "lengths"])

    # each is much work: dealt to all cores, whatever the size of their rows
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    rows = candidates.select("locus", "tree").mapInPandas(run, SHAPE).join(sites, "locus").repartition(cores, "locus", "tree")
    if not climb:
        return rows.withColumn("loglik", _log_likelihood(F.col("lengths"), q, pi)).select("locus", "tree", "lengths", "loglik")
    edges = F.size("lengths")
    value = lambda x: _log_likelihood(x, q, pi)

    def step(a: Column, i: Column) -> Column:
        f = F.get(literal(factors), F.floor(i / (edges * sweeps)).cast("int"))
        moved = lambda g: F.transform(a["x"], lambda t, k: F.when(k == i % edges, F.least(F.greatest(t * g, F.lit(1e-8)), F.lit(20.0))).otherwise(t))
        better = lambda p, x: let(x, lambda y: let(value(y), lambda v: F.when(v > p["best"], F.struct(y.alias("x"), v.alias("best"))).otherwise(p)))
        return let(better(a, moved(f)), lambda p: better(p, F.when(p["best"] > a["best"], p["x"]).otherwise(moved(1 / f))))

    steps = F.sequence(F.lit(0), edges * sweeps * len(factors) - 1)
    out = rows.withColumn("out", F.aggregate(steps, F.struct(F.col("lengths").alias("x"), value(F.col("lengths")).alias("best")), step))
    return out.select("locus", "tree", F.col("out.x").alias("lengths"), F.col("out.best").alias("loglik"))


def _best(scores: DataFrame) -> DataFrame:
    return scores.groupBy("locus").agg(F.max_by(F.struct("tree", "lengths", "loglik"), F.struct("loglik", "tree")).alias("b")).select("locus", "b.*")


def ml_trees(seqs: DataFrame, q: Column | None = None, pi: list[float] | None = None, precision: int = 6) -> DataFrame:
    """locus, nsamples, gene_tree, loglik: the unrooted tree of largest likelihood that interchanges reach from the neighbour-joining tree.

    Each round scores all interchanges of the loci that still got better, in one pass, with lengths near the tree's; the best of a locus then gets its own lengths.
    Loci of three sequences have one tree, of fewer none.
    """
    sites = written(columns(seqs), "site-patterns")

    def start(batches):
        for b in batches:
            yield pd.DataFrame({"locus": b["locus"], "tree": [write(unrooted(parse(t)), 8) for t in b["gene_tree"]]})

    def around(batches):
        for b in batches:
            rows = [(locus, t) for locus, tree, lengths in zip(b["locus"], b["tree"], b["lengths"], strict=True) for t in neighbours(_with_lengths(parse(tree), lengths))]
            yield pd.DataFrame(rows, columns=["locus", "tree"])

    def lengthened(batches):
        for b in batches:
            yield pd.DataFrame({"locus": b["locus"], "tree": [write(_with_lengths(parse(t), x), 8) for t, x in zip(b["tree"], b["lengths"], strict=True)]})

    def finish(batches):
        for b in batches:
            yield pd.DataFrame({"locus": b["locus"], "nsamples": [len(parse(t).leaves()) for t in b["tree"]], "gene_tree": [write(_with_lengths(parse(t), x), precision) for t, x in zip(b["tree"], b["lengths"], strict=True)], "loglik": b["loglik"]})

    first = gene_trees(seqs, precision=8).where("nsamples > 2").mapInPandas(start, "locus long, tree string")
    best = written(_best(scored(first, sites, q=q, pi=pi)), "ml-trees")
    open_ = best
    while open_.limit(1).count():
        near = _best(scored(open_.mapInPandas(around, "locus long, tree string"), sites, sweeps=1, factors=NEAR, q=q, pi=pi)).mapInPandas(lengthened, "locus long, tree string")
        tried = _best(scored(near, sites, sweeps=2, q=q, pi=pi))
        old = best.select("locus", F.col("loglik").alias("__old"))
        open_ = written(tried.join(old, "locus").where(F.col("loglik") > F.col("__old") + 1e-6).drop("__old"), "ml-better")
        new = written(best.join(open_.select("locus"), "locus", "left_anti").unionByName(open_), "ml-trees")
        erase(best)
        best = new
    return best.mapInPandas(finish, "locus long, nsamples long, gene_tree string, loglik double")
