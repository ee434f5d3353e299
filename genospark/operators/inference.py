"""Gene trees from sequences, one locus a group, and quartet frequencies of gene trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.newick import Node, parse, write


def jc_matrix(seqs: list[str]) -> np.ndarray:
    x = np.array([list(s) for s in seqs])
    # a sequence against all at a time
    p = np.array([(one != x).mean(axis=1) for one in x]) if x.size else np.zeros((len(seqs), len(seqs)))
    return -0.75 * np.log(1 - 4 / 3 * np.minimum(p, 0.7499))


def neighbor_joining(names: list[str], d: np.ndarray) -> Node:
    """The published algorithm of Saitou and Nei; ties go to the first pair."""
    nodes, d = [Node(n) for n in names], d.astype(float).copy()
    while len(nodes) > 3:
        n = len(nodes)
        total = d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(q.argmin()), n))
        a = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        nodes[i].dist, nodes[j].dist = max(a, 0.0), max(d[i, j] - a, 0.0)
        new = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        joined = Node(children=[nodes[i], nodes[j]])
        d = np.block([[d[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None, :], np.zeros((1, 1))]])
        nodes = [nodes[k] for k in keep] + [joined]
    if len(nodes) == 3:
        for k, (i, j) in enumerate(((1, 2), (0, 2), (0, 1))):
            nodes[k].dist = max(0.0, (d[k, i] + d[k, j] - d[i, j]) / 2)
    elif len(nodes) == 2:
        nodes[0].dist = nodes[1].dist = d[0, 1] / 2
    return nodes[0] if len(nodes) == 1 else Node(children=nodes)


def upgma(names: list[str], d: np.ndarray) -> Node:
    nodes, sizes, heights, d = [Node(n) for n in names], [1] * len(names), [0.0] * len(names), d.astype(float).copy()
    while len(nodes) > 1:
        m = d + np.diag(np.full(len(nodes), np.inf))
        i, j = sorted(divmod(int(m.argmin()), len(nodes)))
        h = d[i, j] / 2
        nodes[i].dist, nodes[j].dist = h - heights[i], h - heights[j]
        new = (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j])
        keep = [k for k in range(len(nodes)) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None, :], np.zeros((1, 1))]])
        nodes, sizes, heights = [nodes[k] for k in keep] + [Node(children=[nodes[i], nodes[j]])], [sizes[k] for k in keep] + [sizes[i] + sizes[j]], [heights[k] for k in keep] + [h]
    return nodes[0]


ESTIMATORS = {"nj": neighbor_joining, "upgma": upgma}


def gene_trees(seqs: DataFrame, estimator: str = "nj", precision: int = 6) -> DataFrame:
    """locus, nsamples, gene_tree.  seqs: locus, name, seq.  Loci without differences get a star tree."""
    build = ESTIMATORS[estimator]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("name")
        names, texts = list(g["name"]), list(g["seq"])
        if len(set(texts)) == 1:
            tree = Node(children=[Node(n) for n in names]) if len(names) > 1 else Node(names[0])
        else:
            tree = build(names, jc_matrix(texts))
        return pd.DataFrame({"locus": [key[0]], "nsamples": [len(names)], "gene_tree": [write(tree, precision)]})

    return seqs.groupBy("locus").applyInPandas(run, "locus long, nsamples long, gene_tree string")


def concatenated_tree(seqs: DataFrame, estimator: str = "nj", precision: int = 6) -> DataFrame:
    """nsamples, gene_tree: one tree of all loci side by side.  Distances add up over loci, so no task holds all sequences.

    seqs: locus, name, seq; of equal length within a locus.
    """
    build = ESTIMATORS[estimator]

    def count(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("name")
        names, x = list(g["name"]), np.array([list(s) for s in g["seq"]])
        diff = np.array([(one != x).sum(axis=1) for one in x]) if x.size else np.zeros((len(names), len(names)), dtype=int)
        at = [(a, b, int(diff[i, j]), x.shape[1]) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
        return pd.DataFrame(at, columns=["s0", "s1", "ndiff", "nsites"])

    parts = seqs.groupBy("locus").applyInPandas(count, "s0 string, s1 string, ndiff long, nsites long")
    # one row a pair of samples
    pairs = parts.groupBy("s0", "s1").agg(F.sum("ndiff").alias("ndiff"), F.sum("nsites").alias("nsites")).toPandas()
    names = sorted({*pairs["s0"], *pairs["s1"]})
    at = {n: i for i, n in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for r in pairs.itertuples():
        p = min(r.ndiff / max(1, r.nsites), 0.7499)
        d[at[r.s0], at[r.s1]] = d[at[r.s1], at[r.s0]] = -0.75 * np.log(1 - 4 / 3 * p)
    rows = [(len(names), write(build(names, d), precision))] if names else []
    return seqs.sparkSession.createDataFrame(rows, "nsamples long, gene_tree string")


def window_trees(calls: DataFrame, width: int, estimator: str = "nj") -> DataFrame:
    """locus, window, start, end, nvariable, gene_tree of every tumbling window of sites."""
    from ..sources.writers import pack
    from .numbering import ranked
    from .stats import site_windows

    number = F.floor(F.col("site") / width)
    keyed = calls.withColumn("locus", F.struct("locus", number.alias("window")))
    each = pack(keyed).select(F.col("locus").alias("w"), F.col("sample").cast("string").alias("name"), "seq")
    # windows are numbered, so that no two meet
    numbers = ranked(each.select("w").distinct(), ["w"], "id")
    trees = gene_trees(each.join(numbers, "w").select(F.col("id").alias("locus"), "name", "seq"), estimator)
    named = trees.join(numbers, trees["locus"] == numbers["id"]).select("w.locus", "w.window", "gene_tree")
    return site_windows(calls, width).join(named, ["locus", "window"])


def internode_distances(trees: DataFrame, column: str = "gene_tree", imap: dict[str, str] | None = None) -> DataFrame:
    """a < b, n, dist: the mean number of inner nodes between two taxa over all trees that have both.

    imap: taxon of a tip; the tips' own names without it.
    """
    imap = imap or {}

    def run(batches):
        for b in batches:
            total: dict[tuple[str, str], list[int]] = {}
            for text in b[column]:
                root = parse(text)
                up = {id(c): n for n in root.walk() for c in n.children}
                paths = []
                for tip in root.leaves():
                    path, at = [], tip
                    while id(at) in up:
                        at = up[id(at)]
                        path.append(id(at))
                    paths.append((imap.get(tip.name, tip.name), path))
                # an unrooted tree: a root of two children is no node
                bare = {id(root)} if len(root.children) == 2 else set()
                for i, (x, p) in enumerate(paths):
                    place = {n: k for k, n in enumerate(p)}
                    for y, q in paths[i + 1 :]:
                        if x != y:
                            k, j = next((k, place[n]) for k, n in enumerate(q) if n in place)
                            nodes = k + j + 1 - len(bare & {q[k]})
                            got = total.setdefault((min(x, y), max(x, y)), [0, 0])
                            got[0] += nodes
                            got[1] += 1
            yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=["a", "b", "s", "n"])

    parts = trees.select(column).mapInPandas(run, "a string, b string, s long, n long")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("dist"))


def species_tree(trees: DataFrame, column: str = "gene_tree", imap: dict[str, str] | None = None, precision: int = 6) -> str:
    """An unrooted species tree from gene trees: neighbour joining on mean internode distances, which is consistent under the coalescent."""
    # one row a pair of taxa
    rows = internode_distances(trees, column, imap).collect()
    names = sorted({x for r in rows for x in (r["a"], r["b"])})
    at = {n: i for i, n in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = r["dist"]
    return write(neighbor_joining(names, d), precision)


def quartet_topologies(trees: DataFrame, column: str = "gene_tree") -> DataFrame:
    """quartet (four tips), topology (the pair that holds the first tip, | the other), n: over all trees and quartets."""

    def run(batches):
        from itertools import combinations

        for b in batches:
            out: dict[tuple[str, str], int] = {}
            for text in b[column]:
                root = parse(text)
                below: dict[int, frozenset] = {}
                for n in root.walk():
                    below[id(n)] = frozenset([n.name]) if not n.children else frozenset().union(*(below[id(c)] for c in n.children))
                tips = sorted(below[id(root)])
                clades = [c for c in below.values() if 1 < len(c) < len(tips)]
                for q in combinations(tips, 4):
                    split = next((s for c in clades if len(s := c & set(q)) == 2), None)
                    if split is not None:
                        pair = sorted(split if q[0] in split else set(q) - split)
                        key = (",".join(q), f"{','.join(pair)}|{','.join(sorted(set(q) - set(pair)))}")
                        out[key] = out.get(key, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["quartet", "topology", "n"])

    parts = trees.select(column).mapInPandas(run, "quartet string, topology string, n long")
    return parts.groupBy("quartet", "topology").agg(F.sum("n").alias("n"))
