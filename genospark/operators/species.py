"""Species trees that share the most quartets with gene trees: weights of splits over all nodes of all gene trees, then dynamic programming over clades by size.

A clade is a set of taxa without taxon 0, which roots all trees; it is known by `bits`, an array of words of 62 taxa.  A split is a clade cut in two.  Its weight
is the number of quartets that a node of a gene tree and the split resolve alike; every quartet that two trees share has two such pairs of nodes.

relations:  parts (parts: for every side of a gene tree's node the samples of each taxon; n: gene-tree nodes alike), clades (bits, size, low), splits (c, a, b, size, w)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.newick import Node, parse
from ..sources.tables import erase, written
from .inference import species_tree

WORD = 62
CLADES = "bits array<long>, size int, low int"
#: Up to so many taxa all clades are candidates, so that the tree is the best of all.
ALL_CLADES = 8


def _bits(members: np.ndarray) -> list[int]:
    """Words of a row of flags."""
    return [sum(1 << i for i in np.flatnonzero(members[k : k + WORD]).tolist()) for k in range(0, len(members), WORD)]


def _clade(members: np.ndarray) -> tuple[list[int], int, int]:
    return _bits(members), int(members.sum()), int(np.flatnonzero(members)[0])


def _below(root: Node, taxon: dict[str, int], imap: dict[str, str]) -> dict[int, np.ndarray]:
    """The samples of each taxon below every node."""
    below: dict[int, np.ndarray] = {}
    for node in root.walk():
        own = np.zeros(len(taxon), dtype=np.int64)
        if not node.children:
            own[taxon[imap.get(node.name, node.name)]] = 1
        for c in node.children:
            own += below[id(c)]
        below[id(node)] = own
    return below


def taxa_of(trees: DataFrame, column: str = "gene_tree", imap: dict[str, str] | None = None) -> list[str]:
    """The taxa of all trees in order: the tips of the tree to be found."""
    imap = imap or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": sorted({imap.get(t.name, t.name) for text in b[column] if text for t in parse(text).leaves()})})

    return sorted(r["name"] for r in trees.select(column).mapInPandas(run, "name string").distinct().collect())


def tree_parts(trees: DataFrame, taxa: list[str], column: str = "gene_tree", imap: dict[str, str] | None = None) -> DataFrame:
    """parts, n: the inner nodes of all trees by what lies on each of their sides, and how many nodes are alike.  Nodes may have any number of sides; null trees have none."""
    imap, taxon = imap or {}, {t: i for i, t in enumerate(taxa)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count: dict[tuple, int] = {}
            for text in b[column]:
                if not text:
                    continue
                root = parse(text)
                below = _below(root, taxon, imap)
                for node in root.walk():
                    sides = [below[id(c)] for c in node.children]
                    if node is not root:
                        sides.append(below[id(root)] - below[id(node)])
                    # fewer than three sides resolve nothing
                    if node.children and len(sides) > 2:
                        key = tuple(sorted(tuple(s.tolist()) for s in sides))
                        count[key] = count.get(key, 0) + 1
            yield pd.DataFrame({"parts": [[list(p) for p in k] for k in count], "n": list(count.values())})

    return trees.select(column).mapInPandas(run, "parts array<array<long>>, n long").groupBy("parts").agg(F.sum("n").alias("n"))


def tree_clades(trees: DataFrame, taxa: list[str], column: str = "gene_tree", imap: dict[str, str] | None = None) -> DataFrame:
    """bits, size, low (smallest taxon): sides of edges without taxon 0.  A taxon is on the side that has more than half of its samples in the tree."""
    imap, taxon = imap or {}, {t: i for i, t in enumerate(taxa)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: set[tuple] = set()
            for text in b[column]:
                if not text:
                    continue
                root = parse(text)
                below = _below(root, taxon, imap)
                there = below[id(root)] > 0
                for own in below.values():
                    side = 2 * own > below[id(root)]
                    side = there & ~side if side[0] else side
                    if side.any() and not side[0]:
                        seen.add(tuple(side.tolist()))
            rows = [_clade(np.array(s)) for s in seen]
            yield pd.DataFrame(rows, columns=["bits", "size", "low"])

    return trees.select(column).mapInPandas(run, CLADES).distinct()


def all_clades(trees: DataFrame, taxa: list[str]) -> DataFrame:
    """Every set of taxa but taxon 0: for small numbers of taxa."""
    number = trees.sparkSession.range(1, 1 << (len(taxa) - 1)).select((F.col("id") * 2).alias("x"))
    low = F.aggregate(F.sequence(F.lit(1), F.lit(len(taxa) - 1)), F.lit(len(taxa)), lambda a, i: F.when(F.get(F.split(F.reverse(F.bin("x")), ""), i) == "1", F.least(a, i)).otherwise(a))
    return number.select(F.array("x").alias("bits"), F.bit_count("x").cast("int").alias("size"), low.alias("low"))


def splits_of(clades: DataFrame) -> DataFrame:
    """c, a, b, size: the clades that are the union of two others; a has the smallest taxon of c, so that a split comes once, and clades meet by that taxon."""
    c = clades.where("size > 1").select(F.col("bits").alias("c"), "size", "low")
    a = clades.select(F.col("bits").alias("a"), F.col("size").alias("a_size"), F.col("low").alias("a_low"))
    inside = F.forall(F.zip_with("a", "c", lambda x, y: x.bitwiseAND(F.bitwise_not(y)) == 0), lambda x: x)
    rest = F.zip_with("c", "a", lambda x, y: x.bitwiseAND(F.bitwise_not(y)))
    cut = c.join(a, (F.col("low") == F.col("a_low")) & (F.col("a_size") < F.col("size")) & inside).select("c", "a", rest.alias("b"), "size")
    return cut.join(clades.select(F.col("bits").alias("b")), "b", "left_semi").select("c", "a", "b", "size")


def _flags(bits, n: int) -> np.ndarray:
    """Rows of words as rows of flags."""
    words = np.array([list(b) for b in bits], dtype=np.int64).reshape(len(bits), -1)
    return np.concatenate([(words[:, [k]] >> np.arange(WORD)) & 1 for k in range(words.shape[1])], axis=1)[:, :n]


def _weights(parts: list[np.ndarray], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quartets of splits (rows of a and b) with two samples on one side of a node and one on each of two others, each in its own part of the split.

    Over three different sides: all triples, less those with two equal sides, twice those with three.
    """
    flat, first = np.concatenate(parts), np.cumsum([0, *[len(p) for p in parts[:-1]]])
    x, y = flat @ a.T, flat @ b.T
    z = flat.sum(axis=1)[:, None] - x - y
    add = lambda v: np.add.reduceat(v, first, axis=0)
    # pairs of samples of different taxa
    square = flat * flat
    xx, yy = square @ a.T, square @ b.T
    zz = square.sum(axis=1)[:, None] - xx - yy
    total = 0
    for u, v, w in (((x * x - xx) // 2, y, z), ((y * y - yy) // 2, x, z), ((z * z - zz) // 2, x, y)):
        total = total + add(u) * add(v) * add(w) - add(u * v) * add(w) - add(u * w) * add(v) - add(v * w) * add(u) + 2 * add(u * v * w)
    return (n[:, None] * total).sum(axis=0)


def weighted(splits: DataFrame, parts: DataFrame, ntaxa: int, nodes: int = 50_000, block: int = 256) -> DataFrame:
    """splits with w.  The nodes of the gene trees are dealt to tasks of some `nodes`, and every task gets all splits, as a query set over all nodes."""
    tasks = max(1, -(-parts.count() // nodes))
    dealt = parts.withColumn("task", F.pmod(F.xxhash64("parts"), F.lit(tasks)).cast("int"))
    every = splits.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def run(key: tuple, some: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
        a, b, w = _flags(cut["a"], ntaxa), _flags(cut["b"], ntaxa), np.zeros(len(cut), dtype=np.int64)
        sides, n = [np.array([list(p) for p in x], dtype=np.int64) for x in some["parts"]], some["n"].to_numpy()
        if len(sides):
            for i in range(0, len(cut), block):
                for j in range(0, len(sides), 4 * block):
                    w[i : i + block] += _weights(sides[j : j + 4 * block], n[j : j + 4 * block], a[i : i + block], b[i : i + block])
        return cut[["c", "a", "b", "size"]].assign(w=w)

    kind = "c array<long>, a array<long>, b array<long>, size int, w long"
    return dealt.groupBy("task").cogroup(every.groupBy("task")).applyInPandas(run, kind).groupBy("c", "a", "b", "size").agg(F.sum("w").alias("w"))


def quartet_species_tree(trees: DataFrame, column: str = "gene_tree", imap: dict[str, str] | None = None, exact: int = ALL_CLADES) -> DataFrame:
    """species_tree, score, ntaxa: the tree whose quartets agree with the most quartets of the gene trees, one row.

    imap: taxon of a tip; the tips' own names without it.  Up to `exact` taxa it is the best of all trees; beyond, the best of those whose clades are sides of
    the gene trees' edges or of the tree of internode distances, which makes sure that there is one.  Ties go to the tree that is first as text.  Quartets of
    samples of fewer than four taxa don't count.  Null or empty trees take no part;
    without any tree there is no row.  Under four taxa there is one tree, with score 0.
    """
    spark = trees.sparkSession
    taxa = taxa_of(trees, column, imap)
    kind = "species_tree string, score long, ntaxa int"
    if len(taxa) < 4:
        return spark.createDataFrame([("(" + ",".join(taxa) + ");" if len(taxa) > 1 else f"{taxa[0]};", 0, len(taxa))] if taxa else [], kind)
    if len(taxa) <= exact:
        clades = all_clades(trees, taxa)
    else:
        guide = spark.createDataFrame([(species_tree(trees.where(F.length(column) > 0), column, imap),)], "guide string")
        ones = spark.createDataFrame([_clade(np.arange(len(taxa)) == i) for i in range(1, len(taxa))] + [_clade(np.arange(len(taxa)) > 0)], CLADES)
        clades = tree_clades(trees, taxa, column, imap).unionByName(tree_clades(guide, taxa, "guide")).unionByName(ones).distinct()
    clades, parts = written(clades, "clades"), written(tree_parts(trees, taxa, column, imap), "tree-parts")
    splits = written(weighted(splits_of(clades), parts, len(taxa)), "splits")
    names = F.array(*[F.lit(t) for t in taxa])
    best = written(clades.where("size = 1").select("bits", F.lit(0).cast("long").alias("score"), F.get(names, F.col("low")).alias("tree")), "species")
    levels = [best]
    for size in range(2, len(taxa)):
        of = lambda p: best.select(F.col("bits").alias(p), F.col("score").alias(f"{p}_score"), F.col("tree").alias(f"{p}_tree"))
        cut = splits.where(F.col("size") == size).join(of("a"), "a").join(of("b"), "b")
        text = F.concat(F.lit("("), F.least("a_tree", "b_tree"), F.lit(","), F.greatest("a_tree", "b_tree"), F.lit(")"))
        one = cut.select("c", F.struct((-(F.col("w") + F.col("a_score") + F.col("b_score"))).alias("less"), text.alias("tree")).alias("x")).groupBy("c").agg(F.min("x").alias("x"))
        levels.append(written(one.select(F.col("c").alias("bits"), (-F.col("x.less")).alias("score"), F.col("x.tree").alias("tree")), "species"))
        best = best.unionByName(levels[-1])
    out = levels[-1].select(F.concat(F.lit(f"({taxa[0]},"), "tree", F.lit(");")).alias("species_tree"), (F.col("score") / 2).cast("long").alias("score"), F.lit(len(taxa)).alias("ntaxa"))
    # the last level has one row; the rest isn't read again
    erase(clades, parts, splits, *levels[:-1])
    return out
