"""Newick text to node rows and back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = re.compile(r"\s*([(),;]|:[^(),;]*|'[^']*'|[^(),:;]+)")
SCHEMA = "tree long, idx int, parent int, name string, dist double, height double, is_leaf boolean"


@dataclass
class Node:
    name: str = ""
    dist: float = 0.0
    children: list[Node] = field(default_factory=list)
    height: float = 0.0
    ne: float | None = None

    def walk(self) -> Iterator[Node]:
        """Nodes below first, without recursion."""
        stack = [(self, False)]
        while stack:
            node, seen = stack.pop()
            if seen or not node.children:
                yield node
            else:
                stack.append((node, True))
                stack += [(c, False) for c in reversed(node.children)]

    def leaves(self) -> list[Node]:
        return [n for n in self.walk() if not n.children]


def parse(text: str) -> Node:
    """A tree from Newick text; heights count up from the deepest tip.  Empty text is one node `n0`."""
    root = Node()
    stack, node = [], root
    for piece in PIECE.findall(text.strip()):
        if piece == "(":
            stack.append(node)
            node = Node()
            stack[-1].children.append(node)
        elif piece == ",":
            node = Node()
            stack[-1].children.append(node)
        elif piece == ")":
            node = stack.pop()
        elif piece == ";":
            break
        elif piece[0] == ":":
            node.dist = float(piece[1:].split("[")[0])
        else:
            node.name = piece.strip().strip("'")
    if stack:
        raise ValueError("unbalanced parentheses in tree")
    if not root.children and not root.name:
        root.name = "n0"
    return with_heights(root)


def with_heights(root: Node) -> Node:
    depth = {id(root): 0.0}
    order = list(root.walk())
    for node in reversed(order):
        for c in node.children:
            depth[id(c)] = depth[id(node)] + c.dist
    top = max(depth[id(n)] for n in order)
    for node in order:
        node.height = top - depth[id(node)]
    return root


def binary(root: Node, dist: float = 1e-5) -> Node:
    """Nodes of more than two children resolved by added nodes on edges of length dist."""
    for node in list(root.walk()):
        while len(node.children) > 2:
            last = node.children[-2:]
            node.children = [*node.children[:-2], Node(dist=dist, children=last)]
    return with_heights(root)


def write(root: Node, precision: int = 14) -> str:
    """Newick text; children are ordered by their smallest tip name."""
    done: dict[int, tuple[str, str]] = {}
    for node in root.walk():
        if not node.children:
            done[id(node)] = (node.name, node.name)
        else:
            parts = sorted((done[id(c)][0], f"{done[id(c)][1]}:{c.dist:.{precision}g}") for c in node.children)
            done[id(node)] = (parts[0][0], "(" + ",".join(p for _, p in parts) + ")")
    return done[id(root)][1] + ";"


def bare(root: Node) -> str:
    """Newick text of the topology alone, without lengths and names of inner nodes; children are ordered by their smallest tip name."""
    done: dict[int, tuple[str, str]] = {}
    for node in root.walk():
        parts = sorted(done[id(c)] for c in node.children)
        done[id(node)] = (parts[0][0], "(" + ",".join(p for _, p in parts) + ")") if parts else (node.name, node.name)
    return done[id(root)][1] + ";"


def topologies(trees: DataFrame, column: str = "newick") -> DataFrame:
    """trees with a column topology: the tree as `bare` writes it, null where there is none.  Trees of one topology have one text."""

    @F.pandas_udf("string")
    def strip(texts):
        return texts.map(lambda x: bare(parse(x)) if x else None).astype(object)

    return trees.withColumn("topology", strip(column))


def rows(root: Node, tree: int = 0) -> list[tuple]:
    """Rows of SCHEMA; tips are numbered first, in the order of the text."""
    order = [*root.leaves(), *(n for n in root.walk() if n.children)]
    idx = {id(n): i for i, n in enumerate(order)}
    up = {id(c): n for n in order for c in n.children}
    return [(tree, idx[id(n)], idx[id(up[id(n)])] if id(n) in up else None, n.name, n.dist, n.height, not n.children) for n in order]


def explode_trees(trees: DataFrame, column: str = "newick", key: str = "tree") -> DataFrame:
    """Node rows of every tree of a table (key, column)."""

    def run(batches):
        for b in batches:
            out = [r for k, text in zip(b[key], b[column], strict=True) if text for r in rows(parse(text), int(k))]
            frame = pd.DataFrame(out, columns=["tree", "idx", "parent", "name", "dist", "height", "is_leaf"])
            frame["parent"] = frame["parent"].astype("Int32")
            yield frame

    return trees.select(key, column).mapInPandas(run, SCHEMA)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """tree, newick: one tree a line, numbered from 0 in the order of file names and of their lines, however the files are split.

    A file is read as one piece, as tree files are small; its lines are numbered in it, and files by sums over their counts.
    """
    from pyspark.sql import Window as W

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.filter(F.split("value", "\\r?\\n"), lambda x: F.trim(x) != "").alias("lines"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    base = files.select("file", F.size("lines").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return files.join(base, "file").select("before", F.posexplode("lines").alias("i", "newick")).select((F.col("before") + F.col("i")).cast("long").alias("tree"), "newick")


def read_stats(spark: SparkSession, path: str, skip: str = "[") -> DataFrame:
    """A tab-separated table of sampled parameters , its columns named and typed by its content; lines that begin with `skip` are comments."""
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).option("comment", skip).csv(path)
