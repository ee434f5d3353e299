"""Trees as nested sets: nodes get numbers such that what is below a node is a range, and ancestor tests compare two numbers.

Relations: nodes (tree, node, parent; the root of a tree has no parent).  Steps over ancestors double: after k steps a node knows the ancestor 2**k above it and
what lies between, so that a tree of depth d takes log2(d) joins, each over one row a node.  No relation holds a row for every node and ancestor.  Trees of up to SMALL nodes each are
worked off as one row a tree instead, with the same results.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import erase, written
from .numbering import ranked

SMALL = 48
FOLDS = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def large(df: DataFrame) -> DataFrame:
    """df for a join by sorted rows, on either side.

    Spark guesses a table's size from its files, and packed tables of numbers and few names are many times as large once they are read: by that guess they would be
    broadcast through the driver whatever their number of rows.
    """
    return df.hint("merge")


def spread(nodes: DataFrame) -> DataFrame:
    """nodes dealt by tree, so that no task holds more for being the only reader of a small file with many trees."""
    return nodes.repartition("tree")


def _jumps(nodes: DataFrame, down: dict[str, str], up: dict[str, str], keep: list[str] = []) -> Iterator[tuple[int, DataFrame]]:
    """k and tree, node, to (the ancestor 2**k above), the `down` columns folded over the nodes less than 2**k below, the `up` columns summed over those less than 2**k above, the columns `keep` unchanged.

    down: column -> "sum", "min" or "max"; up: column -> "sum".  Each step is a written table; the last has no `to`.
    """
    state = written(nodes.select("tree", "node", F.col("parent").alias("to"), *down, *up, *keep), "jumps")
    k = 0
    while True:
        yield k, state
        if not state.where("to is not null").limit(1).count():
            return
        far = state.select(F.col("tree").alias("__t"), F.col("node").alias("__n"), F.col("to").alias("__to"), *[F.col(c).alias(f"__v_{c}") for c in up])
        new = state.join(large(far), (F.col("tree") == F.col("__t")) & (F.col("to") == F.col("__n")), "left")
        new = new.select("tree", "node", F.col("__to").alias("to"), *down, *[(F.col(c) + F.coalesce(F.col(f"__v_{c}"), F.lit(0))).alias(c) for c in up], *keep)
        if down:
            sent = state.where("to is not null").groupBy(F.col("tree").alias("__t"), F.col("to").alias("__n")).agg(*[FOLDS[f][0](c).alias(f"__v_{c}") for c, f in down.items()])
            new = new.join(large(sent), (F.col("tree") == F.col("__t")) & (F.col("node") == F.col("__n")), "left")
            new = new.select("tree", "node", "to", *[F.when(F.col("__n").isNull(), F.col(c)).otherwise(FOLDS[f][1](F.coalesce(c, f"__v_{c}"), F.coalesce(f"__v_{c}", c))).alias(c) for c, f in down.items()], *up, *keep)
        state, k = written(new, "jumps"), k + 1


def _are_small(nodes: DataFrame) -> bool:
    return (nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= SMALL


def _in_rows(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """tree, rows: the nodes of a tree in pre-order (children by name), as struct(path, node, parent, columns); path: the names from the root to the node."""
    one = nodes.groupBy("tree").agg(F.collect_list(F.struct("node", "parent", *columns)).alias("all"))
    one = one.withColumn("up", F.map_from_entries(F.transform("all", lambda n: F.struct(n["node"], n["parent"]))))
    over = lambda p: F.try_element_at("up", F.element_at(p, 1))
    path = lambda n: F.aggregate(F.sequence(F.lit(1), F.size("all")), F.array(n), lambda p, _: F.when(over(p).isNull(), p).otherwise(F.concat(F.array(over(p)), p)))
    return one.select("tree", F.array_sort(F.transform("all", lambda n: F.struct(path(n["node"]).alias("path"), n["node"].alias("node"), n["parent"].alias("parent"), *[n[c].alias(c) for c in columns]))).alias("rows"))


def _below(n: Column) -> Column:
    """The rows of a node's subtree."""
    return F.filter("rows", lambda x: F.get(x["path"], F.size(n["path"]) - 1).eqNullSafe(n["node"]))


def _folded_rows(nodes: DataFrame, down: dict[str, str], up: dict[str, str], keep: list[str], tip: str | None) -> DataFrame:
    """As `_jumps`, within the row of a tree: its nodes are an array, and `to` is the place of the ancestor 2**k above (from 1, 0 for none)."""
    kinds = dict(nodes.dtypes)
    carried = [*keep, tip] if tip else keep

    def start(all_: Column) -> Column:
        alone = lambda told, n: [(~F.coalesce(F.array_contains(told["parents"], n["node"]), F.lit(False))).alias(tip)] if tip else []
        place = lambda told: F.transform(all_, lambda n: F.struct(n["node"].alias("node"), F.coalesce(F.array_position(told["names"], n["parent"]), F.lit(0)).cast("int").alias("to"), *[n[c].alias(c) for c in [*down, *up, *keep]], *alone(told, n)))
        told = F.struct(F.transform(all_, lambda n: n["node"]).alias("names"), F.transform(all_, lambda n: n["parent"]).alias("parents"))
        return F.element_at(F.transform(F.array(told), place), 1)

    def fold(rows: Column, x: Column, i: Column, c: str, how: str) -> Column:
        return F.aggregate(F.filter(rows, lambda y: y["to"] == i + 1), x[c], lambda a, y: F.when(a.isNull(), y[c]).when(y[c].isNull(), a).otherwise(FOLDS[how][1](a, y[c])).cast(kinds[c]))

    def step(rows: Column) -> Column:
        over = lambda x: F.get(rows, x["to"] - 1)
        climb = lambda x, c: F.when(x["to"] > 0, x[c] + over(x)[c]).otherwise(x[c]).cast(kinds[c])
        return F.transform(rows, lambda x, i: F.struct(
            x["node"].alias("node"), F.coalesce(over(x)["to"], F.lit(0)).alias("to"),
            *[fold(rows, x, i, c, how).alias(c) for c, how in down.items()], *[climb(x, c).alias(c) for c in up], *[x[c].alias(c) for c in carried],
        ))

    one = nodes.groupBy("tree").agg(F.collect_list(F.struct("node", "parent", *down, *up, *keep)).alias("all"))
    doublings = F.sequence(F.lit(0), F.ceil(F.log2(F.size("all"))).cast("int"))
    rows = F.aggregate(doublings, start(F.col("all")), lambda rows, _: F.when(F.exists(rows, lambda x: x["to"] > 0), step(rows)).otherwise(rows))
    return one.select("tree", F.explode(rows).alias("n")).select("tree", "n.node", *[F.col("n")[c].alias(c) for c in [*down, *up, *carried]])


def folded(nodes: DataFrame, down: dict[str, str], up: dict[str, str] | None = None, keep: list[str] | None = None, tip: str | None = None) -> DataFrame:
    """tree, node, the `down` columns folded over the subtree of each node (itself included; nulls take no part), the `up` columns summed from it to its root, and the columns `keep` as they are; in the column `tip`, if named, whether nothing is below the node."""
    if _are_small(nodes):
        return _folded_rows(nodes, down, up or {}, keep or [], tip)
    if tip:
        inner = nodes.where("parent is not null").select("tree", F.col("parent").alias("node"), F.lit(1).alias("__inner")).distinct()
        nodes = nodes.join(large(inner), ["tree", "node"], "left").withColumn(tip, F.col("__inner").isNull()).drop("__inner")
        keep = [*(keep or []), tip]
    last = None
    for _, state in _jumps(nodes, down, up or {}, keep or []):
        if last is not None:
            erase(last)
        last = state
    return last.drop("to")


def labels(nodes: DataFrame) -> DataFrame:
    """tree, node, parent, depth, pre, last: a node's subtree are the nodes of its tree with pre between its pre and last.  Children are in the order of their names."""
    if _are_small(nodes):
        rows = _in_rows(nodes, [])
        each = F.posexplode(F.transform("rows", lambda n: F.struct(n["node"].alias("node"), n["parent"].alias("parent"), (F.size(n["path"]) - 1).cast("long").alias("depth"), F.size(_below(n)).alias("size")))).alias("pre", "n")
        return rows.select("tree", each).select("tree", "n.node", "n.parent", "n.depth", F.col("pre").cast("long").alias("pre"), (F.col("pre") + F.col("n.size") - 1).cast("long").alias("last"))
    one = F.lit(1).cast("long")
    sizes = folded(nodes.select("tree", "node", "parent", one.alias("size"), one.alias("depth")), {"size": "sum"}, {"depth": "sum"})
    rows = nodes.select("tree", "node", "parent").join(large(sizes), ["tree", "node"])
    # earlier siblings' sizes: running sums over all nodes by parent, less what stands before the first child
    run = ranked(rows, ["tree", F.col("parent").asc_nulls_first(), "node"], "__run", "size")
    first = run.groupBy(F.col("tree").alias("__t"), F.col("parent").alias("__p")).agg(F.min("__run").alias("__start"))
    same = (F.col("tree") == F.col("__t")) & F.col("parent").eqNullSafe(F.col("__p"))
    step = run.join(large(first), same).select("tree", "node", "parent", "size", "depth", (F.when(F.col("parent").isNull(), 0).otherwise(1) + F.col("__run") - F.col("__start")).cast("long").alias("pre"))
    step = written(step, "nested-steps")
    # several roots of a tree follow each other
    pre = folded(step.select("tree", "node", "parent", "pre"), {}, {"pre": "sum"})
    out = step.drop("pre").join(large(pre), ["tree", "node"])
    return out.select("tree", "node", "parent", (F.col("depth") - 1).alias("depth"), "pre", (F.col("pre") + F.col("size") - 1).alias("last"))


def above(a: str, b: str) -> Column:
    """Whether node a is b or an ancestor of it, by their labels in columns <a>_pre, <a>_last, <b>_pre."""
    return (F.col(f"{a}_pre") <= F.col(f"{b}_pre")) & (F.col(f"{b}_pre") <= F.col(f"{a}_last"))


def climbed(nodes: DataFrame, points: DataFrame, at: str, columns: dict[str, Column], passes: Column) -> DataFrame:
    """points with `at` moved to the highest ancestor on the way up for which `passes` holds for all below it.

    nodes: tree, node, parent and the columns named in `columns`; `passes` is a condition over points and those columns (as they are named there) of the
    ancestor.  It must hold from the start up to some ancestor and not above: the longest jumps are tried first.
    """
    steps = []
    for k, state in _jumps(nodes.select("tree", "node", "parent"), {}, {}):
        steps.append(state.where("to is not null").select("tree", F.col("node").alias(at), F.col("to").alias("__to")))
    told = nodes.select("tree", F.col("node").alias("__to"), *[c.alias(f"__{name}") for name, c in columns.items()])
    ok = functools.reduce(lambda a, b: a & b, [F.col("__to").isNotNull(), passes])
    for n, step in enumerate(reversed(steps)):
        points = points.join(large(step), ["tree", at], "left").join(large(told), ["tree", "__to"], "left").withColumn(at, F.when(ok, F.col("__to")).otherwise(F.col(at))).drop("__to", *[f"__{c}" for c in columns])
        if n % 4 == 3:
            points = written(points, "climb")
    return points


def lowest_common(nodes: DataFrame, pairs: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """pairs (tree, a, b) with mrca, depth_a (steps from a up to it); pairs of unknown nodes, or of different trees, are left out."""
    numbers = written(labels(nodes), "labels") if numbers is None else numbers
    side = lambda x: numbers.select("tree", F.col("node").alias(x), F.col("depth").alias(f"{x}_depth"), F.col("pre").alias(f"{x}_pre"), F.col("last").alias(f"{x}_last"))
    both = pairs.join(side("a"), ["tree", "a"]).join(side("b"), ["tree", "b"]).withColumn("__at", F.col("a"))
    # climb from a as long as the ancestor isn't above b; the next one is, unless a is itself
    under = ~((F.col("__pre") <= F.col("b_pre")) & (F.col("b_pre") <= F.col("__last")))
    apart = climbed(numbers, both.where(~above("a", "b")), "__at", {"pre": F.col("pre"), "last": F.col("last")}, under)
    top = numbers.select("tree", F.col("node").alias("__at"), F.col("parent").alias("mrca"), (F.col("depth") - 1).alias("__depth"))
    apart = apart.join(top, ["tree", "__at"]).where("mrca is not null").select("tree", "a", "b", "mrca", (F.col("a_depth") - F.col("__depth")).alias("depth_a"))
    return both.where(above("a", "b")).select("tree", "a", "b", F.col("a").alias("mrca"), F.lit(0).cast("long").alias("depth_a")).unionByName(apart)


def fingerprint(member: Column) -> list[Column]:
    """Two 63-bit numbers of a set's member; sums of them over a set name the set, whatever the order."""
    h = F.md5(member.cast("string"))
    return [F.conv(F.substring(h, 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(2)]


def clades(nodes: DataFrame) -> DataFrame:
    """tree, node, ntips, f0, f1: the number of tips below each node, and the fingerprint of their set.  nodes: tree, node, parent."""
    inner = nodes.where("parent is not null").select("tree", F.col("parent").alias("node"), F.lit(1).alias("__inner")).distinct()
    tip = F.col("__inner").isNull()
    f = [F.when(tip, x).otherwise(F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"f{i}") for i, x in enumerate(fingerprint(F.col("node")))]
    rows = nodes.select("tree", "node", "parent").join(large(inner), ["tree", "node"], "left")
    rows = rows.select("tree", "node", "parent", F.when(tip, 1).otherwise(0).cast("long").alias("ntips"), *f)
    return folded(rows, {"ntips": "sum", "f0": "sum", "f1": "sum"})
