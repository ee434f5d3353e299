"""Trees as node relations: idx, name, parent, height, up_height, dist, ne, is_leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..sources.tables import written
from . import nested

ROOT_DIST = 1e-5


RECURSION = """
with recursive up(name, ancestor, depth) max recursion level {levels} as (
  select name, name, 0L from {{nodes}} union all select up.name, n.parent, up.depth + 1 from up join {{nodes}} n on up.ancestor = n.name where n.parent is not null)
select name, ancestor, depth from up"""


def ancestors(nodes: DataFrame, shallow: int = 32) -> DataFrame:
    """name, ancestor, depth of every node and each of its ancestors, itself at depth 0: as many rows as nodes times their depth.

    Trees of up to `shallow` levels are walked by a recursive query, deeper ones by paths whose length doubles with each written table.  For tests of single pairs take
    `nested.labels`, which has one row a node.
    """
    nodes = written(nodes.select("name", "parent"), "nodes")
    spark = nodes.sparkSession
    deepest = nested.folded(as_nested(nodes).withColumn("depth", F.lit(1).cast("long")), {}, {"depth": "sum"}).agg(F.max("depth")).first()[0] or 0
    if deepest <= shallow:
        # the session's limit on rows holds for all rows of a recursion together
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        return spark.sql(RECURSION.format(levels=shallow + 1), nodes=nodes)
    step = nodes.where("parent is not null").select("name", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth"))
    paths = jump = step
    reach = 1
    while reach < deepest:
        # paths reach depth `reach`, jump holds those of just that depth
        far = paths.select(F.col("name").alias("__mid"), F.col("ancestor").alias("__top"), F.col("depth").alias("__more"))
        longer = written(jump.join(far, jump["ancestor"] == F.col("__mid")).select("name", F.col("__top").alias("ancestor"), (F.col("depth") + F.col("__more")).alias("depth")), "paths")
        paths, jump, reach = paths.unionByName(longer), longer.where(F.col("depth") == 2 * reach), 2 * reach
    own = nodes.select("name", F.col("name").alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    return own.unionByName(paths)


def as_nested(nodes: DataFrame) -> DataFrame:
    """tree, node, parent: one tree of named nodes, as `nested` has them."""
    return nodes.select(F.lit(0).alias("tree"), F.col("name").alias("node"), "parent")


def root_paths(nodes: DataFrame) -> DataFrame:
    """tree, node, ancestor, depth for many small trees (tree, node, parent): every tree is one row while its paths are walked.

    A path takes as many steps as the deepest node of its tree has ancestors: a first walk, from all tips at once, finds that number.
    """
    one = nodes.groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("node", "parent"))).alias("up"))
    start = lambda n: F.struct(F.array(n).alias("path"), n.alias("at"))
    step = lambda a: F.when(F.try_element_at("up", a["at"]).isNull(), a).otherwise(F.struct(F.concat(a["path"], F.array(F.try_element_at("up", a["at"]))).alias("path"), F.try_element_at("up", a["at"]).alias("at")))
    walk = lambda n: F.aggregate(F.sequence(F.lit(1), F.col("levels")), start(n), lambda a, _: step(a))["path"]
    # the nodes of a level are the parents of the level below; an emptied level ends the count
    above = lambda level: F.array_distinct(F.filter(F.transform(level, lambda n: F.try_element_at("up", n)), lambda n: n.isNotNull()))
    rise = lambda a: F.when(F.size(a["level"]) == 0, a).otherwise(F.struct(above(a["level"]).alias("level"), (a["n"] + 1).alias("n")))
    levels = F.aggregate(F.sequence(F.lit(1), F.size("up")), F.struct(F.map_keys("up").alias("level"), F.lit(0).alias("n")), lambda a, _: rise(a))["n"]
    one = one.withColumn("levels", F.greatest(levels, F.lit(1)))
    paths = one.select("tree", F.explode(F.transform(F.map_keys("up"), lambda n: F.struct(n.alias("node"), walk(n).alias("path")))).alias("p"))
    return paths.select("tree", F.col("p.node").alias("node"), F.posexplode("p.path").alias("depth", "ancestor"))


def mrca(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, mrca: the deepest common ancestor (closest to a) of given pairs, and depth_a, the steps from a up to it."""
    return nested.lowest_common(as_nested(nodes), pairs.withColumn("tree", F.lit(0))).drop("tree")


def monophyletic(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """group, ancestor (the clade with exactly the group's tips, else null), is_monophyletic.  groups: group, tip.

    Sets of tips meet by their sizes and fingerprints of 120 bits, so that no set is gathered.
    """
    f = [x.alias(f"f{i}") for i, x in enumerate(nested.fingerprint(F.col("tip")))]
    sets = groups.select("group", "tip").distinct().select("group", *f).groupBy("group").agg(F.count("*").alias("ntips"), F.sum("f0").alias("f0"), F.sum("f1").alias("f1"))
    clades = nested.clades(as_nested(nodes)).select(F.col("node").alias("ancestor"), "ntips", F.col("f0").alias("c0"), F.col("f1").alias("c1"))
    hit = sets.join(clades, (sets["ntips"] == clades["ntips"]) & (F.col("f0") == F.col("c0")) & (F.col("f1") == F.col("c1")), "left")
    return hit.groupBy("group").agg(F.min("ancestor").alias("ancestor")).withColumn("is_monophyletic", F.col("ancestor").isNotNull())


def edges_at(nodes: DataFrame, times: DataFrame) -> DataFrame:
    """time, nedges, names: edges that exist at a time (height <= time < up_height, the root without end)."""
    at = F.broadcast(times).join(nodes, (F.col("height") <= F.col("time")) & (F.col("time") < F.coalesce("up_height", F.lit(float("inf")))))
    return at.groupBy("time").agg(F.count("*").alias("nedges"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def edge_at(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """As-of lookup: tip, time, edge, edge_height: for each (tip, time) the edge above the tip that holds the time, the highest node at or below it."""
    tree = nodes.select(F.lit(0).alias("tree"), F.col("name").alias("node"), "parent", "height")
    start = nodes.select(F.col("name").alias("tip"), F.col("height").alias("__low"))
    here = points.join(start, "tip").where("__low <= time").select(F.lit(0).alias("tree"), "tip", "time", F.col("tip").alias("edge")).distinct()
    at = nested.climbed(tree, here, "edge", {"height": F.col("height")}, F.col("__height") <= F.col("time"))
    return at.join(tree.select(F.col("node").alias("edge"), F.col("height").alias("edge_height")), "edge").select("tip", "time", "edge", "edge_height")


def overlap(nodes: DataFrame, lower: float | None = None, upper: float | None = None, sisters: bool = True, buckets: int = 64, tile: int = 256, ways: int = 32) -> DataFrame:
    """src, dest, lo, hi: ordered pairs of edges, neither the root's, that overlap in time.

    Edges that begin in one bucket of time and end in one are packed in blocks of about `tile`, one row each, and two blocks are opened only if their times overlap.  Blocks are
    dealt `ways` ways, and each two ways are a unit: a block goes to `ways` + 1 units at most, so what is shuffled grows with the edges and not with their pairs.
    The overlap is cut to the proportions lower and upper of its length; sisters=False leaves out children of one parent.
    """
    edges = nodes.where("parent is not null and name is not null").select("name", "parent", F.col("height").alias("lo"), F.col("up_height").alias("hi"))
    span = F.broadcast(edges.agg(F.min("lo").alias("first"), ((F.max("hi") - F.min("lo")) / buckets).alias("width")))  # one row
    slot = lambda x: F.when(F.col("width") > 0, F.floor((x - F.col("first")) / F.col("width"))).otherwise(0).cast("int")
    edges = edges.crossJoin(span).withColumn("begins", slot(F.col("lo"))).withColumn("ends", slot(F.col("hi"))).where("begins <= ends")
    before = W.orderBy("begins", "ends").rowsBetween(W.unboundedPreceding, -1)  # one row for two buckets
    sizes = edges.groupBy("begins", "ends").agg(F.ceil(F.count("*") / tile).alias("n"))
    sizes = F.broadcast(sizes.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "ways": F.least(F.lit(ways), F.sum("n").over(W.partitionBy()))}))
    edges = edges.join(sizes, ["begins", "ends"]).withColumn("g", F.col("before") + F.pmod(F.xxhash64("name"), F.col("n")))
    blocks = edges.groupBy("g", "ways").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.collect_list(F.struct("name", "parent", "lo", "hi")).alias("edges"))
    blocks = blocks.withColumn("t", F.col("g") % F.col("ways"))
    # few bytes make many pairs: the number of tasks is not for the planner to lower
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(p: str, own: str, other: str, start: Column, stop: Column) -> DataFrame:
        return blocks.select(F.col("t").alias(own), F.explode(F.sequence(start, stop)).alias(other), *[F.col(c).alias(f"{p}_{c}") for c in ("g", "first", "last", "edges")]).repartition(tasks, "t0", "t1")

    both = side("a", "t0", "t1", F.col("t"), F.col("ways") - 1).join(nested.large(side("z", "t1", "t0", F.lit(0).cast("long"), F.col("t"))), ["t0", "t1"])
    # two blocks meet once, except that those of one way meet in any order
    both = both.where(((F.col("t0") < F.col("t1")) | (F.col("a_g") <= F.col("z_g"))) & (F.greatest("a_first", "z_first") < F.least("a_last", "z_last")))
    turns = F.when(F.col("a_g") == F.col("z_g"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    pairs = both.select("a_edges", "z_edges", F.explode(turns).alias("turned")).select("z_edges", "turned", F.explode("a_edges").alias("a")).select("a", "turned", F.explode("z_edges").alias("z"))
    lo, hi = F.greatest("a.lo", "z.lo"), F.least("a.hi", "z.hi")
    pairs = pairs.where((F.col("a.name") != F.col("z.name")) & (lo < hi))
    if not sisters:
        pairs = pairs.where("a.parent <> z.parent")
    src, dest = (F.when(F.col("turned"), F.col(f"{y}.name")).otherwise(F.col(f"{x}.name")) for x, y in ("az", "za"))
    size = hi - lo
    start = lo + F.lit(lower) * size if lower is not None else lo
    end = lo + F.lit(upper) * size if upper is not None else hi
    return pairs.select(src.alias("src"), dest.alias("dest"), start.alias("lo"), end.alias("hi"))


def recombination_map(positions: DataFrame, peaks: int, low: float, high: float) -> DataFrame:
    """position, recomb_rate: a cosine wave of `peaks` peaks over the largest position."""
    top = positions.agg(F.max("position").alias("top"))
    x = F.col("position") / F.col("top") * (2 * 3.141592653589793 * peaks)
    return positions.crossJoin(F.broadcast(top)).select("position", ((-F.cos(x) + 1) * ((high - low) / 2) + low).alias("recomb_rate"))


def drawn_positions(keys: DataFrame, key: str, length: float, seed) -> DataFrame:
    """position: a uniform place within the length for every row, drawn by its key, and both ends."""
    at = keys.select((uniform(seed, "position", F.col(key)) * length).alias("position"))
    return at.unionByName(keys.sparkSession.range(2).select((F.col("id") * float(length)).alias("position")))


def drawn_recombination_map(spark: SparkSession, length: float, n: int, peaks: int, low: float, high: float, seed) -> DataFrame:
    """position, recomb_rate: the wave of `recombination_map` at both ends and n - 2 drawn positions."""
    return recombination_map(drawn_positions(spark.range(max(0, n - 2)), "id", length, seed), peaks, low, high)


def even_positions(spark: SparkSession, length: float, n: int) -> DataFrame:
    return spark.range(n).select((F.col("id") * (length / max(1, n - 1))).alias("position"))


def resolve_polytomies(nodes: DataFrame) -> DataFrame:
    """Binary tree: a node's third and later children hang below added nodes on edges of length 1e-5."""
    w = W.partitionBy("parent").orderBy("name")
    ranked = nodes.withColumns({"k": F.row_number().over(w), "of": F.count("*").over(W.partitionBy("parent"))})
    wide = (F.col("of") > 2) & F.col("parent").isNotNull()
    added = F.concat(F.col("parent"), F.lit("+"), (F.col("of") - F.col("k")).cast("string"))
    # child k hangs at added node of - k, the last two share the first added node
    at = F.when(F.col("k") == F.col("of"), F.concat(F.col("parent"), F.lit("+1"))).otherwise(added)
    # the first child stays at the parent itself
    moved = ranked.withColumn("new_parent", F.when(wide & (F.col("k") > 1), at).otherwise(F.col("parent")))
    extra = ranked.where(wide & (F.col("k") > 1) & (F.col("k") < F.col("of"))).select(
        added.alias("name"), F.when(F.col("k") == 2, F.col("parent")).otherwise(F.concat(F.col("parent"), F.lit("+"), (F.col("of") - F.col("k") + 1).cast("string"))).alias("parent"), F.lit(ROOT_DIST).alias("dist"),
    )
    return moved.select("name", F.col("new_parent").alias("parent"), "dist").unionByName(extra)


def tree_scalars(nodes: DataFrame) -> DataFrame:
    """tree, nnodes, ntips, total_length (of all edges), tree_height (the longest way from the root to a tip).  nodes: tree, node, parent, dist; a root's own edge counts as 0."""
    edge = F.when(F.col("parent").isNull(), 0.0).otherwise(F.coalesce("dist", F.lit(0.0))).cast("double")
    rows = nodes.select("tree", "node", "parent", edge.alias("way"), edge.alias("edge"))
    told = nested.folded(rows, {}, {"way": "sum"}, ["edge"], "tip")
    return told.groupBy("tree").agg(F.count("*").alias("nnodes"), F.count_if("tip").alias("ntips"), F.sum("edge").alias("total_length"), F.max("way").alias("tree_height"))


def rescaled(nodes: DataFrame, height: float) -> DataFrame:
    """nodes with dist multiplied so that each tree's height is `height`; trees of height 0 stay as they are."""
    tall = tree_scalars(nodes).select("tree", "tree_height")
    factor = F.when(F.col("tree_height") > 0, F.lit(float(height)) / F.col("tree_height")).otherwise(1.0)
    return nodes.join(tall, "tree").withColumn("dist", F.col("dist") * factor).select(*nodes.columns)
