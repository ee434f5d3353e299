"""Species trees by quartets against the best of all trees, and streams of calls and breakpoints against batch results."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from genospark.model import Model
from genospark.operators import species
from genospark.operators import trees as T
from genospark.sources import newick
from genospark.streaming import sites


def resolved(root: newick.Node) -> set:
    """Quartets of tips as a pair of pairs."""
    below, out = {}, set()
    for n in root.walk():
        below[id(n)] = frozenset([n.name]) if not n.children else frozenset().union(*(below[id(c)] for c in n.children))
    tips = below[id(root)]
    for own in below.values():
        for a, b in itertools.combinations(sorted(own), 2):
            for c, d in itertools.combinations(sorted(tips - own), 2):
                out.add(frozenset([frozenset([a, b]), frozenset([c, d])]))
    return out


def all_trees(taxa: list[str]) -> list[str]:
    """All unrooted binary trees: the last taxon goes on every edge of the smaller trees."""

    def grown(tree, new):
        yield (tree, new)
        if isinstance(tree, tuple):
            for t in grown(tree[0], new):
                yield (t, tree[1])
            for t in grown(tree[1], new):
                yield (tree[0], t)

    trees = [taxa[1]]
    for t in taxa[2:]:
        trees = [g for tree in trees for g in grown(tree, t)]
    text = lambda t: t if isinstance(t, str) else f"({text(t[0])},{text(t[1])})"
    return [f"({taxa[0]},{text(t)});" for t in trees]


def drawn(taxa: list[str], rng: random.Random, polytomies: bool = False) -> str:
    parts = list(taxa)
    rng.shuffle(parts)
    while len(parts) > 1:
        k = 3 if polytomies and len(parts) > 3 and rng.random() < 0.4 else 2
        some = [parts.pop(rng.randrange(len(parts))) for _ in range(k)]
        parts.append("(" + ",".join(some) + ")")
    return parts[0] + ";"


def score(tree: str, trees: list[str], imap: dict) -> int:
    """Quartets of samples of four taxa that the species tree and the gene trees resolve alike."""
    want, total = resolved(newick.parse(tree)), 0
    for text in trees:
        for pair in resolved(newick.parse(text)):
            named = [[imap.get(x, x) for x in p] for p in pair]
            flat = {x for p in named for x in p}
            if len(flat) == 4 and frozenset(map(frozenset, named)) in want:
                total += 1
    return total


@pytest.mark.parametrize("polytomies", [False, True])
def test_best_of_all_trees(spark, polytomies):
    rng, taxa = random.Random(7 + polytomies), list("abcdef")
    trees = [drawn(rng.sample(taxa, rng.choice([4, 5, 6])), rng, polytomies) for _ in range(25)]
    df = spark.createDataFrame([(t,) for t in trees] + [(None,), ("",)], "gene_tree string").repartition(3)
    got = species.quartet_species_tree(df).first()
    every = {t: score(t, trees, {}) for t in all_trees(taxa)}
    assert len(every) == 105 and got.ntaxa == 6
    assert got.score == max(every.values()) == score(got.species_tree, trees, {})


def test_clades_of_gene_trees(spark):
    """Beyond the number of taxa up to which all clades are tried: copies of one tree among others give it back."""
    rng, taxa = random.Random(3), [f"t{i}" for i in range(9)]
    true = drawn(taxa, rng)
    trees = [true] * 30 + [drawn(taxa, rng) for _ in range(10)]
    df = spark.createDataFrame([(t,) for t in trees], "gene_tree string")
    got = species.quartet_species_tree(df).first()
    assert resolved(newick.parse(got.species_tree)) == resolved(newick.parse(true))
    assert got.score == score(got.species_tree, trees, {})


def test_words_of_many_taxa(spark):
    """Clades of more than one word: a caterpillar of 70 taxa and its shifted copies."""
    taxa = [f"t{i:02d}" for i in range(70)]
    text = taxa[0]
    for t in taxa[1:]:
        text = f"({text},{t})"
    clades = species.tree_clades(spark.createDataFrame([(text + ";",)], "gene_tree string"), taxa)
    splits = species.splits_of(clades).collect()
    assert clades.where("size(bits) = 2").count() == clades.count() and len(splits) == 68
    for s in splits:
        assert all(x ^ y == z for x, y, z in zip(s.a, s.b, s.c, strict=True))


def test_several_samples_of_a_taxon(spark):
    imap = {f"{t}_{k}": t for t in "abcde" for k in (0, 1)}
    pair = lambda t: f"({t}_0,{t}_1)"
    trees = [f"((({pair('a')},{pair('b')}),{pair('c')}),({pair('d')},{pair('e')}));"] * 3 + ["((((a_0,b_1),(b_0,a_1)),(c_0,d_0)),((c_1,d_1),(e_0,e_1)));"]
    got = species.quartet_species_tree(spark.createDataFrame([(t,) for t in trees], "gene_tree string"), imap=imap).first()
    assert resolved(newick.parse(got.species_tree)) == resolved(newick.parse("(((a,b),c),(d,e));"))
    assert got.score == score(got.species_tree, trees, imap)


def test_few_taxa(spark):
    df = lambda *t: spark.createDataFrame([(x,) for x in t], "gene_tree string")
    assert species.quartet_species_tree(df()).count() == 0
    assert tuple(species.quartet_species_tree(df("(b,a);", "((a,c),b);")).first()) == ("(a,b,c);", 0, 3)
    assert species.quartet_species_tree(df("(a,b,c,d);")).first().score == 0


def run(stream, path, mode="append"):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    if q.exception():
        raise q.exception()


CALLS = "locus long, site long, sample long, allele long, ts timestamp"


def test_completed_sites(spark, tmp_path):
    """Sites complete in one run or over a restart; one that lacks a call is given out when its time is over; rows behind the watermark are dropped."""
    minute = lambda rows: [(0, site, sample, allele, f"2024-01-01 {h:02d}:00:00") for site, sample, allele, h in rows]

    def put(rows):
        spark.createDataFrame(minute(rows), "locus long, site long, sample long, allele long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go():
        run(sites.completed_sites(spark.readStream.schema(CALLS).parquet(f"{tmp_path}/in"), 3), tmp_path)

    # site 0 is whole, with a repeated call; site 1 waits for a sample; site 2 never gets it
    put([(0, 0, 1, 0), (0, 1, 1, 0), (0, 1, 3, 0), (0, 2, None, 0), (1, 0, 1, 0), (1, 1, 2, 0), (2, 0, 1, 0)])
    go()
    put([(1, 2, 2, 0), (0, 0, 3, 0)])
    go()
    put([(9, 0, 1, 12)])
    go()
    # the watermark stands at 11:00: the rest of site 2 is late
    put([(2, 1, 1, 1), (2, 2, 1, 1), (9, 1, 2, 12), (9, 2, 3, 12)])
    go()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 0, 3, 1, True), (0, 1, 3, 2, True), (0, 2, 1, 1, False), (0, 9, 3, 3, True)]


def test_sessions(spark, sf, tmp_path):
    """A stream's sessions that the watermark has closed are those of the batch."""
    from genospark.sources import adapters

    points = adapters.breakpoints(spark, sf).select("locus", F.col("ts").cast("timestamp").alias("ts"))
    points.repartition(1).write.parquet(f"{tmp_path}/in")
    # a breakpoint far later closes all
    points.limit(1).select("locus", F.to_timestamp(F.lit("2124-01-01")).alias("ts")).write.mode("append").parquet(f"{tmp_path}/in")
    run(sites.sessions(spark.readStream.schema("locus long, ts timestamp").parquet(f"{tmp_path}/in"), "1 day"), tmp_path)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").where("session_start < '2100-01-01'").collect()))
    assert got == sorted(map(tuple, sites.sessions(points, "1 day").collect())) and len(got) > 100


def test_topologies(spark):
    texts = ["((b:1,a:2)x:1,c:3);", "(c,(a,b));", "", None, "a:1;"]
    got = newick.topologies(spark.createDataFrame([(t,) for t in texts], "newick string")).collect()
    assert [r.topology for r in got] == ["((a,b),c);"] * 2 + [None, None, "a;"]


def test_scalars_and_rescaling(spark):
    rng = random.Random(5)
    rows = []
    for tree in range(6):
        n = rng.choice([1, 5, 30, 90])
        rows += [(tree, f"n{i}", f"n{rng.randrange(i)}" if i else None, rng.random()) for i in range(n)]
    nodes = spark.createDataFrame(rows, "tree long, node string, parent string, dist double")
    up = {(t, n): (p, d) for t, n, p, d in rows}

    def way(t, n):
        p, d = up[t, n]
        return 0.0 if p is None else d + way(t, p)

    want = {t: (sum(x[0] == t for x in rows), len({x[1] for x in rows if x[0] == t} - {x[2] for x in rows if x[0] == t}), sum(x[3] for x in rows if x[0] == t and x[2]), max(way(t, x[1]) for x in rows if x[0] == t)) for t in range(6)}
    for r in T.tree_scalars(nodes).collect():
        assert (r.nnodes, r.ntips) == want[r.tree][:2] and (r.total_length, r.tree_height) == pytest.approx(want[r.tree][2:])
    again = {r.tree: r.tree_height for r in T.tree_scalars(T.rescaled(nodes, 10.0)).collect()}
    assert all(again[t] == pytest.approx(10.0 if w[3] else 0.0) for t, w in want.items())


def test_drawn_map(spark):
    rows = sorted(map(tuple, T.drawn_recombination_map(spark, 1000.0, 50, 2, 1.0, 3.0, 9).collect()))
    assert len(rows) == 50 and rows[0] == (0.0, 1.0) and rows[-1][0] == 1000.0
    assert all(r == pytest.approx(2 - math.cos(4 * math.pi * x / 1000)) for x, r in rows)


def test_admixture_keeps_from_the_ends(spark):
    m = Model(spark, "((a:1000,b:1000):1000,c:2000);", Ne=10, admixture_edges=("a", "b", (0, 1000), 0.1))
    assert [e[0] for e in m.demography.events if e[1] == "migration"] == [0.001, 999.999]
