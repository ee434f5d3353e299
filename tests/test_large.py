"""Plans that hold at size: what grows with the data isn't broadcast, and no key or file gathers it in one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genospark.functions import markov
from genospark.operators import likelihood as L
from genospark.operators import nested
from genospark.operators import stats as S
from genospark.operators import trees as T
from genospark.plans import queries as Q


def joins(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]


def shuffled(df):
    """Bytes of all rows that went through a shuffle of df; the query is run."""
    df.collect()
    plans, size = [df._jdf.queryExecution().executedPlan().executedPlan()], 0
    while plans:
        p = plans.pop()
        size += p.metrics().apply("dataSize").value() if p.nodeName() == "Exchange" else 0
        below = p.children()
        plans += [below.apply(i) for i in range(below.size())] + ([p.plan()] if p.nodeName().endswith("QueryStage") else [])
    return size


def test_gene_trees_are_not_broadcast(spark, sf):
    """Tables of gene trees lie below the broadcast threshold here, as packed files of many trees do by their size on disk."""
    path = Q.path(spark, sf)
    expected = L.expected_distance(L.tree_unchanged(L.edge_unchanged(path)), 1e-8)
    seen = [L.edge_path(*Q.species(spark), Q.genes(spark, sf)), L.topo_unchanged(path), L.edge_unchanged_at(path), L.compared(Q.A.intervals(spark, sf).withColumnRenamed("locus", "tree"), expected),
            L.embed_smc(*Q.species(spark), Q.genes(spark, sf)), Q.QUERIES["distance_lik"](spark, sf), L.distances_by_node(*Q.species(spark), Q.genes(spark, sf), expected)]
    for df in seen:
        assert any("SortMergeJoin" in line for line in joins(df))
        assert not [line for line in joins(df) if "Broadcast" in line and "tree#" in line]


@pytest.mark.parametrize("n", [1, 2, 9, 30])
def test_folds_of_chains_and_stars(spark, n):
    rows = [(0, f"c{i}", f"c{i - 1}" if i else None, i + 1) for i in range(n)] + [(1, f"s{i}", "s0" if i else None, i + 1) for i in range(n)]
    df = spark.createDataFrame(rows, "tree int, node string, parent string, v int").withColumns({"most": F.col("v"), "own": F.col("v")})
    got = {(r["tree"], r["node"]): (r["v"], r["most"], r["own"]) for r in nested.folded(df.withColumn("way", F.col("v")).drop("v").withColumnRenamed("way", "v"), {"most": "max"}, {"v": "sum"}, ["own"]).collect()}
    assert got == {(0, f"c{i}"): (sum(range(1, i + 2)), n, i + 1) for i in range(n)} | {(1, f"s{i}"): (1 + (i + 1) * (i > 0), i + 1 if i else n, i + 1) for i in range(n)}


def test_transitions_of_many_matrices(spark):
    """General matrices go through in batches, as the column expression has them; rows without a time have none."""
    rates = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: 0.05 + (F.col("id") * 7 + i * i) % 11 / 5)
    off = spark.range(40).select("id", rates.alias("x"), F.when(F.col("id") != 3, F.col("id") * F.col("id") / 20.0).alias("t"))
    row = lambda i: [F.get("x", F.lit(3 * i + j - (j > i))) if j != i else -(F.get("x", F.lit(3 * i)) + F.get("x", F.lit(3 * i + 1)) + F.get("x", F.lit(3 * i + 2))) for j in range(4)]
    df = off.select("id", "t", F.array(*[F.array(*row(i)) for i in range(4)]).alias("q"))
    for r in df.select("id", markov.transition(F.col("q"), F.col("t"), 4).alias("a"), markov.transitions(F.col("q"), F.col("t"), 4).alias("b")).collect():
        assert (r["b"] is None) == (r["id"] == 3)
        assert r["b"] is None or np.abs(np.array(r["a"]) - np.array(r["b"])).max() < 1e-9


def test_general_matrices_are_not_interpreted(spark, sf):
    assert "ArrowEvalPython" in Q.QUERIES["general_pmat"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_edges_of_one_time_meet_by_tiles(spark):
    """Edges that all live at the same time fall into many units, with each ordered pair once."""
    rows = [(f"e{k}", f"p{k % 3}", 0.0, 10.0) for k in range(90)] + [("root", None, 10.0, None)]
    df = spark.createDataFrame(rows, "name string, parent string, height double, up_height double")
    out = T.overlap(df, sisters=False, tile=8)
    assert sorted((r["src"], r["dest"]) for r in out.collect()) == sorted((f"e{a}", f"e{b}") for a in range(90) for b in range(90) if a % 3 != b % 3)
    assert len({r["p"] for r in out.select(F.spark_partition_id().alias("p")).distinct().collect()}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("sisters, part", [(False, None), (True, 0.25)])
def test_shuffles_of_edges_grow_with_edges(spark, sisters, part):
    """Twice the edges make four times the pairs, and shuffle about twice the bytes."""
    size = []
    for n in (320, 640):
        rows = [(f"e{k:03}", f"p{k % 3}", 0.0, 10.0 + k % 2) for k in range(n)] + [("root", None, 11.0, None)]
        size.append(shuffled(T.overlap(spark.createDataFrame(rows, "name string, parent string, height double, up_height double"), part, part and 1 - part, sisters, tile=8)))
    assert 0 < size[1] < 2.5 * size[0]


def test_rounding_is_spared_for_whole_numbers_only(spark):
    values = [0.0, -0.0, 0.5, -3.0, 2.0000005, 1e-7, -1e-7, 4503599627370497.5, 9.3e18, -9.3e18, 1e300, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", Q.rounded(F.col("x")).alias("a"), F.round("x", 6).alias("b")).collect():
        assert str(r["a"]) == str(r["b"])


@pytest.mark.parametrize("together", [1, 8])
def test_pairs_over_the_sites_that_both_have(spark, together):
    """Samples of different lengths, several blocks of sites, many tiles; a pair without a common site has no row."""
    r = random.Random(together)
    seqs = {s: {site: r.choice([0, 1, 2, 3, None]) for site in r.sample(range(40 * (s % 9), 40 * (s % 9) + 150), 90)} for s in range(40)}
    rows = [(s, site, a) for s, q in seqs.items() for site, a in q.items()] + [(None, 3, 1)]
    out = S.pairwise(spark.createDataFrame(rows, "sample long, site long, allele int"), tile=8, together=together)
    want = {}
    for a, x in seqs.items():
        for b, y in seqs.items():
            both = x.keys() & y.keys()
            if a < b and both:
                want[a, b] = (len(both), sum(x[k] != y[k] for k in both))
    assert {(r["s0"], r["s1"]): (r["nsites"], r["ndiff"]) for r in out.collect()} == want
    assert ("HashAggregate(keys=[s0" in out._jdf.queryExecution().executedPlan().toString()) == (together == 1)


@pytest.mark.parametrize("model", [None, "JC"])
def test_shuffles_of_samples_grow_with_samples(spark, model):
    """Twice the samples make four times the pairs, and shuffle about twice the bytes."""
    calls = lambda n: spark.range(n).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("site")).withColumn("allele", F.pmod(F.hash("sample", "site"), F.lit(4)))
    size = [shuffled(S.pairwise(calls(n), model, tile=8)) for n in (320, 640)]
    assert 0 < size[1] < 2.5 * size[0]


@pytest.mark.parametrize("small", [0, 48])
def test_tree_scalars_in_one_pass(spark, monkeypatch, small):
    """Trees in rows and trees by jumps have the same scalars, and no table of nodes is joined to itself."""
    monkeypatch.setattr(nested, "SMALL", small)
    rows = [(t, f"n{i}", f"n{(i - 1) // (t + 1)}" if i else None, float(i + t)) for t in range(4) for i in range(3 * t + 1)]
    out = T.tree_scalars(spark.createDataFrame(rows, "tree int, node string, parent string, dist double"))
    want = {}
    for t in range(4):
        up = {n: (p, d) for tree, n, p, d in rows if tree == t}
        far = lambda n: 0.0 if up[n][0] is None else up[n][1] + far(up[n][0])  # noqa: B023, E731
        want[t] = (len(up), len(up.keys() - {p for p, _ in up.values()}), sum(d for p, d in up.values() if p), max(map(far, up)))
    assert {r["tree"]: (r["nnodes"], r["ntips"], r["total_length"], r["tree_height"]) for r in out.collect()} == want
    assert not joins(out)
