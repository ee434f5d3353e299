"""Rate matrices and tree likelihoods against definitions: series, closed forms, sums over all inner states, and all topologies."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from genospark.functions import hky, markov
from genospark.operators import evolve, phylo
from genospark.sources import newick


def rates(n, seed):
    r = np.random.default_rng(seed)
    pi = r.dirichlet(np.ones(n) * 4)
    s = r.random((n, n))
    q = (s + s.T) * pi[None, :]
    np.fill_diagonal(q, 0)
    q /= (pi[:, None] * q).sum()
    np.fill_diagonal(q, -q.sum(axis=1))
    return q, pi


def power(q, t):
    """exp(Q t) by eigenvalues."""
    w, v = np.linalg.eig(q)
    return (v @ np.diag(np.exp(w * t)) @ np.linalg.inv(v)).real


@pytest.mark.parametrize("n", [2, 4, 20])
def test_transition(spark, n):
    q, _ = rates(n, n)
    times = [0.0, 1e-6, 0.1, 0.9, 3.0, 40.0]
    df = spark.createDataFrame([(t, i % n) for i, t in enumerate(times)], "t double, i int")
    m = markov.literal(q)
    for r in df.select("t", "i", markov.transition(m, F.col("t"), n).alias("p"), markov.transition_row(m, F.col("t"), F.col("i"), n).alias("row")).collect():
        want = power(q, r["t"])
        assert np.abs(np.array(r["p"]) - want).max() < 1e-9 and np.abs(np.array(r["row"]) - want[r["i"]]).max() < 1e-9
        assert np.abs(markov.matrix_at(q, r["t"]) - want).max() < 1e-9


def test_transition_is_hky(spark):
    pi = [0.1, 0.2, 0.3, 0.4]
    df = spark.createDataFrame([(k, t) for k in (0.5, 2.0, 8.0) for t in (0.01, 0.7, 5.0)], "kappa double, t double")
    cols = [F.lit(p) for p in pi]
    q = F.array(*[F.array(*[hky.rate(F.col("kappa"), cols, i, j) for j in range(4)]) for i in range(4)])
    closed = F.array(*[F.array(*[hky.probability(F.col("kappa"), cols, F.col("t"), i, j) for j in range(4)]) for i in range(4)])
    for r in df.select(markov.transition(q, F.col("t"), 4).alias("a"), closed.alias("b")).collect():
        assert np.abs(np.array(r["a"]) - np.array(r["b"])).max() < 1e-9


@pytest.mark.parametrize("shape, n", [(None, 20), (0.7, 4)])
def test_evolved_under_any_matrix(spark, shape, n):
    """The joint states of root and tip have the probabilities of the matrix."""
    q, pi = rates(n, 3)
    sites = spark.range(20_000).select(F.lit(0).cast("long").alias("locus"), F.col("id").alias("site"))
    calls, anc = evolve.evolved(sites, newick.parse("(a:0.4,b:1.5);"), 1.0, 1.0, pi.tolist(), 7, shape=shape, matrix=q)
    n0 = np.bincount([r["anc"] for r in anc.collect()], minlength=n) / 20_000
    assert np.abs(n0 - pi).max() < 5 * math.sqrt(pi.max() / 20_000)
    for tip, t in (("a", 0.4), ("b", 1.5)):
        got = {(r["anc"], r["allele"]): r["n"] / 20_000 for r in calls.where(f"sample = '{tip}'").join(anc, ["locus", "site"]).groupBy("anc", "allele").agg(F.count("*").alias("n")).collect()}
        if shape is None:
            want = pi[:, None] * power(q, t)
        else:  # the mean over gamma rates, by eigenvalues
            w, v = np.linalg.eig(q)
            want = pi[:, None] * (v @ np.diag((1 - w * t / shape) ** -shape) @ np.linalg.inv(v)).real
        off = max(abs(got.get((i, j), 0) - want[i, j]) / math.sqrt(want[i, j] / 20_000 + 1e-9) for i in range(n) for j in range(n))
        assert off < 6


def by_all_states(tree, seqs, q, pi):
    """The sum over the states of all inner nodes."""
    nodes = list(tree.walk())
    inner = [n for n in nodes if n.children]
    up = {id(c): n for n in nodes for c in n.children}
    total = 0.0
    for k in range(len(next(iter(seqs.values())))):
        here = 0.0
        for states in itertools.product(range(4), repeat=len(inner)):
            at = {id(n): s for n, s in zip(inner, states, strict=True)}
            p = pi[at[id(tree)]]
            for n in nodes:
                if n is not tree:
                    row = power(q, n.dist)[at[id(up[id(n)])]]
                    s = at.get(id(n), "ACGT".find(seqs[n.name][k]) if not n.children else None)
                    p *= 1.0 if s == -1 else row[s]
            here += p
        total += math.log(here)
    return total


JC = np.full((4, 4), 1 / 3) - np.eye(4) * 4 / 3


def drawn_seqs(seed, n, length, names="abcdefg"):
    """Sequences along a caterpillar."""
    r = np.random.default_rng(seed)
    seqs = [r.integers(0, 4, length)]
    for _ in range(n - 1):
        x = seqs[r.integers(0, len(seqs))].copy()
        hit = r.random(length) < 0.25
        x[hit] = r.integers(0, 4, hit.sum())
        seqs.append(x)
    return {names[i]: "".join("ACGT"[s] for s in x) for i, x in enumerate(seqs)}


def frame(spark, loci):
    return spark.createDataFrame([(k, n, s) for k, seqs in enumerate(loci) for n, s in seqs.items()], "locus long, name string, seq string")


@pytest.mark.parametrize("general", [False, True])
def test_likelihood_brute_force(spark, general):
    q, pi = rates(4, 8) if general else (JC, np.full(4, 0.25))
    seqs = drawn_seqs(2, 4, 12)
    seqs["b"] = "N" + seqs["b"][1:5] + "-" + seqs["b"][6:]
    trees = ["((a:0.1,b:0.2):0.3,c:0.15,d:0.4);", "(a:0.3,b:0.1,c:0.2,d:0.1);", "(a:0.1,(b:0.2,(c:0.3,d:0.1):0.05):0.2);"]
    sites = phylo.columns(frame(spark, [seqs]))
    df = spark.createDataFrame([(0, t) for t in trees], "locus long, tree string")
    got = {r["tree"]: r["loglik"] for r in phylo.scored(df, sites, climb=False, q=markov.literal(q) if general else None, pi=pi.tolist()).collect()}
    for t in trees:
        assert got[t] == pytest.approx(by_all_states(newick.parse(t), seqs, q, pi), abs=1e-9)


def splits(text):
    root = newick.parse(text)
    tips = frozenset(n.name for n in root.leaves())
    sides = [frozenset(x.name for x in n.leaves()) for n in root.walk()]
    return {min(s, tips - s, key=lambda x: (len(x), sorted(x))) for s in sides if 1 < len(s) < len(tips) - 1}


def test_ml_trees_are_the_best_of_all(spark):
    loci = [drawn_seqs(s, 5, 60) for s in range(3)] + [drawn_seqs(9, 4, 30), drawn_seqs(10, 3, 20)]
    seqs = frame(spark, loci)
    every = [(k, t) for k, s in enumerate(loci) for t in phylo.topologies(sorted(s))]
    assert [sum(k == j for k, _ in every) for j in range(5)] == [15, 15, 15, 3, 1]
    all_ = phylo.scored(spark.createDataFrame(every, "locus long, tree string"), phylo.columns(seqs)).collect()
    found = {r["locus"]: r for r in phylo.ml_trees(seqs).collect()}
    assert set(found) == set(range(5))
    for k in range(5):
        best = max((r for r in all_ if r["locus"] == k), key=lambda r: r["loglik"])
        assert found[k]["loglik"] == pytest.approx(best["loglik"], abs=0.01)
        near = [r for r in all_ if r["locus"] == k and r["loglik"] > best["loglik"] - 0.02]
        assert any(splits(found[k]["gene_tree"]) == splits(r["tree"]) for r in near)


def test_lengths_climb_to_the_known_optimum(spark):
    """Two sequences on a star of three, the third all missing: the distance is Jukes and Cantor's."""
    a, b = "ACGT" * 25, "ACGT" * 20 + "AAAA" * 5
    seqs = frame(spark, [{"a": a, "b": b, "c": "N" * 100}])
    (r,) = phylo.scored(spark.createDataFrame([(0, "(a:0.1,b:0.1,c:0.1);")], "locus long, tree string"), phylo.columns(seqs)).collect()
    p = 15 / 100
    assert r["lengths"][0] + r["lengths"][1] == pytest.approx(-0.75 * math.log(1 - 4 / 3 * p), rel=0.01)


def test_neighbours():
    tree = newick.parse("((a:1,b:1):1,c:1,(d:1,e:1):1);")
    before = newick.write(tree, 3)
    got = phylo.neighbours(tree)
    assert newick.write(tree, 3) == before and len(got) == 4
    assert len({frozenset(splits(t)) for t in got}) == 4 and all(splits(t) != splits(before) for t in got)
