"""Nested sets, jumps, fingerprints, carried marks and numbering against plain walks over the same trees."""

import random

import pytest
from pyspark.sql import functions as F

from genospark.operators import nested, numbering, stats
from genospark.operators import trees as T

TREE = "tree long, node string, parent string, x long"


def drawn(seed, n, shape):
    """Nodes of a tree: parents by a rule, names in no order."""
    r = random.Random(seed)
    names = r.sample(range(10 * n), n)
    name = lambda i: f"v{names[i]}"
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "any": lambda i: r.randrange(i), "deep": lambda i: max(0, i - r.randint(1, 3))}[shape]
    return [(name(i), name(up(i)) if i else None, r.choice([None, r.randint(-50, 50)])) for i in range(n)]


def walk(nodes):
    up = {n: p for n, p, _ in nodes}
    out = {}
    for n in up:
        path = [n]
        while up[path[-1]]:
            path.append(up[path[-1]])
        out[n] = path
    return out


def frames(spark, trees):
    return spark.createDataFrame([(t, *row) for t, nodes in enumerate(trees) for row in nodes], TREE)


FORESTS = {"small": [drawn(k, 1 + k, s) for k, s in enumerate(["chain", "star", "any", "deep"] * 4)], "large": [drawn(1, 200, "chain"), drawn(2, 130, "star"), drawn(3, 150, "any"), drawn(4, 1, "any")]}


@pytest.mark.parametrize("kind", FORESTS)
def test_folded(spark, kind):
    trees = FORESTS[kind]
    df = frames(spark, trees).withColumns({"n": F.lit(1).cast("long"), "hi": F.col("x"), "lo": F.col("x"), "d": F.lit(1).cast("long")})
    got = {(r["tree"], r["node"]): (r["n"], r["lo"], r["hi"], r["d"]) for r in nested.folded(df, {"n": "sum", "lo": "min", "hi": "max"}, {"d": "sum"}).collect()}
    for t, nodes in enumerate(trees):
        paths, x = walk(nodes), {n: v for n, _, v in nodes}
        for n in paths:
            below = [m for m in paths if n in paths[m]]
            vals = [x[m] for m in below if x[m] is not None]
            assert got[t, n] == (len(below), min(vals, default=None), max(vals, default=None), len(paths[n]))
    assert len(got) == sum(map(len, trees))


@pytest.mark.parametrize("kind", FORESTS)
def test_labels(spark, kind):
    trees = FORESTS[kind]
    got = {(r["tree"], r["node"]): r for r in nested.labels(frames(spark, trees)).collect()}
    assert len(got) == sum(map(len, trees))
    for t, nodes in enumerate(trees):
        paths = walk(nodes)
        assert sorted(got[t, n]["pre"] for n in paths) == list(range(len(nodes)))
        for a in paths:
            assert got[t, a]["depth"] == len(paths[a]) - 1
            assert {m for m in paths if got[t, a]["pre"] <= got[t, m]["pre"] <= got[t, a]["last"]} == {m for m in paths if a in paths[m]}
        # children by name
        for p in paths:
            kids = sorted(n for n, q, _ in nodes if q == p)
            assert kids == sorted(kids, key=lambda n: got[t, n]["pre"])


@pytest.mark.parametrize("kind", FORESTS)
def test_lowest_common(spark, kind):
    trees, r = FORESTS[kind], random.Random(5)
    pairs = [(t, r.choice(nodes)[0], r.choice(nodes)[0]) for t, nodes in enumerate(trees) for _ in range(20)]
    df = spark.createDataFrame(sorted(set(pairs)) + [(0, "nowhere", "nothing")], "tree long, a string, b string")
    got = {(x["tree"], x["a"], x["b"]): (x["mrca"], x["depth_a"]) for x in nested.lowest_common(frames(spark, trees), df).collect()}
    want = {}
    for t, a, b in set(pairs):
        paths = walk(trees[t])
        top = next(n for n in paths[a] if n in paths[b])
        want[t, a, b] = (top, paths[a].index(top))
    assert got == want


def test_caterpillar_of_100_000_nodes(spark):
    """Labels and common ancestors of a tree as deep as it is large; a relation of all ancestors would have 5 billion rows."""
    n = 100_000
    nodes = spark.range(n).select(F.lit(0).alias("tree"), F.format_string("v%06d", F.col("id")).alias("node"), F.when(F.col("id") > 0, F.format_string("v%06d", F.col("id") - 1)).alias("parent"))
    numbers = nested.labels(nodes)
    off = numbers.where((F.col("pre") != F.substring("node", 2, 6).cast("long")) | (F.col("last") != n - 1) | (F.col("depth") != F.col("pre"))).count()
    assert numbers.count() == n and off == 0
    got = nested.lowest_common(nodes, spark.createDataFrame([(0, "v099999", "v000007"), (0, "v012345", "v054321")], "tree int, a string, b string")).collect()
    assert {(r["a"], r["mrca"], r["depth_a"]) for r in got} == {("v099999", "v000007", 99_992), ("v012345", "v012345", 0)}


@pytest.mark.parametrize("shape, n", [("any", 60), ("chain", 90), ("star", 40)])
def test_ancestors_by_recursion_and_by_paths(spark, shape, n):
    nodes = drawn(9, n, shape)
    df = spark.createDataFrame([(a, b) for a, b, _ in nodes], "name string, parent string")
    want = {(a, b, k) for a, path in walk(nodes).items() for k, b in enumerate(path)}
    for shallow in (0, 100):
        got = [tuple(r) for r in T.ancestors(df, shallow).collect()]
        assert set(got) == want and len(got) == len(want)


def test_edge_at(spark):
    nodes = drawn(11, 80, "deep")
    paths = walk(nodes)
    height = {n: 0.0 for n in paths}
    for n in sorted(paths, key=lambda n: -len(paths[n])):
        kids = [height[m] for m, p, _ in nodes if p == n]
        height[n] = max(kids, default=-1.0) + 1
    df = spark.createDataFrame([(n, p, height[n]) for n, p, _ in nodes], "name string, parent string, height double")
    r = random.Random(2)
    points = {(r.choice(nodes)[0], r.uniform(-1, max(height.values()) + 2)) for _ in range(60)}
    got = {(x["tip"], x["time"]): (x["edge"], x["edge_height"]) for x in T.edge_at(df, spark.createDataFrame(list(points), "tip string, time double")).collect()}
    want = {}
    for tip, time in points:
        on = [n for n in paths[tip] if height[n] <= time]
        if height[tip] <= time:
            want[tip, time] = (on[-1], height[on[-1]])
    assert got == want


def test_monophyly_by_fingerprints(spark):
    nodes = drawn(21, 70, "any")
    paths, parents = walk(nodes), {p for _, p, _ in nodes}
    tips = {n: frozenset(m for m in paths if n in paths[m] and m not in parents) for n in paths}
    r = random.Random(3)
    groups = {f"g{k}": set(tips[n]) for k, n in enumerate(list(paths)[:25])} | {f"h{k}": set(r.sample(sorted(tips[nodes[0][0]]), 4)) for k in range(20)}
    df = spark.createDataFrame([(g, t) for g, some in groups.items() for t in some for _ in range(2)], "group string, tip string")
    tree = spark.createDataFrame([(a, b) for a, b, _ in nodes], "name string, parent string")
    got = {x["group"]: (x["ancestor"], x["is_monophyletic"]) for x in T.monophyletic(df, tree).collect()}
    for g, some in groups.items():
        hit = min((n for n in paths if tips[n] == some), default=None)
        assert got[g] == (hit, hit is not None)


def test_overlap_by_buckets(spark):
    r = random.Random(4)
    rows = [(f"e{k}", f"p{r.randrange(5)}", lo, lo + r.choice([0.0, 1.0, 40.0, 900.0])) for k in range(50) for lo in [r.choice([0.0, 10.0, 500.0, 999.0])]] + [("root", None, 2000.0, None)]
    df = spark.createDataFrame(rows, "name string, parent string, height double, up_height double")
    for sisters in (True, False):
        got = sorted(tuple(x) for x in T.overlap(df, 0.25, 0.75, sisters, buckets=7).collect())
        want = []
        for a, p, l1, h1 in rows[:-1]:
            for b, q, l2, h2 in rows[:-1]:
                lo, hi = max(l1, l2), min(h1, h2)
                if a != b and lo < hi and (sisters or p != q):
                    want.append((a, b, lo + 0.25 * (hi - lo), lo + 0.75 * (hi - lo)))
        assert got == sorted(want)
    plan = T.overlap(df)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("width, levels", [(10_000, 2), (3, 2), (7, 1), (50, 0)])
def test_sites_in_intervals(spark, width, levels):
    r = random.Random(width)
    cuts = {locus: sorted(r.sample(range(-40, 400), 30)) for locus in range(3)}
    marks = [(locus, a, b, k) for locus, cs in cuts.items() for k, (a, b) in enumerate(zip(cs, cs[1:], strict=False)) if r.random() < 0.7] + [(0, 5, 5, 99)]
    sites = [(r.randrange(4), r.randrange(-60, 430), i) for i in range(400)]
    i = spark.createDataFrame(marks, "locus long, start long, end long, tidx long")
    s = spark.createDataFrame(sites, "locus long, site long, id long")
    m = i.where("end > start").select("locus", F.col("start").alias("site"), F.struct("start", "end").alias("v"))
    got = {(x["locus"], x["site"]): x["v"] and x["v"]["start"] for x in stats.carried(s.select("locus", "site").distinct(), m, ["locus"], "site", "v", width, levels).collect()}
    assert got == {(locus, site): max((a for g, a, b, _ in marks if g == locus and a <= site and b > a), default=None) for locus, site, _ in sites}
    found = sorted((x["id"], x["tidx"]) for x in stats.site_to_tree(s, i).collect())
    assert found == sorted((i, k) for locus, site, i in sites for g, a, b, k in marks if g == locus and a <= site < b)
    joins = [line for line in stats.site_to_tree(s, i)._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("<" in line or "NestedLoop" in line for line in joins)


@pytest.mark.parametrize("size", [None, "w"])
def test_ranked(spark, size):
    r = random.Random(8)
    rows = [(r.choice(["b", "a", None, "a+", "ab"]), k % 7, r.randint(0, 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "name string, k int, w long").repartition(5)
    got = sorted((x["at"], x["name"], x["k"], x["w"]) for x in numbering.ranked(df, [F.col("name").asc_nulls_first(), "k"], "at", size).collect()) if size is None else None
    if size is None:
        assert [x[0] for x in got] == list(range(300))
        assert [(x[1] or "", x[2]) for x in got] == sorted((n or "", k) for n, k, _ in rows)
    else:
        run = sorted(numbering.ranked(df, [F.col("name").asc_nulls_first(), "k"], "at", size).collect(), key=lambda x: (x["name"] or "", x["k"], x["at"], x["w"]))
        assert all(b["at"] >= a["at"] for a, b in zip(run, run[1:], strict=False))
        assert max(x["at"] + x["w"] for x in run) == sum(w for *_, w in rows)
