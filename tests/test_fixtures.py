"""Hand-computed values."""

import pytest
from pyspark.sql import functions as F

from genospark.functions import bases, hky
from genospark.operators import calls as C
from genospark.operators import likelihood as L
from genospark.operators import stats as S
from genospark.operators import trees as T
from genospark.sources import newick, writers

SITES = [(0, "0110"), (0, "0101"), (2, "2332"), (0, "0000"), (0, "0011"), (0, "011."), (1, "1001")]


@pytest.fixture(scope="module")
def calls(spark):
    rows = [(0, s, "p", i, None if g[k] == "." else int(g[k])) for i, (_, g) in enumerate(SITES) for k, s in enumerate("ABCD")]
    return spark.createDataFrame(rows, "locus long, sample string, pop string, site long, allele int")


@pytest.fixture(scope="module")
def anc(spark):
    return spark.createDataFrame([(0, i, a) for i, (a, _) in enumerate(SITES)], "locus long, site long, anc int")


def test_variable_sites(calls):
    assert sorted(r.site for r in C.variable_sites(calls).collect()) == [0, 1, 2, 4, 5, 6]


def test_alts_and_genotypes(spark, calls, anc):
    alts = {r.site: r.alt for r in C.alt_alleles(calls, anc).select("site", C.alt_string().alias("alt")).collect()}
    assert alts == {0: "C", 1: "C", 2: "T", 3: "", 4: "C", 5: "C", 6: "A"}
    got = {(r.site, r.sample): r.gt for r in C.geno_index(calls, anc).collect()}
    assert [got[5, s] for s in "ABCD"] == [0, 1, 1, None]
    multi = spark.createDataFrame([(0, s, "p", 0, a) for s, a in zip("ABCD", (3, 1, 0, 2), strict=True)], "locus long, sample string, pop string, site long, allele int")
    one = spark.createDataFrame([(0, 0, 0)], "locus long, site long, anc int")
    assert C.alt_alleles(multi, one).select(C.alt_string().alias("a")).first().a == "T,G,C"
    assert [r.gt for r in C.geno_index(multi, one).orderBy("sample").collect()] == [1, 3, 0, 2]


def test_patterns_and_dstat(calls):
    quads = S.wide(calls, "sample", list("ABCD"), ["locus", "site"])
    cells = sorted((r["row"], r["col"]) for r in S.site_patterns(quads).collect())
    assert cells == sorted({(1, 4), (1, 1), (11, 14), (0, 0), (0, 5), (4, 1)})
    d = S.d_statistic(quads).first()
    assert (d.abba, d.baba, d.fixed, d.dstat) == (3, 1, 1, 0.5)
    m = S.dense(S.site_patterns(quads)).first().matrix
    assert m[1][4] == 1 and m[11][14] == 1 and sum(map(sum, m)) == 6


def test_distances(calls):
    d = {(r.s0, r.s1): r.dist for r in S.pairwise(calls).collect()}
    assert d["A", "B"] == pytest.approx(5 / 7) and d["A", "D"] == pytest.approx(3 / 7)
    jc = {(r.s0, r.s1): r.dist for r in S.pairwise(calls, "JC").collect()}
    assert jc["A", "D"] == pytest.approx(0.635473, abs=1e-6)


def test_iupac(spark):
    pairs = [(0, 0, "A"), (1, 1, "C"), (0, 1, "M"), (2, 0, "R"), (0, 3, "W"), (1, 2, "S"), (3, 1, "Y"), (2, 3, "K"), (None, 2, "G"), (3, None, "T"), (None, None, "N")]
    got = spark.createDataFrame(pairs, "a int, b int, want string").withColumn("got", bases.iupac(F.col("a"), F.col("b"))).collect()
    assert all(r.got == r.want for r in got)


def test_individual_names(spark):
    make = lambda n: spark.createDataFrame([(f"{p}_{i}", p) for p, k in n.items() for i in range(k)], "sample string, pop string")
    names = lambda n: sorted({r.individual for r in C.diploid_map(make(n)).collect()})
    assert names({"A": 2, "B": 2}) == ["A", "B"]
    assert names({"A": 4, "B": 2}) == ["A_0", "A_1", "B_0"]


def test_locus_summary(spark):
    i = spark.createDataFrame([(0, 0, 40, 40, 2), (0, 40, 100, 60, 0), (1, 0, 100, 100, 0)], "locus long, start long, end long, nbps long, nsnps long")
    assert sorted(map(tuple, S.locus_summary(i).collect())) == [(0, 0, 100, 100, 2), (1, 0, 100, 100, 0)]
    e = S.empty_loci(i).first()
    assert (e.nempty, e.percent) == (1, 50.0)


def test_kingman(spark):
    t = spark.createDataFrame([(0, 100.0), (0, 500.0), (0, 1500.0)], "tree long, time double")
    got = L.kingman_loglik(L.coal_intervals(t), F.lit(1000.0)).first().logp
    assert got == pytest.approx(-24.202707, abs=1e-6)
    grid = spark.createDataFrame([(1000.0,)], "ne double")
    assert L.kingman_grid(L.coal_intervals(t), grid).first().loss == pytest.approx(24.202707, abs=1e-6)


@pytest.fixture(scope="module")
def embedded(spark):
    species = spark.createDataFrame([("A", "X", 0.0, 100.0, 1000.0), ("B", "X", 0.0, 100.0, 1000.0), ("C", "R", 0.0, 300.0, 1000.0), ("X", "R", 100.0, 300.0, 1000.0), ("R", None, 300.0, None, 1000.0)], "node string, parent string, height double, up_height double, ne double")
    members = spark.createDataFrame([("A", "A_0"), ("A", "A_1"), ("B", "B_0"), ("C", "C_0")], "node string, sample string")
    genes = spark.createDataFrame([(0, "A_0", "n1", 0.0), (0, "A_1", "n1", 0.0), (0, "B_0", "n2", 0.0), (0, "C_0", "n3", 0.0), (0, "n1", "n2", 50.0), (0, "n2", "n3", 150.0), (0, "n3", None, 400.0)], "tree long, gnode string, parent string, height double")
    return species, members, genes


def test_msc(embedded):
    table = L.embed_msc(*embedded)
    got = {r.node: (r.nedges_in, r.nedges_out, list(r.coals)) for r in table.collect()}
    assert got == {"A": (2, 1, [50.0]), "B": (1, 1, []), "C": (1, 1, []), "X": (2, 1, [50.0]), "R": (2, 1, [100.0])}
    assert L.msc_loglik(table).first().loss == pytest.approx(22.902707, abs=1e-6)


def test_unchanged(embedded):
    path = L.edge_path(*embedded).persist()
    p = {r.edge: r.p for r in L.edge_unchanged(path).collect()}
    want = {"A_0": 0.012294245, "A_1": 0.012294245, "n1": 0.024386861, "B_0": 0.036347535, "n2": 0.059127192, "C_0": 0.092725126}
    assert p == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    t = L.tree_unchanged(L.edge_unchanged(path)).first()
    assert (t.sumlen, t.p) == (1000.0, pytest.approx(0.060992089, abs=1e-9))
    assert L.expected_distance(L.tree_unchanged(L.edge_unchanged(path)), 1e-8).first().expected == pytest.approx(106_495.375, abs=1e-2)
    topo = {r.edge: (r.length, r.p) for r in L.topo_unchanged(path).collect()}
    want = {"A_0": 0.071869906, "A_1": 0.071869906, "n1": 0.154019453, "B_0": 0.166148865, "n2": 1.0, "C_0": 1.0}
    assert {k: v[1] for k, v in topo.items()} == {k: pytest.approx(v, abs=1e-8) for k, v in want.items()}
    assert sum(n * q for n, q in topo.values()) / 1000 == pytest.approx(0.697511266, abs=1e-8)


def test_point_formula_averages_to_the_edge(embedded):
    path = L.edge_path(*embedded).persist()
    edge = {r.edge: r.p for r in L.edge_unchanged(path).collect()}
    n, total = 16, dict.fromkeys(edge, 0.0)
    for k in range(n):
        for r in L.edge_unchanged_at(path, (k + 0.5) / n).collect():
            total[r.edge] += r.p / n
    assert total == {k: pytest.approx(v, abs=2e-4) for k, v in edge.items()}


def test_hky(spark):
    pi = [F.lit(x) for x in (0.2, 0.1, 0.3, 0.4)]
    k = F.lit(0.5)
    row = spark.range(1).select(*[hky.rate(k, pi, 0, j).alias(f"q{j}") for j in range(4)], *[hky.probability(k, pi, F.lit(0.1), 0, j).alias(f"p{j}") for j in range(4)], hky.ts_tv(k, pi).alias("r")).first()
    assert [row[f"q{j}"] for j in range(4)] == pytest.approx([-1.083333, 0.166667, 0.25, 0.666667], abs=1e-6)
    assert [row[f"p{j}"] for j in range(4)] == pytest.approx([0.898794, 0.015352, 0.024446, 0.061407], abs=1e-6)
    assert sum(row[f"p{j}"] for j in range(4)) == pytest.approx(1)


def test_newick(spark):
    text = "(((a:1,b:1):1,c:2):1,d:3);"
    root = newick.parse(text)
    assert root.height == 3 and newick.write(root) == "(((a:1,b:1):1,c:2):1,d:3);"
    assert newick.parse("").name == "n0"
    b = newick.binary(newick.parse("(a:2,(b,c,d,e):1);"))
    assert all(len(n.children) in (0, 2) for n in b.walk()) and len(b.leaves()) == 5
    with pytest.raises(ValueError):
        newick.parse("((a,b);")
    nodes = newick.explode_trees(spark.createDataFrame([(7, text)], "tree long, newick string"))
    assert nodes.count() == 7 and nodes.where("is_leaf").count() == 4


def test_polytomies(spark):
    nodes = spark.createDataFrame([("r", None, None), *((c, "r", 1.0) for c in "abcde")], "name string, parent string, dist double")
    rows = T.resolve_polytomies(nodes).collect()
    kids = {}
    for r in rows:
        kids.setdefault(r.parent, []).append(r.name)
    assert all(len(v) == 2 for k, v in kids.items() if k) and sum(r.dist == T.ROOT_DIST for r in rows if r.dist) == 3


def test_ancestors_of_a_long_path(spark):
    n = 21
    nodes = spark.createDataFrame([(str(i), str(i + 1) if i < n - 1 else None) for i in range(n)], "name string, parent string")
    got = T.ancestors(nodes)
    assert got.count() == n * (n + 1) // 2 and got.where("depth = 20").count() == 1


def test_ancestors_deeper_than_64(spark):
    n = 150
    nodes = spark.createDataFrame([(str(i), str(i + 1) if i < n - 1 else None) for i in range(n)], "name string, parent string")
    got = T.ancestors(nodes)
    assert got.count() == n * (n + 1) // 2 and got.where("name = '0' and ancestor = '149' and depth = 149").count() == 1


def test_pack_round_trip(calls):
    seqs = writers.pack(calls)
    back = writers.unpack(seqs)
    key = ["locus", "sample", "site", "allele"]
    assert sorted(map(str, back.select(*key).collect())) == sorted(map(str, calls.select(*key).collect()))
    text = writers.phylip(seqs.withColumnRenamed("sample", "name")).first().text
    assert text.splitlines()[0] == "4 7" and text.splitlines()[1].startswith("A          A")


def test_partitions_do_not_matter(spark, calls, anc):
    for n in (1, 4, 16):
        c = calls.repartition(n)
        assert sorted(map(str, C.mask_coverage(c, 0.5, 3, True).select("sample", "site", "allele").collect())) == sorted(map(str, C.mask_coverage(calls, 0.5, 3, True).select("sample", "site", "allele").collect()))
