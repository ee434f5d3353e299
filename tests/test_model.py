"""Simulation: statistics with fixed seeds, the facade, sinks and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from genospark.model import Model, ModelError, rate_file
from genospark.operators import ancestry, evolve, inference
from genospark.operators import simulate as S
from genospark.sources import adapters, newick
from genospark.streaming import intervals as streams

TREE = "((a:1000,b:1000):1000,c:2000);"


def heights(texts):
    return np.array([newick.parse(t).height for t in texts])


def test_tmrca(spark):
    m = Model(spark, "(p);", Ne=1000, nsamples=6, recomb=0.0, seed_trees=5)
    h = heights(r.genealogy for r in m.sim_trees(600, 1).collect())
    assert abs(h.mean() - 4 * 1000 * (1 - 1 / 6)) < 5 * 2 * 1000 * 1.07 / math.sqrt(600)


def test_no_coalescence_before_the_split(spark):
    m = Model(spark, TREE, Ne=500, nsamples=1, recomb=0.0, seed_trees=1)
    for r in m.sim_trees(100, 1).collect():
        root = newick.parse(r.genealogy)
        assert root.height >= 2000 - 1e-6 and min(n.height for n in root.walk() if n.children) >= 1000 - 1e-6


def test_smc_agrees_with_the_closed_form():
    """The share of recombinations that change nothing equals the weighted edge probabilities."""
    d = S.Demography({"p": 1000.0}, [], [(f"s{i}", "p", 0.0) for i in range(4)])
    tree = S.first_tree(d, S.generator(3, 0))
    n, ne2 = 4000, 2000.0
    same = sum(not S.next_tree(d, S.generator(3, 1, i), tree)[1] for i in range(n)) / n
    hs = sorted(tree.height[p] for p in set(tree.parent.values()))
    bounds = [0.0, *hs]
    want = total = 0.0
    for c, p in tree.parent.items():
        rows = [(4 - k, bounds[k + 1] - bounds[k]) for k in range(3) if bounds[k] >= tree.height[c] - 1e-9 and bounds[k + 1] <= tree.height[p] + 1e-9]
        for i, (a, t) in enumerate(rows):
            xs = (np.arange(2000) + 0.5) / 2000 * t
            left = np.exp(-a * (t - xs) / ne2)
            pr, passed = (1 - left) / a, left
            for b, u in rows[i + 1 :]:
                pr, passed = pr + passed * (1 - math.exp(-b * u / ne2)) / b, passed * math.exp(-b * u / ne2)
            want += pr.mean() * t
        total += tree.height[p] - tree.height[c]
    want /= total
    assert abs(same - want) < 5 * math.sqrt(want * (1 - want) / n)


def test_recombinant_trees_are_trees():
    d = S.Demography({"a": 500.0, "b": 500.0, "r": 800.0}, [(1000.0, "split", ("a", "b"), "r")], [("a0", "a", 0.0), ("a1", "a", 0.0), ("b0", "b", 0.0), ("b1", "b", 100.0)])
    for locus in range(30):
        parts = S.intervals(d, S.generator(2, locus), 5000, 1e-6)
        assert parts[0][0] == 0 and parts[-1][1] == 5000 and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
        for _, _, t in parts:
            assert len(t.parent) == 6 and all(t.height[p] >= t.height[c] for c, p in t.parent.items())
            assert sorted(n.name for n in newick.parse(t.newick(10)).leaves()) == ["a0", "a1", "b0", "b1"]
            root = newick.parse(t.newick(10))
            assert all(n.height >= 1000 - 1e-3 for n in root.walk() if {"a", "b"} <= {x.name[0] for x in n.leaves()})


def test_loci_and_masks(spark):
    m = Model(spark, TREE, Ne=1000, nsamples={"a": 2, "b": 1, "c": 1}, mut=1e-6, recomb=1e-7, seed_trees=9)
    s = m.sim_loci(4, 200)
    assert s.df.columns == ["locus", "start", "end", "nbps", "nsnps", "tidx", "genealogy"]
    assert {r.locus: r.n for r in s.df.groupBy("locus").agg(F.sum("nbps").alias("n")).collect()} == dict.fromkeys(range(4), 200)
    assert s.calls.count() == 4 * 200 * 4 and s.calls.select("sample").distinct().count() == 4
    varying = s.calls.groupBy("locus", "site").agg(F.countDistinct("allele").alias("n")).where("n > 1").count()
    assert 0 < varying <= s.df.agg(F.sum("nsnps")).first()[0]
    again = Model(spark, TREE, Ne=1000, nsamples={"a": 2, "b": 1, "c": 1}, mut=1e-6, recomb=1e-7, seed_trees=9).sim_loci(4, 200)
    assert sorted(map(str, again.df.collect())) == sorted(map(str, s.df.collect()))
    masked = s.apply_missing_mask(coverage=0.5, cut_sites=(2, 2))
    lost = masked.calls.groupBy("locus", "sample").agg(F.count("allele").alias("n")).collect()
    assert {r.n for r in lost} <= {0, 200} and any(r.n == 0 for r in lost)
    with pytest.raises(ModelError):
        masked.apply_missing_mask(coverage=0.9)


def test_jc_distance(spark):
    m = Model(spark, "(a:50000,b:50000);", Ne=1, mut=2e-6, recomb=0.0, seed_trees=4)
    s = m.sim_loci(1, 20000)
    per = s.calls.groupBy("site").agg(F.countDistinct("allele").alias("n"))
    p = per.where("n > 1").count() / 20000
    want = 0.75 * (1 - math.exp(-4 / 3 * 2 * 2e-6 * 50000))
    assert abs(p - want) < 5 * math.sqrt(want * (1 - want) / 20000)


def test_snps(spark):
    m = Model(spark, TREE, Ne=1000, nsamples=2, mut=1e-5, seed_trees=3)
    s = m.sim_snps(20, min_alleles=2, max_alleles=2)
    assert s.df.count() == 20 and s.df.agg(F.max("locus")).first()[0] == 19
    per = s.calls.groupBy("locus").agg(F.countDistinct("allele").alias("n")).collect()
    assert all(r.n == 2 for r in per)
    with pytest.raises(ValueError):
        m.sim_snps(1, min_mutations=3, max_mutations=2)


def test_admixture_and_arguments(spark):
    m = Model(spark, TREE, Ne=1000, admixture_edges=[("a", "c", None, 1.0)], recomb=0.0, seed_trees=6)
    assert [e[1] for e in m.demography.events].count("pulse") == 1
    # from 500 generations on a's lineage is in c, where the two meet before the split at 2000 with probability 1 - exp(-1500 / 2N)

    def meeting(text):
        return min(n.height for n in newick.parse(text).walk() if {"a", "c"} <= {x.name for x in n.leaves()})

    low, want = sum(meeting(r.genealogy) < 1999 for r in m.sim_trees(400, 1).collect()) / 400, 1 - math.exp(-1500 / 2000)
    assert abs(low - want) < 5 * math.sqrt(want * (1 - want) / 400)
    assert Model(spark, TREE, Ne=1, admixture_edges=("a", "b", (100, 200), 0.1)).debug_demography().where("type = 'migration'").count() == 2
    with pytest.warns(UserWarning):
        Model(spark, TREE, Ne=1, wrong=1)
    for bad in ({"nsamples": 1.5}, {"nsamples": {"a": 1}}):
        with pytest.raises(TypeError):
            Model(spark, TREE, Ne=1, **bad)
    with pytest.raises(ModelError):
        Model(spark, TREE)
    assert [s for s, _ in Model(spark, "(b,a);", Ne=1).samples] == ["a", "b"]
    assert [s for s, _ in Model(spark, "(a,b);", Ne=1, nsamples={"a": 2, "b": 1}).samples] == ["a_0", "a_1", "b_0"]


def test_export(spark, tmp_path):
    m = Model(spark, TREE, Ne=1000, nsamples=2, mut=1e-6, recomb=0.0, seed_trees=8)
    s = m.sim_loci(3, 50)
    text = s.write_concat_to_phylip()
    assert text.splitlines()[0] == "6 150" and len(text.splitlines()) == 7
    assert s.write_concat_to_phylip(idxs=[1]).splitlines()[0] == "6 50"
    with pytest.raises(ModelError):
        s.write_concat_to_phylip(idxs=[9])
    vcf = s.write_vcf(diploid=True).collect()
    assert all(len(r.line.split("\t")) == 9 + 3 for r in vcf)
    s.write_loci_to_phylip(str(tmp_path / "phy"))
    s.write_vcf(str(tmp_path / "vcf"), codec="gzip")
    s.write_popfile(str(tmp_path / "pop"))
    assert spark.read.text(str(tmp_path / "pop")).count() == 6
    assert m.imap() == {p: [f"{p}_0", f"{p}_1"] for p in "abc"} and m.imap(diploid=True) == {p: [p] for p in "abc"}


def test_written_files_are_whole(spark, tmp_path):
    m = Model(spark, TREE, Ne=1000, nsamples=2, mut=2e-6, recomb=0.0, seed_trees=8)
    s = m.sim_loci(3, 130)
    lines = lambda p: [r.value for f in sorted(p.glob("part-*")) for r in spark.read.text(str(f)).collect()]
    for diploid, names in ((False, ["a_0", "a_1", "b_0", "b_1", "c_0", "c_1"]), (True, ["a", "b", "c"])):
        path = tmp_path / f"vcf{diploid}"
        s.write_vcf(str(path), diploid=diploid)
        got = lines(path)
        head = [x for x in got if x.startswith("#")]
        assert got[: len(head)] == head and head[0] == "##fileformat=VCFv4.2" and head[-1].split("\t")[9:] == names
        body = [x.split("\t") for x in got[len(head) :]]
        assert body == sorted(body, key=lambda r: (int(r[0]), int(r[1]))) and {len(r) for r in body} == {9 + len(names)}
        assert {r[0] for r in body} == {x.split("ID=")[1].split(",")[0] for x in head if x.startswith("##contig")}
        path = tmp_path / f"nex{diploid}"
        s.write_concat_to_nexus(str(path), diploid=diploid)
        got = lines(path)
        assert got[0] == "#NEXUS" and got[-1] == "end;" and f"ntax={len(names)} nchar=390" in got[2]
        seqs = {}
        for x in got[5:-2]:
            n, piece = x.split()
            seqs[n] = seqs.get(n, "") + piece
        text = s.write_concat_to_phylip(diploid=diploid).splitlines()
        assert text[0] == f"{len(names)} 390" and dict(x.split() for x in text[1:]) == seqs and list(seqs) == names
        s.write_popfile(str(tmp_path / f"pop{diploid}"), diploid)
        assert sorted(lines(tmp_path / f"pop{diploid}")) == [f"{n[0]}\t{n}" for n in names]
    s.write_loci_to_phylip(str(tmp_path / "phy"), name_prefix="x", name_suffix="y")
    assert sorted(p.name for p in (tmp_path / "phy").glob("file=*")) == ["file=x0y.phy", "file=x1y.phy", "file=x2y.phy"]
    s.write_loci_tables(str(tmp_path / "loci"))
    s.write_snps_tables(str(tmp_path / "snps"), diploid=True)
    read = lambda p: spark.read.parquet(str(tmp_path / p))
    assert read("loci/seqs").count() == 18 and read("loci/phymap").agg(F.max("phy1")).first()[0] == 390
    assert read("snps/snps").count() == read("snps/genos").count() == 3 * read("snps/snpsmap").count() > 0
    assert {r.value for r in read("snps/attributes").where("key = 'name'").collect()} == {"a", "b", "c"}


def test_diploids_pair_by_number(spark):
    m = Model(spark, "(a,b);", Ne=10, nsamples={"a": 12, "b": 2})
    pairs = {}
    for r in m.sim_loci(1, 1).pairs().collect():
        pairs.setdefault(r.individual, set()).add(r.sample)
    assert pairs["a_0"] == {"a_0", "a_1"} and pairs["a_1"] == {"a_2", "a_3"} and pairs["a_5"] == {"a_10", "a_11"}
    with pytest.raises(ModelError):
        Model(spark, "(a,b);", Ne=10, nsamples={"a": 3, "b": 2}).sim_loci(1, 1).write_vcf(diploid=True)


def test_rare_snps(spark):
    """The search goes on over far more than 10,000 candidates."""
    s = Model(spark, "(p);", Ne=100, nsamples=2, mut=1e-7, seed_trees=3).sim_snps(1)
    assert s.df.count() == 1
    with pytest.raises(ValueError):
        S.sim_snps(spark, Model(spark, "(p);", Ne=100, nsamples=2).demography, 5, 1e-9, (1, 1), np.full((4, 4), 0.25), np.full(4, 0.25), most_candidates=1000)


def test_full_coalescent(spark):
    """Moments of two samples with recombination, and trees that agree with their tables."""
    d = S.Demography({"p": 500.0}, [], [("x", "p", 0.0), ("y", "p", 0.0)])
    # at any site the time is exponential with mean 2N; at distance rho the correlation of two sites is (rho + 18) / (rho^2 + 13 rho + 18)
    rate, n = 1e-3, 1500
    first, last = [], []
    for k in range(n):
        parts = ancestry.intervals(d, S.generator(5, k), 1001, rate / 1000)
        assert parts[0][0] == 0 and parts[-1][1] == 1001 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        first.append(max(parts[0][2].height.values())), last.append(max(parts[-1][2].height.values()))
    rho = 4 * 500 * rate
    assert abs(np.mean(first + last) - 1000) < 5 * 1000 / math.sqrt(n)
    assert abs(np.corrcoef(first, last)[0, 1] - (rho + 18) / (rho * rho + 13 * rho + 18)) < 0.12
    m = Model(spark, TREE, Ne=1000, nsamples=2, mut=1e-7, recomb=1e-7, seed_trees=9, store_tree_sequences=True)
    s = m.sim_loci(3, 3000)
    nodes, edges = s.tree_sequences
    assert s.df.agg(F.sum("nbps")).first()[0] == 9000 and s.df.count() > 6
    assert nodes.where("name is not null").count() == 18
    # at every site each of the 6 samples but none else begins a path; a binary tree of 6 tips has 10 edges
    at = edges.join(spark.range(0, 3000, 500).select(F.col("id").alias("x")), (F.col("start") <= F.col("x")) & (F.col("x") < F.col("end"))).groupBy("locus", "x").count().collect()
    assert len(at) == 18 and {r["count"] for r in at} == {10}
    low = edges.join(nodes.select("locus", F.col("node").alias("parent"), F.col("time").alias("up")), ["locus", "parent"]).join(nodes.select("locus", F.col("node").alias("child"), "time"), ["locus", "child"])
    assert low.where("time >= up").count() == 0
    with pytest.raises(ModelError):
        Model(spark, TREE, Ne=1, ancestry_model="other")
    assert heights(r.genealogy for r in Model(spark, TREE, Ne=500, recomb=0.0, ancestry_model="smc_prime").sim_trees(20, 5).collect()).min() >= 2000 - 1e-6


def test_evolution(spark):
    """Gamma rates have mean 1 and variance 1 / shape; states follow HKY along a branch."""
    sites = spark.range(20_000).select(F.lit(0).cast("long").alias("locus"), F.col("id").alias("site"))
    for shape in (0.5, 3.0):
        got = evolve.site_rates(sites, shape, None, 1).agg(F.avg("rate"), F.var_samp("rate")).first()
        assert abs(got[0] - 1) < 5 * math.sqrt(1 / shape / 20_000) and abs(got[1] - 1 / shape) < 0.25 / shape
    binned = evolve.site_rates(sites, 1.0, 4, 1)
    assert binned.select("rate").distinct().count() == 4 and abs(binned.agg(F.avg("rate")).first()[0] - 1) < 0.05
    pi, kappa, t = [0.1, 0.2, 0.3, 0.4], 3.0, 0.5
    calls, anc = evolve.evolved(sites, newick.parse("(a:500,b:0);"), 1e-3, kappa, pi, 3)
    both = calls.where("sample = 'a'").join(anc, ["locus", "site"]).groupBy("anc", "allele").count().toPandas()
    q = np.array([[pi[j] * (kappa if i % 2 == j % 2 else 1) for j in range(4)] for i in range(4)])
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(axis=1))
    q /= -(np.array(pi) * q.diagonal()).sum()
    w, v = np.linalg.eig(q)
    p = (v @ np.diag(np.exp(w * t)) @ np.linalg.inv(v)).real
    for r in both.itertuples():
        want = pi[r.anc] * p[r.anc, r.allele]
        assert abs(r.count / 20_000 - want) < 5 * math.sqrt(want * (1 - want) / 20_000)
    assert calls.where("sample = 'b'").join(anc, ["locus", "site"]).where("allele <> anc").count() == 0


def test_amino_acid_rates(tmp_path):
    n = 20
    lower = [[i * 20 + j + 1 for j in range(i)] for i in range(1, n)]
    (tmp_path / "m.dat").write_text("\n".join(" ".join(map(str, r)) for r in lower) + "\n\n" + " ".join(["0.05"] * n) + "\n\nA made-up matrix")
    letters, root, probs = rate_file(str(tmp_path / "m.dat"))
    assert len(letters) == 20 and root == pytest.approx(np.full(20, 0.05)) and probs.sum(axis=1) == pytest.approx(np.ones(20)) and (probs.diagonal() == 0).all()
    assert probs[2, 0] / probs[2, 1] == pytest.approx(41 / 42)


def test_trees_of_many_loci(spark, tmp_path):
    m = Model(spark, "(((a:4000,b:4000):4000,c:8000):4000,d:12000);", Ne=1000, nsamples=2, recomb=0.0, mut=1e-7, seed_trees=2)
    loci = m.sim_trees(150, 1)
    imap = {s: p for s, p in m.samples}
    clades = lambda text: {tuple(sorted(x.name for x in n.leaves())) for n in newick.parse(text).walk() if n.children}
    assert {("a", "b"), ("c", "d")} & clades(inference.species_tree(loci, "genealogy", imap))
    s = m.sim_loci(4, 3000)
    got = inference.concatenated_tree(s.seqs()).first()
    assert got.nsamples == 8 and all({tuple(f"{p}_{k}" for k in (0, 1))} <= {c if len(c) == 2 else c for c in clades(got.gene_tree)} or p == "d" for p in "c")
    windows = inference.window_trees(s.calls, 1000).collect()
    assert len(windows) == 12 and all(r.gene_tree.count(",") == 7 for r in windows)
    for k in range(3):
        (tmp_path / f"t{k}.nwk").write_text("".join(f"(a:{k},b:{i});\n" for i in range(3)) + "\n")
    trees = newick.read_trees(spark, str(tmp_path / "t*.nwk")).orderBy("tree").collect()
    assert [(r.tree, r.newick) for r in trees] == [(3 * k + i, f"(a:{k},b:{i});") for k in range(3) for i in range(3)]
    (tmp_path / "stats.tsv").write_text("[ID: 1]\nGen\tLnL\n0\t-10.5\n100\t-9.25\n")
    stats = newick.read_stats(spark, str(tmp_path / "stats.tsv"))
    assert stats.dtypes == [("Gen", "int"), ("LnL", "double")] and stats.count() == 2


def test_estimators(spark):
    d = np.array([[0, 2, 4, 6], [2, 0, 4, 6], [4, 4, 0, 6], [6, 6, 6, 0]], dtype=float)
    for build in inference.ESTIMATORS.values():
        clades = {tuple(sorted(x.name for x in n.leaves())) for n in build(list("abcd"), d).walk() if n.children}
        assert ("a", "b") in clades or ("c", "d") in clades
    same = spark.createDataFrame([(0, n, "ACGT") for n in "abc"], "locus long, name string, seq string")
    assert inference.gene_trees(same).first().gene_tree.count(",") == 2
    trees = spark.createDataFrame([("((a:1,b:1):1,(c:1,d:1):1);",)] * 3, "gene_tree string")
    assert inference.quartet_topologies(trees).collect()[0]["n"] == 3


def test_streams(spark, sf, tmp_path):
    points = adapters.breakpoints(spark, sf)
    points.select("locus", "position", "ts").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("locus long, position long, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    q = streams.windowed_counts(stream).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("win").agg(F.sum("n")).first()[0] == points.count()
    q = streams.closing_intervals(stream).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    from genospark.operators.stats import breakpoint_intervals

    assert spark.table("closed").count() == breakpoint_intervals(points).count()
