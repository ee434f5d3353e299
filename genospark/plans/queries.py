"""Queries: each applies an operator of the library to a whole adapter view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bases, hky, markov, rng
from ..operators import calls as C
from ..operators import evolve, inference, nested, numbering, phylo
from ..operators import likelihood as L
from ..operators import stats as S
from ..operators import trees as T
from ..operators.species import quartet_species_tree
from ..sources import adapters as A
from ..sources import writers
from ..sources.tables import written
from ..streaming.sites import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MISSING = 0.05
RECOMB = 1e-8


def rounded(x: Column) -> Column:
    """x to 6 places; what is whole is spared the decimal arithmetic, which costs more than a pair of rows does."""
    return F.when(F.floor(x) == x, F.floor(x).cast("double")).otherwise(F.round(x, 6))


def typed(df: DataFrame) -> DataFrame:
    """Whole numbers as long, fractions rounded to 6 places."""
    kinds = {"int": "long", "tinyint": "long", "smallint": "long", "bigint": "long"}
    cast = lambda c, k: F.col(c).cast(kinds[k]) if k in kinds else rounded(F.col(c).cast("double")) if k in ("double", "float") or k.startswith("decimal") else F.col(c)
    return df.select(*[cast(c, k).alias(c) for c, k in df.dtypes])


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return typed(f(spark, sf_dir))

    run.__doc__ = f.__doc__
    QUERIES[f.__name__] = run
    return run


# random draws


@query
def rng_uniform(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", rng.uniform("rng", F.col("o_orderkey")).alias("u"))


@query
def categorical_draw(spark, d):
    return A.table(spark, d, "events").select("event_id", rng.categorical([F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.4)], "draw", F.col("event_id")).alias("code"))


@query
def kingman_times(spark, d):
    return times(spark, d).select("tree", "k", "time")


def times(spark, d, n: int = 6, ne: float = 1000.0) -> DataFrame:
    """Coalescent times of one population: exponential waits with C(k,2) / 2Ne, summed up."""
    k = A.table(spark, d, "customer").select(F.col("c_custkey").alias("tree"), F.explode(F.sequence(F.lit(2).cast("long"), F.lit(n).cast("long"))).alias("k"))
    wait = rng.exponential(L.pairs(F.col("k")) / (2 * ne), "kingman", F.col("tree"), F.col("k"))
    w = W.partitionBy("tree").orderBy(F.desc("k"))
    return k.withColumn("wait", wait).withColumn("time", F.sum("wait").over(w))


# trees


@query
def tree_nodes(spark, d):
    return A.tree_nodes(spark, d)


def samples(spark, d) -> DataFrame:
    """pop, k, name, rank: 1 + idx mod 3 samples a tip."""
    tips = A.tree_nodes(spark, d).where("is_leaf").select(F.col("name").alias("pop"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("idx") % 3)).alias("k"))
    most = F.broadcast(tips.agg((F.max("k") > 0).alias("many")))  # one row
    named = tips.crossJoin(most).withColumn("name", F.when(F.col("many"), F.concat_ws("_", "pop", F.col("k").cast("string"))).otherwise(F.col("pop"))).drop("many")
    return numbering.ranked(named, ["name"], "rank").withColumn("rank", F.col("rank") + 1)


@query
def samples_expand(spark, d):
    return samples(spark, d)


@query
def popfile(spark, d):
    return writers.popfile(samples(spark, d))


@query
def imap(spark, d):
    return writers.imap(samples(spark, d))


@query
def tree_ancestors(spark, d):
    return T.ancestors(A.tree_nodes(spark, d))


@query
def tree_mrca(spark, d):
    nodes = A.tree_nodes(spark, d)
    pairs = A.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("a"), F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("b"))
    return T.mrca(nodes, pairs)


@query
def monophyly(spark, d):
    nodes = A.tree_nodes(spark, d)
    tips = A.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("tip"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("g1"), F.concat(F.lit("m"), F.col("s_suppkey") % 7).alias("g2"))
    groups = tips.select("tip", F.explode(F.array("g1", "g2")).alias("group"))
    return T.monophyletic(groups, nodes)


@query
def edges_at_time(spark, d):
    grid = spark.range(0, 8).select((F.col("id") * 50_000.0).alias("time"))
    return T.edges_at(A.tree_nodes(spark, d), grid)


@query
def asof_edge(spark, d):
    nodes = A.tree_nodes(spark, d)
    points = A.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("tip"), (F.abs("s_acctbal") * 32).alias("time"))
    return T.edge_at(nodes, points)


@query
def edge_overlap(spark, d):
    return T.overlap(A.tree_nodes(spark, d), sisters=False)


@query
def admix_edges(spark, d):
    return T.overlap(A.tree_nodes(spark, d), 0.25, 0.75)


@query
def recomb_map(spark, d):
    return T.recombination_map(A.table(spark, d, "part").select(F.col("p_partkey").cast("double").alias("position")), 5, 1e-3, 5.0)


@query
def recomb_map_drawn(spark, d):
    """The same wave at positions drawn by part key, with both ends."""
    return T.recombination_map(T.drawn_positions(A.table(spark, d, "part"), "p_partkey", 1e6, "map"), 5, 1e-3, 5.0)


@query
def tree_scalars(spark, d):
    """Of every order a tree: its lines hang below their suppliers, with quantities as lengths."""
    line = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tree"), F.concat_ws("-", F.lit("l"), "l_linenumber", "l_partkey", "l_suppkey").alias("leaf"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("sup"), F.col("l_quantity").cast("double").alias("dist")).repartition("tree")
    tip = line.groupBy("tree", "leaf", "sup").agg(F.max("dist").alias("dist")).select("tree", F.col("leaf").alias("node"), F.col("sup").alias("parent"), "dist")
    mid = line.select("tree", F.col("sup").alias("node"), F.lit("o").alias("parent"), F.lit(1.0).alias("dist")).distinct()
    root = line.select("tree", F.lit("o").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("dist")).distinct()
    return T.tree_scalars(tip.unionByName(mid).unionByName(root))


@query
def theta_table(spark, d):
    return L.theta_table(A.tree_nodes(spark, d).withColumnRenamed("name", "node"))


@query
def names_intersect(spark, d):
    c, s = A.table(spark, d, "orders").select(F.col("o_custkey").alias("name")), A.table(spark, d, "events").select(F.col("user_id").alias("name"))
    return c.intersect(s)


@query
def names_except(spark, d):
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("name")).exceptAll(A.table(spark, d, "orders").select("o_custkey").distinct())


@query
def names_minus(spark, d):
    """Customers with orders who have no events."""
    return A.table(spark, d, "orders").select(F.col("o_custkey").alias("name")).subtract(A.table(spark, d, "events").select("user_id"))


@query
def trait_scale(spark, d):
    """Traits with -999 as null, matched by normalised names and rescaled to Ne between 1e3 and 1e5."""
    trait = A.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey"), F.nullif(F.round("c_acctbal"), F.lit(-999.0)).alias("x")).where("x > 0")
    nation = A.table(spark, d, "nation").select("n_nationkey", F.replace("n_name", F.lit("_"), F.lit(" ")).alias("label"))
    key = F.substring_index(F.replace("label", F.lit(" "), F.lit("_")), "_", -1).cast("long")
    both = trait.join(F.broadcast(nation.withColumn("key", key)), F.col("c_nationkey") == F.col("key"))
    top = trait.agg(F.max("x").alias("top"))
    return both.crossJoin(F.broadcast(top)).select("c_custkey", "label", F.greatest(F.lit(1e3), 1e5 * F.col("x") / F.col("top")).alias("ne"))


@query
def param_grid(spark, d):
    """All parameter combinations that no finished job has."""
    sizes = A.table(spark, d, "part").select(F.col("p_size").alias("nsites")).distinct()
    nes = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("neff"))
    reps = A.table(spark, d, "region").select(F.col("r_regionkey").alias("rep"))
    done = A.table(spark, d, "supplier").select((F.col("s_suppkey") % 50 + 1).cast("int").alias("nsites"), F.col("s_nationkey").alias("neff"))
    return sizes.crossJoin(F.broadcast(nes)).crossJoin(F.broadcast(reps)).join(done, ["nsites", "neff"], "left_anti")


# substitution model


def hky_params(spark, d) -> tuple[DataFrame, list]:
    p = A.table(spark, d, "part").select("p_partkey", (0.5 + F.col("p_size") / 10).alias("kappa"), (F.col("p_retailprice") / 2000).alias("t"), *[(0.1 + rng.uniform("pi", F.col("p_partkey"), i)).alias(f"x{i}") for i in range(4)])
    total = F.col("x0") + F.col("x1") + F.col("x2") + F.col("x3")
    return p.select("p_partkey", "kappa", "t", *[(F.col(f"x{i}") / total).alias(f"pi{i}") for i in range(4)]), [F.col(f"pi{i}") for i in range(4)]


def _cells(value):
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), value(i, j).alias("v")) for i in range(4) for j in range(4)])).alias("c")


@query
def hky_qmat(spark, d):
    p, pi = hky_params(spark, d)
    return p.select("p_partkey", hky.ts_tv(F.col("kappa"), pi).alias("ts_tv"), _cells(lambda i, j: hky.rate(F.col("kappa"), pi, i, j))).select("p_partkey", "ts_tv", "c.i", "c.j", F.col("c.v").alias("q"))


@query
def hky_pmat(spark, d):
    p, pi = hky_params(spark, d)
    return p.select("p_partkey", _cells(lambda i, j: hky.probability(F.col("kappa"), pi, F.col("t"), i, j))).select("p_partkey", "c.i", "c.j", F.col("c.v").alias("p"))


@query
def general_pmat(spark, d):
    """The same by uniformisation, which takes any matrix."""
    p, pi = hky_params(spark, d)
    q = F.array(*[F.array(*[hky.rate(F.col("kappa"), pi, i, j) for j in range(4)]) for i in range(4)])
    # much work a row
    made = p.withColumn("q", q).repartition(spark.sparkContext.defaultParallelism, "p_partkey").select("p_partkey", markov.transitions(F.col("q"), F.col("t").cast("double"), 4).alias("m"))
    rows = made.select("p_partkey", F.posexplode("m").alias("i", "row"))
    return rows.select("p_partkey", "i", F.posexplode("row").alias("j", "p"))


@query
def rate_bins(spark, d):
    """Rates binned by equal widths; a bin's rate is its mean."""
    e = A.table(spark, d, "events").where("value is not null").select("event_id", "value")
    edge = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    binned = e.crossJoin(F.broadcast(edge)).withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 8)), F.lit(7)))
    return binned.join(F.broadcast(binned.groupBy("bin").agg(F.avg("value").alias("rate"))), "bin").select("event_id", "bin", "rate")


# the result table


@query
def filter_nsnps(spark, d):
    return A.intervals(spark, d).where("nsnps > 1")


@query
def first_tree(spark, d):
    return A.intervals(spark, d).where("tidx = 0")


def wanted(spark, d) -> DataFrame:
    return A.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("locus"))


@query
def subset_semi(spark, d):
    return A.intervals(spark, d).join(wanted(spark, d), "locus", "left_semi")


@query
def subset_anti(spark, d):
    return wanted(spark, d).join(A.intervals(spark, d), "locus", "left_anti")


@query
def locus_summary(spark, d):
    return S.locus_summary(A.intervals(spark, d))


@query
def trees_per_locus(spark, d):
    return S.trees_per_locus(A.intervals(spark, d))


@query
def interval_stats(spark, d):
    return S.interval_stats(A.intervals(spark, d), "genealogy")


@query
def nbps_histogram(spark, d):
    return S.histogram(A.intervals(spark, d), "nbps", 20)


@query
def empty_loci(spark, d):
    return S.empty_loci(A.intervals(spark, d))


@query
def distinct_loci(spark, d):
    return A.intervals(spark, d).agg(F.countDistinct("locus").alias("nloci"), F.countDistinct("genealogy").alias("ntrees"))


@query
def breakpoint_intervals(spark, d):
    return S.breakpoint_intervals(A.breakpoints(spark, d))


@query
def site_to_tree(spark, d):
    sites = A.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("locus"), (F.col("o_orderkey") * 7919 % 2592000).alias("site"))
    return S.site_to_tree(sites, A.intervals(spark, d)).select("o_orderkey", "locus", "site", "start", "end", "tidx")


@query
def site_to_tree_skewed(spark, d):
    """Two thirds of the sites (lines) and intervals (orders) are of one locus."""
    locus = lambda key, other: F.when(key % 3 < 2, 0).otherwise(1 + other % 50)
    i = A.table(spark, d, "orders").select(locus(F.col("o_orderkey"), F.col("o_orderkey")).alias("locus"), (F.col("o_orderkey") * 8).alias("start"), (F.col("o_orderkey") * 8 + 5).alias("end"), F.col("o_orderkey").alias("tidx"))
    sites = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", locus(F.col("l_orderkey"), F.col("l_orderkey")).alias("locus"), (F.col("l_orderkey") * 8 + F.col("l_linenumber") + F.col("l_partkey") % 40).alias("site"))
    return S.site_to_tree(sites, i).select("l_orderkey", "l_linenumber", "locus", "site", "start", "tidx")


@query
def union_chunks(spark, d):
    i = A.intervals(spark, d)
    chunk = lambda k: i.where(F.col("locus") % 2 == k).withColumn("chunk", F.lit(k))
    return chunk(0).unionByName(chunk(1))


@query
def top_genealogies(spark, d):
    """The ten longest intervals."""
    return A.intervals(spark, d).orderBy(F.desc("nbps"), "locus", "tidx").limit(10)


@query
def sample_rows(spark, d):
    """A hash-ordered sample of 100 intervals: the same whatever the partitions."""
    return A.intervals(spark, d).orderBy(F.md5(F.concat_ws(":", F.lit("sample"), "locus", "tidx")), "locus", "tidx").limit(100)


@query
def phymap(spark, d):
    return writers.phymap(S.locus_summary(A.intervals(spark, d)))


@query
def snp_filter(spark, d):
    """Candidates (orders) with 2 to 6 mutations (lines) and at least 2 alleles (return flags), numbered by candidate."""
    cand = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("candidate")).agg(F.count("*").alias("n_mut"), F.countDistinct("l_returnflag").alias("n_alleles"))
    return numbering.numbered(cand.where(F.col("n_mut").between(2, 6) & (F.col("n_alleles") >= 2)), "candidate", "locus")


# calls


@query
def ancestral_overlay(spark, d):
    """Random ancestral bases, overwritten where a sample is mutated."""
    c = A.calls(spark, d)
    quarter = [F.lit(0.25)] * 4
    key = [F.col("sample"), F.col("site")]
    anc = c.where("sample = 0").select("locus", "site", rng.categorical(quarter, "anc", F.col("locus"), F.col("site")).alias("anc"))
    mut = c.where(rng.uniform("mut", *key) < 0.1).select("locus", "sample", "site", rng.categorical(quarter, "mutal", *key).alias("derived"))
    return C.overlay(anc, c.select("sample").distinct(), mut).select("sample", "locus", "site", "anc", "allele")


@query
def site_slice(spark, d):
    return A.calls(spark, d, MISSING).where("site >= 10 and site < 30").select("sample", "site", bases.base(F.col("allele")).alias("base"))


@query
def variable_sites(spark, d):
    return C.variable_sites(A.calls(spark, d, MISSING))


@query
def contig_lines(spark, d):
    return C.contig_lines(A.calls(spark, d, MISSING))


@query
def alt_alleles(spark, d):
    return C.alt_alleles(A.calls(spark, d, MISSING), A.ancestral(A.calls(spark, d))).select("locus", "site", bases.base(F.col("anc")).alias("ref"), C.alt_string().alias("alt"))


def genos(spark, d) -> DataFrame:
    return C.geno_index(A.calls(spark, d, MISSING), A.ancestral(A.calls(spark, d)))


@query
def geno_index(spark, d):
    return genos(spark, d).select("locus", "sample", "site", "gt")


@query
def diploid_map(spark, d):
    return C.diploid_map(A.calls(spark, d))


@query
def diploid_names(spark, d):
    """Pairs of samples whose names end in numbers of different lengths: a_2 comes before a_10."""
    c = A.table(spark, d, "customer").select(F.col("c_nationkey").alias("pop"), F.concat_ws("_", F.concat(F.lit("n"), F.col("c_nationkey")), F.col("c_custkey")).alias("sample"))
    return C.diploid_map(c)


def _pairs(spark, d, fill):
    return C.geno_pairs(genos(spark, d), C.diploid_map(A.calls(spark, d)), fill).select("locus", "site", "individual", bases.genotype(F.col("left"), F.col("right")).alias("gt"))


@query
def geno_pairs(spark, d):
    return _pairs(spark, d, False)


@query
def geno_fill(spark, d):
    return _pairs(spark, d, True)


@query
def iupac(spark, d):
    return C.iupac_calls(A.calls(spark, d, MISSING), C.diploid_map(A.calls(spark, d)))


@query
def vcf_rows(spark, d):
    return writers.vcf_rows(A.calls(spark, d, MISSING), A.ancestral(A.calls(spark, d)), C.diploid_map(A.calls(spark, d)))


@query
def snpsmap(spark, d):
    return writers.snpsmap(C.variable_sites(A.calls(spark, d, MISSING)))


@query
def base_freq(spark, d):
    return S.base_freq(A.calls(spark, d, MISSING))


@query
def site_windows(spark, d):
    return S.site_windows(A.calls(spark, d, MISSING), 8)


@query
def mask_site(spark, d):
    return C.mask_coverage(A.calls(spark, d), 0.8, "cov", by_site=True)


@query
def mask_locus(spark, d):
    return C.mask_coverage(A.calls(spark, d), 0.8, "cov")


@query
def mask_cutsite(spark, d):
    c = A.calls(spark, d)
    return C.mask_cut_sites(C.mask_coverage(c, 0.9, "cov", by_site=True), A.ancestral(c), 1, 1).select("locus", "sample", "pop", "site", "allele")


# sequences


@query
def decode_bases(spark, d):
    c = A.calls(spark, d, MISSING)
    return writers.pack(c)


@query
def phylip_locus(spark, d):
    s = A.seqs(spark, d).select(F.floor(F.col("sample") / 10).alias("locus"), F.concat(F.lit("s"), F.col("sample")).alias("name"), "seq")
    return writers.phylip(writers.aligned(s))


@query
def phylip_concat(spark, d):
    s = writers.pack(A.calls(spark, d, MISSING)).select("locus", F.concat(F.lit("s"), F.col("sample")).alias("name"), "seq")
    return writers.concatenated(s).select(F.concat(writers.padded(F.col("name")), F.lit(" "), F.col("seq")).alias("line"))


@query
def nexus_blocks(spark, d):
    return writers.nexus_blocks(A.seqs(spark, d).select(F.concat(F.lit("s"), F.col("sample")).alias("name"), "seq"))


@query
def nexus_concat(spark, d):
    """Interleaved pieces of all loci side by side, cut without joining them first."""
    s = writers.pack(A.calls(spark, d, MISSING)).select("locus", F.concat(F.lit("s"), F.col("sample")).alias("name"), "seq")
    return writers.nexus_cut(s, 10)


# patterns and distances


def quads(spark, d) -> DataFrame:
    """The k-th samples of populations 0 to 3, site by site."""
    c = A.calls(spark, d).where("pop < 4")
    k = c.select("sample", "pop").distinct().withColumn("k", F.row_number().over(W.partitionBy("pop").orderBy("sample")) - 1)
    return S.wide(c.join(k.select("sample", "k"), "sample"), "pop", [0, 1, 2, 3], ["k", "locus", "site"])


@query
def site_patterns(spark, d):
    return S.site_patterns(quads(spark, d))


@query
def dstat(spark, d):
    return S.d_statistic(quads(spark, d), ["k"])


@query
def pattern_cube(spark, d):
    return S.pattern_cube(quads(spark, d))


def representatives(spark, d) -> DataFrame:
    return S.quartets(S.consensus(A.calls(spark, d, MISSING)), "pop")


@query
def quartet_patterns(spark, d):
    return S.site_patterns(representatives(spark, d), ["q0", "q1", "q2", "q3"], "n")


@query
def dstat_all(spark, d):
    return S.d_statistic(representatives(spark, d), ["q0", "q1", "q2", "q3"], "n")


@query
def pairwise_hamming(spark, d):
    return S.pairwise(A.calls(spark, d, MISSING))


@query
def pairwise_jc(spark, d):
    return S.pairwise(A.calls(spark, d, MISSING), "JC").select("s0", "s1", "dist")


# likelihoods

SPECIES = [("A", "X", 0.0, 100.0, 1000.0), ("B", "X", 0.0, 100.0, 1500.0), ("C", "R", 0.0, 300.0, 800.0), ("X", "R", 100.0, 300.0, 1200.0), ("R", None, 300.0, None, 2000.0)]
MEMBERS = [("A", "A_0"), ("A", "A_1"), ("B", "B_0"), ("C", "C_0")]


def species(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(SPECIES, "node string, parent string, height double, up_height double, ne double"), spark.createDataFrame(MEMBERS, "node string, sample string")


def genes(spark, d) -> DataFrame:
    """A caterpillar gene tree a customer, with drawn heights."""
    u = lambda i: rng.uniform("gene", F.col("c_custkey"), i)
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("tree"), (10 + 280 * u(1)).alias("h1"), u(2).alias("u2"), u(3).alias("u3"))
    c = c.withColumn("h2", F.greatest("h1", F.lit(100.0)) + 1 + 150 * F.col("u2")).withColumn("h3", F.greatest("h2", F.lit(300.0)) + 1 + 400 * F.col("u3"))
    node = lambda name, parent, h: F.struct(F.lit(name).alias("gnode"), F.lit(parent).cast("string").alias("parent"), h.alias("height"))
    zero = F.lit(0.0)
    every = F.array(node("A_0", "n1", zero), node("A_1", "n1", zero), node("B_0", "n2", zero), node("C_0", "n3", zero), node("n1", "n2", F.col("h1")), node("n2", "n3", F.col("h2")), node("n3", None, F.col("h3")))
    return c.select("tree", F.explode(every).alias("g")).select("tree", "g.gnode", "g.parent", "g.height")


def path(spark, d) -> DataFrame:
    return written(L.edge_path(*species(spark), genes(spark, d)), "edge-paths")


@query
def coal_intervals(spark, d):
    return L.coal_intervals(times(spark, d).select("tree", "time"))


@query
def kingman_loglik(spark, d):
    return L.kingman_loglik(L.coal_intervals(times(spark, d).select("tree", "time")), F.lit(1200.0))


@query
def kingman_grid(spark, d):
    grid = spark.range(1, 9).select((F.col("id") * 500.0).alias("ne"))
    return L.kingman_grid(L.coal_intervals(times(spark, d).select("tree", "time")), grid)


@query
def embed_msc(spark, d):
    t = L.embed_msc(*species(spark), genes(spark, d))
    return t.select("tree", "node", "dist", "neff", "nedges_in", "nedges_out", F.size("coals").alias("ncoals"), F.aggregate("coals", F.lit(0.0), lambda a, x: a + x).alias("waited"))


@query
def msc_loglik(spark, d):
    return L.msc_loglik(L.embed_msc(*species(spark), genes(spark, d)))


@query
def embed_smc(spark, d):
    return L.embed_smc(*species(spark), genes(spark, d))


@query
def edge_path(spark, d):
    return path(spark, d).select("tree", "edge", "i", "start", "stop", "node", "neff", "nedges", "dist")


@query
def edge_unchanged(spark, d):
    return L.edge_unchanged(path(spark, d))


@query
def edge_unchanged_at(spark, d):
    return L.edge_unchanged_at(path(spark, d))


@query
def tree_unchanged(spark, d):
    return L.tree_unchanged(L.edge_unchanged(path(spark, d)))


@query
def topo_unchanged(spark, d):
    return L.topo_unchanged(path(spark, d))


@query
def expected_dist(spark, d):
    return L.expected_distance(L.tree_unchanged(L.edge_unchanged(path(spark, d))), RECOMB)


@query
def distance_lik(spark, d):
    """Observed interval lengths against expected ones, joined by number; densities are scaled by 1e12."""
    e = L.expected_distance(L.tree_unchanged(L.edge_unchanged(path(spark, d))), RECOMB).select("tree", "expected")
    o = A.intervals(spark, d).select("locus", "tidx", "nbps")
    joined = o.join(nested.large(e), F.col("locus") == F.col("tree"))
    return joined.select("locus", "tidx", "nbps", "expected", (L.distance_likelihood(F.col("nbps").cast("double"), F.col("expected")) * 1e12).alias("likelihood"))


@query
def smc_compare(spark, d):
    """Observed and expected distances with their rates and negated log-likelihoods."""
    e = L.expected_distance(L.tree_unchanged(L.edge_unchanged(path(spark, d))), RECOMB)
    o = A.intervals(spark, d).select(F.col("locus").alias("tree"), "tidx", "start", "nbps")
    return L.compared(o, e).select("tree", "start", "obs_dist", "exp_wait", F.round(F.col("lambda_") * 1e6, 6).alias("lambda_"), "logliks")


@query
def node_distances(spark, d):
    """Expected distances of gene trees by the species nodes that are clades in them."""
    sp, members = species(spark)
    g = genes(spark, d)
    e = L.expected_distance(L.tree_unchanged(L.edge_unchanged(path(spark, d))), RECOMB)
    return L.distances_by_node(sp, members, g, e)


@query
def gamma_rates(spark, d):
    """Rates of sites: gamma draws of mean 1 and variance 1/2, in bins of equal width by locus; counts and means of the bins."""
    sites = A.calls(spark, d).select("locus", "site").distinct()
    wide = sites.select("locus", F.explode(F.sequence(F.col("site") * 500, F.col("site") * 500 + 499)).alias("site"))
    return evolve.site_rates(wide, 2.0, 8, "gamma").groupBy("locus", F.round("rate", 9).alias("rate")).agg(F.count("*").alias("n"))


@query
def concat_tree(spark, d):
    """One tree of the populations' consensus sequences, all loci side by side."""
    c = S.consensus(A.calls(spark, d, MISSING)).withColumnRenamed("pop", "sample")
    return inference.concatenated_tree(writers.pack(c).select("locus", F.concat(F.lit("p"), F.col("sample")).alias("name"), "seq"))


LIKELY = "((p0:0.1,p1:0.2):0.05,p2:0.3,p3:0.15);"


@query
def tree_loglik(spark, d):
    """Log-likelihood of one tree of populations 0 to 3 for the alignment of their k-th samples."""
    rows = quads(spark, d).select("k", "locus", "site", F.explode(F.array(*[F.struct(F.lit(f"p{i}").alias("name"), F.col(f"s{i}").alias("a")) for i in range(4)])).alias("x"))
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("locus", "site", bases.base(F.col("x.a")).alias("b")))), lambda x: x["b"]), "")
    seqs = rows.groupBy(F.col("k").alias("locus"), F.col("x.name").alias("name")).agg(letters.alias("seq"))
    trees = seqs.select(F.col("locus").cast("long").alias("locus"), F.lit(LIKELY).alias("tree")).distinct()
    return phylo.scored(trees, phylo.columns(seqs), climb=False).select(F.col("locus").alias("k"), "loglik")


@query
def ml_trees(spark, d):
    """The trees of largest likelihood of the populations' consensus sequences, by locus."""
    c = S.consensus(A.calls(spark, d, MISSING)).withColumnRenamed("pop", "sample")
    return phylo.ml_trees(writers.pack(c).select("locus", F.concat(F.lit("p"), F.col("sample")).alias("name"), "seq"))


@query
def window_trees(spark, d):
    """Gene trees of windows of sites, of populations' consensus sequences."""
    return inference.window_trees(S.consensus(A.calls(spark, d, MISSING)).withColumnRenamed("pop", "sample"), 8)


@query
def species_quartets(spark, d):
    """The species tree of most shared quartets, from gene trees of windows of the populations' consensus sequences."""
    c = S.consensus(A.calls(spark, d, MISSING)).withColumnRenamed("pop", "sample")
    return quartet_species_tree(inference.window_trees(c, 8))


@query
def breakpoint_sessions(spark, d):
    """Breakpoints of a locus that follow each other within less than a day; times in seconds."""
    sec = lambda c: F.expr(f"timestampdiff(SECOND, timestamp_ntz'{A.EPOCH}', cast({c} as timestamp_ntz))")
    return sessions(A.breakpoints(spark, d), "1 day").select("locus", sec("session_start").alias("start"), sec("session_end").alias("end"), "n")


@query
def internode_distances(spark, d):
    loci = _model(spark, recomb=0.0).sim_trees(100, 1)
    return inference.internode_distances(loci, "genealogy", {f"{p}_{k}": p for p in "abcd" for k in (0, 1)})


@query
def evolve_sites(spark, d):
    """States of tips after evolution along a genealogy, counted by site pattern."""
    from ..sources import newick

    sites = A.table(spark, d, "customer").select(F.lit(0).cast("long").alias("locus"), F.col("c_custkey").alias("site"))
    calls, _ = evolve.evolved(sites, newick.parse("((a:1000,b:1000):1000,c:2000);"), 1e-4, 2.0, [0.1, 0.2, 0.3, 0.4], 5, shape=0.8)
    return S.wide(calls.withColumn("pop", F.col("sample")), "pop", ["a", "b", "c"], ["locus", "site"]).groupBy("s0", "s1", "s2").agg(F.count("*").alias("n"))


@query
def arg_edges(spark, d):
    """Edges of the full coalescent with recombination."""
    return _model(spark, recomb=1e-7).tree_sequences(20, 2000)[1]


# without an oracle: simulation and tree building


def _model(spark, **options):
    from ..model import Model

    return Model(spark, "(((a:1000,b:1000):1000,c:2000):1000,d:3000);", Ne=1000, nsamples=2, seed_trees=11, **options)


@query
def sim_trees(spark, d):
    return _model(spark, recomb=1e-7).sim_trees(40, 2000)


@query
def sim_loci(spark, d):
    return _model(spark, mut=1e-6, recomb=1e-8).sim_loci(40, 500).df


@query
def sim_snps(spark, d):
    return _model(spark, mut=1e-5).sim_snps(50).df


@query
def nj_trees(spark, d):
    c = A.calls(spark, d)
    top = c.select("sample").distinct().withColumn("g", F.floor(F.col("sample") / 10))
    return inference.gene_trees(writers.pack(c).join(top, "sample").groupBy("g", "sample").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("locus", "seq"))), lambda x: x["seq"]), "").alias("seq")).select(F.col("g").alias("locus"), F.concat(F.lit("s"), F.col("sample")).alias("name"), "seq"))


@query
def quartet_topology_freq(spark, d):
    loci = _model(spark, recomb=0.0).sim_trees(100, 1)
    return inference.quartet_topologies(loci, "genealogy")
