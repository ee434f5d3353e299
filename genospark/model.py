"""The facade: a species tree with its demography, simulation, masking, statistics and export."""

from __future__ import annotations

import warnings
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bases
from .functions.rng import categorical
from .operators import calls as C
from .operators import ancestry, evolve
from .operators import simulate as S
from .operators import stats as S_
from .sources import bgzf, newick, writers

# State letters of the supported substitution models.
#: Generations that an admixture keeps from the ends of its edges, as far as they are long enough.
INSET = 1e-3
ALPHABETS = {"JC69": "ACGT", "HKY": "ACGT", "BINARY": "01", "PAM": "ARNDCQEGHILKMFPSTWYV", "BLOSUM62": "ARNDCQEGHILKMFPSTWYV"}


class ModelError(Exception):
    """Arguments that don't describe a model."""


def substitution(model, kappa: float = 1.0, pi=None) -> tuple[str, np.ndarray, np.ndarray]:
    """(letters, root distribution, matrix of a substitution) of a named model, or of a given triple.

    JC69: every other base; BINARY: the other state; HKY: transitions kappa times as likely.  The amino-acid models
    take their published matrices as a triple, which `rate_file` makes of a file.
    """
    if not isinstance(model, str):
        return model
    name = model.upper()
    if name in ("PAM", "BLOSUM62"):
        raise ModelError(f"{model} needs its matrix: give (letters, root distribution, substitution matrix)")
    if name not in ALPHABETS:
        raise ModelError(f"unknown substitution model {model}; supported: {', '.join(ALPHABETS)} or a triple")
    letters = ALPHABETS[name]
    n = len(letters)
    root = np.full(n, 1 / n) if pi is None else np.asarray(pi, dtype=float) / np.sum(pi)
    q = np.tile(root, (n, 1)) if name == "HKY" else np.ones((n, n))
    if name == "HKY":
        for i in range(4):
            q[i, (i + 2) % 4] *= kappa
    np.fill_diagonal(q, 0)
    return letters, root, q / q.sum(axis=1, keepdims=True)


def rate_file(path: str, letters: str = ALPHABETS["PAM"]) -> tuple[str, np.ndarray, np.ndarray]:
    """The triple of an amino-acid model from a file of exchange rates: the lower triangle of a symmetric matrix, row by row, then
    the equilibrium frequencies, all divided by white space; what follows is a comment."""
    n, numbers = len(letters), []
    with open(path) as f:
        for word in f.read().split():
            try:
                numbers.append(float(word))
            except ValueError:
                break
    need = n * (n - 1) // 2 + n
    if len(numbers) < need:
        raise ModelError(f"{path} has {len(numbers)} of {need} numbers")
    s, q = np.zeros((n, n)), numbers[: need - n]
    s[np.tril_indices(n, -1)] = q
    root = np.array(numbers[need - n : need]) / np.sum(numbers[need - n : need])
    rate = (s + s.T) * root[None, :]
    return letters, root, rate / rate.sum(axis=1, keepdims=True)


class Model:
    """tree: Newick text or a node; Ne: diploid size of all nodes, or None if nodes carry `ne`; nsamples: haploids a tip,
    a number or a dict by tip name or number; admixture_edges: (source, dest, time, rate), or a list of them."""

    def __init__(self, spark: SparkSession, tree: str | newick.Node = "(p);", Ne: float | None = None, nsamples=1, admixture_edges=None, mut: float = 1e-8, recomb=1e-9, ancestry_model: str = "hudson", subst_model="JC69", kappa: float = 1.0, equilibrium_frequencies=None, seed_trees: int = 0, seed_mutations: int | None = None, store_tree_sequences: bool = False, record_full_arg: bool = False, **unknown):
        if unknown:
            warnings.warn(f"arguments that are not known are ignored: {', '.join(sorted(unknown))}", stacklevel=2)
        if ancestry_model not in S.ANCESTRY:
            raise ModelError(f"unknown ancestry model {ancestry_model}; supported: {', '.join(S.ANCESTRY)}")
        if record_full_arg:
            warnings.warn("nodes at which nothing coalesces are not recorded; tree_sequences has all coalescences", stacklevel=2)
        self.spark, self.mut, self.recomb, self.ancestry_model, self.store_tree_sequences = spark, mut, recomb, ancestry_model, store_tree_sequences
        root = newick.parse(tree) if isinstance(tree, str) else tree
        if not root.children or len(root.children) == 1:
            leaf = root.children[0] if root.children else root
            root = newick.Node(leaf.name, 0.0, [], 0.0, leaf.ne)
        self.tree = newick.binary(root)
        self.letters, self.root, self.probs = substitution(subst_model, kappa, equilibrium_frequencies)
        # without a mutation seed the trees' seed serves both
        self.seeds = (seed_trees, seed_mutations or seed_trees)
        self.nodes = [*self.tree.leaves(), *(n for n in self.tree.walk() if n.children)]
        self.tips = self.tree.leaves()
        if len({t.name for t in self.tips}) < len(self.tips):
            raise ModelError("tip names must differ")
        self._set_ne(Ne)
        self._set_samples(nsamples)
        self._set_admixture(admixture_edges)

    def _set_ne(self, ne: float | None) -> None:
        for n in self.nodes:
            n.ne = ne if ne is not None else n.ne
            if n.ne is None:
                raise ModelError("every node needs an Ne, or the model does")

    def _set_samples(self, nsamples) -> None:
        if isinstance(nsamples, int):
            counts = {t.name: nsamples for t in self.tips}
        elif isinstance(nsamples, dict):
            counts = {(self.tips[k].name if isinstance(k, int) else k): n for k, n in nsamples.items()}
        else:
            raise TypeError("nsamples is a number or a dict by tip")
        if set(counts) != {t.name for t in self.tips}:
            raise TypeError("nsamples must name every tip")
        many = any(n != 1 for n in counts.values())
        self.samples = sorted(((f"{t}_{k}" if many else t), t) for t, n in counts.items() for k in range(n))

    def _node(self, key) -> newick.Node:
        found = [n for i, n in enumerate(self.nodes) if key == i or key == n.name]
        if len(found) != 1:
            raise ModelError(f"no node {key}")
        return found[0]

    def _set_admixture(self, edges) -> None:
        edges = [edges] if isinstance(edges, tuple) else list(edges or [])
        up = {id(c): n for n in self.nodes for c in n.children}
        pops = {id(n): f"p{i}" for i, n in enumerate(self.nodes)}
        end = lambda n: up[id(n)].height if id(n) in up else float("inf")
        events = [(n.height, "split", tuple(pops[id(c)] for c in n.children), pops[id(n)]) for n in self.nodes if n.children]
        for edge in edges:
            if len(edge) != 4:
                raise ModelError("an admixture edge is (source, dest, time, rate)")
            src, dest, time, rate = self._node(edge[0]), self._node(edge[1]), edge[2], edge[3]
            lo, hi = max(src.height, dest.height), min(end(src), end(dest))
            if not lo < hi < float("inf"):
                raise ModelError("the edges of an admixture don't share a time")
            at = lambda x: float(x) if isinstance(x, int) else lo + x * (hi - lo)
            # none: a pulse half way; one value: a pulse; two: an interval; whole numbers are generations, fractions proportions
            if isinstance(time, (tuple, list)):
                a, b = at(time[0]), at(time[1])
            else:
                a = b = at(0.5 if time is None else time)
            if not (lo <= a <= b <= hi):
                raise ModelError("the admixture lies outside the time that its edges share")
            # it neither begins nor ends together with an edge
            inset = min(INSET, (hi - lo) / 4)
            a, b = min(max(a, lo + inset), hi - inset), max(min(b, hi - inset), lo + inset)
            s, d = pops[id(src)], pops[id(dest)]
            events += [(a, "pulse", s, d, rate)] if a == b else [(a, "migration", s, d, rate), (b, "migration", s, d, 0.0)]
        tips = {t.name: t for t in self.tips}
        self.demography = S.Demography({pops[id(n)]: float(n.ne) for n in self.nodes}, sorted(events, key=lambda e: (e[0], e[1])), [(name, pops[id(tips[t])], tips[t].height) for name, t in self.samples])

    def debug_demography(self) -> DataFrame:
        """time, type, detail of every event."""
        return self.spark.createDataFrame([(float(e[0]), e[1], " ".join(map(str, e[2:]))) for e in self.demography.events] or [(0.0, "none", "")], "time double, type string, detail string")

    def tree_table(self) -> DataFrame:
        rows = [(*r, float(n.ne)) for r, n in zip(newick.rows(self.tree), self.nodes, strict=True)]
        return self.spark.createDataFrame(rows, newick.SCHEMA + ", ne double")

    def sample_table(self) -> DataFrame:
        return self.spark.createDataFrame([(s, t) for s, t in self.samples], "sample string, pop string")

    def imap(self, diploid: bool = False) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        rows = C.diploid_map(self.sample_table()).collect() if diploid else []
        for name, pop in sorted({(r["individual"], r["pop"]) for r in rows}) if diploid else self.samples:
            out.setdefault(pop, []).append(name)
        return out

    def sim_trees(self, nloci: int = 1, nsites: int = 1, precision: int = 14) -> DataFrame:
        return S.sim_trees(self.spark, self.demography, nloci, int(nsites), self.recomb, self.seeds[0], precision, self.ancestry_model)

    def tree_sequences(self, nloci: int = 1, nsites: int = 1) -> tuple[DataFrame, DataFrame]:
        """Node and edge tables of the loci that sim_trees and sim_loci of the same size have under the full coalescent."""
        return ancestry.tree_sequences(self.spark, self.demography, nloci, int(nsites), self.recomb, self.seeds[0])

    def evolve(self, genealogy: str | newick.Node, nsites: int, kappa: float = 1.0, equilibrium_frequencies=(0.25,) * 4, gamma: float | None = None, gamma_categories: int | None = None, locus: int = 0, model=None) -> tuple[DataFrame, DataFrame]:
        """Calls and ancestral states of sites that evolve along one genealogy under HKY; gamma: shape of the sites' rates.

        model: a name or triple as `substitution` takes it; sites change at the mutation rate to a state that its matrix draws.
        """
        root = newick.parse(genealogy) if isinstance(genealogy, str) else genealogy
        sites = self.spark.range(nsites).select(F.lit(locus).cast("long").alias("locus"), F.col("id").alias("site"))
        if model is None:
            return evolve.evolved(sites, root, self.mut, kappa, list(equilibrium_frequencies), self.seeds[1], gamma, gamma_categories)
        letters, start, jump = substitution(model, kappa)
        return evolve.evolved(sites, root, self.mut, kappa, list(start), self.seeds[1], gamma, gamma_categories, matrix=jump - np.eye(len(letters)))

    def sim_loci(self, nloci: int = 1, nsites: int = 1, precision: int = 14) -> Simulated:
        if self.mut <= 0:
            warnings.warn("without a mutation rate all sequences are ancestral", stacklevel=2)
        loci = S.sim_loci(self.spark, self.demography, nloci, int(nsites), self.mut, self.recomb, self.seeds, self.probs, self.root, precision, self.ancestry_model)
        out = Simulated(self, loci, int(nsites))
        if self.store_tree_sequences:
            out.tree_sequences = self.tree_sequences(nloci, nsites)
        return out

    def sim_snps(self, nsnps: int = 1, min_alleles: int = 2, max_alleles: int | None = None, min_mutations: int = 1, max_mutations: int | None = None, repeat_on_trees: bool = False, precision: int = 14) -> Simulated:
        d = replace(self.demography)
        loci = S.sim_snps(self.spark, d, nsnps, self.mut, self.seeds, self.probs, self.root, min_alleles, max_alleles, min_mutations, max_mutations, repeat_on_trees, precision)
        return Simulated(self, loci, 1)


class Simulated:
    """A simulation's relations: df (the result table), ancestral, calls; masking gives a new object."""

    def __init__(self, model: Model, loci: DataFrame, nsites: int, calls: DataFrame | None = None):
        self.model, self.loci, self.nsites = model, loci, nsites
        self.df = S.table(loci)
        sites = model.spark.range(nsites).select(F.col("id").alias("site"))
        every = self.df.select("locus").distinct().crossJoin(F.broadcast(sites))
        draw = categorical([F.lit(float(p)) for p in model.root], "anc", model.seeds[1], F.col("locus"), F.col("site"))
        hit = S.hit_sites(loci).select("locus", "site", F.col("anc").alias("hit"))
        self.ancestral = every.join(hit, C.SITE, "left").select("locus", "site", F.coalesce("hit", draw).alias("anc"))
        self._calls = calls

    @property
    def calls(self) -> DataFrame:
        """locus, sample, pop, site, allele of all samples."""
        if self._calls is None:
            self._calls = C.overlay(self.ancestral, self.model.sample_table(), S.derived(self.loci)).select("locus", "sample", "pop", "site", "allele")
        return self._calls

    def apply_missing_mask(self, coverage: float = 1.0, cut_sites: tuple[int, int] = (0, 0), distance=None, coverage_type: str = "locus", seed: int = 0) -> Simulated:
        """Calls lost by coverage (a locus of a sample, or single sites), then haplotypes lost by mutated cut sites."""
        if distance is not None:
            raise NotImplementedError("dropout by distance")
        if C.has_missing(self.calls):
            raise ModelError("a mask has been applied already")
        out = C.mask_coverage(self.calls, coverage, seed, by_site=coverage_type != "locus") if coverage < 1 else self.calls
        if any(cut_sites):
            out = C.mask_cut_sites(out, self.ancestral, *cut_sites)
        return Simulated(self.model, self.loci, self.nsites, out.select("locus", "sample", "pop", "site", "allele"))

    def pairs(self) -> DataFrame:
        """sample, pop, individual, side: haploids joined in pairs; every population needs an even number of them."""
        samples = self.model.sample_table()
        if odd := [r["pop"] for r in C.odd_populations(samples).collect()]:
            raise ModelError(f"diploid output needs an even number of haploids: {', '.join(sorted(odd))}")
        return C.diploid_map(samples)

    def names(self, diploid: bool = False) -> DataFrame:
        """name of every sample or individual."""
        return self.pairs().select(F.col("individual").alias("name")).distinct() if diploid else self.model.sample_table().select(F.col("sample").alias("name"))

    def seqs(self, idxs: list[int] | None = None, diploid: bool = False) -> DataFrame:
        """locus, name, seq; idxs: these loci only; diploid: pairs of haploids as ambiguity codes."""
        calls = self.calls
        if idxs is not None:
            wanted = self.model.spark.createDataFrame([(i,) for i in idxs], "locus long")
            missing = wanted.join(self.df, "locus", "left_anti").count()
            if missing:
                raise ModelError(f"{missing} of the loci asked for don't exist")
            calls = calls.join(F.broadcast(wanted), "locus", "left_semi")
        if diploid:
            return writers.pack_codes(C.iupac_calls(calls, self.pairs())).withColumnRenamed("individual", "name")
        return writers.pack(calls).withColumnRenamed("sample", "name")

    def write_loci_to_phylip(self, outdir: str, idxs: list[int] | None = None, name_prefix: str = "", name_suffix: str = "", diploid: bool = False) -> None:
        """A folder `file=<prefix><locus><suffix>.phy` a locus."""
        text = writers.phylip(self.seqs(idxs, diploid))
        file = F.concat(F.lit(name_prefix), F.col("locus").cast("string"), F.lit(f"{name_suffix}.phy"))
        writers.write_text(text.select(file.alias("file"), "text"), outdir, by="file")

    def write_concat_to_phylip(self, path: str | None = None, idxs: list[int] | None = None, diploid: bool = False) -> str | None:
        one = writers.concatenated(self.seqs(idxs, diploid)).withColumn("locus", F.lit(0))
        text = writers.phylip(one)
        if path is None:
            return text.first()["text"]
        writers.write_text(text.select("text"), path)
        return None

    def write_concat_to_nexus(self, path: str, idxs: list[int] | None = None, diploid: bool = False) -> None:
        lines = writers.nexus_lines(self.seqs(idxs, diploid))
        writers.write_text(lines.orderBy("part", "block", "name").select("value"), path)

    def write_vcf(self, path: str | None = None, diploid: bool = False, fill_missing_alleles: bool = True, codec: str | None = None, bgzip: bool = False) -> DataFrame | None:
        """The rows, or with a path a VCF document with its header; bgzip: in block-gzip files."""
        pairs = self.pairs() if diploid else None
        if path is None:
            return writers.vcf_rows(self.calls, self.ancestral, pairs, fill_missing_alleles)
        lines = writers.vcf_lines(self.calls, self.ancestral, pairs, fill_missing_alleles)
        ordered = lines.orderBy("chrom", "pos").select("line")
        if bgzip:
            bgzf.write_lines(ordered, path, "vcf.gz")
        else:
            writers.write_text(ordered, path, codec=codec)
        return None

    def write_popfile(self, path: str, diploid: bool = False) -> None:
        writers.write_text(writers.popfile(self.names(diploid)), path)

    def write_loci_tables(self, path: str, diploid: bool = False) -> None:
        """Parquet tables for what an HDF5 file of loci holds: seqs, phymap, and attributes."""
        self._write_tables(path, diploid, seqs=self.seqs(diploid=diploid), phymap=writers.phymap(S_.locus_summary(self.df)))

    def write_snps_tables(self, path: str, diploid: bool = False) -> None:
        """Parquet tables for what an HDF5 file of SNPs holds: snps (letters), snpsmap, genos (pairs of allele numbers), and attributes."""
        sites = C.variable_sites(self.calls)
        snps = self.calls.join(sites, C.SITE, "left_semi")
        pairs = self.pairs() if diploid else self.calls.select("sample", "pop").distinct().select("sample", F.col("sample").alias("individual"), F.lit(0).alias("side"))
        letters = C.iupac_calls(snps, pairs) if diploid else snps.select("locus", "site", F.col("sample").alias("individual"), bases.base(F.col("allele")).alias("code"))
        genos = C.geno_pairs(C.geno_index(snps, self.ancestral), pairs, fill=True)
        self._write_tables(path, diploid, snps=letters.withColumnRenamed("individual", "name"), snpsmap=writers.snpsmap(sites), genos=genos.withColumnRenamed("individual", "name"))

    def _write_tables(self, path: str, diploid: bool, **tables: DataFrame) -> None:
        for name, rows in tables.items():
            rows.write.parquet(f"{path}/{name}")
        self.names(diploid).select(F.lit("name").alias("key"), F.col("name").alias("value")).unionByName(self.model.spark.createDataFrame([("nsites", str(self.nsites)), ("diploid", str(diploid))], "key string, value string")).write.parquet(f"{path}/attributes")
