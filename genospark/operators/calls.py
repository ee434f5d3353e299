"""Genotype calls in long form: variable sites, alleles, genotypes, diploids, masking.

A call is (locus, sample, site, allele); a null allele is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bases
from ..functions.rng import uniform

SITE = ["locus", "site"]


def variable_sites(calls: DataFrame) -> DataFrame:
    """locus, site of sites with two or more alleles; missing calls don't count."""
    return calls.groupBy(*SITE).agg(F.min("allele").alias("lo"), F.max("allele").alias("hi")).where("lo <> hi").select(*SITE)


def contig_lines(calls: DataFrame) -> DataFrame:
    """locus, length of loci that vary if missing is a state, numbered from 1."""
    state = F.coalesce("allele", F.lit(9))
    sites = calls.groupBy(*SITE).agg((F.min(state) != F.max(state)).alias("varies"))
    return sites.groupBy("locus").agg(F.count("*").alias("length"), F.count_if("varies").alias("n")).where("n > 0").select((F.col("locus") + 1).alias("chrom"), "length", F.col("n").alias("nvariable"))


def alt_alleles(calls: DataFrame, anc: DataFrame) -> DataFrame:
    """locus, site, anc, alts: alleles other than the ancestor's, by falling code."""
    seen = calls.where("allele is not null").groupBy(*SITE).agg(F.collect_set("allele").alias("seen"))
    return seen.join(anc, SITE).select(*SITE, "anc", F.sort_array(F.filter("seen", lambda x: x != F.col("anc")), asc=False).alias("alts"))


def alt_string(alts: str = "alts") -> Column:
    return F.array_join(F.transform(alts, lambda x: bases.base(x)), ",")


def geno_index(calls: DataFrame, anc: DataFrame) -> DataFrame:
    """locus, sample, site, anc, alts, gt: 0 for the ancestor's allele, else the place in the ALT list; null if missing."""
    alts = alt_alleles(calls, anc)
    gt = F.when(F.col("allele") == F.col("anc"), 0).otherwise(F.array_position("alts", F.col("allele"))).cast("long")
    return calls.join(alts, SITE).select("locus", "sample", "pop", "site", "anc", "alts", F.when(F.col("allele").isNotNull(), gt).alias("gt"))


def suffix(name: str) -> Column:
    """The number at the end of a name, by which samples are ordered (a_2 before a_10); null without one."""
    return F.regexp_extract(F.col(name).cast("string"), r"(\d{1,18})$", 1).try_cast("long")


def diploid_map(samples: DataFrame) -> DataFrame:
    """sample, pop, individual (name), side (0 or 1): consecutive haploids of a population, by the numbers in their names, are paired.

    An individual is named by its population if that is all it has, else by population and number.  The last haploid of an
    odd population is paired with itself; `odd_populations` finds such ones.
    """
    ranked = samples.select("sample", "pop").distinct().withColumn("k", F.row_number().over(W.partitionBy("pop").orderBy(suffix("sample").asc_nulls_first(), "sample")) - 1)
    most = ranked.agg(F.max("k").alias("most"))
    pair = F.floor(F.col("k") / 2).cast("long")
    name = F.when(F.col("most") <= 1, F.col("pop").cast("string")).otherwise(F.concat_ws("_", F.col("pop").cast("string"), pair.cast("string")))
    return ranked.crossJoin(F.broadcast(most)).select("sample", "pop", name.alias("individual"), (F.col("k") % 2).cast("long").alias("side"))


def odd_populations(samples: DataFrame) -> DataFrame:
    """pop of the populations whose haploids can't all be paired."""
    return samples.select("sample", "pop").distinct().groupBy("pop").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select("pop")


def geno_pairs(genos: DataFrame, pairs: DataFrame, fill: bool = False) -> DataFrame:
    """locus, site, individual, left, right: genotype indices of the two haploids (one aggregate, no self-join).

    fill: one missing side takes the other's allele.
    """
    both = genos.join(pairs.select("sample", "individual", "side"), "sample")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("gt")))
    out = both.groupBy("locus", "site", "individual").agg(side(0).alias("l"), side(1).alias("r"), F.max("side").alias("sides"))
    r = F.when(F.col("sides") == 0, F.col("l")).otherwise(F.col("r"))
    l, r = (F.coalesce("l", r), F.coalesce(r, "l")) if fill else (F.col("l"), r)
    return out.select("locus", "site", "individual", l.alias("left"), r.alias("right"))


def iupac_calls(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """locus, site, individual, code: diploid letters."""
    both = calls.join(pairs.select("sample", "individual", "side"), "sample")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("allele")))
    out = both.groupBy("locus", "site", "individual").agg(side(0).alias("l"), side(1).alias("r"))
    return out.select("locus", "site", "individual", bases.iupac(F.col("l"), F.col("r")).alias("code"))


def mask_coverage(calls: DataFrame, coverage: float, seed, by_site: bool = False) -> DataFrame:
    """Calls missing with probability 1 - coverage, by locus and sample or by single site."""
    keys = [F.col("locus"), F.col("sample"), *([F.col("site")] if by_site else [])]
    return calls.withColumn("allele", F.when(uniform(seed, *keys) >= 1 - coverage, F.col("allele")))


def mask_cut_sites(calls: DataFrame, anc: DataFrame, first: int, last: int) -> DataFrame:
    """A haplotype is missing for a locus if one of the first or last bases differs from the ancestor's (missing differs)."""
    cut = (F.col("site") < F.col("lo") + first) | (F.col("site") > F.col("hi") - last)
    joined = calls.join(anc, SITE)
    ends = joined.groupBy("locus").agg(F.min("site").alias("lo"), F.max("site").alias("hi"))
    # only the sites at the ends tell which haplotypes are lost
    lost = joined.join(ends, "locus").where(cut & ~F.col("allele").eqNullSafe(F.col("anc"))).select("locus", "sample", F.lit(True).alias("lost")).distinct()
    return joined.join(lost, ["locus", "sample"], "left").withColumn("allele", F.when(F.col("lost").isNull(), F.col("allele"))).drop("lost", "anc")


def overlay(baseline: DataFrame, samples: DataFrame, mutations: DataFrame) -> DataFrame:
    """Calls of every sample: the baseline's allele, overwritten where a mutation is (locus, sample, site, derived)."""
    return baseline.crossJoin(F.broadcast(samples)).join(mutations, ["locus", "sample", "site"], "left").withColumn("allele", F.coalesce("derived", "anc")).drop("derived")


def has_missing(calls: DataFrame) -> bool:
    return bool(calls.where("allele is null").limit(1).count())
