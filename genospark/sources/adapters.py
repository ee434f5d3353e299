"""Views of the engine's relations over general tables.

calls        sample, pop, locus, site, allele             from embeddings (quantised components)
seqs         sample, pop, seq                             from documents (letters recoded as bases)
intervals    locus, start, end, nbps, nsnps, tidx, genealogy   from events (gaps between a user's events)
tree_nodes   idx, name, parent, height, up_height, dist, ne, is_leaf   from region, nation, supplier
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..operators import numbering

SITES_PER_LOCUS = 16
LETTERS = "abcdefghijklmnopqrstuvwxyz"
RECODED = "ACGTACGTACGTACGTACGTACGTAC"
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str, missing: float = 0.0) -> DataFrame:
    v = F.col("v").cast("double")
    code = F.when(v < -0.125, 0).when(v < 0, 1).when(v < 0.125, 2).otherwise(3)
    out = (
        table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").cast("long").alias("pop"), F.posexplode("embedding").alias("site", "v"))
        .select("sample", "pop", F.floor(F.col("site") / SITES_PER_LOCUS).alias("locus"), F.col("site").cast("long").alias("site"), code.alias("allele"))
    )
    if missing:
        out = out.withColumn("allele", F.when(uniform("miss", F.col("sample"), F.col("site")) >= missing, F.col("allele")))
    return out


def ancestral(calls_: DataFrame, sample: int = 0) -> DataFrame:
    """locus, site, anc: the alleles of one sample stand for the ancestor."""
    return calls_.where(F.col("sample") == sample).select("locus", "site", F.col("allele").alias("anc"))


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, RECODED)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"), F.col("lang").alias("pop"), letters.alias("seq"))


def breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locus, event_id, position, kind: a user's events in seconds."""
    sec = F.expr(f"timestampdiff(SECOND, timestamp_ntz'{EPOCH}', ts)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("locus"), "event_id", sec.alias("position"), F.col("event_type").alias("kind"), "ts")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("locus").orderBy("ts", "event_id")
    u = uniform("snps", F.col("event_id"))
    return (
        breakpoints(spark, sf_dir).withColumns({"end": F.lead("position").over(w), "tidx": (F.row_number().over(w) - 1).cast("long")})
        .where("end is not null")
        .select("locus", F.col("position").alias("start"), "end", (F.col("end") - F.col("position")).alias("nbps"), F.greatest(F.lit(0), F.floor(u * 8) - 5).cast("long").alias("nsnps"), "tidx", F.col("kind").alias("genealogy"))
    )


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy root, region, nation, supplier; heights 3e5, 2e5, 1e5, 0."""
    row = lambda df, name, parent, height, ne: df.select(name.alias("name"), parent.alias("parent"), F.lit(height).alias("height"), ne.cast("double").alias("ne"))
    tag = lambda c, k: F.concat(F.lit(c), F.col(k).cast("string"))
    read = lambda t: table(spark, sf_dir, t)
    nodes = (
        row(read("supplier"), tag("s", "s_suppkey"), tag("n", "s_nationkey"), 0.0, 1000 * (1 + F.col("s_nationkey")))
        .unionByName(row(read("nation"), tag("n", "n_nationkey"), tag("r", "n_regionkey"), 1e5, 1000 * (1 + F.col("n_nationkey"))))
        .unionByName(row(read("region"), tag("r", "r_regionkey"), F.lit("root"), 2e5, F.lit(1000)))
        .unionByName(row(spark.range(1), F.lit("root"), F.lit(None).cast("string"), 3e5, F.lit(1000)))
    )
    up = nodes.select(F.col("name").alias("parent"), F.col("height").alias("up_height"))
    inner = nodes.select(F.col("parent").alias("name")).where("name is not null").distinct().withColumn("has_child", F.lit(True))
    out = nodes.join(up, "parent", "left").join(inner, "name", "left")
    return numbering.ranked(out, ["name"], "idx").select(
        (F.col("idx") + 1).alias("idx"), "name", "parent", "height", "up_height", (F.col("up_height") - F.col("height")).alias("dist"), "ne", F.col("has_child").isNull().alias("is_leaf")
    )
