"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Edge cases.  Null and empty texts pass toxicity and decontamination, are near duplicates of equal ones with other ids only if empty, and take part in mixing
without tokens.  Rows without a doc_id take part in every stage, and go by their text where a stage needs a key.  Repeated rows count
once from near_dedup on.  Labels that name no document, or name it twice, are handled by the operators (see there).  An empty table goes
through all stages; without labels nothing is toxic and quality is unknown, so that all documents have the same rate.  Further columns
are kept up to the last stage, which returns op2's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genospark.llm import bagminhash, common, decontaminate, mixing, sharding, toxicity

#: Shares of the tokens by labelled quality that the mixture is to have: near those that the posteriors give the corpus, so that few documents go.
TARGETS = {"high": 0.75, "low": 0.25}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the model learns from the labelled rows of `docs`."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return bagminhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tokens have the shares of labelled quality that TARGETS names: of a domain with too many a part goes, by rates of at most 1, and none is repeated."""
    quality = F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")
    return mixing.resample(docs, common.table(spark, sf_dir, "labels"), quality, TARGETS, once=True)


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, as in op2."""
    return sharding.digest(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_to_targets), ("sharding", deal_to_shards)]

#: Hashes, signatures and alignments have no portable SQL; the pipeline is tested against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else common.stored(out, f"stage-{name}")
    return docs
