"""Queries op1 .. op13: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bagminhash, decontaminate, katz, mixing, oracles, periodic, secrets, sharding, spelling, substring, token_counts, token_output, toxicity
from .common import crc_bucket, table

#: Rank file of a public byte-level BPE.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The same vocabulary for the tokenizers library.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments", "best_segment", "evidence")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(table(spark, sf_dir, "documents"), RANKS, by=["source"])


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


#: Shares of the tokens that the mixture is to have, by the labelled table's classes.
TARGETS = {"high": 0.80, "low": 0.12, "toxic": 0.08}


def label_domain():
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_domain(), TARGETS)
    p = [F.round(F.col("p")[i], 9).alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))]
    return rows.select("doc_id", "n_tokens", *p, F.round("rate", 9).alias("rate"), mixing.copies_of(F.col("rate"), F.col("doc_id")).alias("copies"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lang = secrets.language(docs)
    return secrets.findings(docs, secrets.grow(secrets.labelled_findings(spark, lang), lang), lang)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 7) == 2
    out = katz.scores(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), slip=199))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digest(periodic.collapse(periodic.rolled(docs)))


def op13_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_output.round_trip(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_token_counts, op4_nearest_neighbours, op5_mixing, op6_decontamination, op7_near_duplicates, op8_secrets, op9_katz, op10_substring_dedup, op11_spelling_variants, op12_periodic_runs, op13_token_output)}

#: The other operators can't be written in portable SQL over the tables (alignment, tokenizers, sketches, trained models).
ORACLES = oracles.ORACLES
