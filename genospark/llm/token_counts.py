"""Exact histogram of encoded lengths, with suffix sums for every context limit.

Texts are encoded with a public tokenizer (a rank file; its path is a parameter) and documents are
counted by length.  Suffix sums over the lengths answer, for any limit L: how many documents are at
least L long, how many tokens all hold, and how many remain when each document is truncated at L.

Edge cases.  A null or empty text has length 0.  Null group values are a group of their own.  An
empty table gives an empty histogram.  Repeated rows count each time.  Runs of any length, of
white space or without any, are encoded as the tokenizer does it.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices

#: The pattern that splits a text before the merges of the public rank files (a fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Runs of the characters that have the property White_Space (a fixed value).
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a rank file, loaded once in a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def length_of(enc, text: str) -> int:
    """The number of tokens of a text; long runs of white space don't meet the pattern, whose matching would overflow its stack.

    The pattern takes such a run as one piece up to its last character, which begins the next piece unless the text ends there.
    """
    total = at = 0
    for m in LONG_BLANK.finditer(text):
        last = m.end() if m.end() == len(text) else m.end() - 1
        total += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._encode_single_piece(text[m.start() : last]))
        at = last
    return total + len(enc.encode_ordinary(text[at:]))


def with_lengths(docs: DataFrame, ranks: str, by: list[str] | None = None, ship: bool = True) -> DataFrame:
    """The `by` columns and n_tokens of every row.  ship: the rank file goes to the executors with the job."""
    by = by or []
    name = ranks.rpartition("/")[2]
    if ship:
        docs.sparkSession.sparkContext.addFile(ranks)

    def run(batches):
        enc = encoder(SparkFiles.get(name) if ship else ranks)
        for b in batches:
            texts = [t or "" for t in b.column("__text").to_pylist()]
            n = [length_of(enc, t) for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), pa.array(n, pa.int64())], [*by, "n_tokens"])

    kinds = dict(docs.dtypes)
    picked = docs.select(*by, F.col("text").cast("string").alias("__text"))
    return picked.mapInArrow(cut_by("__text", run), ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n_tokens long"]))


def cut_by(text: str, run):
    def cut(batches):
        return run(slices(batches, text))

    return cut


def histogram(docs: DataFrame, ranks: str, by: list[str] | None = None, block: int = 512) -> DataFrame:
    """by, n_tokens, docs, docs_at_least, tokens_at_least, docs_total, tokens_total, truncated_total, share_below.

    truncated_total: tokens left of all documents of the group if each is cut at n_tokens.  The suffix sums
    run within blocks of lengths and over the block totals, so a window never holds more than `block` lengths or
    all blocks of a group.
    """
    by = by or []
    counts = with_lengths(docs, ranks, by).groupBy(*by, "n_tokens").agg(F.count("*").alias("docs"))
    # a histogram has at most as many rows as there are lengths
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    totals = counts.groupBy(*by, "block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = W.partitionBy(*by).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    totals = totals.select(
        *by, "block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("at"),
        F.sum("bd").over(whole).alias("docs_total"), F.sum("bt").over(whole).alias("tokens_total"),
    )
    inside = W.partitionBy(*by, "block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    same = functools.reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*by, "block"]])
    out = counts.withColumns({"sd": F.sum("docs").over(inside), "st": F.sum("tokens").over(inside)}).alias("c").join(totals.alias("t"), same)
    n, dl, tl = F.col("c.n_tokens"), F.col("sd") + F.col("ad"), F.col("st") + F.col("at")
    return out.select(
        *(F.col(f"c.{k}").alias(k) for k in by), n.alias("n_tokens"), F.col("c.docs").alias("docs"), dl.alias("docs_at_least"), tl.alias("tokens_at_least"), "docs_total", "tokens_total",
        (F.col("tokens_total") - tl + n * dl).alias("truncated_total"), ((F.col("docs_total") - dl) / F.col("docs_total")).alias("share_below"),
    )


def answers(hist: DataFrame, limits: list[int], quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """From a histogram: kind, at, value rows: `truncated` totals for any limits, `quantile` lengths (nearest rank)."""
    by = by or []
    lim = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits]))
    trunc = hist.withColumn("at", lim).groupBy(*by, "at").agg(F.sum(F.col("docs") * F.least("n_tokens", "at")).alias("value"))
    q = hist.withColumn("at", F.explode(F.array(*[F.lit(float(x)) for x in quantiles])))
    # the first length at or below which at least the share `at` of the documents lies
    reach = (F.col("docs_total") - F.col("docs_at_least") + F.col("docs")) >= F.ceil(F.col("at") * F.col("docs_total"))
    quant = q.where(reach).groupBy(*by, "at").agg(F.min("n_tokens").alias("value"))
    return trunc.select(*by, F.lit("truncated").alias("kind"), F.col("at").cast("double").alias("at"), "value").unionByName(quant.select(*by, F.lit("quantile").alias("kind"), "at", "value"))
