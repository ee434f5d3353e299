"""Soft-membership mixing of documents to target weights, in DataFrame functions only.

Classifier.  A naive Bayes model over the presence of words (and two binned features: how many of the words
are distinct, and how many there are) is fitted on a bounded sample of the documents that the labelled table names;
it gives every document posteriors over the domains.

Rates.  Document i with n_i tokens and posteriors p_i gets a rate r_i >= 0 so that the expected token totals
S_d = sum r_i n_i p_id meet targets T_d.  Projected gradient on the least-squares residual, from r = 1:
r <- max(0, r - p . g), g = M^-1 (S - T), M = sum n_i p_i p_i^T over the documents with r > 0.  Each
pass is one aggregate over the documents; only the totals reach the driver.  Steps that do not lessen the
residual are halved; where that doesn't help, the plain gradient goes on.  With `most_rate` the rates are also bounded from above, and documents at a bound stay out of M.

Edge cases.  A null or empty text has no tokens and gets the prior as its posterior.  Labelled rows with a null
domain are left out; a doc_id labelled twice takes the smaller domain name.  Repeated rows each get their rate.
Without labelled documents all domains are equally likely.  Targets for domains without mass leave a
residual, which `fit_rates` returns.  An empty table gives an empty result.  Other columns are kept by `resample` alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def with_terms(docs: DataFrame) -> DataFrame:
    """The documents with n_tokens and terms added."""
    every = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "[ \n]"), lambda x: x != "")
    out = docs.withColumn("__w", every).withColumn("n_tokens", F.size("__w").cast("long")).withColumn("__u", F.array_distinct("__w"))
    share = F.concat(F.lit("\x01share"), F.floor(10 * F.size("__u") / F.greatest(F.col("n_tokens"), F.lit(1))).cast("string"))
    length = F.concat(F.lit("\x01length"), F.floor(F.log2(F.col("n_tokens") + 1)).cast("string"))
    return out.withColumn("terms", F.when(F.col("n_tokens") > 0, F.concat("__u", F.array(share, length))).otherwise(F.array().cast("array<string>"))).drop("__w", "__u")


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], max_labelled: int = 8_000, max_terms: int = 400, smooth: float = 0.5) -> dict:
    """Prior and term weights, from at most max_labelled labelled documents; at most max_terms terms."""
    # bounded by max_labelled, so it may be broadcast
    ids = labels.select(F.col("doc_id").alias("__id"), domain.alias("domain")).where(F.col("__id").isNotNull() & F.col("domain").isin(domains)).groupBy("__id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    sample = with_terms(docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))).select("domain", "terms")
    seen = sample.select("domain", F.explode(F.concat("terms", F.array(F.lit("\x02")))).alias("term"))
    counts = stored(seen.groupBy("term").agg(*[F.count_if(F.col("domain") == d).alias(f"c{i}") for i, d in enumerate(domains)]), "mixing-terms")
    whole = (counts.where("term = '\x02'").collect() or [[""] + [0] * len(domains)])[0][1:]
    total = sum(whole)
    prior = [(n + smooth) / (total + smooth * len(domains)) for n in whole]
    # the terms whose presence says most: the largest chi-square-like spread of the domains' rates
    rate = [(F.col(f"c{i}") + smooth) / (n + 2 * smooth) for i, n in enumerate(whole)]
    mean = sum(F.col(f"c{i}") for i in range(len(domains))) / max(1, total)
    spread = sum(n * (r - mean) * (r - mean) for n, r in zip(whole, rate, strict=True)) / (mean * (1 - mean) + 1e-9)
    top = counts.where("term <> '\x02'").select("term", *[F.log(r).alias(f"w{i}") for i, r in enumerate(rate)], *[F.log(1 - r).alias(f"a{i}") for i, r in enumerate(rate)], spread.alias("spread")).orderBy(F.desc("spread"), "term").limit(max_terms).collect()
    k = len(domains)
    base = [float(np.log(p)) + sum(r[f"a{i}"] for r in top) for i, p in enumerate(prior)]
    return {"domains": domains, "prior": prior, "base": base, "weights": {r["term"]: [r[f"w{i}"] - r[f"a{i}"] for i in range(k)] for r in top}}


def posteriors(docs: DataFrame, model: dict) -> DataFrame:
    """The documents with n_tokens and p (array<double>, in the order of the model's domains)."""
    k, weights = len(model["domains"]), model["weights"]
    doubles = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    out = with_terms(docs)
    if weights:
        vocab = F.array(*[F.lit(t) for t in weights])
        table = F.map_from_arrays(vocab, F.array(*[doubles(w) for w in weights.values()]))
        logs = F.aggregate(F.array_intersect("terms", vocab), doubles(model["base"]), lambda a, t: F.zip_with(a, F.element_at(table, t), lambda x, y: x + y))
    else:
        logs = doubles(np.log(model["prior"]))
    out = out.withColumn("__l", F.when(F.col("n_tokens") > 0, logs).otherwise(doubles(np.log(model["prior"])))).drop("terms")
    out = out.withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))))
    norm = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("p", F.transform("__e", lambda x: x / norm)).drop("__l", "__e") if k else out


def rate_of(steps: list[np.ndarray], most_rate: float = float("inf")) -> Column:
    """r after the given steps, from the column p.

    Written out step by step: inside a higher-order function the optimizer would compute p again at every step.
    """
    r = F.lit(1.0)
    for g in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col("p")[i] * float(x) for i, x in enumerate(g)), F.lit(0.0)))
        if most_rate < float("inf"):
            r = F.least(F.lit(float(most_rate)), r)
    return r


def fit_rates(rows: DataFrame, targets: np.ndarray, most: int = 25, tolerance: float = 1e-6, most_rate: float = float("inf")) -> tuple[list[np.ndarray], np.ndarray]:
    """The gradient steps that give the rates, and the totals they reach.  rows: n_tokens, p."""
    k = len(targets)
    p = lambda i: F.col("p")[i]

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = rows.select("p", F.col("n_tokens").cast("double").alias("n"), rate_of(steps, most_rate).alias("r"))
        # at the start every rate is free, also where it begins at the bound
        live = F.when((F.col("r") > 0) & ((F.col("r") < most_rate) if steps else F.lit(True)), F.col("n")).otherwise(0.0)
        got = at.agg(*[F.sum(F.col("n") * F.col("r") * p(i)).alias(f"s{i}") for i in range(k)], *[F.sum(live * p(i) * p(j)).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        m = np.array([[got[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        return np.array([got[f"s{i}"] or 0.0 for i in range(k)]), m

    steps: list[np.ndarray] = []
    s, m = totals(steps)
    gap = lambda s: float(np.linalg.norm(s - targets) / max(1.0, float(targets.sum())))
    # with this step the plain gradient never overshoots
    short = 1 / max(1e-300, float(np.linalg.eigvalsh(m)[-1]))
    scale = 1.0
    for _ in range(most):
        if gap(s) <= tolerance or not m.any():
            break
        g = scale * np.linalg.lstsq(m, s - targets, rcond=1e-9)[0] if scale > 0.2 else short * (s - targets)
        s2, m2 = totals([*steps, g])
        if gap(s2) < gap(s):
            steps, s, m = [*steps, g], s2, m2
            scale = 1.0 if scale > 0.2 else scale
        elif scale <= 0.2:
            break
        else:
            scale /= 2
    return steps, s


def solve(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], once: bool = False, **options) -> tuple[dict, DataFrame, list[np.ndarray]]:
    """The classifier, the written table doc_id, n_tokens, p, and the steps of the rates.

    weights: share of the tokens wanted of each domain.  The total stays, or with `once` it falls to what the scarcest domain
    allows without repeating a document, and no rate exceeds 1.
    """
    domains = sorted(weights)
    model = fit_classifier(docs, labels, domain, domains, **options)
    rows = stored(posteriors(docs.select("doc_id", "text"), model).select("doc_id", "n_tokens", "p"), "mixing-posteriors")
    share = np.array([weights[d] for d in domains], dtype=float)
    share = share / share.sum()
    have = np.array([v or 0.0 for v in rows.agg(*[F.sum(F.col("n_tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(len(domains))]).first()])
    total = float(np.min(have[share > 0] / share[share > 0])) if once else float(have.sum())
    steps, _ = fit_rates(rows, share * total, most_rate=1.0 if once else float("inf"))
    return model, rows, steps


def mixed(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], **options) -> DataFrame:
    """doc_id, n_tokens, p, rate of every document."""
    _, rows, steps = solve(docs, labels, domain, weights, **options)
    return rows.withColumn("rate", rate_of(steps))


def copies_of(rate: Column, key: Column) -> Column:
    """How often a document is taken: the rate rounded up or down by a draw from its key, so the mean is the rate."""
    u = F.pmod(F.xxhash64(F.lit("mixing"), key), F.lit(1 << 30)) / float(1 << 30)
    # rates of 1 reach it up to rounding
    return F.floor(rate + u + 1e-9).cast("int")


def resample(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], once: bool = False, **options) -> DataFrame:
    """The documents, each as often as its rate says, with their columns; with `once` none is repeated.

    The posteriors are computed again beside the text, so no text is shuffled.
    """
    model, _, steps = solve(docs, labels, domain, weights, once, **options)
    # the row travels in a struct, so that none of its columns can clash with the model's
    again = posteriors(docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", "text"), model)
    # rows without an id are drawn by their text
    copies = copies_of(F.col("__rate"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    taken = again.withColumn("__rate", rate_of(steps, 1.0 if once else float("inf"))).withColumn("__copies", copies)
    # an outer explode: a filter on the copies would be pushed below the model and have it computed over and over
    each = taken.select("__doc", F.explode_outer(F.when(F.col("__copies") > 0, F.sequence(F.lit(1), F.col("__copies")))).alias("__k"))
    return each.where("__k is not null").select("__doc.*")
