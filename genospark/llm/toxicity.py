"""Toxic passages as maximum-scoring segments of token log-odds.

Fit.  Document frequencies of terms (words, and stems of 4 and 5 letters) in toxic and clean labelled
documents give log-odds under a Dirichlet prior (a flat part plus a part that follows the pooled
frequencies).  Terms whose log-odds stand `z_min` standard deviations above zero form the lexicon; a word
scores the log-odds of its best term less `shrink` standard deviations (terms under `least` are left out), a
word without a term scores the
log-odds of "not in the lexicon", which is slightly negative.

Scan.  The linear-time all-maximal-segments algorithm of Ruzzo and Tompa, run over the lexicon
hits with the gaps between them summed up, finds every maximal segment.

Calibration.  A segment of score S in a text of n words has the expected number of chance
occurrences E = K n exp(-lambda S) (Karlin and Altschul); lambda solves sum p exp(lambda s) = 1 over the
clean background and K is fitted on clean labelled texts.  A document's evidence is the sum of
-ln E over its segments with E < e_max; a logistic curve fitted on the labelled sample maps it to 0..1.
lambda, K and the curve are fitted crosswise: each half of the sample is scored by the lexicon of the other.

Edge cases.  Null and empty texts have no evidence and get the lowest score.  Labels that are null
are left out; a doc_id labelled twice counts as toxic if any label says so.  Without labelled toxic
texts the lexicon is empty and every score is the prior.  Repeated rows are scored each on its own.
Columns of `docs` other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, slices, stored

LETTERS = re.compile(r"[^\W\d_]+")


class Lexicon(dict):
    """Best score of a word's terms, or None; words looked up once are remembered, up to `most` of them."""

    def __init__(self, terms: dict[str, float], most: int = 300_000):
        super().__init__()
        self.terms, self.most = terms, most

    def __missing__(self, word: str) -> float | None:
        if len(self) >= self.most:
            self.clear()
        found = [s for t in terms_of(word) if (s := self.terms.get(t)) is not None]
        self[word] = best = max(found, default=None)
        return best

    def __reduce__(self):
        return Lexicon, (self.terms, self.most)


def terms_of(word: str) -> tuple[str, ...]:
    """The word itself and its stems of 4 and 5 letters, if it is longer."""
    return (word, word[:5] + "*", word[:4] + "*") if len(word) > 5 else (word, word[:4] + "*") if len(word) == 5 else (word,)


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon = field(default_factory=lambda: Lexicon({}))
    other: float = -0.01
    lam: float = 1.0
    k: float = 0.1
    e_max: float = 1.0
    bias: float = 0.0
    slope: float = 0.0


def segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first word, last word, score) of a text, in linear time.

    hits: (position, positive score) in order; every other position scores `other` < 0.
    """
    # each entry: start, end, total before it, total after it, the last earlier entry with a lower total before it (-1: none)
    done: list[tuple[int, int, float]] = []
    found: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for at, score in hits:
        total += other * (at - last - 1)
        last, start, before, j = at, at, total, len(found) - 1
        total += score
        while True:
            # entries between an entry and the one it points to have no lower total before them
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            start, before, back = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = back
        if j < 0:
            # no earlier entry can grow any more
            done += [(s, e, after - low) for s, e, low, after, _ in found]
            found.clear()
        found.append((start, at, before, total, j))
    return done + [(s, e, after - low) for s, e, low, after, _ in found]


def evidence(text: str | None, m: ToxicityModel) -> tuple[float, int, float]:
    """Summed -ln E over significant segments, their number, the best segment's score."""
    tokens = LETTERS.findall(text.lower()) if text else []
    hits = [(i, s) for i, s in enumerate(map(m.lexicon.__getitem__, tokens)) if s is not None]
    if not hits:
        return 0.0, 0, 0.0
    found = segments(hits, m.other)
    base = math.log(m.k * len(tokens))
    logs = [m.lam * s - base for _, _, s in found]
    good = [x for x in logs if x > -math.log(m.e_max)]
    return sum(good), len(good), max(s for _, _, s in found)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """text, toxic of at most max_labelled labelled rows (those of smallest hash).

    The ids are bounded by max_labelled, which is why they may be broadcast.
    """
    ids = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    # equal texts fall into the same half
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))


NAMES = ["tox0", "clean0", "tox1", "clean1"]


def term_counts(sample: DataFrame, flush: int = 200_000) -> DataFrame:
    """term and, for either half, the toxic and clean documents with it; the empty term counts documents."""

    def count(batches):
        counts = defaultdict(Counter)
        for b in slices(batches):
            for text, y, half in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("half").to_pylist(), strict=True):
                into = counts[2 * half + (y != 1)]
                into.update({t for w in set(LETTERS.findall(text.lower())) for t in terms_of(w)} if text else ())
                into[""] += 1
            if sum(map(len, counts.values())) > flush:
                yield rows(counts)
                counts.clear()
        yield rows(counts)

    def rows(counts):
        keys = list(set().union(*counts.values()))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[i][k] for k in keys], pa.int64()) for i in range(4))], ["term", *NAMES])

    parts = sample.mapInArrow(count, "term string, " + ", ".join(f"{n} long" for n in NAMES))
    return parts.groupBy("term").agg(*(F.sum(n).alias(n) for n in NAMES))


def _terms(counts: DataFrame, t, c, n_tox: int, n_clean: int, max_terms: int, flat: float, pooled: float, z_min: float, shrink: float, least: float) -> dict[str, float]:
    """The lexicon's terms from counts t and c: at most max_terms, the most significant ones."""
    prior = F.lit(flat) + F.lit(pooled) * (t + c) / F.lit(float(n_tox + n_clean))
    odds = lambda x, n: F.log((x + prior) / (F.lit(n + 2 * flat + pooled) - x))
    scored = (
        counts.where((F.col("term") != "") & (t > 0)).withColumn("odds", odds(t, n_tox) - odds(c, n_clean))
        .withColumn("sd", F.sqrt(1 / (t + prior) + 1 / (c + prior)))
        .where((F.col("odds") >= z_min * F.col("sd")) & (F.col("odds") >= least + shrink * F.col("sd")))
    )
    top = scored.orderBy(F.desc(F.col("odds") / F.col("sd")), "term").limit(max_terms).collect()
    return {r["term"]: r["odds"] - shrink * r["sd"] for r in top}


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 30_000, max_terms: int = 20_000, flat: float = 0.5, pooled: float = 1.0, z_min: float = 2.5, shrink: float = 1.5, least: float = 1.8, e_max: float = 1.0) -> ToxicityModel:
    """Learn from a bounded labelled sample (max_labelled rows); the lexicon keeps the max_terms most significant terms."""
    sample = stored(labelled_sample(docs, labels, max_labelled), "toxic-sample")
    counts = stored(term_counts(sample), "toxic-terms")
    whole = (counts.where("term = ''").collect() or [dict.fromkeys(NAMES, 0)])[0]
    n_tox, n_clean = whole["tox0"] + whole["tox1"], whole["clean0"] + whole["clean1"]
    prior = ToxicityModel(bias=math.log((n_tox + 0.5) / (n_clean + 0.5)))
    if not n_tox or not n_clean:
        return prior
    how = (max_terms, flat, pooled, z_min, shrink, least)
    terms = _terms(counts, F.col("tox0") + F.col("tox1"), F.col("clean0") + F.col("clean1"), n_tox, n_clean, *how)
    if not terms:
        return prior
    halves = [Lexicon(_terms(counts, F.col(f"tox{h}"), F.col(f"clean{h}"), whole[f"tox{h}"], whole[f"clean{h}"], *how)) for h in (0, 1)]

    def hits_of(text: str | None, half: int) -> tuple[list[tuple[int, float]], int]:
        tokens = LETTERS.findall(text.lower()) if text else []
        return [(i, x) for i, x in enumerate(map(halves[1 - half].__getitem__, tokens)) if x is not None], len(tokens)

    def each(batches):
        for b in slices(batches):
            yield from zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("half").to_pylist(), strict=True)

    def tally(batches):
        # how many hits of each score, and (without a score) how many words
        count = Counter()
        for text, y, half in each(batches):
            hits, n = hits_of(text, half)
            count.update((int(y == 1), x) for _, x in hits)
            count[int(y == 1), None] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.int32()), pa.array([k[1] for k in count], pa.float64()), pa.array(list(count.values()), pa.int64())], ["y", "s", "n"])

    # at most two rows a term
    tallied = sample.mapInArrow(tally, "y int, s double, n long").groupBy("y", "s").agg(F.sum("n").alias("n")).collect()
    clean_words, tox_words = (sum(r["n"] for r in tallied if r["y"] == v and r["s"] is None) for v in (0, 1))
    clean_hits = np.array([(r["s"], r["n"]) for r in tallied if r["y"] == 0 and r["s"] is not None]).reshape(-1, 2)
    tox_hits = sum(r["n"] for r in tallied if r["y"] == 1 and r["s"] is not None)
    rate_tox, rate_clean = (tox_hits + 0.5) / (tox_words + 1), (clean_hits[:, 1].sum() + 0.5) / (clean_words + 1)
    scores, weights = clean_hits.T if len(clean_hits) else (np.array(list(terms.values())), np.ones(len(terms)))
    # at least twice what clean hits bring, so that clean text drifts downwards
    other = min(-1e-3, math.log((1 - min(rate_tox, 0.5)) / (1 - min(rate_clean, 0.49))), -2 * rate_clean * float(np.average(scores, weights=weights)) / (1 - min(rate_clean, 0.5)))
    lam = _lambda(scores, weights, rate_clean, other)

    def numbers(f):
        """y and a number of each text: at most max_labelled rows."""

        def run(batches):
            got = [(int(y == 1), f([x for _, _, x in segments(hits, other)], n)) for text, y, half in each(batches) for hits, n in [hits_of(text, half)]]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.float64())], ["y", "x"])

        return sample.mapInArrow(run, "y int, x double").collect()

    # K from the share of clean texts whose best segment passes a high level
    best = np.array([r["x"] for r in numbers(lambda found, n: max(found, default=0.0)) if r["y"] == 0])
    level = max(float(np.quantile(best, 0.95)), 1.0)
    k = min(10.0, max(1e-6, (1 + float((best >= level).sum())) / (max(1, clean_words) * math.exp(-lam * level))))
    rows = numbers(lambda found, n: sum(v for x in found if (v := lam * x - math.log(k * max(1, n))) > -math.log(e_max)))
    # sorted, so that the curve doesn't depend on the order of tasks
    x, y = np.array(sorted((r["x"], float(r["y"])) for r in rows)).T
    bias, slope = _logistic(np.log1p(x), y)
    return ToxicityModel(Lexicon(terms), other, lam, k, e_max, bias, slope)


def _lambda(scores: np.ndarray, weights: np.ndarray, p_hit: float, other: float) -> float:
    """The positive root of (1-p) exp(l other) + p mean(exp(l s)) = 1, by bisection."""
    f = lambda v: (1 - p_hit) * math.exp(v * other) + p_hit * float(np.average(np.exp(np.minimum(v * scores, 600)), weights=weights)) - 1
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return min(max(hi, 0.05), 5.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[float, float]:
    """Newton's method for a one-variable logistic curve with a small ridge on the slope."""
    a = np.column_stack([np.ones_like(x), x])
    w = np.zeros(2)
    pen = np.diag([1e-6, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pen, a.T @ (y - p) - pen @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, n_segments, best_segment, evidence for every row, over whole texts."""

    def run(batches):
        for b in slices(batches):
            got = [evidence(t, model) for t in b.column("text").to_pylist()]
            x = np.array([g[0] for g in got])
            s = 1 / (1 + np.exp(-np.clip(model.bias + model.slope * np.log1p(x), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.float64()), pa.array(x)], ["doc_id", "score", "n_segments", "best_segment", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_segments int, best_segment double, evidence double")


def keep(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold, with all their columns."""

    def run(batches):
        for b in slices(batches):
            x = np.array([evidence(t, model)[0] for t in b.column("text").to_pylist()])
            s = 1 / (1 + np.exp(-np.clip(model.bias + model.slope * np.log1p(x), -30, 30)))
            yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, char_start, char_end, segment_score, e_value, passage: every significant segment."""

    def run(batches):
        for b in slices(batches):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                low = (text or "").lower()
                spans = [m.span() for m in LETTERS.finditer(low)]
                hits = [(i, s) for i, (x, y) in enumerate(spans) if (s := model.lexicon[low[x:y]]) is not None]
                for x, y, s in segments(hits, model.other) if hits else ():
                    e = model.k * len(spans) * math.exp(-model.lam * s)
                    if e < model.e_max:
                        out.append((doc, spans[x][0], spans[y][1], s, e, low[spans[x][0]:spans[y][1]]))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "char_start", "char_end", "segment_score", "e_value", "passage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, char_start long, char_end long, segment_score double, e_value double, passage string")


def held_out(column):
    """Rows never used for learning: crc32 of the id as text is a multiple of 5."""
    return crc_bucket(column, 5) == 0
