"""Periodic runs against the definition, what collapses, and edge cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from genospark.llm import periodic
from genospark.llm.queries import QUERIES


def by_definition(c, least=24, times=3):
    n, out = len(c), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and c[j] == c[j + q]:
                j += 1
            start, size = i, j - i + q
            if j > i and size >= max(least, times * q):
                w = c[start : start + size]
                if not any(w[: size - r] == w[r:] for r in range(1, q)):
                    out.append((start, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest_by_hand(doc_id, text, plant=True):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = by_definition(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("least, times", [(24, 3), (4, 2), (7, 3), (6, 2), (12, 4)])
def test_runs_brute_force(least, times):
    r = random.Random(least * 10 + times)
    some = 0
    for _ in range(150):
        c = []
        while len(c) < r.choice([30, 60, 150]):
            c += [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.choice([1, 2, 3, 5, 9, 14]))] * r.randint(1, 7)
        want = by_definition(c, least, times)
        some += len(want)
        assert periodic.runs_of(np.array(c), least, times) == want
    assert some > 50


def test_ordered():
    r = random.Random(1)
    xs = r.sample(range(10_000), 3000)
    s, seen = periodic.Ordered(xs[0], most=8), [xs[0]]
    for x in xs[1:]:
        before, after = s.put(x)
        assert before == max((y for y in seen if y < x), default=None) and after == min((y for y in seen if y > x), default=None)
        seen.append(x)
    assert list(s) == sorted(xs) and len(s) == len(xs)


@pytest.mark.parametrize("codes", [np.zeros(30_000, dtype=np.int64), np.tile(np.arange(7), 5000), np.tile(np.arange(9000), 4)])
def test_long_runs(codes):
    (run,) = periodic.runs_of(codes)
    assert run == (0, len(codes), len(np.unique(codes)))


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_periodic_runs"](spark, sf).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(digest_by_hand(r["doc_id"], r["text"]) for r in rows)
    assert sum(r["n_runs"] > 0 for r in got) >= 10


def test_odd(spark):
    texts = [None, "", " \n\t ", "one", "a " * 24, "a " * 23, "x y z " * 8 + "x y", "a b " * 12 + "a c " * 12 + "d", "\x0bnaïve\x0c東京 " * 30, "w" * 5000, "p q " * 30]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(4, "a " * 24, "clash", 1), (None, "b " * 40, "clash", 1)], "doc_id long, text string, runs string, p int")
    found = periodic.collapse(docs)
    got = periodic.digest(found).drop("n_words").collect()
    want = [digest_by_hand(i, t, plant=False) for i, t in enumerate(texts)] + [digest_by_hand(4, "a " * 24, plant=False), digest_by_hand(None, "b " * 40, plant=False)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = {r["doc_id"]: r for r in found.collect()}
    assert kept[4]["collapsed"] == "a" and kept[6]["collapsed"] == "x y z" and kept[5]["runs"] == [] and kept[6]["p"] == 1
    assert periodic.collapse(docs.limit(0)).count() == 0
    planted = periodic.digest(periodic.collapse(periodic.rolled(docs.select("doc_id", "text")))).drop("n_words").collect()
    assert sorted(map(tuple, planted), key=str) == sorted([digest_by_hand(i, t) for i, t in enumerate(texts)] + [digest_by_hand(4, "a " * 24), digest_by_hand(None, "b " * 40)], key=str)


def test_best_run(spark):
    rows = spark.createDataFrame([([(5, 30, 10), (2, 27, 9), (40, 28, 7)],), ([(5, 30, 10), (9, 60, 20)],), ([],)], "runs array<struct<start: long, length: long, period: long>>")
    got = [r["b"] for r in rows.select(periodic.best_run(F.col("runs")).alias("b")).collect()]
    assert [g and g["start"] for g in got] == [40, 5, None]
