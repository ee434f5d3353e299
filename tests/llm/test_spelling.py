"""Spelling variants against every pair of words, units that have to be cut, and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from genospark.llm import spelling
from genospark.llm.queries import ORACLES, QUERIES
from genospark.llm.spelling import Index, one_edit

DOCS = "doc_id long, text string, lang string, word string, n string"


def near(x, y):
    """One insertion, deletion or replacement, by the table of edit distances."""
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1] == 1


def by_hand(counts, times=5):
    out = {}
    for w, n in counts.items():
        found = [v for v in counts if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        out[w] = (n, len(found), best if best and counts[best] >= times * n else None)
    roots = {}
    for w in out:
        r = w
        while out[r][2]:
            r = out[r][2]
        roots[w] = r
    return {(w, n, k, f, f and counts[f], roots[w]) for w, (n, k, f) in out.items()}


def words_of(rows, slip=None):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("seed", range(6))
def test_index_brute_force(seed):
    r = random.Random(seed)
    some = {"".join(r.choices("abé"[: 2 + seed % 2], k=r.randint(4, 9))) for _ in range(250)}
    some = sorted(some | {w[:k] + w[k + 1 :] for w in list(some)[:40] if len(w) > 4 for k in (0, 2, len(w) - 1)})
    index = Index(some)
    got = {(some[i], some[j]) for i in range(len(some)) for j in index.near(i)}
    assert got == {(x, y) for i, x in enumerate(some) for y in some[i + 1 :] if near(x, y)}
    assert all(one_edit(x, y) == near(x, y) for x in some[:60] for y in some)


@pytest.mark.parametrize("unit", [20_000, 40, 3])
def test_variants_brute_force(spark, unit):
    """Units of any size give the same: words that share a long front, back or middle are cut until they fit."""
    r = random.Random(7)
    some = {"".join(r.choices("ab", k=r.randint(6, 8))) for _ in range(120)}
    some |= {"commonfront" + "".join(r.choices("xyz", k=r.randint(2, 4))) for _ in range(60)}
    some |= {"".join(r.choices("xyz", k=r.randint(2, 4))) + "commonback" for _ in range(60)}
    some |= {"k" * k for k in range(4, 30)}
    counts = {w: r.choice([5, 6, 25, 30, 130, 700, 4000]) for w in some}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), unit=unit).collect()
    assert {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == by_hand(counts)
    assert len(got) == len(counts)


def test_query(spark, sf):
    """The registered query over a whole table."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_spelling_variants"](spark, sf).collect()
    assert {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == by_hand(words_of(rows, 199))


def test_odd(spark):
    long = "".join(random.Random(3).choices("abcdefgh", k=30_000))
    texts = [None, "", " \n", "Words WORDS wordsx Wordsy", "naïve ÀÉ×÷ ümlaut Ümlaut", f"{long} {long}x", "letteŕed 123 \x00"]
    rows = [(i if i != 3 else None, t, "en", "clash", "clash") for i, t in enumerate(texts * 6)]
    docs = spark.createDataFrame(rows, DOCS)
    got = spelling.variants(spelling.vocabulary(docs, slip=7)).collect()
    want = words_of([r[:2] for r in rows], 7)
    assert {r["word"]: r["n"] for r in got} == want
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0
    whole = {r["word"]: r for r in spelling.variants(spelling.vocabulary(docs)).collect()}
    assert whole[long]["n_near"] == 1 and whole["wordsx"]["n_near"] == 1 and whole["wordsx"]["form"] is None
    assert "ümlaut" in whole and "Ümlaut" in whole and whole["ümlaut"]["n_near"] == 1


def test_forms_are_followed(spark):
    """Chains of forms end at the last; ties of counts go by code points."""
    counts = {"abcdef": 5, "abcdeg": 30, "abcdhg": 200, "abcihg": 1100, "abcdez": 30}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got["abcdef"]["form"] == "abcdeg" and got["abcdef"]["root"] == "abcihg" and math.isclose(got["abcdef"]["form_n"], 30)
    assert got["abcdez"]["form"] is None and got["abcdez"]["n_near"] == 2


def test_oracle(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    if "op11_spelling_variants" not in ORACLES:
        pytest.skip("no SQL")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    cur = con.execute(ORACLES["op11_spelling_variants"])
    names = [d[0] for d in cur.description]
    theirs = sorted(cur.fetchall(), key=str)
    ours = sorted((tuple(r) for r in QUERIES["op11_spelling_variants"](spark, sf).select(*names).collect()), key=str)
    assert ours == theirs
