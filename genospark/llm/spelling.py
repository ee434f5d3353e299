"""Spelling variants: words one edit apart, by a positional q-gram inverted index, grouped under their most frequent neighbour.

Words are runs of letters of the texts, counted over all documents; a word takes part from `shortest` letters and `least` occurrences on.

Index.  A q-gram of a word is posted as (length of the word, gram, position) -> numbers of the words that have it there, in order.  A word asks
for its own grams at positions off by at most one, in words whose length is off by at most one.  An edit destroys at most q grams, so that
two words one edit apart share at least max(length) - q + 1 - q of them (the count filter).  A candidate can lack the bound's number of lists less one, so the
longest lists are held back: the others are merged from a heap, and candidates look themselves up in those held back until they
reach the bound or can't.  What passes is verified letter by letter.

Units.  The index is built in units that fit a task.  An edit lies in one half of a word and leaves the other as it is, so words that are near
share a unit named by a half: a word of length l posts both its halves to the units of length l, and to those of length l + 1 as the shorter
partner.  A unit of more than `unit` words is cut again by the halves of what its words don't share, until it fits; a unit of which one letter is
left holds one word a letter, so no unit stays large, whatever the words have in common, and a word is copied a few times a
level.  A pair is reported in the first unit that could have it alone.

Groups.  The form of a word is its near word of largest count (ties: the smallest by code points) if that count is at least `times` its own;
forms are followed to the last by doubling.

Edge cases.  Null and empty texts have no words.  Rows count each, repeated ones too.  Words of equal count are ordered by code points.  A text or word may
have any length.  Empty tables give an empty result.  Columns other than the id and the text are not read; a null id reads as the empty string.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, slices, stored

Q = 2
#: Letters of Latin scripts, after A to Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
PAIRS = "word string, n long, near string, near_n long"


def _counted(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


def slipped(key: str, run: str, every: int) -> str:
    """The run, without one letter if the checksum of its key and itself is a multiple of `every`."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def vocabulary(docs: DataFrame, shortest: int = 6, least: int = 5, slip: int | None = None, held: int = 200_000) -> DataFrame:
    """word, n of the words of all texts; with `slip`, words lose a letter as `slipped` says.  A task holds `held` words before it passes their counts on."""

    def run(batches):
        found: Counter = Counter()
        for b in slices(batches):
            for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                # lower case of bytes is that of A to Z alone
                here = Counter(RUN.findall((text or "").encode().lower().decode()))
                for word, n in here.items():
                    found[slipped(key, word, slip) if slip else word] += n
                if len(found) >= held:
                    yield _counted(found)
                    found.clear()
        yield _counted(found)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(run, "word string, n long").where(F.length("word") >= shortest)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def one_edit(x: str, y: str) -> bool:
    """Whether y is x with exactly one letter inserted, deleted or replaced."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


class Index:
    """Positional q-grams of some words: posting lists in the order of the words."""

    def __init__(self, words: list[str]):
        self.words, self.lengths, self.posted = words, {len(w) for w in words}, defaultdict(list)
        for k, w in enumerate(words):
            for i in range(len(w) - Q + 1):
                self.posted[len(w), w[i : i + Q], i].append(k)

    def near(self, k: int) -> Iterator[int]:
        """The words after the k-th that are one edit from it."""
        w = self.words[k]
        for m in {len(w) - 1, len(w), len(w) + 1} & self.lengths:
            bound = max(m, len(w)) - Q + 1 - Q
            lists = [(i, [p for j in (i - 1, i, i + 1) if (p := self.posted.get((m, w[i : i + Q], j)))]) for i in range(len(w) - Q + 1)]
            # the shortest lists first; a word in none of them can't reach the bound
            lists.sort(key=lambda x: sum(map(len, x[1])))
            cut = max(0, len(lists) - bound + 1)
            streams = [[(x, i) for x in p[bisect_left(p, k + 1) :]] for i, ps in lists[:cut] for p in ps]
            for other, hits in groupby(heapq.merge(*streams), key=lambda x: x[0]):
                got, left = len({i for _, i in hits}), len(lists) - cut
                for _, ps in lists[cut:]:
                    if got >= bound or got + left < bound:
                        break
                    left -= 1
                    got += any((at := bisect_left(p, other)) < len(p) and p[at] == other for p in ps)
                if got >= bound and one_edit(w, self.words[other]):
                    yield other


def _halved(unit: DataFrame) -> DataFrame:
    """The units of the halves of what is left of words: key, path (halves taken), left (letters of the longer words), rest, short (0, 1), word, n."""
    h, size = F.floor(F.col("left") / 2).cast("int"), F.length("rest")
    back = (F.col("left") - h).cast("int")
    front, behind = F.substring("rest", F.lit(1), h), F.substring("rest", h + 1, size)
    tail, ahead = F.substring("rest", size - back + 1, back), F.substring("rest", F.lit(1), size - back)
    both = F.array(
        F.struct(F.concat("key", F.lit("/a"), front).alias("key"), F.concat("path", F.lit("a")).alias("path"), back.alias("left"), behind.alias("rest")),
        F.struct(F.concat("key", F.lit("/b"), tail).alias("key"), F.concat("path", F.lit("b")).alias("path"), h.alias("left"), ahead.alias("rest")),
    )
    return unit.withColumn("u", F.explode(both)).select("u.key", "u.path", "u.left", "u.rest", "short", "word", "n")


def _earlier(x: str, y: str, left: int, path: str) -> bool:
    """Whether a unit before that of the path has the pair: one of a front half that both share, where the path takes the back."""
    for step in path:
        h = left // 2
        if step == "a":
            x, y, left = x[h:], y[h:], left - h
        elif x[:h] == y[:h]:
            return True
        else:
            x, y, left = x[: len(x) - (left - h)], y[: len(y) - (left - h)], h
    return False


def _found(rows: Iterable[tuple[str, str, int, str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Pairs of near words in rows (key, path, short, word, n) that are ordered by key, each pair both ways."""
    for _, unit in groupby(rows, key=lambda r: r[0]):
        # the longer words first, so that shorter ones aren't compared with each other
        unit = sorted(unit, key=lambda r: (r[2], r[3]))
        whole = sum(1 for r in unit if not r[2])
        if len(unit) < 2 or not whole:
            continue
        index, path, left = Index([r[3] for r in unit]), unit[0][1], len(unit[0][3])
        for i in range(whole):
            for j in index.near(i):
                x, y = unit[i], unit[j]
                if not _earlier(x[3], y[3], left, path):
                    yield x[3], x[4], y[3], y[4]
                    yield y[3], y[4], x[3], x[4]


def near_words(words: DataFrame, unit: int = 20_000) -> DataFrame:
    """word, n, near, near_n of all ordered pairs of words (word, n) that are one edit apart.  Words have at least 2 * Q letters, so that the count filter holds."""
    words = words.where(F.length("word") >= 2 * Q)
    # as a longer (or equal) word of its own length, and as the shorter one of the next
    roles = F.explode(F.array(F.lit(0), F.lit(1))).alias("short")
    level = words.select("word", "n", roles).select((F.length("word") + F.col("short")).cast("string").alias("key"), F.lit("").alias("path"), (F.length("word") + F.col("short")).alias("left"), F.col("word").alias("rest"), "short", "word", "n")
    done = []
    while True:
        level = stored(_halved(level), "spelling-units")
        sizes = level.groupBy("key").agg(F.count("*").alias("members"), F.min("short").alias("least"), F.max("left").alias("open"))
        # alone, or without a longer word: no pairs
        sizes = stored(sizes.where("members > 1 and least = 0").select("key", ((F.col("members") > unit) & (F.col("open") > 1)).alias("crowded")), "spelling-sizes")
        done.append((level, sizes))
        if not sizes.where("crowded").limit(1).count():
            break
        level = level.join(sizes.where("crowded").select("key"), "key").select("key", "path", "left", "rest", "short", "word", "n")

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "path", "short", "word", "n")), strict=True))
        out: list[tuple] = []
        for pair in _found(rows):
            out.append(pair)
            if len(out) >= 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    ready = None
    for level, sizes in done:
        part = level.join(sizes.where("not crowded").select("key"), "key").select("key", "path", "short", "word", "n")
        ready = part if ready is None else ready.unionByName(part)
    pairs = ready.repartition("key").sortWithinPartitions("key").mapInArrow(run, PAIRS)
    return pairs


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n", "near", "near_n"])


def variants(words: DataFrame, times: int = 5, unit: int = 20_000) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word (word, n)."""
    words = stored(words.select("word", "n"), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    told = near_words(words, unit).groupBy("word").agg(F.count("*").alias("n_near"), best)
    named = words.join(told, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.less")).alias("form_n"), F.col("best.near").alias("form"))
    ok = F.col("form_n") >= times * F.col("n")
    named = stored(named.select("word", "n", "n_near", F.when(ok, F.col("form")).alias("form"), F.when(ok, F.col("form_n")).alias("form_n")), "spelling-forms")
    # counts grow by `times` a step, so that chains have at most log(n) steps, followed by doubling
    most = named.where("form is not null").agg(F.max("form_n")).first()[0]
    roots = named.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2, math.log(most, times) + 1))) if most and times > 1 else 0):
        roots = stored(roots, "spelling-roots")
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("top"))
        roots = roots.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"))
    drop(words)
    return named.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
