"""Periodic runs of words: suffix automata with merged end positions.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and a length of at least max(least, times * q) that no
neighbouring word extends.

Where runs can be.  Words q apart in a run of length n are equal over n - q words, which is at least `least - least / times` for any q.  So all words of a run lie
in stretches of that many words that the text has twice.  Stretches are hashed, and only words in a hash that occurs twice go on; equal hashes
of different stretches only let more words go on.  Most texts end here.

Squares.  A suffix automaton of such words has a state for each set of end positions that their substrings have.  From the longest states to the
shortest, each state's ordered set of end positions is merged into that of its link, the smaller into the larger.  An end position that is put between two
others gives two new neighbour distances; a distance d that isn't more than the state's length means that the last d words stand there twice in a
row, with smallest period d: if d were not the smallest, there would be an end position in between.  Each run has such a square: the words
of a run but its last q occur q apart.  A square is extended to both sides as long as words d apart are equal, in stretches of doubling length, unless it
lies in a run of period d that is known.

Edge cases.  Null and empty texts, and texts of blanks, have no words and no runs.  Rows are texts of their own, whatever their ids, repeated rows too.  A text may have any
length; memory is some hundred bytes for each word that goes on.  An empty table gives an empty result.  Other columns are kept; a column named
like one of the results is replaced.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices


class Ordered:
    """An ordered set of numbers in short lists, so that putting one in costs the same in large sets."""

    def __init__(self, first: int, most: int = 512):
        self.lists, self.heads, self.most, self.size = [[first]], [first], most, 1

    def __len__(self) -> int:
        return self.size

    def put(self, x: int) -> tuple[int | None, int | None]:
        """Put x in; the neighbours that it has now."""
        k = max(0, bisect_right(self.heads, x) - 1)
        part = self.lists[k]
        i = bisect_left(part, x)
        before = part[i - 1] if i else self.lists[k - 1][-1] if k else None
        after = part[i] if i < len(part) else self.heads[k + 1] if k + 1 < len(self.heads) else None
        part.insert(i, x)
        self.size += 1
        self.heads[k] = part[0]
        if len(part) > self.most:
            half = len(part) // 2
            self.lists[k : k + 1] = [part[:half], part[half:]]
            self.heads.insert(k + 1, part[half])
        return before, after

    def __iter__(self):
        for part in self.lists:
            yield from part


class Automaton:
    """The suffix automaton of a sequence of numbers; ends[s] is the end position of a state that a prefix made, -1 of a copy."""

    def __init__(self, codes: list[int]):
        self.length, self.link, self.ends = array("q", [0]), array("q", [-1]), array("q", [-1])
        # most states have one transition: its code and state; the others are in a dictionary
        self.code, self.to, self.more = array("q", [-1]), array("q", [-1]), {}
        last = 0
        for k, c in enumerate(codes):
            last = self._add(last, k, c)

    def _state(self, length: int, end: int) -> int:
        for column, x in ((self.length, length), (self.link, 0), (self.ends, end), (self.code, -1), (self.to, -1)):
            column.append(x)
        return len(self.length) - 1

    def _next(self, s: int, c: int) -> int:
        if self.code[s] == c:
            return self.to[s]
        more = self.more.get(s)
        return more.get(c, -1) if more else -1

    def _lead(self, s: int, c: int, t: int) -> None:
        if self.code[s] in (c, -1):
            self.code[s], self.to[s] = c, t
        else:
            self.more.setdefault(s, {})[c] = t

    def _add(self, last: int, end: int, c: int) -> int:
        new, p = self._state(self.length[last] + 1, end), last
        while p >= 0 and (q := self._next(p, c)) < 0:
            self._lead(p, c, new)
            p = self.link[p]
        if p < 0:
            return new
        if self.length[q] > self.length[p] + 1:
            # a copy of q takes the shorter substrings
            copy = self._state(self.length[p] + 1, -1)
            self.code[copy], self.to[copy], self.link[copy] = self.code[q], self.to[q], self.link[q]
            if q in self.more:
                self.more[copy] = dict(self.more[q])
            self.link[q] = copy
            while p >= 0 and self._next(p, c) == q:
                self._lead(p, c, copy)
                p = self.link[p]
            q = copy
        self.link[new] = q
        return new

    def squares(self):
        """end, d: the 2 * d words up to a position are a word sequence twice; each where the two ends become neighbours."""
        sets: dict[int, Ordered] = {}
        # by state: the distance to the neighbour before, of ends that have got a new one there
        fresh: dict[int, dict[int, int]] = {}
        for s in np.argsort(-np.frombuffer(self.length, dtype=np.int64), kind="stable").tolist():
            if s == 0:
                break
            length = self.length[s]
            if self.ends[s] >= 0:
                _merge(sets, fresh, s, Ordered(self.ends[s]))
            for end, d in fresh.pop(s, {}).items():
                if d <= length:
                    yield end, d
            own = sets.pop(s)
            if self.link[s] > 0:
                _merge(sets, fresh, self.link[s], own)


def _merge(sets: dict[int, Ordered], fresh: dict[int, dict[int, int]], s: int, b: Ordered) -> None:
    """Put a set into that of state s, the smaller into the larger."""
    a = sets.get(s)
    if a is None:
        sets[s] = b
        return
    if len(a) < len(b):
        a, b = b, a
    told = fresh.setdefault(s, {})
    for x in b:
        before, after = a.put(x)
        if before is None:
            told.pop(x, None)
        else:
            told[x] = x - before
        if after is not None:
            told[after] = after - x
    sets[s] = a


def _reach(equal, most: int) -> int:
    """How many of the next `most` places are equal up to the first that isn't; equal(a, b) tells for places a to b."""
    done, step = 0, 64
    while done < most:
        here = equal(done, min(most, done + step))
        if not here.all():
            return done + int(np.argmin(here))
        done, step = min(most, done + step), step * 2
    return most


def runs_of(codes: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """start, length, period of the runs of a sequence of numbers (equal words have equal numbers), by start and period."""
    out, known = [], {}
    stretch = least - least // times
    hashes = _hashed(codes, stretch)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return []
    twice = np.zeros(len(hashes) + 1, dtype=np.int64)
    twice[order[1:][same]] = twice[order[:-1][same]] = 1
    cover = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + stretch, -1)
    inside = np.cumsum(cover)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    for lo, hi in edge.reshape(-1, 2).tolist():
        if hi - lo < least:
            continue
        part = codes[lo:hi]
        for end, d in Automaton(np.unique(part, return_inverse=True)[1].tolist()).squares():
            end += lo
            # runs of one period overlap by less than the period
            have = known.setdefault(d, [])
            at = bisect_right(have, (end - 2 * d + 1, len(codes))) - 1
            if at >= 0 and have[at][1] > end:
                continue
            right = _reach(lambda a, b, e=end, d=d: codes[e + 1 + a : e + 1 + b] == codes[e + 1 - d + a : e + 1 - d + b], len(codes) - 1 - end)
            first = end - 2 * d
            left = _reach(lambda a, b, s=first, d=d: (codes[s - b + 1 : s - a + 1] == codes[s - b + 1 + d : s - a + 1 + d])[::-1], first + 1)
            start, stop = first + 1 - left, end + 1 + right
            insort(have, (start, stop))
            if stop - start >= max(least, times * d):
                out.append((start, stop - start, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each stretch of n codes."""
    base, count = 0x9E3779B97F4A7C15, max(0, len(codes) - n + 1)
    # `part` has stretches of a power of two, `out` those of the lower digits of n
    part, out, size, done = codes.astype(np.uint64) + np.uint64(1), np.zeros(count, dtype=np.uint64), 1, 0
    while count and done < n:
        power = np.uint64(pow(base, size, 1 << 64))
        if n & size:
            out = out * power + part[done : done + count]
            done += size
        part, size = part[:-size] * power + part[size:], size * 2
    return out


def collapsed_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in found:
        cover[start + q] += 1
        cover[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def collapse(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """The rows with n_words, runs (start, length, period of each, by start and period) and collapsed: the words that are left when every run is cut to its first
    period, joined by one blank.  Words are separated by blank and the control characters 9 to 13."""

    def run(batches):
        for b in slices(batches):
            names, sizes, all_runs, texts = b.schema.names, [], [], []
            for text in b.column("text").to_pylist():
                words = (text or "").encode().split()
                book: dict[bytes, int] = {}
                codes = np.fromiter((book.setdefault(w, len(book)) for w in words), dtype=np.int64, count=len(words))
                found = runs_of(codes, least, times) if len(words) >= least else []
                sizes.append(len(words))
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(collapsed_words(words, found)).decode())
            new = {"n_words": pa.array(sizes, pa.int64()), "runs": pa.array(all_runs, pa.list_(RUN)), "collapsed": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names if c not in new), *new.values()], [*(c for c in names if c not in new), *new])

    keep = [f for f in docs.schema.fields if f.name not in ("n_words", "runs", "collapsed")]
    rows = docs.select(*(F.col(f"`{f.name}`").cast("string").alias("text") if f.name == "text" else F.col(f"`{f.name}`") for f in keep))
    kinds = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(run, kinds)


def rolled(docs: DataFrame, share: int = 10, fewest: int = 3, spread: int = 8) -> DataFrame:
    """Documents with periods put in, to measure what is found: where the checksum h of doc_id is a multiple of `share`, the words from the a-th on repeat the p words there,
    with g = h // share, a = g % n and p = 1 + (n - a) // (fewest + g % spread).  Their words are joined by one blank; other texts stay."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    picked = (h % share == 0).alias("__picked")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.when(F.col("__picked"), F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")).alias("__w")
    kept = [f"`{c}`" for c in docs.columns]
    rows = docs.select(*kept, picked, F.floor(h / share).alias("__g")).select(*kept, "__picked", "__g", words)
    rows = rows.withColumn("__n", F.coalesce(F.size("__w"), F.lit(0)).cast("long"))
    rows = rows.withColumn("__picked", F.col("__picked") & (F.col("__n") > 0)).withColumn("__a", F.when(F.col("__picked"), F.col("__g") % F.col("__n")))
    left = F.col("__n") - F.col("__a")
    rows = rows.withColumn("__p", (1 + F.floor(left / (fewest + F.col("__g") % spread))).cast("int")).withColumn("__a", F.col("__a").cast("int"))
    again = F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")), F.ceil(left / F.col("__p")).cast("int")))
    new = F.concat_ws(" ", F.slice("__w", F.lit(1), F.col("__a")), F.slice(again, F.lit(1), left.cast("int")))
    return rows.withColumn("text", F.when(F.col("__picked"), new).otherwise(F.col("text"))).select(*kept)


def best_run(runs):
    """The run of greatest length by period; ties: smallest start, then period.  A column of struct(start, length, period), null if there is none."""
    # by start and period already, so that only a greater exponent replaces what is held
    longer = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, x: F.when(longer(a, x), x).otherwise(a))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the best run), runs_sha256, collapsed_sha256, n_words, from what `collapse` returns."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    rows = found.withColumn("best", best_run(F.col("runs")))
    milli = F.expr("best.length * 1000 div best.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
