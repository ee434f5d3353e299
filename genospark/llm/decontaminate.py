"""Benchmark passages in training documents: rare n-gram seeds, then Smith-Waterman alignment.

Seeds.  Every word n-gram of an item is a seed if it is rare: the product of its words' frequencies in
all documents is at most `rare`.  Rarity comes from single words, not from the n-gram's own count, so that
an item leaked thousands of times keeps its seeds.  Pairs of words up to `gaps` apart in the item are seeds too if their product is at most `rare_pair`; a text has such
a pair where the two words follow each other in that order up to `gaps` apart, so that copies are found in which no n-gram is left
whole.  An item with fewer than `least` rare n-grams or pairs takes all of that kind.  Windows of a document around seed hits are
aligned with the items.

Alignment.  Local alignment of the item's words with each window (match 2, mismatch -1, gap -1);
the score is divided by that of a perfect match, so 1 is an exact copy, and edited or paraphrased copies
lie between.  Passages that reach `threshold` are matches; what a window has on both sides of one is aligned again, until
nothing there reaches the threshold.  Windows that meet are one, and are aligned in strips: a passage that may go on behind a strip is left to the
next, so that none is reported twice.

Short items, of fewer than `min_words` words, are too short for alignment; they match where all their words follow one another
exactly, with score 1 and no seed hits.

The items go to the executors in blocks of at most `block_items`; more items mean more blocks, each
over all documents.

Edge cases.  Null and empty texts match nothing, nor do items without words.  Items with equal texts are reported each; rows repeated in the
documents are reported each.  Empty tables give an empty result.  Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, mix64, slices, words

OUT = "doc_id {}, item_id long, score double, char_start long, char_end long, seed_hits int"


def smith_waterman(item: np.ndarray, text: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Best local score, and the ends (exclusive) of the aligned parts in item and text.  Code 0 matches nothing."""
    n = len(text)
    row, best = np.zeros(n + 1, dtype=np.int64), (0, 0, 0)
    steps = np.arange(n + 1, dtype=np.int64) * -gap
    for i, code in enumerate(item, 1):
        new = np.zeros(n + 1, dtype=np.int64)
        np.maximum(row[:-1] + np.where((text == code) & (code > 0), match, mismatch), row[1:] + gap, out=new[1:])
        np.maximum(new, 0, out=new)
        # gaps along the row: the best of all cells to the left, less the distance
        row = np.maximum.accumulate(new + steps) - steps
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j)
    return best


def rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k codes."""
    out = np.zeros(max(0, len(codes) - k + 1), dtype=np.uint64)
    for i in range(k):
        out = mix64(out + codes[i : i + len(out)].astype(np.uint64) + np.uint64(i + 1))
    return out


class Index:
    """Words, codes and seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]], n: int, min_words: int):
        self.n, self.items, self.short, self.vocab = n, [], [], {}
        for item_id, text in items:
            if w := words(text):
                codes = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], dtype=np.int64)
                (self.items if len(w) >= max(n, min_words) else self.short).append((item_id, codes))
        self.base = len(self.vocab) + 1
        by = defaultdict(lambda: defaultdict(list))
        for item_id, codes in self.short:
            by[len(codes)][tuple(codes.tolist())].append(item_id)
        # length of the short items, sorted hashes, items by words
        self.exact = [(k, np.unique(np.concatenate([rolled(np.array(c), k) for c in known])), dict(known)) for k, known in by.items()]

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """A number over 0 for each n-gram of codes; 0 where a word isn't in any item."""
        out, ok = np.zeros(max(0, len(codes) - self.n + 1), dtype=np.int64), True
        for k in range(self.n):
            part = codes[k : k + len(out)]
            out, ok = out * self.base + part, ok & (part > 0)
        return np.where(ok, out, 0)

    def pairs(self, codes: np.ndarray, gap: int) -> np.ndarray:
        """A number under 0 for each two words `gap` apart; 0 where a word isn't in any item."""
        one, two = codes[: max(0, len(codes) - gap)], codes[gap:]
        return np.where((one > 0) & (two > 0), -1 - one * self.base - two, 0)

    def seed(self, freq: np.ndarray, rare: float, rare_pair: float, least: int, gaps: int) -> None:
        logs = np.log10(np.maximum(freq, 1e-12))
        at, self.gaps = defaultdict(list), gaps
        for k, (_, codes) in enumerate(self.items):
            p = sum(logs[codes[i : len(codes) - self.n + 1 + i]] for i in range(self.n))
            grams = [(p, self.grams(codes), math.log10(rare))]
            two = [(logs[codes[: len(codes) - g]] + logs[codes[g:]], self.pairs(codes, g), math.log10(rare_pair)) for g in range(1, gaps + 1) if g < len(codes)]
            for some in (grams, two):
                few = sum(int((p <= limit).sum()) for p, _, limit in some) < least
                for p, keys, limit in some:
                    for i in np.flatnonzero((p <= limit) | few).tolist():
                        at[int(keys[i])].append((k, i))
        self.keys = np.array(sorted(at), dtype=np.int64)
        self.hits = [at[int(g)] for g in self.keys]
        # a quick test of most that aren't keys
        self.marks = np.zeros(1 << 22, dtype=bool)
        self.marks[self.slot(self.keys)] = True

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of seeds in codes, and which seeds."""
        at, seeds = [], []
        if len(self.keys):
            for keys in (self.grams(codes), *(self.pairs(codes, g) for g in range(1, self.gaps + 1))):
                some = np.flatnonzero(self.marks[self.slot(keys)])
                k = np.searchsorted(self.keys, keys[some])
                k[k == len(self.keys)] = 0
                ok = self.keys[k] == keys[some]
                at.append(some[ok]), seeds.append(k[ok])
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *at]), np.concatenate([none, *seeds])

    def codes(self, texts: list[str | None], gap: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts' words with `gap` zeros after each text, and where each text begins."""
        parts, starts, at = [], [], 0
        for t in texts:
            w = words(t)
            starts.append(at)
            parts += [w, ("",) * gap]
            at += len(w) + gap
        flat = itertools.chain.from_iterable(parts)
        return np.fromiter(map(self.vocab.get, flat, itertools.repeat(0)), dtype=np.int64, count=at), np.array([*starts, at], dtype=np.int64)


def frequencies(docs: DataFrame, index: Index) -> np.ndarray:
    """Share of each word of the index among all words of all documents."""

    def run(batches):
        counts, total = np.zeros(index.base, dtype=np.int64), 0
        for b in slices(batches):
            codes, _ = index.codes(b.column("text").to_pylist(), 0)
            counts += np.bincount(codes, minlength=index.base)
            total += len(codes)
        counts[0] = total
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(index.base)), pa.array(counts)], ["code", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(index.base)
    for r in rows:
        out[r["code"]] = r["n"]
    return out / max(1.0, out[0])


def _windows(found: list[tuple[int, int]], length: int, slack: int, end: int) -> list[list[int]]:
    """[from, to, hits] of word windows of an item, those that meet joined."""
    out: list[list[int]] = []
    for pos, at in sorted(found):
        lo, hi = max(0, pos - at - slack), min(end, pos - at + length + slack)
        if out and lo <= out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], hi), out[-1][2] + 1
        else:
            out.append([lo, hi, 1])
    return out


def _passages(item: np.ndarray, text: np.ndarray, lo: int, hi: int, threshold: float) -> list[tuple[int, int, int]]:
    """score, from, to of the passages of text[lo:hi] that reach the threshold, in strips."""
    # words of a passage at most: each word that is in no match costs what a gap costs
    reach = len(item) + math.ceil(2 * len(item) * (1 - threshold)) + 1
    strip, out = 8 * reach, []
    while lo < hi:
        end = min(hi, lo + strip)
        here = sorted(_best(item, text, lo, end, threshold), key=lambda p: p[1])
        if end < hi:
            # the next strip has those that may go on
            here = [p for p in here if p[1] < end - reach]
        out += here
        lo = max([end - reach, *(p[2] for p in here)]) if end < hi else hi
    return out


def _best(item: np.ndarray, text: np.ndarray, lo: int, hi: int, threshold: float) -> list[tuple[int, int, int]]:
    """The same of a strip: its best passage, then those on both sides."""
    out, left = [], [(lo, hi)]
    while left:
        lo, hi = left.pop()
        # a part with too few words can't reach it
        if hi - lo < threshold * len(item):
            continue
        score, i, j = smith_waterman(item, text[lo:hi])
        if score < threshold * 2 * len(item) or not score:
            continue
        back = smith_waterman(item[:i][::-1], text[lo : lo + j][::-1])
        start, end = lo + j - back[2], lo + j
        out.append((score, start, end))
        left += [(end, hi), (lo, start)]
    return out


def _match_block(docs: DataFrame, index: Index, threshold: float) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            ids, texts, out = b.column("doc_id").to_pylist(), b.column("text").to_pylist(), []
            codes, starts = index.codes(texts, max(index.n, index.gaps))
            hit, seeds = index.found(codes)
            by = defaultdict(list)
            for p, d, s in zip(hit.tolist(), (np.searchsorted(starts, hit, side="right") - 1).tolist(), seeds.tolist(), strict=True):
                for k, i in index.hits[s]:
                    by[d, k].append((p - int(starts[d]), i))
            spans = {}

            def chars(d, start, end, texts=texts, spans=spans):
                if d not in spans:
                    spans[d] = [m.span() for m in WORD.finditer(texts[d].lower())]
                return spans[d][start][0], spans[d][end - 1][1]

            for (d, k), found in by.items():
                item_id, item = index.items[k]
                text = codes[starts[d] : starts[d + 1] - max(index.n, index.gaps)]
                for lo, hi, n in _windows(found, len(item), 8 + len(item) // 4, len(text)):
                    for score, start, end in _passages(item, text, lo, hi, threshold):
                        out.append((ids[d], item_id, score / (2 * len(item)), *chars(d, start, end), n))
            for k, keys, known in index.exact:
                for p in np.flatnonzero(np.isin(rolled(codes, k), keys)).tolist():
                    d = int(np.searchsorted(starts, p, side="right")) - 1
                    for item_id in known.get(tuple(codes[p : p + k].tolist()), ()):
                        out.append((ids[d], item_id, 1.0, *chars(d, p - int(starts[d]), p - int(starts[d]) + k), 0))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (b.schema.field("doc_id").type, pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "char_start", "char_end", "seed_hits"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, OUT.format(dict(rows.dtypes)["doc_id"]))


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, score, char_start, char_end, seed_hits of every matching passage (offsets in the lower-case text)."""
    return _matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, **options)


def _matches(docs: DataFrame, benchmark: DataFrame, n: int = 3, rare: float = 1e-9, rare_pair: float = 1e-8, least: int = 6, gaps: int = 3, threshold: float = 0.5, min_words: int = 8, block_items: int = 20_000) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = -(-items.count() // block_items)
    out = docs.sparkSession.createDataFrame([], OUT.format(dict(docs.dtypes)["doc_id"]))
    for k in range(blocks):
        # about block_items rows
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        index = Index([tuple(r) for r in block], n, min_words)
        if index.items or index.short:
            index.seed(frequencies(docs, index) if index.items else np.zeros(index.base), rare, rare_pair, least, gaps)
            out = out.unionByName(_match_block(docs, index, threshold))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a matching passage, with their columns."""
    # a match depends on the text alone, and doc_id may be null
    texts = docs.select(F.md5(F.col("text").cast("string")).alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = _matches(texts, benchmark, **options).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, F.md5(docs["text"].cast("string")) == found["__id"], "left_anti")
