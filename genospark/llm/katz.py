"""Katz backoff language model over documents.

Model.  P(w | h) = D(c) / c(h) where the n-gram h w occurs c times, else alpha(h) P(w | shorter h).  D(c) is c times Good and
Turing's discount for counts up to `most`; higher counts are trusted.  Where every follower of h has a higher count, Good and
Turing free no mass in h; there c(h) is raised by the absolute discount d = n1 / (n1 + 2 n2) of the order (1/2 without n1) for each
follower, so that no word ever has probability 0.  alpha(h) is the mass freed in h over the mass that the shorter model gives to the
words not seen after h, summed exactly over the words seen.  What the unigrams free goes to one unknown type, so that all
probabilities sum to 1.

Exchange.  Texts are tokenised once and kept in splits of about `split_bytes`, as indices into a split's vocabulary of 64-bit hashes.  A split sends
each part (a range of n-gram ids) the sorted ids of its distinct n-grams with their counts, and gets back the totals for exactly those
ids; the first split that learned an n-gram owns it, and speaks for it where contexts are summed.  So a frequent n-gram or word
travels once a split, and no task holds more than a split or a part.  An id is a chained hash; it has 22 bits more than the number of tokens needs
(words: 26), so that an n-gram meets another one's id with a probability of 2**-22 (words: 2**-26) at any size, up to 64 bits.  A split and a part share about split tokens * part tokens / all tokens ids; with very many splits both sizes should
grow with the executors' memory.

Tables.  `fit` writes the counts by order and part, as the totals that each split asked for, with a mark at the split that owns
the n-gram; and for each context, by order and part, the freed mass, the number of followers and the sum of their lower-order counts.
`rows_of` gives both as rows.

Evaluation.  Every token goes down the orders by the recursion, as far as its n-grams are unknown.  A split sums the logarithms that its
counts decide, and notes for each text the contexts whose alpha it needs, or that may have been raised; those it gets back with the
sums over contexts, and adds.

Tokens.  A-Z are lower-cased; tokens are runs of characters other than blanks and \\t\\n\\v\\f\\r, then one end.

Edge cases.  A null text is empty and is scored by its end alone.  A null training mark means held out.  Without training texts every
token has the probability of the unknown type, 1.  Repeated rows are learned from and scored each.  Where counts of counts don't
allow Good and Turing's discount, absolute discounting by n1 / (n1 + 2 n2) takes its place.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import word_hash
from .common import drop, mix64, slices, stored
from .packing import bundled, cuts, packed, packed_few, packed_ids, small, unbundled, unpacked, unpacked_ids, unpacked_values, whole

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: The same for bytes; blanks of all kinds become one.
FOLD = bytes(i + 32 if 65 <= i < 91 else 32 if 9 <= i <= 13 else i for i in range(256))
END = "\x20end"
START = "\x20start"
#: By a number of bytes, the mask of as many in a number of 8; the longest word that is hashed by such numbers; and how many words at once.
BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
LONG = 256
BLOCK = 1 << 16
PAD = np.uint64(0x5DEECE66D)

SPLIT = "split long, n long, n_words long, doc_ids array<long>, train array<boolean>, sizes array<int>, words binary, at binary"
MESSAGE = "what string, level int, part int, split long, ids binary, a binary, b binary, c binary, stats array<long>"
NAMES = ["what", "level", "part", "split", "ids", "a", "b", "c", "stats"]
KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64())]


def tokens(text: str | None) -> list[str]:
    """The tokens of a text, with its end."""
    return [*TOKEN.findall(text.translate(LOWER)), END] if text else [END]


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of all texts, each text with a start in front; and how many each text has.

    Words are cut from the bytes of all texts at once: all that ends one is a single byte in UTF-8.
    """
    texts = texts.fill_null("").cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = (texts.buffers()[2] or pa.py_buffer(b""))[int(edges[0]) : int(edges[-1])].to_pybytes().translate(FOLD)
    edges = edges - edges[0]
    inside = np.zeros(len(raw) + 1, dtype=bool)
    inside[:-1] = np.frombuffer(raw, dtype=np.uint8) != 32
    # a word begins after a blank or where its text does
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    del inside, first, last
    sizes = np.diff(np.searchsorted(begin, edges)) + 2
    stop = np.cumsum(sizes)
    h, word = np.full(stop[-1], word_hash(START), dtype=np.uint64), np.ones(stop[-1], dtype=bool)
    word[stop - sizes] = word[stop - 1] = False
    h[stop - 1] = word_hash(END)
    h[word] = hashed(raw, begin, end)
    return h, sizes


def hashed(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of raw: 8 bytes after the other are mixed in; very long pieces are hashed one by one."""
    lanes = np.ndarray(len(raw) + 1, dtype="<u8", buffer=raw + bytes(8), strides=(1,))
    hashes = np.empty(len(begin), dtype=np.uint64)
    for i in range(0, len(begin), BLOCK):
        out, at = hashes[i : i + BLOCK], begin[i : i + BLOCK]
        size = end[i : i + BLOCK] - at
        out[:] = mix64(size)
        left = np.arange(len(out))
        for k in range(0, LONG, 8):
            left = left[size[left] > k]
            if not len(left):
                break
            lane = lanes[at[left] + k] & BYTES[np.minimum(size[left] - k, 8)]
            out[left] = mix64(out[left] * np.uint64(31) + lane)
        for j in left[size[left] > LONG].tolist():
            out[j] = int.from_bytes(hashlib.blake2b(raw[at[j] : at[j] + size[j]], digest_size=8).digest(), "little")
    return hashes


def splits(docs: DataFrame, training, split_bytes: int) -> DataFrame:
    """The tokenised texts: a vocabulary's hashes, and the words of all documents as indices, each text with a start in front."""

    def run(batches):
        for k, b in enumerate(slices(batches, most=split_bytes)):
            h, sizes = token_hashes(b.column("text"))
            _, _, words, x = ranked(h)
            # frequent words get small indices
            order = np.argsort(-np.bincount(x), kind="stable")
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            cols = [(TaskContext.get().partitionId() << 32) + k, len(x), len(words), b.column("doc_id").to_pylist(), b.column("train").to_pylist(), sizes.tolist(), packed(words[order]), packed(place[x])]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], ["split", "n", "n_words", "doc_ids", "train", "sizes", "words", "at"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train")).mapInArrow(run, SPLIT)


@dataclass
class Split:
    """A split's tokens, and its distinct n-grams by order with what is known of them."""

    number: int
    doc_ids: list
    starts: np.ndarray  # where each text has its start
    train: np.ndarray  # positions to learn from
    words: np.ndarray  # the ids of the vocabulary's words
    at: np.ndarray  # which of them stands at each position
    grams: list[np.ndarray | None]  # by order: the id of the n-gram that ends at each position (of words: none), until `distinct` has taken it
    ids: dict[int, np.ndarray] = field(default_factory=dict)  # by order: the distinct ids, sorted
    place: dict[int, np.ndarray] = field(default_factory=dict)  # by order: which of them ends at each position
    count: dict[int, np.ndarray] = field(default_factory=dict)  # by order: how often training texts have them
    own: dict[int, np.ndarray] = field(default_factory=dict)  # by order: those that this split speaks for


def opened(rows: pa.Table, order: int, bits: int) -> Split:
    row = rows.to_pylist()[0]
    words, at = unpacked(row["words"], np.uint64), unpacked(row["at"], np.uint32)
    h = words[at]
    sizes = np.array(row["sizes"], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    grams = [h]
    for k in range(2, order + 1):
        # the n-gram before, and this word; the starts of all texts are the same context
        g = np.empty_like(h)
        g[1:] = mix64(grams[-1][:-1] * np.uint64(31) + h[1:] + np.uint64(k))
        g[starts] = PAD * np.uint64(k)
        grams.append(g)
    ids = [None, *(g >> np.uint64(64 - bits) for g in grams[1:])]
    return Split(row["split"], row["doc_ids"], starts, np.repeat(np.array(row["train"], dtype=bool), sizes), words >> np.uint64(64 - width(1, bits)), at, ids)


def width(k: int, bits: int) -> int:
    """Bits of the ids of order k."""
    return bits if k > 1 else min(64, bits + 4)


def start_ids(order: int, bits: int) -> list[np.uint64]:
    """By order: the id of the start, which is a context and no token."""
    return [np.uint64(word_hash(START)) >> np.uint64(64 - width(1, bits))] + [PAD * np.uint64(k) >> np.uint64(64 - bits) for k in range(2, order + 1)]


def distinct(s: Split, levels) -> None:
    for k in levels:
        if k == 1:
            # words are distinct already, but for those whose ids meet
            s.ids[k], place = ranked(s.words)[2:]
            s.place[k] = place[s.at]
        else:
            s.ids[k], s.place[k] = ranked(s.grams[k - 1])[2:]
            s.grams[k - 1] = None


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stable order of ids, where each distinct one begins in it, the distinct ones sorted, and which of them stands where.

    An id's leading bits are sorted with its position behind them, as one number.  That puts ids in order unless different ones share
    those bits, which shows; then they are sorted by themselves.
    """
    low = len(ids).bit_length()
    most = int(ids.max()).bit_length() if len(ids) else 0
    key = ids >> np.uint64(max(0, most + low - 64))
    key <<= np.uint64(low)
    key += np.arange(len(ids), dtype=np.uint32)
    key.sort()
    key &= np.uint64((1 << low) - 1)
    by = key.view(np.int64)
    ordered = ids[by]
    if (ordered[1:] < ordered[:-1]).any():
        by = np.argsort(ids, kind="stable")
        ordered = ids[by]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(ids), dtype=np.int32)
    place[by] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    at = np.flatnonzero(new)
    return by, at, ordered[at], place


def messages(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS, strict=True)], NAMES)


def counted(texts: DataFrame, levels: list[int], bits: int, parts: dict[int, int], most: int) -> DataFrame:
    """Messages `reply` (the totals a split asked for) and `stats` (tokens, types and counts of counts of a part)."""
    order = max(levels)

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                s = opened(pa.Table.from_batches([b.slice(i, 1)]), order, bits)
                for k in levels:
                    distinct(s, [k])
                    n = np.bincount(s.place[k][s.train], minlength=len(s.ids[k]))
                    edges = cuts(s.ids[k], parts[k], width(k, bits))
                    yield messages([("ask", k, p, s.number, packed_ids(s.ids[k][x:y]), packed(small(n[x:y])), None, None, None) for p, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x])
                    del s.ids[k], s.place[k]

    starts = start_ids(order, bits)

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("split").to_pydict()
        level, part = rows["level"][0], rows["part"][0]
        lists = [unpacked_ids(x) for x in rows["ids"]]
        ids, n = np.concatenate(lists), np.concatenate([whole(x) for x in rows["a"]])
        by, at, ids, place = ranked(ids)
        total = np.add.reduceat(n[by], at)
        # the first split that has learned it
        first = np.minimum.reduceat(np.where(n[by] > 0, by, len(by)), at)
        own = np.zeros(len(by), dtype=np.uint8)
        own[first[total > 0]] = 1
        back = total[place]
        real = total[(total > 0) & (ids != starts[level - 1])]
        stats = [int(real.sum()), len(real), *np.bincount(np.minimum(real, most + 2), minlength=most + 3)[1 : most + 2].tolist()]
        out, to = [("stats", level, part, None, None, None, None, None, stats)], 0
        for split, x in zip(rows["split"], lists, strict=True):
            here = slice(to, to + len(x))
            out.append(("reply", level, part, split, None, packed(small(back[here])), packed(own[here]), None, None))
            to += len(x)
        return pa.Table.from_batches([messages(out)])

    asked = texts.select("split", "doc_ids", "train", "sizes", "words", "at").mapInArrow(ask, MESSAGE)
    return asked.groupBy("level", "part").applyInArrow(add, MESSAGE)


@dataclass(frozen=True)
class Discounts:
    """D(c) of an order."""

    factor: np.ndarray  # by count, 1 above `most`
    absolute: float
    most: int

    @staticmethod
    def of(n: list[int]) -> Discounts:
        """From the numbers of n-grams that occur 1 .. most + 1 times."""
        most = len(n) - 1
        n, d = [0, *n], {}
        if n[1]:
            a = (most + 1) * n[most + 1] / n[1]
            for c in range(1, most + 1):
                star = (c + 1) * n[c + 1] / n[c] if n[c] else 0.0
                d[c] = (star / c - a) / (1 - a) if a < 1 else 0.0
        b = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        if not n[1] or not all(0 < x < 1 for x in d.values()):
            d = {c: min(max(1 - b / c, 0.05), 0.999) for c in range(1, most + 1)}
        return Discounts(np.array([1.0, *(d[c] for c in sorted(d)), 1.0]), b, most)

    def kept(self, c: np.ndarray) -> np.ndarray:
        """D(c)."""
        return c * self.factor[np.minimum(c, self.most + 1)]


@dataclass
class Model:
    """What is broadcast of a model (a few numbers an order), and its tables."""

    order: int
    bits: int
    parts: int  # of the n-grams of an order
    word_parts: int
    most: int
    tokens: int = 0
    types: int = 0
    discounts: dict[int, Discounts] = field(default_factory=dict)
    mass: float = 1.0  # of the unigrams: tokens, or more where Good and Turing free nothing
    unknown: float = 1.0

    def parts_of(self, k: int) -> int:
        return self.parts if k > 1 else self.word_parts


def informed(s: Split, replies: pa.Table, order: int) -> None:
    """Put the counts that the split got back into it."""
    rows = replies.select(["level", "part", "a", "b"]).sort_by([("level", "ascending"), ("part", "ascending")]).to_pylist()
    for k in range(1, order + 1):
        distinct(s, [k])
        s.count[k] = np.concatenate([whole(r["a"]) for r in rows if r["level"] == k])
        s.own[k] = np.concatenate([unpacked(r["b"], np.uint8) for r in rows if r["level"] == k]).astype(bool)


def before(s: Split, k: int) -> np.ndarray:
    """For each distinct n-gram of order k: its context among the distinct n-grams of order k - 1 (0 for a text's start)."""
    out = np.zeros(len(s.ids[k]), dtype=np.int32)
    out[s.place[k][1:]] = s.place[k - 1][:-1]
    out[s.place[k][s.starts]] = 0
    return out


def behind(s: Split, k: int) -> np.ndarray:
    """For each distinct n-gram of order k: the n-gram of order k - 1 that ends it."""
    out = np.zeros(len(s.ids[k]), dtype=np.int32)
    out[s.place[k]] = s.place[k - 1]
    return out


def no_start(s: Split, k: int) -> np.ndarray:
    out = np.ones(len(s.ids[k]), dtype=bool)
    out[s.place[k][s.starts]] = False
    return out


def told_contexts(s: Split, k: int, ctx: np.ndarray, low: np.ndarray, want: np.ndarray, model: Model) -> list[tuple]:
    """What the split's own n-grams of order k add to their contexts, and which contexts it asks for."""
    mine = s.own[k] & no_start(s, k)
    c, ctx, lower = s.count[k][mine], ctx[mine], s.count[k - 1][low[mine]]
    n = len(s.ids[k - 1])
    add = lambda w: np.bincount(ctx, weights=w, minlength=n)
    # the lower-order counts of the words seen, as the shorter model discounts them
    freed, types, lows = add(c - model.discounts[k].kept(c)), np.bincount(ctx, minlength=n), add(model.discounts[k - 1].kept(lower))
    wish = np.zeros(n, dtype=np.int64)
    wish[want] = 1
    some = np.flatnonzero((types > 0) | (wish > 0))
    ids, out = s.ids[k - 1][some], []
    edges = cuts(ids, model.parts_of(k - 1), width(k - 1, model.bits))
    for p, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        at = some[x:y]
        if y > x:
            # the wish is the lowest bit of the number of types
            out.append(("tell", k, p, s.number, packed_ids(ids[x:y]), packed_few(freed[at]), packed(small(types[at] * 2 + wish[at])), packed_few(lows[at]), None))
    return out


def partly_scored(s: Split, ctx: dict, low: dict, model: Model) -> tuple[dict[int, np.ndarray], tuple]:
    """By order the contexts to ask for, and the message with what counts decide and what waits for those contexts."""
    order, most = model.order, model.most
    c = s.count[1]
    known, unseen, raised, seldom = np.log10(np.where(c > 0, model.discounts[1].kept(c) / model.mass, model.unknown)), {}, {}, {}
    for k in range(2, order + 1):
        c, real = s.count[k], no_start(s, k)
        mass = s.count[k - 1][ctx[k]]
        # contexts that the split knows a discounted follower of can't have been raised
        seldom[k] = np.zeros(len(s.ids[k - 1]), dtype=bool)
        seldom[k][ctx[k][real & (c > 0) & (c <= most)]] = True
        unseen[k], raised[k] = real & (c == 0) & (mass > 0), real & (c > most) & ~seldom[k][ctx[k]]
        known = np.where(c > 0, np.log10(np.maximum(model.discounts[k].kept(c), 1e-9) / np.maximum(mass, 1)), known[low[k]])
    n, inside = len(s.doc_ids), np.ones(len(s.place[1]), dtype=bool)
    inside[s.starts] = False
    total = lambda x: np.add.reduceat(np.where(inside, x, 0), s.starts)
    c = s.count[1][s.place[1]]
    texts = bundled([packed(small(total(1))), packed(small(total(c > 0))), packed(total(np.log10((c + 1) / float(model.tokens + model.types + 1)))), packed(total(known[s.place[order]]))])
    # tokens go down the orders
    doc, at, hit = np.cumsum(~inside) - 1, np.flatnonzero(inside), {}
    for k in range(order, 1, -1):
        u = s.place[k][at]
        hit[k] = [(ctx[k][u[x]], doc[at[x]]) for x in (unseen[k][u], raised[k][u])]
        at = at[s.count[k][u] == 0]
    asked, waits = {}, []
    for k in range(2, order + 1):
        # also the shorter contexts of contexts with unseen words, if they may have been raised
        shorter = low[k][np.unique(hit[k + 1][0][0])] if k < order else np.zeros(0, dtype=np.int64)
        asked[k] = np.unique(np.concatenate([hit[k][0][0], hit[k][1][0], shorter[~seldom[k][shorter]]]))
        under = low[k - 1][asked[k]] if k > 2 else None
        if k > 2:
            spot = np.minimum(np.searchsorted(asked[k - 1], under), max(0, len(asked[k - 1]) - 1))
            spot = np.where(asked[k - 1][spot] == under, spot + 1, 0) if len(asked[k - 1]) else np.zeros(len(under), dtype=np.int64)
        waits += [packed(small(s.count[k - 1][asked[k]])), packed(small(s.count[k - 2][under] if k > 2 else np.zeros(0))), packed(small(spot if k > 2 else np.zeros(0)))]
        for x, d in hit[k]:
            pair, times = np.unique(np.searchsorted(asked[k], x) * n + d, return_counts=True)
            waits += [packed_ids(pair.astype(np.uint64)), packed(small(times))]
    return asked, ("partial", 0, 0, s.number, None, texts, bundled(waits), None, s.doc_ids)


def told(texts: DataFrame, replies: DataFrame, model: Model) -> DataFrame:
    """Messages `tell` (what a split adds to contexts, and asks of them) and `partial` (what it knows of its texts)."""

    def tell(rows: pa.Table, told: pa.Table) -> pa.Table:
        s = opened(rows, model.order, model.bits)
        informed(s, told, model.order)
        ctx, low = ({k: f(s, k) for k in range(2, model.order + 1)} for f in (before, behind))
        asked, partial = partly_scored(s, ctx, low, model)
        return pa.Table.from_batches([messages([partial, *(m for k in ctx for m in told_contexts(s, k, ctx[k], low[k], asked[k], model))])])

    return texts.groupBy("split").cogroup(replies.groupBy("split")).applyInArrow(tell, MESSAGE)


def summed(tells: DataFrame, keep: bool = True) -> DataFrame:
    """Messages `context` (what a split asked for) and, to keep, `contexts` (a part's table of contexts)."""

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("split").to_pydict()
        level, part = rows["level"][0], rows["part"][0]
        lists, wishes = [unpacked_ids(x) for x in rows["ids"]], [whole(x) for x in rows["b"]]
        ids, at = ranked(np.concatenate(lists))[2:]
        total = lambda x: np.bincount(at, weights=x, minlength=len(ids))
        freed, low = (total(np.concatenate([unpacked_values(x) for x in rows[c]])) for c in ("a", "c"))
        types = total(np.concatenate(wishes) // 2).astype(np.int64)
        known, out, to = types > 0, [], 0
        if keep:
            out.append(("contexts", level, part, None, packed_ids(ids[known]), packed_few(freed[known]), packed(small(types[known])), packed_few(low[known]), None))
        for split, x, w in zip(rows["split"], lists, wishes, strict=True):
            here = at[to : to + len(x)][w % 2 > 0]
            if len(here):
                out.append(("context", level, part, split, None, packed_few(freed[here]), packed(small(types[here])), packed_few(low[here]), None))
            to += len(x)
        return pa.Table.from_batches([messages(out)])

    return tells.where("what = 'tell'").groupBy("level", "part").applyInArrow(add, MESSAGE)


def evaluated(tells: DataFrame, contexts: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every text, from the messages `context` and `partial`."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("level", "ascending"), ("part", "ascending")]).to_pylist()
        ids, whole_of = rows[0]["stats"], [r for r in rows if r["what"] == "context"]
        tokens_, known_, base, score = (f(x) for f, x in zip((whole, whole, lambda x: unpacked(x, np.float64), lambda x: unpacked(x, np.float64)), unbundled(rows[0]["a"]), strict=True))
        waits, extra = iter(unbundled(rows[0]["b"])), np.zeros(0)
        for k in range(2, model.order + 1):
            mass, under, spot = (whole(next(waits)) for _ in range(3))
            mine = [r for r in whole_of if r["level"] == k]
            freed, types, low = (np.concatenate([f(r[c]) for r in mine]) if mine else np.zeros(0) for c, f in (("a", unpacked_values), ("b", whole), ("c", unpacked_values)))
            # the shorter context may have been raised too
            under = model.mass if k == 2 else under + np.concatenate([[0.0], extra])[spot]
            # what a context without discounted followers is raised by
            extra = np.where(freed == 0, model.discounts[k].absolute * types, 0.0)
            alpha = np.log10((freed + extra) / (mass + extra) / np.maximum(1 - low / under, 1e-15)) if len(mass) else mass
            for value in (alpha, np.log10(mass / (mass + extra)) if len(mass) else mass):
                pair, times = unpacked_ids(next(waits)).astype(np.int64), whole(next(waits))
                score = score + np.bincount(pair % len(ids), weights=value[pair // len(ids)] * times, minlength=len(ids))
        cols = [pa.array(ids, pa.int64()), *map(pa.array, (tokens_, known_, base, score))]
        return pa.table(dict(zip(("doc_id", "n_tokens", "n_known", "base_score", "score"), cols, strict=True)))

    pick = lambda t, what: t.where(F.col("what") == what).select("split", "what", "level", "part", "a", "b", "c", "stats")
    return pick(tells, "partial").unionByName(pick(contexts, "context")).groupBy("split").applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def fit(docs: DataFrame, training, order: int = 3, most: int = 5, split_bytes: int = 8 << 20, part_tokens: int = 1_000_000, keep: bool = True) -> tuple[Model, DataFrame, list[DataFrame]]:
    """The model, the texts' splits, and the written tables with the messages of each step.

    keep: the splits, the counts and the table of contexts stay, for `rows_of`; evaluation needs the last two tables alone.
    """
    texts = stored(splits(docs, training, split_bytes), "lm-splits")
    size, words = (int(x or 0) for x in texts.agg(F.sum("n"), F.sum("n_words")).first())
    # a split has far fewer words than tokens
    model = Model(order, min(64, 22 + size.bit_length()), *(max(1, -(-n // part_tokens)) for n in (size, words)), most)
    # the longest n-grams apart, so that not all orders' ids are on their way at once
    tables = [stored(counted(texts, levels, model.bits, {k: model.parts_of(k) for k in levels}, most), "lm-grams", by="what") for levels in ([order], list(range(1, order))) if levels]
    stats = {k: [0] * (most + 3) for k in range(1, order + 1)}
    for t in tables:
        for r in t.where("what = 'stats'").select("level", F.posexplode("stats").alias("i", "n")).groupBy("level", "i").agg(F.sum("n").alias("n")).collect():
            stats[r["level"]][r["i"]] = r["n"]
    model.tokens, model.types = stats[1][:2]
    model.discounts = {k: Discounts.of(x[2:]) for k, x in stats.items()}
    if model.tokens:
        counts = stats[1][2 : 2 + most]
        lost = sum(n * (c - float(model.discounts[1].kept(np.array([c]))[0])) for c, n in enumerate(counts, 1))
        extra = 0.0 if any(counts) else model.discounts[1].absolute * model.types
        model.mass = model.tokens + extra
        model.unknown = (lost + extra) / model.mass
    tables.append(stored(told(texts, replies(tables), model), "lm-told", by="what"))
    if not keep:
        drop(texts, *tables[:-1])
    tables.append(stored(summed(tables[-1], keep), "lm-contexts", by="what"))
    return model, texts, tables


def replies(tables: list[DataFrame]) -> DataFrame:
    """The counts that splits have got back."""
    some = [t.where("what = 'reply'").select("split", "level", "part", "a", "b") for t in tables]
    return some[0].unionByName(some[1]) if len(some) > 1 else some[0]


def rows_of(model: Model, texts: DataFrame, tables: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The model's tables as rows: (level, gram, n), and (level, context, freed, types, low); ids in 64 bits."""

    def grams(rows: pa.Table, told: pa.Table) -> pa.Table:
        s = opened(rows, model.order, model.bits)
        informed(s, told, model.order)
        mine = [(k, s.own[k] & no_start(s, k)) for k in s.ids]
        cols = [np.concatenate(x) for x in zip(*((np.full(m.sum(), k, np.int32), s.ids[k][m].view(np.int64), s.count[k][m]) for k, m in mine), strict=True)]
        return pa.table(dict(zip(("level", "gram", "n"), map(pa.array, cols), strict=True)))

    def contexts(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = unpacked_ids(r["ids"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["level"], np.int32)), pa.array(ids.view(np.int64)), pa.array(unpacked_values(r["a"])), pa.array(whole(r["b"])), pa.array(unpacked_values(r["c"]))], ["level", "context", "freed", "types", "low"])

    counts = texts.groupBy("split").cogroup(replies(tables[:-2]).groupBy("split")).applyInArrow(grams, "level int, gram long, n long")
    return counts, tables[-1].where("what = 'contexts'").select("level", "ids", "a", "b", "c").mapInArrow(contexts, "level int, context long, freed double, types long, low double")


def scores(docs: DataFrame, training, order: int = 3, **options) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; `training` marks the rows to learn from."""
    model, _, tables = fit(docs, training, order, keep=False, **options)
    out = evaluated(*tables[-2:], model)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"), "base_score", "score")
