"""Repeated passages by content-defined chunks.

A gear hash h = (h << 2) + G[byte] (32 bits, so 16 bytes of memory) rolls over the UTF-8 bytes; a
boundary lies where it is smallest among `reach` bytes to either side.  Boundaries depend on nearby bytes
alone, so an insertion moves only the chunks it touches.  In text of a short period, positions of all periods tie, and
each is a boundary; a run of equal chunks is then cut into pieces of some 64 bytes, which are equal wherever the run begins.

Chunks are counted by digest over all documents.  Texts are chunked once, in splits; a split sends the sorted digests of its
chunks, each once, to the parts that count them (ranges of digests), and gets back for each of them who has it first and
how many documents have it.  So a chunk that a third of all documents share travels once a split, and no task holds more than a split or
a part.  The first holder is the row of the smallest doc_id (among rows of one id, one of them); a chunk is a repeat in every other row
(with `within`, also where the same row has it earlier).  Neighbouring repeats form a span; spans of at least `least_words` words (or,
in text with few blanks, 12 * least_words bytes) are reported.

A passage loses its ends to chunks that straddle them: at most 2 * reach + 16 bytes and a chunk in front,
reach bytes and a chunk behind.  With the defaults any shared passage of over 50 words keeps most of its words, while a shared line of
up to 16 words stays below the limit.

Edge cases.  Null and empty texts have no chunks.  Rows that share a doc_id are rows of their own, repeated rows too: all but one of them
repeat the whole text.  Null doc_ids come after all others.  An empty table gives an empty result.  Other columns are not read, and kept by `without_spans`, which knows a row
by its id and the digest of its text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, stored
from .packing import cuts, packed, packed_ids, packed_values, small, unpacked, unpacked_ids, unpacked_values, whole

SPLIT = "split long, n long, doc_ids array<long>, marks array<string>, chunks array<int>, sizes binary, words binary, place binary, digests binary, first binary, copies binary"
MESSAGE = "part int, split long, digests binary, first binary, copies binary, own binary"
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1


@functools.lru_cache(maxsize=1)
def _gear() -> tuple[np.ndarray, np.ndarray]:
    g = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (g >> np.uint64(32)).astype(np.uint32), g | np.uint64(1)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    base = 0x5851F42D4C957F2D
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _spread_min(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of h[i-w:i] for each i (all ones where there is nothing)."""
    top = np.uint32(0xFFFFFFFF)
    out, cur, size, done = np.full(len(h), top, dtype=np.uint32), h.copy(), 1, 0
    while done < w:
        if (w - done) & size:
            shift = done + 1
            np.minimum(out[shift:], cur[: len(h) - shift], out=out[shift:])
            done += size
        nxt = cur.copy()
        np.minimum(nxt[size:], cur[:-size], out=nxt[size:])
        cur, size = nxt, size * 2
    return out


def boundaries(data: np.ndarray, reach: int) -> np.ndarray:
    """Where h is smallest among `reach` bytes to either side, or as small as another there.  A boundary follows its byte."""
    h = _gear()[0][data]
    for shift in (1, 2, 4, 8):
        nxt = h.copy()
        nxt[shift:] += h[:-shift] << np.uint32(2 * shift)
        h = nxt
    left, right = _spread_min(h, reach), _spread_min(h[::-1], reach)[::-1]
    ok = (h <= left) & (h <= right)
    ok[:reach] = ok[len(ok) - reach :] = False
    return np.flatnonzero(ok) + 1


def chunk_batch(texts: list[str | None], reach: int, most: int, piece: int = 64) -> tuple[np.ndarray, ...]:
    """doc, idx, start, len, words that begin, digest of all chunks of a list of texts."""
    raw = [t.encode() if t else b"" for t in texts]
    pad = 2 * reach
    size = sum(map(len, raw)) + pad * (len(raw) + 1)
    data, starts, at = np.zeros(size, dtype=np.uint8), [], pad
    inside = np.zeros(size, dtype=bool)
    ends = []
    for r in raw:
        starts.append(at)
        if r:
            data[at : at + len(r)], inside[at : at + len(r)] = np.frombuffer(r, dtype=np.uint8), True
            ends += [at, at + len(r)]
        at += len(r) + pad
    found = boundaries(data, reach)
    # a boundary must have `reach` bytes of its own text on both sides
    keep = inside[np.maximum(found - reach, 0)] & inside[np.minimum(found + reach, size - 1)]
    edge = np.union1d(np.array(ends, dtype=np.int64), found[keep])
    lo, hi = edge[:-1], edge[1:]
    real = inside[np.minimum(lo, size - 1)]
    lo, hi = lo[real], hi[real]
    extra = (hi - lo - 1) // most
    if extra.any():  # stretches without a boundary
        n = extra + 1
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        base, end = np.repeat(lo, n), np.repeat(hi, n)
        lo, hi = base + k * most, np.minimum(base + (k + 1) * most, end)
    power, inverse = _powers(1 << max(20, int(size).bit_length()))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_gear()[1][data] * power[:size])])
    digest = lambda: mix64(mix64((sums[hi] - sums[lo]) * inverse[lo]) + (hi - lo).astype(np.uint64))
    got = digest()
    again = np.zeros(len(lo), dtype=bool)
    again[1:] = (got[1:] == got[:-1]) & (lo[1:] == hi[:-1]) & (hi[1:] - lo[1:] < piece)
    if again.any():  # runs of equal chunks
        at = np.arange(len(lo))
        k = at - np.maximum.accumulate(np.where(again, 0, at))
        head = ~again | (k % (-(-piece // np.maximum(hi - lo, 1))) == 0)
        lo, hi = lo[head], np.maximum.reduceat(hi, np.flatnonzero(head))
        got = digest()
    blank = (data == 32) | ((data >= 9) & (data <= 13)) | ~inside
    begins = np.concatenate([[0], np.cumsum(~blank & np.concatenate([[True], blank[:-1]]))])
    starts = np.array(starts, dtype=np.int64)
    doc = np.searchsorted(starts, lo, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(texts)))
    idx = np.arange(len(doc)) - first[doc] if len(doc) else np.zeros(0, dtype=np.int64)
    return doc, idx, lo - starts[doc] if len(doc) else lo, hi - lo, begins[hi] - begins[lo], got


def mark(text):
    """The text's digest of 128 bits; with the doc_id it names a row, up to repeated rows."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def splits(docs: DataFrame, reach: int, most: int, split_bytes: int) -> DataFrame:
    """The chunks of each split, and its distinct digests with their first document and the number of documents that have them."""

    def run(batches):
        for k, b in enumerate(slices(batches, most=split_bytes)):
            ids = [LAST if i is None else i for i in b.column("doc_id").to_pylist()]
            doc, _, _, size, words, digest = chunk_batch(b.column("text").to_pylist(), reach, most)
            some, place = np.unique(digest, return_inverse=True)
            # one row a digest and document
            pair = np.unique(place.astype(np.int64) * len(ids) + doc)
            by = np.array(ids, dtype=np.int64)[pair % len(ids)]
            copies = np.bincount(pair // len(ids), minlength=len(some))
            first = np.minimum.reduceat(by, np.cumsum(copies) - copies) if len(some) else by
            row = [(TaskContext.get().partitionId() << 32) + k, len(some), b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), np.bincount(doc, minlength=len(ids)).astype(np.int32), packed(small(size)), packed(small(words)), packed(small(place)), packed_ids(some), packed_values(first), packed(small(copies))]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in SPLIT.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark(F.col("text")).alias("mark"))
    return rows.mapInArrow(run, SPLIT)


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in MESSAGE.split(", ")])


def counted(chunks: DataFrame, parts: int) -> DataFrame:
    """For each split and part: which of the split's digests several documents have, and of those the first document, their number, and whether the split has the first."""

    def ask(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, first, copies = unpacked_ids(r["digests"]), unpacked_values(r["first"], np.int64), whole(r["copies"])
                edges = cuts(ids, parts)
                yield _messages([(p, r["split"], packed_ids(ids[x:y]), packed_values(first[x:y]), packed(small(copies[x:y])), None) for p, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x])

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("split").to_pydict()
        lists = [unpacked_ids(x) for x in rows["digests"]]
        ids, first, copies = np.concatenate(lists), np.concatenate([unpacked_values(x, np.int64) for x in rows["first"]]), np.concatenate([whole(x) for x in rows["copies"]])
        # by digest, then by the first document; of equal ones the first split's
        by = np.lexsort((first, ids))
        ordered = ids[by]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        own = np.zeros(len(ids), dtype=np.uint8)
        own[by[at]] = 1
        least, total = np.empty(len(ids), dtype=np.int64), np.empty(len(ids), dtype=np.int64)
        least[by], total[by] = first[by][at][group], np.add.reduceat(copies[by], at)[group]
        out, to = [], 0
        for split, x in zip(rows["split"], lists, strict=True):
            here = slice(to, to + len(x))
            many = total[here] > 1
            out.append((rows["part"][0], split, packed(many.astype(np.uint8)), packed_values(least[here][many]), packed(small(total[here][many])), packed(own[here][many])))
            to += len(x)
        return pa.Table.from_batches([_messages(out)])

    asked = chunks.select("split", "digests", "first", "copies").mapInArrow(ask, MESSAGE)
    return asked.groupBy("part").applyInArrow(add, MESSAGE)


SPANS = "doc_id long, span_start long, span_end long, n_chunks long, first_doc_id long, copies long, text_md5 string"
NONE = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SPANS.split(", ")])


def repeated_spans(docs: DataFrame, reach: int = 16, most: int = 256, least_words: int = 24, within: bool = False, split_bytes: int = 3 << 20, part_chunks: int = 1_000_000) -> DataFrame:
    """doc_id, span_start, span_end (bytes), n_chunks, first_doc_id (the smallest of its chunks' first documents), copies and text_md5 of every repeated span."""
    chunks = stored(splits(docs, reach, most, split_bytes), "chunk-splits")
    parts = max(1, -(-int(chunks.agg(F.sum("n")).first()[0] or 0) // part_chunks))
    replies = stored(counted(chunks, parts), "chunk-counts")

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        r, told = rows.to_pylist()[0], told.sort_by("part").to_pydict()
        ids, sizes, words, place = r["doc_ids"], whole(r["sizes"]), whole(r["words"]), whole(r["place"])
        doc = np.repeat(np.arange(len(ids)), r["chunks"])
        if not len(doc):
            return NONE.empty_table()
        ends = np.cumsum(sizes)
        base = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(r["chunks"])])[:-1]][doc]
        many = np.concatenate([unpacked(x, np.uint8) for x in told["digests"]]).astype(bool)
        spread = lambda c, f: np.concatenate([f(x) for x in told[c]])
        first, copies, own = (np.zeros(len(many), dtype=np.int64) for _ in range(3))
        first[many], copies[many], own[many] = spread("first", lambda x: unpacked_values(x, np.int64)), spread("copies", whole), spread("own", lambda x: unpacked(x, np.uint8))
        # the holder in this split: of the rows with a digest that of the smallest id, then the first
        key = np.array([LAST if i is None else i for i in ids], dtype=np.int64)[doc]
        by = np.lexsort((np.arange(len(doc)), key, place))
        head = np.ones(len(doc), dtype=bool)
        head[1:] = place[by][1:] != place[by][:-1]
        holder = np.empty(len(many), dtype=np.int64)
        holder[place[by][head]] = doc[by][head]
        repeat = many[place] & ~((own[place] > 0) & (holder[place] == doc))
        if within:
            at = np.lexsort((np.arange(len(doc)), doc, place))
            same = np.zeros(len(doc), dtype=bool)
            same[at[1:]] = (place[at][1:] == place[at][:-1]) & (doc[at][1:] == doc[at][:-1])
            repeat |= same
            first = np.where(many, first, LAST)
        at = np.flatnonzero(repeat)
        if not len(at):
            return NONE.empty_table()
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) > 1) | (doc[at][1:] != doc[at][:-1])
        heads = np.flatnonzero(new)
        lo, hi = (ends - sizes - base)[at][heads], np.maximum.reduceat((ends - base)[at], heads)
        n, w = np.add.reduceat(np.ones(len(at), dtype=np.int64), heads), np.add.reduceat(words[at], heads)
        # what a row has within itself alone has the row as its first holder
        whose = np.where(many[place[at]], first[place[at]], key[at])
        least, most_copies = np.minimum.reduceat(whose, heads), np.maximum.reduceat(np.maximum(copies[place[at]], 1), heads)
        keep = (w >= least_words) | (hi - lo >= 12 * least_words)
        cols = [[ids[d] for d in doc[at][heads][keep]], lo[keep], hi[keep], n[keep], [None if x == LAST else int(x) for x in least[keep]], most_copies[keep], [r["marks"][d] for d in doc[at][heads][keep]]]
        return pa.table([pa.array(x, t) for x, t in zip(cols, NONE.types, strict=True)], schema=NONE)

    return chunks.drop("digests", "first", "copies").groupBy("split").cogroup(replies.groupBy("split")).applyInArrow(run, SPANS)


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents with the spans cut from their texts; a byte at a span's edge that splits a character is dropped.

    A row is known by its doc_id and its text.  Repeated rows repeat the whole text, all but one: one of them gets the spans that aren't the whole text, if
    a whole text is reported less often than there are rows.
    """
    each = spans.groupBy("doc_id", "text_md5", "span_start", "span_end").agg(F.count("*").alias("n"))
    told = each.groupBy(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__mark")).agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end", "n"))).alias("__all"))
    # the place of a row tells repeated rows apart; it is written, so that it stays the same
    placed = stored(docs.withColumns({"__at": F.monotonically_increasing_id(), "__m": mark(F.col("text"))}), "without-spans")
    heads = placed.groupBy(F.col("doc_id").cast("long").alias("__head_id"), F.col("__m").alias("__head_m")).agg(F.min("__at").alias("__head"), F.count("*").alias("__n"))
    heads = heads.join(told, F.col("__head_id").eqNullSafe(F.col("__id")) & (F.col("__head_m") == F.col("__mark"))).select("__head", "__n")
    rows = placed.join(told, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark")), "left").join(heads, F.col("__at") == F.col("__head"), "left")
    whole = lambda s: (s["span_start"] == 0) & (s["span_end"] == F.octet_length(F.col("text")))
    times = F.aggregate(F.filter("__all", whole), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    rows = rows.withColumn("__spans", F.when(F.col("__head").isNotNull() & (times < F.col("__n")), F.filter("__all", lambda s: ~whole(s))).when(times > 0, F.filter("__all", whole)).otherwise(F.col("__all")))

    @F.pandas_udf("string")
    def remove(text, spans_of):
        out = []
        for t, ss in zip(text, spans_of, strict=True):
            if t is not None and ss is not None and len(ss):
                raw, at, keep = t.encode(), 0, []
                for s in ss:
                    keep.append(raw[at : s["span_start"]])
                    at = max(at, s["span_end"])
                t = b"".join([*keep, raw[at:]]).decode(errors="ignore")
            out.append(t)
        return type(text)(out, dtype=object)

    return rows.withColumn("text", remove("text", "__spans")).select(*docs.columns)
