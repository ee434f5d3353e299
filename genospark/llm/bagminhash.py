"""Near duplicates by BagMinHash signatures over multisets of word shingles.

Signature.  A shingle of weight w owns the weights (0, w], discretised into the blocks (0,1], (1,2], (2,4],
(4,8] and so on.  Every (shingle, block) pair seeds a Poisson process whose rate is the block's width; each point
has a time, a register and a weight inside the block, and is kept if the shingle's weight reaches it.
A register takes its earliest point.  Equal shingles share their processes in every document, so
two registers agree with the probability of the weighted Jaccard similarity.  The processes of a document run in step, and
stop when its last register has been filled: later points can't change a register.

Bands.  `bands` bands of `rows` registers are hashed to buckets.  Documents are first reduced to classes of equal
word sequences.  A bucket has two leaders: the member with most company in all its buckets, and the smallest one.  Every member is
compared with the two leaders that it shares most buckets with, which joins large groups of copies with few comparisons.

Rest.  Then every bucket that still holds several components is worked off whole: it is cut into blocks of about `block` members,
and any two blocks are one unit of work, in which the members of different components are compared.  Buckets with the same members are
taken once.  A pair needs no comparison if the texts' sizes alone keep it below the threshold, or if its signatures agree in fewer
registers than six standard deviations below those of a pair at the threshold.  In a unit, likelier pairs go first, and a pair that
links have joined by then is skipped.  A comparison computes the exact weighted Jaccard similarity of the two texts.  Only links leave a
unit, so no pairs of a group travel; texts travel to the units that need them, one copy a unit.

Edge cases.  A text with fewer words than a shingle is one shingle of all its words.  Texts without
words are copies of byte-equal texts only; a null text is in a class of its own (of null ids, one).  Rows that share doc_id
and text are one document; rows that share only the doc_id are documents apart, each in the class of its text.  Rows without an id take part, after all
others: a class of such rows alone has a null class_id, and the one with the smallest digest of its text stays.  An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MASK64, drop, mix64, slices, stored, words

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
POWERS = mix64(np.arange(1, 65, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class WordHashes(dict):
    """64-bit hashes of words; the last `most` or so are remembered."""

    def __missing__(self, word: str, most: int = 400_000) -> int:
        if len(self) >= most:
            self.clear()
        self[word] = h = word_hash(word)
        return h


def shingles(tokens: list[list[str]], n: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, shingle hash, count of the distinct shingles of each document, sorted by document and hash."""
    docs, out = [], []
    for d, w in enumerate(tokens):
        if not w:
            continue
        h = np.fromiter(map(hashes.__getitem__, w), dtype=np.uint64, count=len(w))
        k = min(n, len(h))
        s = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i in range(k):
            s += h[i : i + len(s)] * POWERS[i]
        docs.append(np.full(len(s), d, dtype=np.int64)), out.append(mix64(s))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc, sh = np.concatenate(docs), np.concatenate(out)
    order = np.lexsort((sh, doc))
    doc, sh = doc[order], sh[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sh[1:] != sh[:-1])
    at = np.flatnonzero(new)
    return doc[at], sh[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, sh: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Registers (n_docs, m) of point identities; documents without shingles have zeros."""
    regs = np.zeros((n_docs, m), dtype=np.uint64)
    flat = regs.reshape(-1)
    total = np.bincount(doc, weights=count, minlength=n_docs)
    # the blocks (0,1], (1,2], (2,4], ... that a count reaches into
    parts = [(doc, sh, np.ones(len(doc)), np.ones(len(doc)))]
    lo = 1
    while (reach := count > lo).any():
        parts.append((doc[reach], mix64(sh[reach] + np.uint64(lo * int(GOLDEN) & MASK64)), np.full(reach.sum(), float(lo)), np.minimum(count[reach], 2 * lo) - lo))
        lo *= 2
    d, seed, width, own = (np.concatenate(x) for x in zip(*parts, strict=True))

    def next_point(seed, j, t, width):
        r = mix64(seed + j * GOLDEN)
        return r, t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / width

    j = np.ones(len(d), dtype=np.uint64)
    r, t = next_point(seed, j, 0.0, width)
    # a window of time after the other, until every register has its earliest point
    pending, begun, step = total > 0, np.zeros(n_docs), math.log(m) + 0.5
    while pending.any():
        limit = np.where(pending, begun + m * step / np.maximum(total, 1), 0.0)
        now, got = np.flatnonzero(t < limit[d]), []
        d1, seed1, width1, own1, j1, r1, t1 = (x[now] for x in (d, seed, width, own, j, r, t))
        while len(now):
            r2 = mix64(r1 ^ GOLDEN)
            hit = (r2 & np.uint64(0xFFFFFFFF)).astype(np.float64) / (1 << 32) * width1 < own1
            reg = ((r2[hit] >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            got.append((d1[hit], reg.astype(np.int64), t1[hit], r1[hit]))
            j1 = j1 + np.uint64(1)
            r1, t1 = next_point(seed1, j1, t1, width1)
            live = t1 < limit[d1]
            # those that have left the window wait there
            gone = now[~live]
            j[gone], r[gone], t[gone] = j1[~live], r1[~live], t1[~live]
            now, d1, seed1, width1, own1, j1, r1, t1 = (x[live] for x in (now, d1, seed1, width1, own1, j1, r1, t1))
        if got:
            pd, pr, pt, pid = (np.concatenate(x) for x in zip(*got, strict=True))
            slot = pd * m + pr
            free = flat[slot] == 0
            slot, pd, pt, pid = slot[free], pd[free], pt[free], pid[free]
            key = (slot.astype(np.uint64) << np.uint64(36)) | ((pt - begun[pd]) / (limit[pd] - begun[pd]) * (1 << 36)).astype(np.uint64)
            order = np.argsort(key)
            slot = slot[order]
            first = np.ones(len(slot), dtype=bool)
            first[1:] = slot[1:] != slot[:-1]
            flat[slot[first]] = pid[order[first]] | np.uint64(1)
        pending &= (regs == 0).any(axis=1)
        begun, step = np.where(pending, limit, 0.0), 1.0
    return regs


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(regs), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(regs), mix64(np.array([b + 1], dtype=np.uint64))[0])
        for i in range(rows):
            h = mix64(h * np.uint64(31) + regs[:, b * rows + i])
        out[:, b] = h
    return out.view(np.int64)


class Shingled:
    """The shingles of some texts, to compare pairs of them."""

    def __init__(self, texts: list[str], n: int):
        self.doc, self.sh, self.count = shingles([words(t) for t in texts], n, WordHashes())
        self.ends = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.total = np.bincount(self.doc, weights=self.count, minlength=len(texts))

    def similarity(self, i: int, j: int) -> float:
        """Weighted Jaccard similarity of two multisets of shingles."""
        x, y = slice(self.ends[i], self.ends[i + 1]), slice(self.ends[j], self.ends[j + 1])
        _, u, v = np.intersect1d(self.sh[x], self.sh[y], assume_unique=True, return_indices=True)
        least = float(np.minimum(self.count[x][u], self.count[y][v]).sum())
        both = self.total[i] + self.total[j] - least
        return least / both if both else 0.0


def digests(doc_id: int | None, text: str | None, tokens: list[str]) -> tuple[int, int]:
    """128 bits that are equal for equal word sequences (for texts without words: for equal bytes)."""
    if text is None:
        raw = b"\x00null" + repr(doc_id).encode()
    else:
        raw = b"\x01" + " ".join(tokens).encode() if tokens else b"\x02" + text.encode()
    h = hashlib.md5(raw).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def mark():
    """The digest of a row's text; a null text has none."""
    return F.coalesce(F.md5(F.col("text").cast("string")), F.lit(""))


def numbered(df: DataFrame, *by: str) -> DataFrame:
    """df with `rep`, the place of each row in the order of the columns: numbers within ranges, and the rows in the ranges before."""
    split, place = F.spark_partition_id().alias("__split"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__place")
    # written, so that a range's rows keep their numbers
    ordered = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", split, place), "near-reps")
    ranges = ordered.groupBy("__split").agg(F.count("*").alias("n")).orderBy("__split").collect()  # one row a range
    starts, total = [], 0
    for r in ranges:
        starts.append((r["__split"], total))
        total += r["n"]
    first = df.sparkSession.createDataFrame(starts, "__split int, __first long")
    return ordered.join(F.broadcast(first), "__split").withColumn("rep", F.col("__first") + F.col("__place")).drop("__split", "__place", "__first")


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, mark (digest of the text), d1, d2 (digest of the word sequence), keys (bucket of each band; none without words), size (shingles), sketch (a byte of each register)."""

    def run(batches):
        hashes = WordHashes()
        for b in slices(batches, most=1 << 20):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            tokens = [words(t) for t in texts]
            doc, sh, count = shingles(tokens, n, hashes)
            regs = signatures(doc, sh, count, len(tokens), bands * rows)
            keys = band_keys(regs, bands, rows)
            dig = np.array([digests(i, t, w) for i, t, w in zip(ids, texts, tokens, strict=True)], dtype=np.int64).reshape(-1, 2)
            some = np.array([bool(w) for w in tokens], dtype=bool)
            ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1)))
            total = np.bincount(doc, weights=count, minlength=len(tokens)).astype(np.int64)
            sketch = [x.tobytes() for x in (mix64(regs) >> np.uint64(56)).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(dig[:, 0]), pa.array(dig[:, 1]), lists, pa.array(total), pa.array(sketch, pa.binary())], ["doc_id", "mark", "d1", "d2", "keys", "size", "sketch"])

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark().alias("mark"))
    return marked.mapInArrow(run, "doc_id long, mark string, d1 long, d2 long, keys array<long>, size long, sketch binary")


LINKS = "a long, b long, sim double"


def _links(found: list[tuple]) -> pa.Table:
    cols = zip(*found, strict=True) if found else [()] * 3
    return pa.table({c: pa.array(x, k) for c, x, k in zip(("a", "b", "sim"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})


def led(pairs: DataFrame, texts: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """a, b, sim of the pairs (a leader, a member) whose similarity reaches the threshold; a leader's text goes to each block of its members once."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).alias("n"))
    at = stored(pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "n").alias("block")), "near-led")
    members = at.join(texts.select(F.col("rep").alias("b"), "text"), "b").select("a", "block", "b", "text")
    leaders = at.select(F.col("a").alias("lead"), F.col("block").alias("part")).distinct().join(texts.select(F.col("rep").alias("lead"), F.col("text").alias("lead_text")), "lead")

    def run(leader: pa.Table, rows: pa.Table) -> pa.Table:
        if not leader.num_rows:
            return _links([])
        a, b = leader.column("lead")[0].as_py(), rows.column("b").to_pylist()
        both = Shingled([leader.column("lead_text")[0].as_py(), *rows.column("text").to_pylist()], n)
        found = [(a, x, s) for i, x in enumerate(b, 1) if (s := both.similarity(0, i)) >= threshold]
        return _links(found)

    return leaders.groupBy("lead", "part").cogroup(members.groupBy("a", "block")).applyInArrow(run, LINKS)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows (of two or three numbers); beyond that joins shuffle it."""
    return F.broadcast(df) if df.count() <= most else df


def joined_components(comps: DataFrame | None, links: DataFrame, name: str = "near") -> DataFrame:
    """node, comp of all nodes that aren't their own component's smallest, after more links a, b.

    Components hook to the smallest component they are linked with; hooks are followed to their roots by doubling;
    links that still join different components hook again.
    """
    edges = links.select("a", "b")
    if comps is not None:
        edges = relabelled(relabelled(edges, "a", comps), "b", comps)
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), f"{name}-edges")
    while edges.limit(1).count():
        hook = stored(edges.groupBy("hi").agg(F.min("lo").alias("lo")), f"{name}-hooks")
        while True:
            up = small(hook.select(F.col("hi").alias("lo"), F.col("lo").alias("top")))
            new = stored(hook.join(up, "lo", "left").select("hi", F.coalesce("top", "lo").alias("lo"), F.col("top").isNotNull().alias("moved")), f"{name}-hooks")
            hook = new.select("hi", "lo")
            if not new.where("moved").limit(1).count():
                break
        roots = hook.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
        comps = stored(roots if comps is None else relabelled(comps, "comp", roots).unionByName(roots), f"{name}-comps")
        edges = relabelled(relabelled(edges, "hi", roots), "lo", roots).where("hi <> lo")
        edges = stored(edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), f"{name}-edges")
    return comps


def relabelled(df: DataFrame, column: str, comps: DataFrame) -> DataFrame:
    """df with the nodes of a column replaced by their components."""
    new = small(comps.select(F.col("node").alias(column), F.col("comp").alias("__c")))
    return df.join(new, column, "left").withColumn(column, F.coalesce("__c", column)).select(*df.columns)


def classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 6, block: int = 128) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the near-duplicate class), kept (this document stays), text_md5 of every row.

    With the defaults a pair at exactly 0.8 shares a bucket with probability 0.99994.
    """
    sig = stored(signed(docs, n, bands, rows), "near-signed")
    ids = stored(sig.select("doc_id", "mark", "d1", "d2"), "near-ids")
    # a class of equal word sequences by its first row: the smallest id, then the digest of the text
    own = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("own")
    reps = sig.groupBy("d1", "d2").agg(own, F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    reps = numbered(reps.select("own.*", "d1", "d2", "keys", "size", "sketch"), "no_id", "doc_id", "mark", "d1", "d2")
    drop(sig)
    members = stored(_led_members(reps.select("rep", F.explode("keys").alias("key"))), "near-members")
    # only texts with company go on
    own = stored(reps.join(members.select("rep").distinct(), "rep"), "near-own")
    texts = stored(_texts(docs, own.select("rep", "doc_id", "mark")), "near-texts")
    links = stored(led(_first_pairs(members), texts, n, threshold, block), "near-links")
    comps = joined_components(None, links)
    rest = stored(_rest(own, members, texts, comps, n, threshold, bands * rows, block), "near-links")
    comps = joined_components(comps, rest)
    drop(members, own, texts)
    heads = reps.select("rep", F.col("doc_id").alias("class_id"), F.col("mark").alias("class_mark"))
    final = reps.select("d1", "d2", "rep")
    if comps is not None:
        final = relabelled(final, "rep", comps)
    out = ids.join(final.join(heads, "rep").drop("rep"), ["d1", "d2"])
    return out.select("doc_id", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))).alias("kept"), F.col("mark").alias("text_md5"))


def _texts(docs: DataFrame, own: DataFrame) -> DataFrame:
    """rep, text of the representatives, each once."""
    own = small(own.select("rep", F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark().alias("mark"))
    return rows.join(own, (F.col("mark") == F.col("__mark")) & F.col("doc_id").eqNullSafe(F.col("__id"))).groupBy("rep").agg(F.first("text").alias("text"))


def _led_members(keyed: DataFrame) -> DataFrame:
    """rep, key, n (members of the bucket), least and central (its leaders), for buckets with company."""
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowd = stored(keyed.join(many, "key"), "near-crowd")
    company = crowd.groupBy("rep").agg(F.sum("n").alias("company"))
    lead = crowd.join(company, "rep").groupBy("key").agg(F.min("rep").alias("least"), F.min_by("rep", F.struct(-F.col("company"), "rep")).alias("central"))
    return crowd.join(lead, "key")


def _first_pairs(members: DataFrame, most: int = 2) -> DataFrame:
    """a (the leader), b: every member with the `most` leaders that it shares most buckets with."""
    shared = members.select("rep", F.explode(F.array_distinct(F.array("least", "central"))).alias("lead")).where("lead <> rep").groupBy("rep", "lead").agg(F.count("*").alias("n"))
    best = W.partitionBy("rep").orderBy(F.desc("n"), "lead")
    pairs = shared.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most).select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    # two leaders may have each other
    return pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"), F.min_by("b", "a").alias("b")).select("a", "b")


def _rest(own: DataFrame, members: DataFrame, texts: DataFrame, comps: DataFrame | None, n: int, threshold: float, m: int, block: int) -> DataFrame:
    """Links that join the components of every bucket that holds several."""
    at = members.select("rep", F.col("rep").alias("comp"), "key")
    if comps is not None:
        at = relabelled(at, "comp", comps)
    h = F.xxhash64("rep")
    mixed = at.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h)).alias("y")).where("c <> d")
    # buckets with the same members are one
    mixed = mixed.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = at.join(mixed, "key").groupBy("rep").agg(F.min("comp").alias("comp"), F.sort_array(F.collect_list(F.struct("key", "blocks"))).alias("at"))
    placed = stored(placed.join(own.select("rep", "size", "sketch"), "rep"), "near-placed")
    mine = F.pmod(F.xxhash64("rep"), "x.blocks").cast("int")
    units = placed.select("rep", "comp", "size", "sketch", F.col("at.key").alias("keys"), F.explode("at").alias("x")).withColumn("mine", mine)
    # a member meets its own block and every other
    units = units.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("x.blocks") - 1))).select(F.col("x.key").alias("key"), F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), "mine", "rep", "comp", "size", "sketch", "keys")
    need = math.floor(m * threshold - 6 * math.sqrt(m * threshold * (1 - threshold)))

    def candidates(rows: dict) -> list[tuple[int, int, int]]:
        """agreement, i, j of the pairs of a unit that may be links."""
        if not rows["rep"]:
            return []
        key, across = rows["key"][0], rows["i"][0] != rows["j"][0]
        comp, size, side = (np.array(rows[c], dtype=np.int64) for c in ("comp", "size", "mine"))
        sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(comp), -1)
        keys, out = [set(k) for k in rows["keys"]], []
        for i in range(len(comp)):
            ok = (comp[i + 1 :] != comp[i]) & (np.minimum(size[i + 1 :], size[i]) >= (threshold - 1e-9) * np.maximum(size[i + 1 :], size[i]))
            if across:
                ok &= side[i + 1 :] != side[i]
            j = i + 1 + np.flatnonzero(ok)
            agree = (sketch[j] == sketch[i]).sum(axis=1)
            for k in np.flatnonzero(agree >= need):
                # a pair belongs to the smallest bucket that both are in
                if min(keys[i] & keys[j[k]]) == key:
                    out.append((int(agree[k]), i, int(j[k])))
        return out

    def pick(rows: pa.Table) -> pa.Table:
        some = sorted({x for _, i, j in candidates(rows.to_pydict()) for x in (i, j)})
        return rows.take(pa.array(some, pa.int64()))

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.to_pydict()
        texts, top, out = Shingled(rows["text"], n), {}, []

        def root(x):
            while (y := top.get(x, x)) != x:
                top[x] = x = top.get(y, y)
            return x

        for _, i, j in sorted(candidates(rows), reverse=True):
            a, b = root(rows["comp"][i]), root(rows["comp"][j])
            if a != b and (s := texts.similarity(i, j)) >= threshold:
                top[a] = b
                out.append((rows["rep"][i], rows["rep"][j], s))
        return _links(out)

    kind = "key long, i int, j int, mine int, rep long, comp long, size long, sketch binary, keys array<long>"
    picked = stored(units.groupBy("key", "i", "j").applyInArrow(pick, kind), "near-units")
    return picked.join(texts, "rep").groupBy("key", "i", "j").applyInArrow(compare, LINKS)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, one of each class, with their columns."""
    stay = classes(docs.select("doc_id", "text"), **options).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__stay")).distinct()
    keyed = docs.withColumns({"__key": F.col("doc_id").cast("long"), "__mark": mark()})
    left = keyed.join(stay, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__stay")), "left_semi")
    # repeated rows of one doc_id and text count once; they are reduced before the shuffle
    one = left.groupBy("__key", "__mark").agg(F.first(F.struct(*docs.columns)).alias("__row"))
    return one.select("__row.*")
