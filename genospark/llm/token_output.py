"""Token ids in files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

Code.  The ids of all documents are counted; the counts (at most one a vocabulary entry) give code lengths of at most `limit` bits by package merging, and lengths alone
give the canonical codes: codes of a length are consecutive numbers in the order of ids.

Files.  Documents are dealt by ranges of doc_id, and each range writes a file through a Python data source, `huffman_tokens`: the code lengths, blocks, and an index
of the blocks.  A block holds whole documents, of `block_ids` ids or a little more, and can be read alone: doc_ids, sizes, a checkpoint every `every` ids (the
bit at which it begins), and the bits.  A checkpoint's ids depend on nothing before it, so that all of a block are decoded side by side, one table look-up
a step, and any stretch of ids can be read from the checkpoint before it (`Block.ids`).  A manifest, written when all tasks have ended, names the files that count, in order, and how
many ids come before each; files of lost or repeated tasks aren't in it.

Encoding.  Texts are cut where the byte-level pattern always ends a piece: before white space that follows other characters, and in texts of Latin letters also around words.  The library encodes
each new piece; short ones of Latin texts are then kept in a table by their bytes, which a worker looks up for all pieces of a batch at once, and some of the others by themselves.  A table that has taken `most` pieces is
emptied.  Tokenizers with another way of cutting get whole texts.  The strings of special tokens in a text are ordinary text.

Edge cases.  A null or empty text is the end id alone.  Rows count each, repeated ones too; rows of one id follow each other by a hash of their texts.  Rows without an id come first.
An empty table gives files without blocks.  A text may have any length.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import drop, scratch, slices, stored

#: Characters with the property White_Space (a fixed value).
BLANK = "\t-\r \x85\xa0  -     　"
#: What a text may be cut into: white space and the characters up to the next white space.
CUT = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
#: The bytes of ASCII and of Latin letters; the letters' second bytes but those of the signs for times and division.
LATIN = bytes([*range(128), 0xC3, *range(0x80, 0xC0)])
LETTER = bytes(chr(b).isalpha() if b < 128 else True for b in range(256))
#: Kinds of pieces: a word (with the blank before it), what stands before a blank and a word or before the end, what stands right before a word, and others.
WORD, FREE, GLUED, MIXED = range(4)
#: Pieces of up to SHORT bytes are two numbers: their bytes, and in the last byte their size and kind. By size, SHORT + 1 for all longer ones.
SHORT = 15
LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(SHORT + 2)], dtype=np.uint64)
HIGH = np.array([(1 << 8 * max(min(n, SHORT) - 8, 0)) - 1 for n in range(SHORT + 2)], dtype=np.uint64)
TAG = np.array([*(n << 56 for n in range(SHORT + 1)), 0xFF << 56], dtype=np.uint64)
MAGIC = b"HTOK0001"
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


class Table:
    """The ids of short pieces by their two numbers, a slot each: a piece that is put where another one stands replaces it."""

    def __init__(self, most: int):
        self.most, bits = most, (4 * most).bit_length()
        self.shift = np.uint64(64 - bits)
        self.low, self.high = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64)
        self.at, self.n = np.zeros(1 << bits, dtype=np.uint32), np.zeros(1 << bits, dtype=np.uint8)
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.held = self.used = 0

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece its slot, the place and number of its ids, and whether it is there."""
        if self.held > self.most:
            self.high[:] = 0
            self.held = self.used = 0
        h = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        slot = (h >> self.shift).astype(np.int64)
        return slot, self.at[slot].astype(np.int64), self.n[slot].astype(np.int64), (self.low[slot] == low) & (self.high[slot] == high)

    def put(self, found: list[bytes], slot: np.ndarray, low: np.ndarray, high: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place and number of the ids of pieces that weren't there. One short piece a slot stays; the others' ids stand until the next call."""
        at = np.flatnonzero(short)
        slots, first = np.unique(slot[at], return_index=True)
        kept = at[first]
        rest = np.ones(len(found), dtype=bool)
        rest[kept] = False
        order = np.concatenate([kept, np.flatnonzero(rest)])
        flat = np.frombuffer(b"".join([found[i] for i in order.tolist()]), dtype="<u4")
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(flat), dtype="<u4")])
        self.ids[self.used : self.used + len(flat)] = flat
        place = np.empty(len(found), dtype=np.int64)
        place[order] = self.used + np.cumsum(n[order]) - n[order]
        self.low[slots], self.high[slots], self.at[slots], self.n[slots] = low[kept], high[kept], place[kept], n[kept]
        self.held += len(kept)
        self.used += int(n[kept].sum())
        return place, n


class Encoder:
    """The ids of texts as little-endian 32-bit numbers."""

    def __init__(self, path: str, most: int = 1_000_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        pre = rules.get("pre_tokenizer") or {}
        self.cuts = rules.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.known, self.most, self.longest, self.table = [{}, {}, {}, {}], most, longest, Table(most)
        # the byte-level vocabulary writes printable bytes as they are, and the others as the signs from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.signs = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, each one piece of the pattern: the merges alone, over the signs that stand for the bytes."""
        raw = b"\n".join(words)
        text = raw.decode("latin-1")
        for b in set(raw).intersection(self.signs) - {10}:
            text = text.replace(chr(b), chr(self.signs[b]))
        merges = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in merges(w)]).tobytes() for w in text.split("\n")]

    def _learn(self, kind: int, new: list[bytes]) -> list[bytes]:
        if not new:
            return []
        if kind == WORD:
            return self._words(new)
        if kind == GLUED:
            # white space before a word is cut otherwise than at the end
            return [x[:-4] for x in self._whole([w.decode() + "a" for w in new])]
        return self._whole([w.decode() for w in new])

    def _ids(self, kind: int, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of a kind; up to half of `most` are remembered by themselves, but those that the table keeps."""
        known = self.known[kind]
        new = set(pieces).difference(known)
        if len(known) + len(new) > self.most // 2:
            known.clear()
            new = set(pieces)
        new = list(new)
        got = dict(zip(new, self._learn(kind, new), strict=True))
        out = [got[x] if x in got else known[x] for x in pieces]
        known.update((x, y) for x, y in got.items() if len(x) <= self.longest and (kind == MIXED or len(x) > SHORT))
        return out

    def _latin(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts of ASCII and Latin letters: pieces are cut and known by their bytes, for all texts at once."""
        if not texts:
            return []
        pad = bytes(16)
        raw = pad + b"".join([x for t in texts for x in (t, pad)])
        data, letter = np.frombuffer(raw, dtype=np.uint8), np.frombuffer(raw.translate(LETTER), dtype=bool)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes + 16)
        starts = ends - sizes
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        first, stop = edge[::2].copy(), edge[1::2].copy()
        seen = np.searchsorted(first, ends)
        words = np.diff(seen, prepend=0)
        some = np.flatnonzero(words)
        # what stands before each word, from the end of the word before or the text's start
        before = np.empty_like(first)
        before[1:] = stop[:-1]
        before[(seen - words)[some]] = starts[some]
        ahead = data[first - 1]
        blank, tied = ahead == 32, ahead == 39
        lo = np.where(tied, before, first - blank)
        gap = np.flatnonzero(lo > before)
        last = starts.copy()
        last[some] = stop[seen[some] - 1]
        # the kind of piece that begins at a byte, plus 1; at a text's end MIXED + 2
        mark = np.zeros(len(raw), dtype=np.uint8)
        mark[before[gap]] = np.where(blank[gap], FREE + 1, GLUED + 1)
        mark[lo] = np.where(tied, MIXED + 1, WORD + 1)
        mark[last] = FREE + 1
        mark[ends] = MIXED + 2
        bound = np.flatnonzero(mark)
        kind = mark[bound]
        piece = np.flatnonzero(kind < MIXED + 2)
        begin, end, kind = bound[piece], bound[piece + 1], kind[piece] - 1
        size = np.minimum(end - begin, SHORT + 1)
        window = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        low, high = window[begin] & LOW[size], window[begin + 8] & HIGH[size]
        high |= TAG[size] | kind.astype(np.uint64) << np.uint64(60)
        slot, place, n, there = self.table.find(low, high)
        short = size <= SHORT
        miss = np.flatnonzero(~(there & short))
        if len(miss):
            found: list[bytes] = [b""] * len(miss)
            for which in range(4):
                mine = np.flatnonzero(kind[miss] == which)
                pieces = [raw[x:y] for x, y in zip(begin[miss[mine]].tolist(), end[miss[mine]].tolist(), strict=True)]
                for i, x in zip(mine.tolist(), self._ids(which, pieces), strict=True):
                    found[i] = x
            place[miss], n[miss] = self.table.put(found, slot[miss], low[miss], high[miss], short[miss])
        upto = np.cumsum(n)
        ids = self.table.ids[np.repeat(place - (upto - n), n) + np.arange(int(upto[-1]) if len(upto) else 0)].tobytes()
        total = np.concatenate([[0], upto])[np.searchsorted(begin, ends)].tolist()
        return [ids[4 * x : 4 * y] for x, y in zip([0, *total[:-1]], total, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._whole(texts)
        raws = [t.encode() for t in texts]
        plain = [not raw.translate(None, LATIN) and b"\xc3\x97" not in raw and b"\xc3\xb7" not in raw for raw in raws]
        ready = iter(self._latin([raw for raw, ok in zip(raws, plain, strict=True) if ok]))
        other = lambda t: b"".join(self._ids(MIXED, [c.encode() for c in CUT.findall(t)]))
        return [next(ready) if ok else other(t) for t, ok in zip(texts, plain, strict=True)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths, 0 for counts of 0: the shortest prefix code with lengths of at most `limit`, by package merging."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, items = [], leaves
    for level in range(limit):
        if level:
            pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([leaves, pairs])
            by = np.argsort(both, kind="stable")
            items, own = both[by], by < len(leaves)
        else:
            own = np.ones(len(leaves), dtype=bool)
        levels.append(np.cumsum(own))
    # from the last level, the first 2n - 2 items: their leaves get a bit, their packages are items of the level before
    lengths, take = np.zeros(len(leaves), dtype=np.int64), 2 * len(leaves) - 2
    for seen in reversed(levels):
        n = int(seen[take - 1]) if take else 0
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


class Code:
    """Canonical codes of the given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths = np.asarray(lengths, dtype=np.uint8)
        self.bits = int(lengths.max()) if len(lengths) and lengths.any() else 1
        used = np.flatnonzero(lengths)
        self.order = used[np.argsort(lengths[used], kind="stable")]
        self.room = np.int64(1) << (self.bits - lengths[self.order].astype(np.int64))
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[self.order] = ((np.cumsum(self.room) - self.room) >> (self.bits - lengths[self.order].astype(np.int64))).astype(np.uint64)

    @functools.cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The id and the length of the code that the next `bits` bits begin with."""
        rest = (1 << self.bits) - int(self.room.sum())
        ids = np.concatenate([np.repeat(self.order, self.room), np.zeros(rest, dtype=np.int64)]).astype(np.uint32)
        sizes = np.concatenate([np.repeat(self.lengths[self.order], self.room), np.ones(rest, dtype=np.uint8)])
        return ids, sizes.astype(np.int64)

    def pack(self, ids: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
        """The bits of the ids, and the bit at which each `every`-th id begins."""
        if not len(ids):
            return b"", np.zeros(0, dtype=np.uint64)
        size = self.lengths[ids].astype(np.int64)
        if not size.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(size)
        begins = ends - size
        word, over = begins >> 6, (begins & 63) + size - 64
        code = self.codes[ids]
        shifted = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(ends[-1] + 63) // 64 + 1, dtype=np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(shifted, first)
        spill = np.flatnonzero(over > 0)
        out[word[spill] + 1] |= code[spill] << (64 - over[spill]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], begins[::every].astype(np.uint64)

    def unpack(self, raw: bytes, begins: np.ndarray, n: int, every: int) -> np.ndarray:
        """n ids from their bits, all checkpoints side by side."""
        if not n:
            return np.zeros(0, dtype="<u4")
        ids, sizes = self.tables
        padded = np.frombuffer(raw + bytes(8), dtype=np.uint8).astype(np.uint32)
        ahead = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        at, last = begins.astype(np.int64), len(ahead) - 1
        out = np.empty((min(every, n), len(at)), dtype="<u4")
        for k in range(len(out)):
            code = (ahead[np.minimum(at >> 3, last)] >> (32 - self.bits - (at & 7)).astype(np.uint32)) & np.uint32((1 << self.bits) - 1)
            out[k] = ids[code]
            at += sizes[code]
        return out.T.reshape(-1)[:n]


@dataclass
class Block:
    """Whole documents as bits."""

    doc_ids: np.ndarray
    known: np.ndarray  # 0 for documents without an id
    sizes: np.ndarray
    begins: np.ndarray
    bits: bytes
    every: int

    @staticmethod
    def of(code: Code, docs: list[tuple[int | None, bytes]], every: int, width: int = 4) -> Block:
        ids = np.frombuffer(b"".join(raw for _, raw in docs), dtype=f"<u{width}")
        bits, begins = code.pack(ids, every)
        return Block(np.array([i or 0 for i, _ in docs], dtype="<i8"), np.array([i is not None for i, _ in docs], dtype=np.uint8), np.array([len(raw) // width for _, raw in docs], dtype="<u8"), begins.astype("<u8"), bits, every)

    def write(self) -> bytes:
        body = b"".join(x.tobytes() for x in (self.doc_ids, self.known, self.sizes, self.begins)) + self.bits
        return struct.pack("<QQII", len(self.doc_ids), len(self.begins), self.every, zlib.crc32(body)) + body

    @staticmethod
    def read(raw: bytes) -> Block:
        n, marks, every, crc = struct.unpack_from("<QQII", raw)
        if zlib.crc32(raw[24:]) != crc:
            raise ValueError("a block of token ids is damaged")
        parts, at = [], 24
        for kind, count in (("<i8", n), ("u1", n), ("<u8", n), ("<u8", marks)):
            parts.append(np.frombuffer(raw, dtype=kind, count=count, offset=at))
            at += parts[-1].nbytes
        return Block(*parts, raw[at:], every)

    def ids(self, code: Code, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from `first` to before `last`, from the checkpoint before the first."""
        total = int(self.sizes.sum())
        last = total if last is None else min(last, total)
        lo = first // self.every
        hi = -(-last // self.every)
        got = code.unpack(self.bits, self.begins[lo:hi], min(total, hi * self.every) - lo * self.every, self.every)
        return got[first - lo * self.every : last - lo * self.every]


def _store(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path else (files.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    n_docs: int
    n_ids: int


class Writer(DataSourceArrowWriter):
    """Writes the rows (doc_id, ids) of each task to a file of its own."""

    def __init__(self, options: dict):
        self.path, self.every, self.block_ids = options["path"], int(options.get("every", 512)), int(options.get("block_ids", 1 << 20))
        self.lengths, self.width = bytes.fromhex(options["lengths"]), int(options.get("width", 4))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        code = Code(np.frombuffer(zlib.decompress(self.lengths), dtype=np.uint8))
        part, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.tokens"
        index, docs, held, ids = [], [], 0, 0
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(MAGIC + struct.pack("<I", len(self.lengths)) + self.lengths)

            def flush():
                nonlocal docs, held, ids
                raw = Block.of(code, docs, self.every, self.width).write()
                index.append((out.tell(), len(raw), ids, held, len(docs)))
                out.write(raw)
                docs, held, ids = [], 0, ids + held

            for b in iterator:
                for doc in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                    docs.append(doc)
                    held += len(doc[1]) // self.width
                    if held >= self.block_ids:
                        flush()
            if docs:
                flush()
            at = out.tell()
            out.write(np.array(index, dtype="<u8").tobytes() + struct.pack("<QQ", at, len(index)) + MAGIC)
        return Written(part, name, sum(x[4] for x in index), ids)

    def commit(self, messages: list[Written]) -> None:
        store, folder = _store(self.path)
        listed, before = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            listed.append({"file": m.name, "start": before, "n_ids": m.n_ids, "n_docs": m.n_docs})
            before += m.n_ids
        with store.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps({"version": 1, "n_ids": before, "files": listed}).encode())

    def abort(self, messages: list[Written]) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.name}")


@dataclass
class Part(InputPartition):
    file: str
    start: int


class Reader(DataSourceReader):
    """A row for each document, from the files that the manifest names."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Part]:
        store, folder = _store(self.path)
        with store.open_input_stream(f"{folder}/manifest.json") as f:
            listed = json.loads(f.read())["files"]
        return [Part(x["file"], x["start"]) for x in listed if x["n_docs"]] or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/{partition.file}") as f:
            code, index = head(f)
            for at, size, first, _, _ in index.tolist():
                f.seek(at)
                block = Block.read(f.read(size))
                ids, ends = block.ids(code), np.cumsum(block.sizes).astype(np.int64)
                begins = ends - block.sizes.astype(np.int64)
                # few documents at a time, as ids take more room than their bits
                step = max(1, len(ends) // (1 + len(ids) // (1 << 20)))
                for k in range(0, len(ends), step):
                    lo, hi = slice(k, k + step), int(ends[min(k + step, len(ends)) - 1])
                    data = pa.py_buffer(ids[int(begins[k]) : hi].tobytes())
                    offsets = np.concatenate([begins[lo], [hi]]) - begins[k]
                    raw = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int64)), data]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids[lo], pa.int64(), mask=block.known[lo] == 0), pa.array(partition.start + first + begins[lo]), pa.array(block.sizes[lo].astype(np.int64)), raw], ["doc_id", "start", "n_tokens", "ids"])


def head(f) -> tuple[Code, np.ndarray]:
    """The code of an open file, and its index: offset, bytes, ids before, ids, documents of each block."""
    if f.read(8) != MAGIC:
        raise ValueError("not a file of token ids")
    code = Code(np.frombuffer(zlib.decompress(f.read(struct.unpack("<I", f.read(4))[0])), dtype=np.uint8))
    f.seek(f.size() - 24)
    at, n, end = struct.unpack("<QQ8s", f.read(24))
    if end != MAGIC:
        raise ValueError("a file of token ids is cut short")
    f.seek(at)
    return code, np.frombuffer(f.read(40 * n), dtype="<u8").reshape(-1, 5)


class HuffmanTokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return "huffman_tokens"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None) -> tuple[DataFrame, int]:
    """doc_id and ids (little-endian numbers) of every row, and one row a split of the documents with the counts of its ids instead; the bytes of a number."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name, tail = tokenizer.rpartition("/")[2], [] if end_id is None else [end_id]
    width = 2 if max(encoder(tokenizer).tokenizer.get_vocab_size(), *tail, 0) <= 1 << 16 else 4

    def run(batches):
        enc, total, rows = encoder(SparkFiles.get(name)), np.zeros(0, dtype=np.int64), 0
        for b in slices(batches, most=1 << 20):
            rows += b.num_rows
            ids = [np.frombuffer(x, dtype="<u4") for x in enc.encode([t or "" for t in b.column("text").to_pylist()])]
            here = np.bincount(np.concatenate(ids), minlength=len(total))
            here[: len(total)] += total
            total = here
            kept = [np.append(x, tail).astype(f"<u{width}").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()), pa.nulls(len(kept), pa.binary())], ["doc_id", "ids", "counts"])
        used = np.flatnonzero(total)
        counts = np.stack([np.append(used, tail), np.append(total[used], [rows for _ in tail])]).astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["doc_id", "ids", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, counts binary"), width


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id stands in all documents, from the rows with counts; as many numbers as the largest id needs reach the driver."""

    def spread(batches):
        for b in batches:
            for raw in b.column("counts").to_pylist():
                id_, n = np.frombuffer(raw, dtype="<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(id_), pa.array(n)], ["id", "n"])

    rows = ids.where("counts is not null").select("counts").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where("n > 0").toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = None, limit: int = 18, block_ids: int = 1 << 20, every: int = 512, part_ids: int = 16 << 20) -> None:
    """Encode every text, with the end id after each, and write the ids in ascending order of doc_id to files of some `part_ids` ids under `path`."""
    spark = docs.sparkSession
    spark.dataSource.register(HuffmanTokens)
    ids, width = encoded(docs, tokenizer, end_id)
    ids = stored(ids, "token-ids")
    counts = id_counts(ids)
    lengths = zlib.compress(code_lengths(counts, limit).tobytes(), 9).hex()
    parts = max(1, -(-int(counts.sum()) // part_ids))
    # rows of one id are dealt by their ids, and equal rows by their places, so that no part is larger for them
    rows = ids.where("counts is null").select("doc_id", "ids").withColumns({"__h": F.xxhash64("ids"), "__at": F.monotonically_increasing_id()})
    by = [F.col("doc_id").asc_nulls_first(), F.col("__h"), F.col("__at")]
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("doc_id", "ids")
    ordered.write.format("huffman_tokens").options(lengths=lengths, width=width, block_ids=block_ids, every=every).mode("append").save(path)
    drop(ids)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian 32-bit numbers) of every document under `path`."""
    spark.dataSource.register(HuffmanTokens)
    return spark.read.format("huffman_tokens").load(path)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """What `read` gives of the files that `write` has put into the shared folder."""
    path = scratch(docs.sparkSession, "token-files")
    write(docs, tokenizer, path, end_id, **options)
    return read(docs.sparkSession, path)
