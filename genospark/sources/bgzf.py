"""Lines in block-gzip files, as a Python data source `bgzf_lines`: each block is a gzip member of at most 64 KB that says how long it is.

Any gzip program reads such a file whole, and readers that know the blocks begin at any of them: the source splits files by ranges of bytes, looks for the first
block in a range, and hands each line to the range in which the newline before it lies.

A written folder has a file a partition, in order, each with the end marker of the format, and a manifest of the files that count.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the format: the start of a block's header, with the extra field that has its size, and the most bytes of text a block takes.
HEADER = bytes.fromhex("1f8b08040000000000ff0600424302 00".replace(" ", ""))
MOST = 65280


def block(data: bytes) -> bytes:
    """One block.  Empty data gives the format's end marker."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return HEADER + struct.pack("<H", len(HEADER) + 2 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def size_at(raw: bytes, at: int) -> int:
    """The size of the block that begins at a place, 0 if none does."""
    if raw[at : at + len(HEADER)] != HEADER or len(raw) < at + len(HEADER) + 2:
        return 0
    return struct.unpack_from("<H", raw, at + len(HEADER))[0] + 1


def unpacked(raw: bytes) -> bytes:
    data = zlib.decompress(raw[len(HEADER) + 2 : -8], -15)
    crc, n = struct.unpack("<II", raw[-8:])
    if n != len(data) or crc != zlib.crc32(data):
        raise ValueError("a block is damaged")
    return data


def store_of(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path else (files.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.ending = options["path"], options.get("ending", "txt.gz")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name, held = f"part-{part:05d}-{uuid.uuid4().hex}.{self.ending}", b""
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for b in iterator:
                held += "".join(f"{line or ''}\n" for line in b.column("value").to_pylist()).encode()
                while len(held) >= MOST:
                    out.write(block(held[:MOST]))
                    held = held[MOST:]
            if held:
                out.write(block(held))
            out.write(block(b""))
        return Written(part, name)

    def commit(self, messages: list[Written]) -> None:
        store, folder = store_of(self.path)
        names = [m.name for m in sorted((m for m in messages if m is not None), key=lambda m: m.part)]
        with store.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Written]) -> None:
        store, folder = store_of(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.name}")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class Reader(DataSourceReader):
    """value, file, of every line; the rows of a range are in the order of the file."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", 8 << 20))

    def partitions(self) -> list[Range]:
        store, folder = store_of(self.path)
        if store.get_file_info(folder).type == files.FileType.File:
            names = [folder]
        else:
            with store.open_input_stream(f"{folder}/manifest.json") as f:
                names = [f"{folder}/{name}" for name in json.loads(f.read())]
        return [Range(n, at, at + self.split) for n in names for at in range(0, store.get_file_info(n).size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = store_of(self.path)
        with store.open_input_file(partition.file) as f:
            lines = []
            for line in lines_of(f, partition.start, partition.end):
                lines.append(line)
                if len(lines) == 10_000:
                    yield _rows(lines, partition.file)
                    lines = []
            yield _rows(lines, partition.file)


def _rows(lines: list[bytes], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.decode() for x in lines], pa.string()), pa.array([name.rpartition("/")[2]] * len(lines), pa.string())], ["value", "file"])


def first_block(f, start: int, end: int) -> int:
    """Where the first block from `start` on begins; `end` or more if none begins before it."""
    size = f.size()
    f.seek(start)
    raw = f.read(min(size, end + (1 << 17)) - start)
    at = raw.find(HEADER)
    while at >= 0 and start + at < end:
        # a header's bytes may stand in a block by chance; then no other follows where it says
        n = size_at(raw, at)
        if n and (start + at + n == size or size_at(raw, at + n)):
            return start + at
        at = raw.find(HEADER, at + 1)
    return max(end, start)


def blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    """place, text of the blocks from a place on."""
    size = f.size()
    while at < size:
        f.seek(at)
        raw = f.read(1 << 16)
        n = size_at(raw, 0)
        if not n:
            raise ValueError("not a block-gzip file")
        yield at, unpacked(raw[:n])
        at += n


def lines_of(f, start: int, end: int) -> Iterator[bytes]:
    """The lines behind the first newline of the blocks from `start` on (from 0: all), up to the first newline of those from `end` on."""
    at = first_block(f, start, end)
    if at >= min(end, f.size()):
        return
    held, skipping = b"", start > 0
    for place, text in blocks(f, at):
        if skipping:
            if place >= end:
                return
            if b"\n" not in text:
                continue
            text, skipping = text[text.index(b"\n") + 1 :], False
        if place >= end:
            if b"\n" in text:
                yield held + text[: text.index(b"\n")]
                return
            held += text
            continue
        *whole, held = (held + text).split(b"\n")
        yield from whole
    if held:
        yield held


class BgzfLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgzf_lines"

    def schema(self) -> str:
        return "value string, file string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def write_lines(lines: DataFrame, path: str, ending: str = "txt.gz") -> None:
    """One text column, in the order of the partitions and their rows."""
    lines.sparkSession.dataSource.register(BgzfLines)
    lines.select(F.col(lines.columns[0]).alias("value")).write.format("bgzf_lines").option("ending", ending).mode("append").save(path)


def read_lines(spark: SparkSession, path: str, split: int = 8 << 20) -> DataFrame:
    """value, file of the lines of a folder that `write_lines` wrote, or of one block-gzip file."""
    spark.dataSource.register(BgzfLines)
    return spark.read.format("bgzf_lines").option("split", split).load(path)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt, individual, gt of the genotypes of a VCF document in block-gzip files."""
    lines = read_lines(spark, path).select("value")
    head = lines.where("value like '#CHROM%'").first()  # as many names as a row has columns
    names = head["value"].split("\t")[9:] if head else []
    body = lines.where("value <> '' and value not like '#%'").select(F.split("value", "\t").alias("c"))
    each = F.explode(F.zip_with(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.slice("c", 10, max(1, len(names))), lambda n, g: F.struct(n.alias("individual"), g.alias("gt")))).alias("s")
    at = lambda i: F.get("c", F.lit(i))
    return body.select(at(0).cast("long").alias("chrom"), at(1).cast("long").alias("pos"), at(3).alias("ref"), at(4).alias("alt"), each).select("chrom", "pos", "ref", "alt", "s.individual", "s.gt")
