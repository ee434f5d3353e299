"""Arrays as compressed bytes, for messages between splits of the texts and ranges of ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(x: np.ndarray) -> bytes:
    """An array as compressed byte planes, with its item size and length in front."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T)
    return bytes([x.itemsize]) + len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpacked(raw: bytes, kind) -> np.ndarray:
    size, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], size * n, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(-1)


def packed_values(x: np.ndarray) -> bytes:
    """Numbers of which many are equal: the distinct ones, and which of them stands where."""
    book, at = np.unique(x, return_inverse=True)
    first = packed(book)
    return len(first).to_bytes(8, "little") + first + packed(at.astype(np.uint32))


def packed_few(x: np.ndarray) -> bytes:
    """`packed_values` where distinct numbers are few: these as they come, unsorted."""
    coded = pa.array(x).dictionary_encode()
    first = packed(coded.dictionary.to_numpy())
    return len(first).to_bytes(8, "little") + first + packed(coded.indices.to_numpy().astype(np.uint32))


def unpacked_values(raw: bytes, kind=np.float64) -> np.ndarray:
    end = 8 + int.from_bytes(raw[:8], "little")
    return unpacked(raw[8:end], kind)[unpacked(raw[end:], np.uint32)]


def packed_ids(ids: np.ndarray) -> bytes:
    """Sorted ids by their differences."""
    return packed(np.diff(ids, prepend=np.uint64(0)))


def unpacked_ids(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in 4 bytes where they fit."""
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)


def whole(raw: bytes) -> np.ndarray:
    return unpacked(raw, np.uint32 if raw[0] == 4 else np.uint64).astype(np.int64)


def bundled(parts: list[bytes]) -> bytes:
    """Several packed arrays as one."""
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def unbundled(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        end = at + 8 + int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : end])
        at = end
    return out


def cuts(ids: np.ndarray, parts: int, bits: int = 64) -> np.ndarray:
    """Where the parts' ranges of ids of that many bits begin and end in sorted ids."""
    bounds = np.array([(p << bits) // parts for p in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(ids, bounds), [len(ids)]])
