"""Sorted hash arrays in files of the shared folder, and how they travel.

Tasks count keys in numpy and send sorted arrays cut by the keys' top bits, so a shuffle
moves a few large values and a frequent key weighs no more than a rare one. A merged
shard is one file; workers map it into memory and look sorted batches of keys up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs


def planes(values: np.ndarray) -> bytes:
    """Numbers compressed byte by byte: all lowest bytes, then the next, so that bytes that are
    nearly always zero cost nothing and random ones are stored as they are."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return pa.compress(np.ascontiguousarray(raw.T).tobytes(), codec="zstd", asbytes=True)


def unplanes(blob: bytes, n: int, dtype) -> np.ndarray:
    kind = np.dtype(dtype)
    raw = np.frombuffer(pa.decompress(blob, n * kind.itemsize, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).reshape(n)


def pack(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as compressed differences."""
    return planes(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack(blob: bytes, n: int, dtype) -> np.ndarray:
    return np.cumsum(unplanes(blob, n, dtype), dtype=dtype)


def squeeze(values: np.ndarray) -> bytes:
    return planes(values.astype("<u8"))


def widen(blob: bytes, n: int) -> np.ndarray:
    return unplanes(blob, n, "<u8")


def small(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def sorted_counts(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each (one each if not given)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def cut(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the parts of sorted keys by their top bits, empty ones left out."""
    edges = np.concatenate([[0], np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(keys)]])
    for s in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(s), int(edges[s]), int(edges[s + 1])


def runs(sorted_keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """As ``cut``, for few keys and many shards."""
    if not len(sorted_keys):
        return
    shard = (sorted_keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    for a, b in zip(starts, np.append(starts[1:], len(shard)), strict=True):
        yield int(shard[a]), int(a), int(b)


def save(folder: str, name: str, arrays: list[np.ndarray]) -> str:
    """Write arrays one after another, each from a multiple of 8; the path is new for each attempt."""
    fs, path = pa.fs.FileSystem.from_uri(f"{folder}/{name}-{uuid.uuid4().hex}.bin")
    with fs.open_output_stream(path) as out:
        for a in arrays:
            raw = np.ascontiguousarray(a).tobytes()
            out.write(raw + b"\0" * (-len(raw) % 8))
    return path if isinstance(fs, pa.fs.LocalFileSystem) else f"{folder}/{path.rpartition('/')[2]}"


def bytes_of(path: str) -> np.ndarray:
    """The file's bytes, mapped into memory where the shared folder is mounted."""
    if path.startswith("/"):
        return np.memmap(path, np.uint8, "r")
    fs, inner = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_file(inner) as f:
        return np.frombuffer(f.read_buffer(), np.uint8)


def parts_of(raw: np.ndarray, kinds: list[tuple[object, int]]) -> list[np.ndarray]:
    """The arrays of a saved file, by their types and lengths."""
    out, at = [], 0
    for kind, n in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(raw[at : at + size].view(kind))
        at += size + -size % 8
    return out


def by_key(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of one key after another; the partition is sorted by these columns."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[n] for n in names)
            if now is not None and key != now:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if now is not None:
        yield now, rows


class CountTable:
    """Sorted keys with a row of ``width`` counts each, over mapped shards."""

    def __init__(self, files: dict[int, tuple[str, int]], bits: int, width: int):
        self.files, self.bits, self.width, self.open = files, bits, width, {}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is there, its counts or zeros)."""
        there, out = np.zeros(len(keys), bool), np.zeros((len(keys), self.width), np.int64)
        order = np.argsort(keys)
        ordered = keys[order]
        for s, a, b in runs(ordered, self.bits):
            if s in self.files:
                if s not in self.open:
                    path, n = self.files[s]
                    raw = bytes_of(path)
                    self.open[s] = raw[: 8 * n].view("<u8"), raw[8 * n : 8 * n + 4 * n * self.width].view("<u4").reshape(n, self.width)
                known, counts = self.open[s]
                at = np.minimum(np.searchsorted(known, ordered[a:b]), len(known) - 1)
                hit = known[at] == ordered[a:b]
                rows = order[a:b][hit]
                there[rows] = True
                out[rows] = counts[at[hit]]
        return there, out
