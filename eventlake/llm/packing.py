"""Packing token sequences by non-negative least squares over a length histogram.

Documents are cut into full windows and a remainder. Remainders fall into bins of
``quantum`` tokens. The strategies are all combinations of at most ``depth`` bins that
fill a window; NNLS solves how often each should be used for the corpus's histogram
(counted over all documents; the only thing that reaches the driver is a count for
each of at most window/quantum bins). Each task then walks its own rows in buffers of
``buffer`` documents: it repeats the strategies in proportion, rounded and as far as
its bins go, and packs what is left greedily, the longest first, cutting a piece where
one would leave a gap. What a buffer can't fill goes to the next one, so only the last
sequence of a task is padded. No row is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_texts, renamed, slices, written
from .tokens import encoder


@dataclass(frozen=True)
class PackConfig:
    window: int = 2048
    quantum: int = 8
    depth: int = 3
    end_id: int = 1
    #: Documents whose remainders a task packs at once.
    buffer: int = 2048
    vocabulary: str | None = None


def strategies(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Combinations of 1..depth bins (each 1..bins, descending) that sum to ``bins``."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, most: int, slots: int) -> None:
        if left == 0:
            out.append(head)
        elif slots:
            for b in range(min(left, most), 0, -1):
                if b * slots < left:
                    break
                extend((*head, b), left - b, b, slots - 1)

    extend((), bins, bins, depth)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """min |a x - b| over x >= 0, by active sets (Lawson and Hanson). A column that leaves as
    soon as it has entered waits until another one has moved the solution. Raises RuntimeError
    if ``rounds`` (30 for each row of a) don't reach the optimum."""
    n = a.shape[1]
    x, active, waiting = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
    scale = max(float(np.abs(b).max(initial=0.0)), 1.0)
    for _ in range(rounds or 30 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active | waiting] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-7 * scale:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            held = x[at]
            step = float(np.min(held[low] / np.maximum(held[low] - z[low], 1e-300)))
            x[at] = held + step * (z - held)
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
        if active[best]:
            waiting[:] = False
        else:
            waiting[best] = True
    else:
        raise RuntimeError("no optimum within the given rounds")
    return x


def solve(histogram: np.ndarray, config: PackConfig) -> list[tuple[tuple[int, ...], float]]:
    """Strategies and repeat counts for a histogram of remainders by bin (1..window/quantum)."""
    bins = config.window // config.quantum
    # A strategy with a bin that is empty could never be used.
    every = [s for s in strategies(bins, config.depth) if all(histogram[b - 1] > 0 for b in s)]
    if not every:
        return []
    a = np.zeros((bins, len(every)), np.float32)
    for j, s in enumerate(every):
        for b in s:
            a[b - 1, j] += 1
    x = nnls(a, histogram / histogram.sum())
    return [(every[j], float(x[j])) for j in np.flatnonzero(x > 0)]


class Packer:
    """Packs the rows of one task. ``pieces`` collects (row, start, length, sequence, offset)."""

    def __init__(self, plan: list[tuple[tuple[int, ...], float]], config: PackConfig, first_sequence: int):
        self.plan, self.config, self.sequence = sorted(plan, key=lambda p: -p[1]), config, first_sequence
        self.by_bin: list[list[tuple[int, int, int]]] = [[] for _ in range(config.window // config.quantum + 1)]
        self.pieces: list[tuple[int, int, int, int, int]] = []
        self.waiting = 0

    def add(self, row: int, n: int) -> None:
        w = self.config.window
        for start in range(0, n - w + 1, w):
            self._put([(row, start, w)])
        if n % w:
            self._wait((row, n - n % w, n % w))

    def _wait(self, piece: tuple[int, int, int]) -> None:
        self.by_bin[-(-piece[2] // self.config.quantum)].append(piece)
        self.waiting += 1

    def _put(self, parts: list[tuple[int, int, int]]) -> None:
        offset = 0
        for row, start, length in parts:
            self.pieces.append((row, start, length, self.sequence, offset))
            offset += length
        self.sequence += 1

    def pack(self, last: bool) -> None:
        """Pack what waits; unless it's the last call, keep pieces that fill no whole sequence."""
        w, q, by_bin = self.config.window, self.config.quantum, self.by_bin
        share = float(self.waiting)
        for parts, times in self.plan:
            need: dict[int, int] = {}
            for b in parts:
                need[b] = need.get(b, 0) + 1
            for _ in range(min(round(times * share), *(len(by_bin[b]) // k for b, k in need.items()))):
                self._put([by_bin[b].pop() for b in parts])
                self.waiting -= len(parts)
        # Greedily: the longest piece, then the longest that fits, and at the end a cut to fill the gap.
        top = len(by_bin) - 1
        total = sum(p[2] for pieces in by_bin for p in pieces)
        while total >= w or (last and total):
            parts, left = [], w
            at = top
            while left and at:
                while at and not by_bin[at]:
                    at -= 1
                if not at:
                    break
                longest = by_bin[at][-1][2]
                if longest <= left:
                    piece = by_bin[at].pop()
                    parts.append(piece)
                    left -= piece[2]
                    continue
                fit = next((b for b in range(min(at, left // q), 0, -1) if by_bin[b]), 0)
                if fit:
                    piece = by_bin[fit].pop()
                    parts.append(piece)
                    left -= piece[2]
                    continue
                if left < 2 * q:  # not worth a cut
                    break
                row, start, length = by_bin[at].pop()
                parts.append((row, start, left))
                by_bin[-(-(length - left) // q)].append((row, start + left, length - left))
                left = 0
            self._put(parts)
            total -= sum(p[2] for p in parts)
        self.waiting = sum(map(len, by_bin))


def _tokenize(end_id: int, vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for part in slices(batches, "text", rows=512):
            ids, size = enc.batch(raw_texts(part.column("text")))
            ids = np.insert(ids, np.cumsum(size), end_id).astype("<u4")
            offsets = np.append(0, np.cumsum(size + 1) * 4).astype(np.int32)
            made = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), made, pa.array(size + 1, pa.int64())], [*kept, "ids", "doc_tokens"])

    return run


def tokenized(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """doc_id, ids (little-endian 32-bit ids, the end id last) and doc_tokens; a null text is empty."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(_tokenize(config.end_id, config.vocabulary), schema)


def _pack(plan, config: PackConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        packer = Packer(plan, config, (task.partitionId() if task else 0) << 33)
        rows: dict[int, tuple[object, bytes]] = {}
        n = 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            packer.pack(last)
            done, packer.pieces = packer.pieces, []
            for at in range(0, len(done), 4096):
                part = done[at : at + 4096]
                ids = [rows[r][1][4 * s : 4 * (s + k)] for r, s, k, _, _ in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows[r][0] for r, *_ in part], pa.int64()),
                        pa.array([s for _, s, *_ in part], pa.int64()),
                        pa.array([k for _, _, k, *_ in part], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                        pa.array([len(rows[r][1]) // 4 for r, *_ in part], pa.int64()),
                        pa.array([q for *_, q, _ in part], pa.int64()),
                        pa.array([o for *_, o in part], pa.int64()),
                    ],
                    ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
            still = {p[0] for pieces in packer.by_bin for p in pieces}
            for r in [r for r in rows if r not in still]:
                del rows[r]

        held = 0
        for part in slices(batches, "ids", rows=256):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist(), strict=True):
                rows[n] = (doc_id, ids)
                packer.add(n, len(ids) // 4)
                held += len(ids)
                n += 1
            if packer.waiting >= config.buffer or held > 64 << 20:
                yield from out(False)
                held = sum(len(ids) for _, ids in rows.values())
        yield from out(True)

    return run


def packed(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian 32-bit), ids_crc32,
    doc_tokens, sequence_id, offset.

    Each token lies in exactly one piece, and a sequence's offsets have no gaps. A null
    or empty text is its end id alone. Rows with a null or repeated doc_id are packed
    like any other. A text of any length is cut at whole windows. No rows give no rows.
    """
    if config.window % config.quantum:
        raise ValueError("window must be a multiple of quantum")
    rows = written(tokenized(docs, config), "tokens")
    left = F.col("doc_tokens") % config.window
    counts = rows.where(left > 0).groupBy(F.ceil(left / config.quantum).alias("bin")).agg(F.count("*").alias("n")).collect()
    histogram = np.zeros(config.window // config.quantum)
    for r in counts:
        histogram[int(r["bin"]) - 1] = r["n"]
    plan = solve(histogram, config)
    return rows.select("doc_id", "ids").mapInArrow(_pack(plan, config), "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_report(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """The pieces of ``packed`` without their ids."""
    return packed(renamed(docs, []), config).drop("ids")
