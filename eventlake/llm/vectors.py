"""Near-duplicate vectors by randomly rotated binary codes with correction factors.

A unit vector is padded and turned by a random rotation; its code is the signs of the
turned components, and its factor is the inner product of the vector with its code's
direction. The turned vector itself is kept in a byte a component, rounded at random
so that it's right on average. ``<code_x, turned_y> / factor_x`` is then an unbiased
estimate of ``<x, y>`` with a known spread, and so is the estimate from y's code; the
lower of their upper bounds counts. Codes, factors and bytes are stored once and are all
that is compared at first: a pair whose bound reaches the threshold is recomputed from the
vectors in double precision, and no other pair is.

Codes meet in ``bands`` hash tables keyed by sign bits of rotations of their own; the
number of bits follows the number of vectors, the number of bands the recall asked for
at the threshold itself (more similar pairs meet more surely). A pair that meets in
several bands is told by the first. No bucket is capped: one with over ``most_bucket``
rows is dealt out as pairs of parts. Pairs to recompute leave a bucket as tiles: two
lists of rows and a bit for each pair of them, so that a dense group costs a bit a pair,
and a tile's vectors are fetched once. Tasks give link counts and a spanning forest of the
links, not the links. Equal vectors are one class with a weight and aren't compared with
each other. With ``recall`` 1 there is one bucket and every pair is recomputed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, dealt, slices, starts_of, whole_buckets, written
from .components import connected_components
from .simhash import codes_of, minimum_labels


@dataclass(frozen=True)
class VectorConfig:
    threshold: float = 0.95
    #: Recall of pairs exactly at the threshold; 1 compares all vectors with each other.
    recall: float = 0.98
    #: Vectors that a bucket should have if they fell evenly.
    even: int = 512
    least_bits: int = 8
    most_bits: int = 30
    #: The bound's number of standard errors.
    errors: float = 4.5
    #: Codes of a bucket that are compared in one piece.
    most_bucket: int = 20_000
    seed: int = 7


def band_settings(n: int, config: VectorConfig) -> tuple[int, int]:
    """(bits, bands) for n vectors: two at the threshold agree on a bit with 1 - angle/pi."""
    agree = 1 - math.acos(config.threshold) / math.pi
    bits = min(config.most_bits, max(config.least_bits, math.ceil(math.log2(max(1, n / config.even)))))
    return bits, math.ceil(math.log(1 - config.recall) / math.log(1 - agree**bits))


def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that no square overflows or vanishes."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    s = scaled(x)
    return s / np.linalg.norm(s, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def code_size(dim: int) -> int:
    """Components of the turned vector: a multiple of 8 that the vector fits in."""
    return max(64, -(-dim // 8) * 8)


def encoded(x: np.ndarray, turn: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: codes (bits as bytes), numbers (correction factor, least component and step
    of the byte form) and a byte for each component."""
    wide = np.zeros((len(x), len(turn)))
    wide[:, : x.shape[1]] = x
    turned = wide @ turn
    factor = np.abs(turned).sum(axis=1) / math.sqrt(len(turn))
    low = turned.min(axis=1)
    step = np.maximum(turned.max(axis=1) - low, 1e-12) / 255
    level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + rng.random(turned.shape)), 0, 255).astype(np.uint8)
    return np.packbits(turned > 0, axis=1), np.stack([factor, low, step], axis=1).astype(np.float32), level


class Codes:
    """Stored codes of some rows, widened for comparing."""

    def __init__(self, code: np.ndarray):
        size = (len(code[0]) - 12) * 8 // 9  # a bit and a byte a component, three numbers
        self.size = size
        self.sign = (np.unpackbits(code[:, : size // 8], axis=1).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(size))
        numbers = np.ascontiguousarray(code[:, size // 8 : size // 8 + 12]).view("<f4")
        self.factor, low, self.step = numbers[:, :1], numbers[:, 1:2], numbers[:, 2:3]
        self.turned = low + code[:, size // 8 + 12 :] * self.step

    def bound(self, other: Codes, config: VectorConfig) -> np.ndarray:
        """Upper bounds of the inner products (row, row of other).

        <code, y> / factor = <x, y> + sqrt(1 - <x, y>^2) * sqrt(1 - factor^2) / factor * u with u of
        deviation 1 / sqrt(size - 1); pairs at or above the threshold have no more noise than those at
        it. A component's rounding has a deviation of half a step at most. Both rows' codes give such
        a bound; a pair needs both.
        """

        def spread(factor: np.ndarray, step: np.ndarray) -> np.ndarray:
            noise = (1 - config.threshold**2) * np.maximum(1 - factor**2, 0) / factor**2 / (self.size - 1)
            return config.errors * np.sqrt(noise + (step / 2) ** 2 / factor**2)

        mine = (self.sign @ other.turned.T) / self.factor + spread(self.factor, other.step.T)
        theirs = (self.turned @ other.sign.T) / other.factor.T + spread(other.factor.T, self.step)
        return np.minimum(mine, theirs)


_CODE = "id long, code binary, packed binary, keys array<int>"


def _encode(dim: int, bits: int, bands: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(code_size(dim), seed)
        turns = [rotation(dim, seed * 1000 + 1 + k) for k in range(-(-bits * bands // dim))]
        weight = (1 << np.arange(bits, dtype=np.int64))[:, None]
        for part in slices(batches, rows=4096):
            x, ids = unit(_matrix(part.column("v"))), part.column("id").to_numpy()
            # The rounding goes by the row, so an attempt that is repeated gives the same codes.
            code, numbers, levels = encoded(x, turn, np.random.Generator(np.random.PCG64([seed, *ids[:1].view(np.uint64).tolist()])))
            whole = np.concatenate([code, numbers.view(np.uint8).reshape(len(x), 12), levels], axis=1)
            if bits:
                signs = np.concatenate([x @ t > 0 for t in turns], axis=1)[:, : bits * bands]
                keys = (signs.reshape(len(x), bands, bits).astype(np.int64) @ weight)[:, :, 0].astype(np.int32)
            else:
                keys = np.zeros((len(x), bands), np.int32)
            packed = keys.astype("<u4").view(np.uint8).reshape(len(x), bands, 4)[:, :, : max(1, -(-bits // 8))]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([r.tobytes() for r in whole], pa.binary()), pa.array([r.tobytes() for r in packed], pa.binary()), lists], ["id", "code", "packed", "keys"])

    return run


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of the links between rows i and j."""
    label = minimum_labels(len(ids), i, j)
    linked = np.flatnonzero(label != np.arange(len(ids)))
    return ids[linked], ids[label[linked]]


_BUCKET = ["band", "key", "low", "high"]
_TILE = "a array<long>, b array<long>, pairs binary"


def _batch(tiles: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([t[c] for t in tiles], pa.list_(pa.int64())) for c in range(2)), pa.array([t[2] for t in tiles], pa.binary())], ["a", "b", "pairs"])


def _candidates(config: VectorConfig, bands: int):
    """Buckets of codes to tiles of the pairs that may reach the threshold and that no earlier
    band has: rows a, rows b, and a bit for each pair of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches, _BUCKET):
            ids, low, high, part, band = (rows.column(c).to_numpy() for c in ("id", "low", "high", "part", "band"))
            code, keys, starts = codes_of(rows.column("code")), codes_of(rows.column("packed")).reshape(rows.num_rows, bands, -1), starts_of(rows, _BUCKET)
            tiles: list[tuple] = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                two = low[s] != high[s]
                first = np.flatnonzero(part[s:e] == low[s]) if two else np.arange(e - s)
                second = np.flatnonzero(part[s:e] != low[s]) if two else first
                for at in range(0, len(first), 512):
                    a = first[at : at + 512]
                    left = Codes(code[s:e][a])
                    for bt in range(0 if two else at, len(second), 4096):
                        b = second[bt : bt + 4096]
                        met = left.bound(Codes(code[s:e][b]), config) >= config.threshold if config.recall < 1 else np.ones((len(a), len(b)), bool)
                        i, j = np.nonzero(met if two else met & (a[:, None] < b[None, :]))
                        if band[s] and len(i):
                            news = np.concatenate([~(keys[s + a[x], : band[s]] == keys[s + b[y], : band[s]]).all(axis=2).any(axis=1) for x, y in ((i[k : k + 65536], j[k : k + 65536]) for k in range(0, len(i), 65536))])
                            i, j = i[news], j[news]
                        if len(i):
                            x, y = np.unique(i), np.unique(j)
                            bit = np.zeros((len(x), len(y)), bool)
                            bit[np.searchsorted(x, i), np.searchsorted(y, j)] = True
                            tiles.append((ids[s + a[x]], ids[s + b[y]], zlib.compress(np.packbits(bit).tobytes(), 1)))
                            if len(tiles) >= 256:
                                yield _batch(tiles)
                                tiles = []
            if tiles:
                yield _batch(tiles)

    return run


def _exact(config: VectorConfig):
    """Tiles with their vectors to rows (id, n, other): links counted, links that span."""

    def links(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs link."""
        ua, ub, out = unit(a), unit(b), np.zeros(len(i), bool)
        if len(i) > 0.1 * len(a) * len(b):
            cosine = (ua @ ub.T)[i, j]
        else:
            cosine = np.concatenate([np.einsum("ij,ij->i", ua[i[k : k + 4096]], ub[j[k : k + 4096]]) for k in range(0, len(i), 4096)])
        out = cosine >= config.threshold
        near = np.flatnonzero(np.abs(cosine - config.threshold) < 1e-9)
        if len(near):  # as close as this, the order of the operations tells
            x, y = scaled(a[i[near]]), scaled(b[j[near]])
            out[near] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= config.threshold
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches, ["tile"], 1 << 13):
            ids, w, nth = (rows.column(c).to_numpy() for c in ("id", "w", "nth"))
            v, pairs, starts = rows.column("v"), rows.column("pairs"), starts_of(rows, ["tile"])
            count, edges = np.zeros(len(ids), np.int64), []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                size = -int(nth[s])  # rows of a come first, numbered from below up to -1
                x = _matrix(v.slice(s, e - s))
                bit = np.unpackbits(np.frombuffer(zlib.decompress(pairs[s].as_py()), np.uint8), count=size * (e - s - size)).reshape(size, -1)
                i, j = np.nonzero(bit)
                hit = links(x[:size], x[size:], i, j)
                i, j = i[hit], j[hit] + size
                np.add.at(count[s:e], i, w[s:e][j])
                np.add.at(count[s:e], j, w[s:e][i])
                # A row may be in both lists.
                names, at = np.unique(ids[s:e], return_inverse=True)
                edges.append(_forest(names, at[i], at[j]))
            counted = np.flatnonzero(count)
            a = np.concatenate([ids[counted], *(x for x, _ in edges)])
            n = np.concatenate([count[counted], np.zeros(len(a) - len(counted), np.int64)])
            b = pa.array(np.concatenate([np.zeros(len(counted), np.int64), *(y for _, y in edges)]), mask=np.arange(len(a)) < len(counted))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), b], ["id", "n", "other"])

    return run


def candidate_tiles(classes: DataFrame, n: int, dim: int, config: VectorConfig = VectorConfig()) -> DataFrame:
    """Tiles (tile, a, b, pairs) of the pairs of classes (id, v) that need to be recomputed, each pair in one tile."""
    bits, bands = band_settings(n, config) if config.recall < 1 else (0, 1)
    codes = written(classes.select("id", "v").mapInArrow(_encode(dim, bits, bands, config.seed), _CODE), "codes")
    rows = dealt(codes.select("id", "code", "packed", F.posexplode("keys").alias("band", "key")), ["band", "key"], "id", config.most_bucket)
    # The tiles' names are stable once written.
    return written(rows.mapInArrow(_candidates(config, bands), _TILE).withColumn("tile", F.monotonically_increasing_id()), "tiles")


def class_links(classes: DataFrame, n: int, dim: int, config: VectorConfig = VectorConfig()) -> DataFrame:
    """Rows (id, n, other) for classes (id, w, v) of ``dim`` components: counts of linked
    rows (other null; sum them by id) and links that span each component (other set)."""
    tiles = candidate_tiles(classes, n, dim, config)
    # Rows of a are numbered below zero, rows of b from zero on; the tile's bits go with its first row.
    row = F.concat(F.transform("a", lambda x, k: F.struct(x.alias("id"), (k - F.size("a")).alias("nth"))), F.transform("b", lambda x, k: F.struct(x.alias("id"), k.alias("nth"))))
    members = tiles.select("tile", "pairs", F.size("a").alias("size"), F.explode(row).alias("m")).select("tile", F.col("m.id").alias("id"), F.col("m.nth").alias("nth"), F.when(F.col("m.nth") == -F.col("size"), F.col("pairs")).alias("pairs"))
    met = members.join(classes.select("id", "w", "v"), "id")
    return met.repartition("tile").sortWithinPartitions("tile", "nth").mapInArrow(_exact(config), "id long, n long, other long")


def near_duplicates(vectors: DataFrame, config: VectorConfig = VectorConfig()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    n_links counts the other rows linked directly, rows of an equal vector included.
    component_id is the least vec_id that links reach. A vector that is null, empty or
    zero, or has a null, NaN or infinite component, links with nothing. Vectors of
    different length never link. A repeated vec_id is two rows; a null vec_id has its
    links counted, and gives its component no id. An empty table gives no rows. Other
    columns aren't looked at. Equal vectors are told by two 64-bit hashes.
    """
    v = F.col("embedding")
    good = F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(good, F.lit(False)), v).alias("v")).select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("k1"), F.xxhash64(F.lit(2), "v").alias("k2"))
    grouped = rows.where(F.col("v").isNotNull()).groupBy("k1", "k2").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"), F.any_value("v").alias("v"))
    # The ids are stable once written.
    classes = written(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    found = None
    for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():
        links = class_links(classes.where(F.size("v") == r["dim"]).select("id", "w", "v"), r["n"], r["dim"], config)
        found = links if found is None else found.union(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "links")
    counts = found.where(F.col("other").isNull()).groupBy("id").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where(F.col("other").isNotNull()).select("id", "other"))
    known = checkpoint(classes.drop("v").join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left").select("k1", "k2", "w", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "id").alias("root")))
    names = checkpoint(known.groupBy("root").agg(F.min("least").alias("component_id")))
    told = checkpoint(known.join(names, "root").select("k1", "k2", (F.col("n") + F.col("w") - 1).alias("n_links"), "component_id"))
    met = rows.drop("v").join(told, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return met.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
