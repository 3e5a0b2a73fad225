"""Near-duplicates by the Jaccard similarity of word shingles, found by SimHash.

Two texts link where their sets of five-word shingles have a Jaccard similarity of
``least`` (0.8) or more. Equal sets are one class. A class has a fingerprint of
``bits`` bits over its set (a tie has the bit of the least shingle, so that short texts
have even bits too). At similarity ``least`` two fingerprints differ in a known share of
bits, so candidates come from the trie self-join of ``simhash`` with a budget that such
pairs keep but for a few in a million. A trie begins with ``width`` bits of its own random order;
the width follows the number of rows, so that buckets stay small, and the number of
tries follows from the recall asked for at ``least`` itself (more similar pairs meet more
surely). Components of the candidates are then checked exactly: a task reads the texts of
a component and compares pairs that keep the budget and aren't yet connected, so it gives
a forest of exact links, never all pairs. Components with many or long texts are cut into
parts, and each pair of parts is a task; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, raw_texts, slices, written
from .components import connected_components
from .simhash import bit_counts, code_links, codes_of, shingle_hashes


@dataclass(frozen=True)
class NearDupConfig:
    shingle: int = 5
    least: float = 0.8
    bits: int = 256
    #: Standard deviations that the bit budget lies above the mean at ``least``.
    spread: float = 4.5
    #: Share of the pairs at ``least`` itself that should share a bucket.
    recall: float = 0.97
    #: Classes that a bucket should have if they fell evenly.
    even: int = 512
    least_width: int = 8
    most_width: int = 32
    #: Classes of a bucket, and classes and shingles of a part of a component.
    most_bucket: int = 50_000
    most_part: int = 4000
    part_shingles: int = 2_000_000
    leaf_pairs: int = 1 << 16
    seed: int = 7

    def share(self) -> float:
        """Share of bits that differ at similarity ``least``: the angle between the sets."""
        return math.acos(2 * self.least / (1 + self.least)) / math.pi

    def distance(self) -> int:
        p = self.share()
        return min(self.bits, math.ceil(self.bits * p + self.spread * math.sqrt(self.bits * p * (1 - p))))

    def tries(self, n: int) -> tuple[int, int]:
        """(width, number) for n rows: the differing bits of a pair are binomial, and a trie
        brings it together if they all lie outside of its first ``width`` bits."""
        width = min(self.most_width, max(self.least_width, math.ceil(math.log2(max(1, n / self.even)))))
        p, total = self.share(), self.bits
        d = np.arange(self.distance() + 1)
        chance = np.exp([math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1) + k * math.log(p) + (total - k) * math.log1p(-p) for k in d.tolist()])
        apart = np.exp([math.lgamma(total - k + 1) - math.lgamma(total - k - width + 1) - math.lgamma(total + 1) + math.lgamma(total - width + 1) if total - k >= width else -np.inf for k in d.tolist()])
        number = 1
        while (chance * (1 - apart) ** number).sum() > 1 - self.recall:
            number += 1
        return width, number


def shingle_set(text: str | bytes | None, n: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    return np.unique(shingle_hashes(text, n))


def wide_code(s: np.ndarray, bits: int) -> bytes:
    """The fingerprint of a set that isn't empty; further words of bits come from mixed hashes."""
    every = np.empty((len(s), bits // 64), np.uint64)
    for k in range(bits // 64):
        h = s + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        every[:, k] = h ^ (h >> np.uint64(29))
    twice = 2 * bit_counts(every)
    least = np.unpackbits(every[:1].view(np.uint8), axis=1, bitorder="little")[0]
    return np.packbits(np.where(twice == len(s), least, twice > len(s)), bitorder="little").tobytes()


def _sketches(config: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [shingle_set(t, config.shingle) for t in raw_texts(part.column("text"))]
            cls = np.array([xxhash.xxh64_intdigest(s.tobytes(), 1) for s in sets], np.uint64).view(np.int64)
            codes = [wide_code(s, config.bits) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(cls), pa.array(list(map(len, sets)), pa.int64()), pa.array(codes, pa.binary())], ["doc_id", "hash", "cls", "size", "code"])

    return run


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``least`` or more."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], codes: np.ndarray, side: np.ndarray, least: float, distance: int) -> list[tuple[int, int]]:
    """Links that span the components under exact similarity, among pairs that keep the bit
    budget. With two sides, the pairs inside of one belong to another task."""
    n, label, out, two = len(sets), np.arange(len(sets)), [], side.min() != side.max()
    value, size = codes.view(np.uint64), np.array(list(map(len, sets)))
    for i in range(1, n):
        differ = np.bitwise_count(value[:i] ^ value[i]).sum(axis=1, dtype=np.int64)
        fit = (differ <= distance) & (np.minimum(size[:i], size[i]) >= least * np.maximum(size[:i], size[i]))
        if two:
            fit &= side[:i] != side[i]
        near = np.flatnonzero(fit)
        near = near[np.argsort(differ[near], kind="stable")]
        while len(near := near[label[near] != label[i]]):
            j, near = int(near[0]), near[1:]
            if alike(sets[i], sets[j], least):
                label[label == label[i]] = label[j]
                out.append((i, j))
    return out


def _checked(config: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cls, side, codes, sets = None, [], [], [], []

        def settled() -> Iterator[pa.RecordBatch]:
            if len(cls) > 1 and (found := forest(sets, np.stack(codes), np.array(side), config.least, config.distance())):
                yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i, _ in found], pa.int64()), pa.array([cls[j] for _, j in found], pa.int64())], ["a", "b"])

        for part in slices(batches, "text", rows=256):
            rows = zip(*(part.column(n).to_pylist() for n in ("root", "low", "high", "part", "cls")), codes_of(part.column("code")), raw_texts(part.column("text")), strict=True)
            for root, low, high, mine, c, code, text in rows:
                if (root, low, high) != now:
                    yield from settled()
                    now, cls, side, codes, sets = (root, low, high), [], [], [], []
                cls.append(c)
                side.append(mine)
                codes.append(code)
                sets.append(shingle_set(text, config.shingle))
        yield from settled()

    return run


def class_links(classes: DataFrame, n: int, docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """Exact links (a, b) that span the components of classes (cls, code, size, first: doc_id and
    hash of a row); n is their number or more."""
    width, number = config.tries(n)
    rng = np.random.Generator(np.random.PCG64(config.seed))
    orders = np.stack([rng.permutation(config.bits) for _ in range(number)])
    coded = classes.where(F.col("code").isNotNull())
    maybe = code_links(coded.select("code", F.col("cls").alias("rep")), orders, width, config.distance(), most_bucket=config.most_bucket, leaf_pairs=config.leaf_pairs)
    members = checkpoint(coded.join(connected_components(written(maybe, "candidates")), coded["cls"] == F.col("node")).select("root", "cls", "code", "size", "first"))
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / config.most_part), F.ceil(F.sum("size") / config.part_shingles)).cast("int").alias("parts"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(members.select("cls", "first.doc_id", "first.hash"), ["doc_id", "hash"]).dropDuplicates(["cls"]).select("cls", "text")
    met = members.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(2)), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = met.select("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "cls", "code").join(written(texts, "texts"), "cls")
    task = ["root", "low", "high"]
    return rows.repartition(*task).sortWithinPartitions(*task).select(*task, "part", "cls", "code", "text").mapInArrow(_checked(config), "a long, b long")


def deduplicated(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """One row of each component of near-duplicates: that of the least doc_id, and of its
    texts in the component the one whose hash is least. Null texts and texts without words
    are one class. Rows without an id stay; rows alike in id and text are one. Other columns
    come along whatever their names. An empty table gives no rows."""
    known = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    rows = written(known.withColumn("hash", F.xxhash64("text")).mapInArrow(_sketches(config), "doc_id long, hash long, cls long, size long, code binary"), "sketches")
    classes = written(rows.groupBy("cls").agg(F.min(F.struct("doc_id", "hash")).alias("first"), F.any_value("code").alias("code"), F.any_value("size").alias("size")), "classes")
    found = connected_components(written(class_links(classes, classes.count(), known, config), "links"))
    kept = classes.join(found, classes["cls"] == found["node"], "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_"), F.col("first.hash").alias("hash_"))
    nth = fresh(docs, "nth_")
    met = docs.join(kept, (docs["doc_id"] == F.col("kept_")) & (F.xxhash64(docs["text"]) == F.col("hash_")))
    one = met.withColumn(nth, F.row_number().over(Window.partitionBy("kept_", "hash_").orderBy(F.lit(1)))).where(F.col(nth) == 1)
    return one.select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))
