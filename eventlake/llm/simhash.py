"""SimHash near-duplicates by a self-join of binary tries.

A text's fingerprint has the bits that over half of its three-word shingles' hashes
have. Fingerprints link at ``distance`` (3) or fewer differing bits. Equal
fingerprints are one class; classes meet as follows. The 64 bits are cut into
``distance + 1`` blocks; two fingerprints that link agree on a whole block, so a
fingerprint goes into one trie for each block, whose first 16 levels are that block.
Each trie is joined with itself: pairs of nodes are walked together from the end of
the block, differing bits add up, and a pair whose sum exceeds the budget is dropped
with all that is below it. Nodes are ranges of a sorted array, so a level of all pairs
is a few numpy operations. A task reads its buckets one after another and gives a
spanning forest of the links that it found, never all pairs of a dense group. Buckets
with over ``most_bucket`` classes are cut into parts, of which each pair is a bucket of
its own; no bucket is capped.

``neardup`` joins wider fingerprints the same way, from tries of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, dealt, raw_texts, renamed, schema_with, slices, starts_of, whole_buckets, words, written
from .components import connected_components

BITS = 64
_BUCKET = ["tab", "key", "low", "high"]


@dataclass(frozen=True)
class SimHashConfig:
    shingle: int = 3
    distance: int = 3
    #: Classes of a bucket beyond which it is cut into parts.
    most_bucket: int = 50_000
    #: Node pairs with at most so many fingerprint pairs are compared outright.
    leaf_pairs: int = 64


def shingle_hashes(text: str | bytes | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle, repeats included; of all words if there are fewer."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    joined = [b" ".join(w)] if len(w) < n else list(map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False)))
    return np.array([xxhash.xxh64_intdigest(s, 42) for s in joined], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of an array (n, words) of 64-bit numbers have each bit, low bits first."""
    total = np.zeros(BITS * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 1 << 13):  # a bounded matrix of bits for a text of any length
        part = np.ascontiguousarray(hashes[at : at + (1 << 13)]).view(np.uint8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return total


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero for none."""
    return int(np.packbits(2 * bit_counts(hashes[:, None]) > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            made = np.array([fingerprint(shingle_hashes(t, n)) for t in raw_texts(part.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made.view(np.int64))], [*part.schema.names, "fp"])

    return run


def with_fingerprint(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """Add ``fp`` (the 64 bits as a long). A null text and a text without words have 0;
    bytes that aren't UTF-8 are hashed as they are."""
    docs = renamed(docs, ["fp"])
    return docs.mapInArrow(_fingerprints(config.shingle), schema_with(docs, ("fp", T.LongType())))


def _expanded(la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j of the node pairs' ranges."""
    nb, sizes = hb - lb, (ha - la) * (hb - lb)
    which = np.repeat(np.arange(len(la)), sizes)
    k = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i, j = la[which] + k // nb[which], lb[which] + k % nb[which]
    keep = i < j
    return i[keep], j[keep]


def minimum_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def trie_links(value: np.ndarray, roots: list[tuple], distance: int, leaf_pairs: int = 64) -> np.ndarray:
    """Component labels (least index) of sorted fingerprints under links of ``distance`` bits.

    value: the fingerprints (n, words), high bits first, sorted within each root's ranges.
    roots: node pairs to start from, as arrays (low a, high a, low b, high b, bits that
    differ, level).
    """
    n, levels = len(value), BITS * value.shape[1]
    label, cache = np.arange(n), {}
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    held = 0

    def settle() -> None:
        nonlocal label, held
        a = np.concatenate([np.arange(n), *found_a])
        b = np.concatenate([label, *found_b])
        label, held = minimum_labels(n, a, b), 0
        found_a.clear()
        found_b.clear()

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal held
        found_a.append(i)
        found_b.append(j)
        held += len(i)
        if held > 1 << 21:
            settle()

    def compare(la, ha, lb, hb) -> None:
        broad = (ha - la) * (hb - lb) > 512  # enough to compare a whole block at once
        for a, b, c, d in zip(la[broad].tolist(), ha[broad].tolist(), lb[broad].tolist(), hb[broad].tolist(), strict=True):
            differ = np.bitwise_count(value[a:b, None, 0] ^ value[None, c:d, 0]).astype(np.uint16)
            for w in range(1, value.shape[1]):
                differ += np.bitwise_count(value[a:b, None, w] ^ value[None, c:d, w])
            i, j = np.nonzero(differ <= distance)
            above = i + a < j + c
            keep(i[above] + a, j[above] + c)
        la, ha, lb, hb = (x[~broad] for x in (la, ha, lb, hb))
        sizes = np.cumsum((ha - la) * (hb - lb))
        at = 0
        while at < len(la):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 19), side="right")))
            i, j = _expanded(la[at:stop], ha[at:stop], lb[at:stop], hb[at:stop])
            near = np.bitwise_count(value[i] ^ value[j]).sum(axis=1, dtype=np.int64) <= distance
            keep(i[near], j[near])
            at = stop

    def ones_before(level: int) -> np.ndarray:
        if level not in cache:
            cache.clear()
            cache[level] = np.concatenate([[0], np.cumsum((value[:, level // BITS] >> np.uint64(BITS - 1 - level % BITS)) & np.uint64(1)).astype(np.int64)])
        return cache[level]

    stack = list(roots)
    while stack:
        la, ha, lb, hb, d, level = stack.pop()
        small = ((ha - la) * (hb - lb) <= leaf_pairs) | (level >= levels)
        compare(la[small], ha[small], lb[small], hb[small])
        la, ha, lb, hb, d = (x[~small] for x in (la, ha, lb, hb, d))
        if not len(la):
            continue
        c = ones_before(level)
        ma, mb = ha - (c[ha] - c[la]), hb - (c[hb] - c[lb])
        same = (la == lb) & (ha == hb)
        next_ = [(la, ma, lb, mb, d), (ma, ha, mb, hb, d), (la, ma, mb, hb, d + 1), (ma[~same], ha[~same], lb[~same], mb[~same], d[~same] + 1)]
        la, ha, lb, hb, d = (np.concatenate(x) for x in zip(*next_, strict=True))
        alive = (ha > la) & (hb > lb) & (d <= distance) & ~((ha - la == 1) & (la == lb) & (ha == hb))
        la, ha, lb, hb, d = (x[alive] for x in (la, ha, lb, hb, d))
        for at in range(0, len(la), 1 << 20):  # a bounded front
            stack.append((*(x[at : at + (1 << 20)] for x in (la, ha, lb, hb, d)), level + 1))
    settle()
    return label


def _keyed(orders: np.ndarray, width: int):
    """Each code's key in each trie: the first ``width`` bits in that trie's order."""
    weight = 1 << np.arange(width - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=4096):
            bits = np.unpackbits(codes_of(part.column("code")), axis=1)
            keys = np.stack([bits[:, order[:width]].astype(np.int64) @ weight for order in orders], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(orders), dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("code"), part.column("rep"), lists], ["code", "rep", "keys"])

    return run


def codes_of(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def _join_tries(orders: np.ndarray, width: int, distance: int, leaf_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches, _BUCKET):
            starts = starts_of(rows, _BUCKET)
            if len(starts) - 1 == rows.num_rows:  # no bucket has two rows
                continue
            tab, low, part, rep = (rows.column(c).to_numpy() for c in ("tab", "low", "part", "rep"))
            codes = codes_of(rows.column("code"))
            value = np.empty((len(codes), codes.shape[1] // 8), np.uint64)
            for t in np.unique(tab):
                at = np.flatnonzero(tab == t)
                for s in range(0, len(at), 1 << 14):  # a bounded matrix of bits
                    value[at[s : s + (1 << 14)]] = np.ascontiguousarray(np.packbits(np.unpackbits(codes[at[s : s + (1 << 14)]], axis=1)[:, orders[t]], axis=1)).view(">u8")
            bucket = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            second = part != low
            order = np.lexsort((*value.T[::-1], second, bucket))
            value, rep = value[order], rep[order]
            start, stop = starts[:-1], starts[1:]
            middle = stop - np.bincount(bucket, second, len(start)).astype(np.int64)
            lone = rows.column("low").to_numpy()[start] == rows.column("high").to_numpy()[start]
            zero = np.zeros(len(start), np.int64)
            roots = [
                (start[lone], stop[lone], start[lone], stop[lone], zero[lone], width),
                (start[~lone], middle[~lone], middle[~lone], stop[~lone], zero[~lone], width),
            ]
            label = trie_links(value, roots, distance, leaf_pairs)
            linked = np.flatnonzero((label != np.arange(len(label))) & (rep[label] != rep))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[label[linked]])], ["a", "b"])

    return run


def code_links(classes: DataFrame, orders: np.ndarray, width: int, distance: int, *, most_bucket: int, leaf_pairs: int) -> DataFrame:
    """Edges (a, b) of class ids that span, in each bucket, the links of ``distance`` bits.

    classes: ``code`` (binary of one length, a multiple of 8 bytes) and ``rep`` (long).
    orders: the order of the bits in each trie; classes that agree on the first ``width``
    bits of a trie share a bucket.
    """
    keyed = classes.select("code", "rep").mapInArrow(_keyed(orders, width), "code binary, rep long, keys array<long>")
    rows = keyed.select("code", "rep", F.posexplode("keys").alias("tab", "key"))
    return dealt(rows, ["tab", "key"], "rep", most_bucket).mapInArrow(_join_tries(orders, width, distance, leaf_pairs), "a long, b long")


def fingerprint_links(classes: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """Edges (a, b) of class ids that span all links between distinct fingerprints.

    classes: ``fp`` (distinct longs) and ``rep`` (long). Two that link agree on one of
    ``distance + 1`` blocks of bits; a trie for each begins with it.
    """
    width = BITS // (config.distance + 1)
    orders = np.stack([np.roll(np.arange(BITS), -block * width) for block in range(config.distance + 1)])
    coded = classes.select(F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("code"), "rep")
    return code_links(coded, orders, width, config.distance, most_bucket=config.most_bucket, leaf_pairs=config.leaf_pairs)


def near_duplicates(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """doc_id, fp and component_id of every row; see ``_labelled``."""
    return _labelled(docs.select("doc_id", "text"), config)


def _labelled(docs: DataFrame, config: SimHashConfig, whole: bool = False) -> DataFrame:
    """doc_id, fp and component_id of every row.

    component_id is the least doc_id that links reach, the row's own included. Rows
    that repeat a doc_id go by their texts: each has the component of its own text. A
    null doc_id links with nothing and has a null component_id. An empty table gives
    no rows; other columns aren't looked at. With ``whole``, the text's given hash and the
    component's own name (its least fingerprint) come too.
    """
    columns = ["doc_id", "fp", *(["hash"] if whole else [])]
    rows = written(with_fingerprint(docs, config).select(*columns), "fingerprints")
    known = rows.where(F.col("doc_id").isNotNull())
    classes = checkpoint(known.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # Nodes are fingerprints: one id can be the least of several classes.
    found = connected_components(fingerprint_links(classes.select("fp", F.col("fp").alias("rep")), config))
    rooted = checkpoint(classes.join(found, classes["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = checkpoint(rooted.join(least, "root").select("fp", "root", "component_id"))
    told = F.col("doc_id").isNotNull()
    return rows.join(labels, "fp", "left").select("doc_id", "fp", *(F.when(told, F.col(c)).alias(c) for c in ("component_id", "root", "hash") if c == "component_id" or whole))


def deduplicated(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """One row of each group of near-duplicates: that of the least doc_id. Of several texts
    of that id in the group, the one whose hash is least stays. Rows without an id stay."""
    told = _labelled(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")), config, whole=True).where(F.col("doc_id") == F.col("component_id"))
    kept = told.groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("k")).select(F.col("k.doc_id").alias("kept_"), F.col("k.hash").alias("hash_"))
    met = docs.join(kept, (docs["doc_id"] == F.col("kept_")) & (F.xxhash64(docs["text"]) == F.col("hash_"))).withColumn("nth_", F.row_number().over(Window.partitionBy("kept_", "hash_").orderBy(F.lit(1))))
    return met.where("nth_ = 1").select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))
