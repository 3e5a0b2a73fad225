"""A bigram or trigram model with interpolated modified Kneser-Ney smoothing, for perplexity.

Counting runs in Spark over all training texts. Tasks count in numpy and send sorted
arrays of keys and counts, cut by the keys' top bits, so a shuffle moves a few large
values and a frequent word weighs no more than a rare one. The model is a folder of
sorted hash arrays in the shared folder: words by XXH64 with counts (frequent words have
small ids, so that what is sent by ids compresses well), bigrams by a bijective mix of both ids with counts, and dense arrays by word id
of context totals, types by count and continuation counts. Of the third order, contexts
by the mix of their two ids, each with its sorted followers and their counts; bigrams
then count the different words before them. Workers map the files into memory and look
sorted batches of keys up; nothing is loaded whole or sent by the driver. Where the
shared folder isn't a mounted file system, shards are read on demand.

Texts begin with as many begin marks as the order needs. A context with a word that
wasn't learned, or that was never seen, leaves the probability to the next shorter one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, raw_texts, renamed, schema_with, scratch_path, slices, words, written
from .hasharrays import by_key, bytes_of, cut, pack, parts_of, planes, runs, save, small, sorted_counts, squeeze, unpack, unplanes, widen

#: Shards of each table are powers of two by the top bits of a key: one for each this many
#: bytes of input, so that a shard's merge stays in a task's memory at any size; and bounds.
SHARD_BYTES = 16 << 20
LEAST_BITS, MOST_BITS = 6, 18
#: Top bits by which a counting task cuts what it sends. More shards are reached in a second step, in
#: which tasks combine what many others have sent before they cut it finer: a row then still holds
#: thousands of keys, and compresses as well as for a small corpus.
FIRST_BITS = 10
#: Hash of the token that ends every text.
END = xxhash.xxh64_intdigest(b"</s>", 1)
#: Words are numbered by the power of two below their count, the most frequent first; so many classes.
CLASSES = 16
#: Tokens that a counting task holds before it sends what it has.
HELD = 1 << 21
#: Keys that a task of the second step combines before it cuts them.
COMBINED = 1 << 22


@dataclass
class Ngrams:
    """What the driver keeps of a model: paths of shards and a few numbers."""

    tokens: int
    vocabulary: int
    word_files: dict[int, tuple[str, int]]
    #: First id of each class of counts and shard.
    word_base: np.ndarray
    bits: int = LEAST_BITS
    order: int = 3
    bigram_files: dict[int, tuple[str, int]] = field(default_factory=dict)
    stat_files: dict[int, tuple[str, int]] = field(default_factory=dict)
    trigram_files: dict[int, str] = field(default_factory=dict)
    trigram_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    bigram_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    bigram_types: int = 0
    #: Probability mass that continuation counts give up, shared by all words and one unknown.
    left_over: float = 0.0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unshift(x: np.ndarray, by: int) -> np.ndarray:
    out, k = x, by
    while k < 64:
        out = x ^ (out >> np.uint64(by))
        k += by
    return out


def unmix(x: np.ndarray) -> np.ndarray:
    x = _unshift(x, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = _unshift(x, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return _unshift(x, 30)


def discounts(of_counts: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of types seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = of_counts
    if not n1 or not n2:
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    made = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(made, (1, 2, 3), strict=True))


BLOBS = "shard int, n long, keys binary, counts binary"


def _blobs(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys, cut by their top bits."""
    rows = [(s, b - a, pack(keys[a:b]), squeeze(counts[a:b])) for s, a, b in cut(keys, bits)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "n", "keys", "counts"])


def word_hashes(text: str | bytes | None) -> list[int]:
    return [*map(xxhash.xxh64_intdigest, words(text)), END]


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a slice, and where each text ends."""
    each = [word_hashes(t) for t in raw_texts(part.column("text"))]
    ends = np.cumsum([len(e) for e in each])
    return np.fromiter(chain.from_iterable(each), np.uint64, int(ends[-1]) if len(each) else 0), ends


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in slices(batches, "text", chars=4 << 20):
            held.append(_tokens(part)[0])
            if sum(map(len, held)) > HELD:
                yield _blobs(*sorted_counts(np.concatenate(held)), bits)
                held.clear()
        if held:
            yield _blobs(*sorted_counts(np.concatenate(held)), bits)

    return run


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return sorted_counts(np.concatenate([unpack(r["keys"], r["n"], "<u8") for r in rows]), np.concatenate([widen(r["counts"], r["n"]) for r in rows]))


def _finer(cut_rows, bits: int):
    """Rows of coarse shards, sorted by shard and salt, to rows of finer ones: what a shard has is
    combined, about COMBINED keys at a time. Rows that tell of files pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                key = row["shard"], row.pop("salt")
                if row.get("path"):
                    yield pa.RecordBatch.from_pylist([row], _PAIRS)
                    continue
                if held and (key != now or size > COMBINED):
                    yield cut_rows(held, bits)
                    held, size = [], 0
                now = key
                held.append(row)
                size += row["n"]
        if held:
            yield cut_rows(held, bits)

    return run


def _finer_words(rows: list[dict], bits: int) -> pa.RecordBatch:
    return _blobs(*_merged(rows), bits)


def _ids_of(row: dict) -> np.ndarray:
    return _both(unpack(row["first"], row["n"], "<u4"), unplanes(row["second"], row["n"], "<u4"))


def _finer_grams(rows: list[dict], bits: int) -> pa.RecordBatch:
    both, counts = np.concatenate([_ids_of(r) for r in rows]), np.concatenate([widen(r["counts"], r["n"]) for r in rows])
    if rows[0]["followers"] is None:
        both, counts = sorted_counts(both, counts)
        return _grams(both, None, counts, bits)
    return _grams(*_sorted_trigrams(both, np.concatenate([unplanes(r["followers"], r["n"], "<u4") for r in rows]), counts), bits)


def _finer_pairs(rows: list[dict], bits: int) -> pa.RecordBatch:
    return _with_files(_finer_grams(rows, bits))


def _by_shard(rows: DataFrame, first: int, bits: int, cut_rows, schema: str) -> DataFrame:
    """Rows cut by the top ``first`` bits (or ``bits``, if these are fewer), by shards of ``bits`` bits."""
    if bits > first:
        # A coarse shard is combined by several tasks, each with the rows of some of those that counted.
        salt = F.pmod(F.spark_partition_id(), F.lit(1 << max(0, bits - first - 2)))
        rows = rows.withColumn("salt", salt).repartition("shard", "salt").sortWithinPartitions("shard", "salt").mapInArrow(_finer(cut_rows, bits), schema)
    return rows.repartition("shard").sortWithinPartitions("shard")


def _classes(counts: np.ndarray) -> np.ndarray:
    """0 for counts of 2 ** 15 and more, down to 15 for 1."""
    return CLASSES - 1 - np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), CLASSES - 1)


def _save_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in by_key(batches, "shard"):
            keys, counts = _merged(rows)
            of = _classes(counts)
            rank = np.zeros(len(keys), "<u4")
            for k in range(CLASSES):
                rank[of == k] = np.arange((of == k).sum())
            path = save(folder, f"words-{shard:03d}", [keys, counts.astype("<u8"), rank])
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n": len(keys), "total": int(counts.sum()), "of_class": np.bincount(of, minlength=CLASSES).tolist()}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("of_class", pa.list_(pa.int64()))]))

    return run


class Words:
    """Word hashes to ids and counts, over mapped shards."""

    def __init__(self, m: Ngrams):
        self.m, self.shards = m, {}

    def _shard(self, s: int) -> list[np.ndarray]:
        if s not in self.shards:
            path, n = self.m.word_files[s]
            self.shards[s] = parts_of(bytes_of(path), [("<u8", n), ("<u8", n), ("<u4", n)])
        return self.shards[s]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each sorted hash; (-1, 0) if it isn't there."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for s, a, b in runs(hashes, self.m.bits):
            if s in self.m.word_files:
                keys, c, rank = self._shard(s)
                at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
                hit = keys[at] == hashes[a:b]
                counts[a:b][hit] = c[at[hit]]
                ids[a:b][hit] = self.m.word_base[_classes(c[at[hit]]), s] + rank[at[hit]]
        return ids, counts


def _pairs(ids: np.ndarray, ends: np.ndarray, begin: int) -> np.ndarray:
    """The id before each token; ``begin`` at a text's start."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[0] = begin
    before[ends[:-1]] = begin
    return before


def _both(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)


GRAMS = "shard int, n long, first binary, second binary, followers binary, counts binary"
_GRAMS = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("followers", pa.binary()), ("counts", pa.binary())])


def _grams(both: np.ndarray, followers: np.ndarray | None, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted pairs of ids, or contexts with followers, cut by the top bits of the pairs' mix and
    sorted by ids within: differences of the first ids, and the small ids of frequent words."""
    shard = mix(both) >> np.uint64(64 - bits)
    order = np.argsort(shard.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
    shard, both, counts = shard[order], both[order], counts[order]
    starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    rows = []
    for a, b in zip(starts, np.append(starts[1:], len(both)), strict=True):
        first, second = (both[a:b] >> np.uint64(32)).astype("<u4"), both[a:b].astype("<u4")
        rows.append({"shard": int(shard[a]), "n": int(b - a), "first": pack(first), "second": planes(second), "followers": None if followers is None else planes(followers[order[a:b]]), "counts": squeeze(counts[a:b])})
    return pa.RecordBatch.from_pylist(rows, _GRAMS)


def _keys_of(row: dict) -> np.ndarray:
    return mix(_ids_of(row))


def _count_ngrams(sent, bits: int):
    """Bigrams, or trigrams as (context, follower), of texts whose words are all learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Ngrams = sent.value
        table, held = Words(m), []

        def counted() -> pa.RecordBatch:
            if m.order == 2:
                both, counts = sorted_counts(np.concatenate([k for k, _ in held]))
                return _grams(both, None, counts, bits)
            return _grams(*_sorted_trigrams(*(np.concatenate(x) for x in zip(*held, strict=True))), bits)

        for part in slices(batches, "text", chars=4 << 20):
            hashes, ends = _tokens(part)
            if not len(hashes):
                continue
            unique, back = np.unique(hashes, return_inverse=True)
            ids = table.find(unique)[0][back]
            before = _pairs(ids, ends, m.vocabulary)
            if m.order == 2:
                held.append((_both(before, ids), None))
            else:
                held.append((_both(before, _pairs(before, ends, m.vocabulary)), ids.astype("<u4")))
            if sum(len(k) for k, _ in held) > HELD:
                yield counted()
                held.clear()
        if held:
            yield counted()

    return run


def _sorted_trigrams(keys: np.ndarray, followers: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, follower) in order, and the sum of the counts of each (one each if not given)."""
    order = np.lexsort((followers, keys))
    keys, followers = keys[order], followers[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (followers[1:] != followers[:-1])))
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts[order], first)
    return keys[first], followers[first], sums


#: Bigrams with the number of words before them, as blobs, and of each file of trigrams its path and numbers.
PAIRS = GRAMS + ", path string, of_counts array<long>"
_PAIRS = pa.schema([*_GRAMS, ("path", pa.string()), ("of_counts", pa.list_(pa.int64()))])


def _with_files(blobs: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*blobs.columns, pa.nulls(blobs.num_rows, pa.string()), pa.nulls(blobs.num_rows, pa.list_(pa.int64()))], schema=_PAIRS)


def _save_trigrams(folder: str, bits: int):
    def pairs(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        both, counts = sorted_counts(np.concatenate(held))
        yield _with_files(_grams(both, None, counts, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for (shard,), rows in by_key(batches, "shard"):
            keys, followers, counts = _sorted_trigrams(*(np.concatenate(x) for x in zip(*((_keys_of(r), unplanes(r["followers"], r["n"], "<u4"), widen(r["counts"], r["n"])) for r in rows), strict=True)))
            path = save(folder, f"trigrams-{shard:03d}", _contexts(keys, followers, counts))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "of_counts": _of_counts(counts)}], _PAIRS)
            held.append(_both(unmix(keys) >> np.uint64(32), followers))
            if sum(map(len, held)) > HELD:
                yield from pairs(held)
                held.clear()
        if held:
            yield from pairs(held)

    return run


def _contexts(keys: np.ndarray, followers: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Arrays of a file of trigrams: contexts seen once and their followers; then those seen fewer
    than 256 times and those seen more: contexts, where their followers begin, followers, counts,
    and of each context its total and its followers seen once and twice. Lengths and sizes first."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    total = np.add.reduceat(counts, first)
    seen = [np.add.reduceat((counts == k).astype(np.int64), first) for k in (1, 2)]
    width = np.diff(np.append(first, len(keys)))
    head, arrays = [int((total == 1).sum())], [keys[first][total == 1], followers[first][total == 1]]
    for these in ((total > 1) & (total < 256), total >= 256):
        inside = np.repeat(these, width)
        narrow = [small(x) for x in (counts[inside], total[these], seen[0][these], seen[1][these])]
        head += [int(these.sum()), int(inside.sum()), *(x.itemsize for x in narrow)]
        arrays += [keys[first][these], np.append(0, np.cumsum(width[these])).astype("<u4"), followers[inside], *narrow]
    return [np.array(head, "<u8"), *arrays]


class Trigrams:
    """Counts of followers of contexts, over mapped shards."""

    def __init__(self, m: Ngrams):
        self.m, self.shards = m, {}

    def _shard(self, s: int) -> list[np.ndarray]:
        if s not in self.shards:
            raw = bytes_of(self.m.trigram_files[s])
            once, *more = (int(x) for x in raw[: 8 * 13].view("<u8"))
            kinds = [("<u8", once), ("<u4", once)]
            for n, inside, *sizes in (more[:6], more[6:]):
                kinds += [("<u8", n), ("<u4", n + 1), ("<u4", inside), *((f"<u{z}", k) for z, k in zip(sizes, (inside, n, n, n), strict=True))]
            self.shards[s] = parts_of(raw[8 * 13 :], kinds)
        return self.shards[s]

    def find(self, keys: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of each context (sorted) and follower: its count, the context's total, and the context's
        followers seen once, twice and more; zeros where there's none."""
        out = np.zeros((5, len(keys)), np.int64)
        for s, a, b in runs(keys, self.m.bits):
            if s not in self.m.trigram_files:
                continue
            once, single, *more = self._shard(s)
            asked, words_asked, o = keys[a:b], words[a:b], out[:, a:b]
            if len(once):
                at = np.minimum(np.searchsorted(once, asked), len(once) - 1)
                hit = once[at] == asked
                o[0][hit] = single[at[hit]] == words_asked[hit]
                o[1][hit] = o[2][hit] = 1
            for known, start, followers, counts, total, n1, n2 in (more[:7], more[7:]):
                if not len(known):
                    continue
                at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                hit = np.flatnonzero(known[at] == asked)
                k, word = at[hit], words_asked[hit]
                low, end = start[k].astype(np.int64), start[k + 1].astype(np.int64)
                o[1][hit], o[2][hit], o[3][hit] = total[k], n1[k], n2[k]
                o[4][hit] = end - low - o[2][hit] - o[3][hit]
                at = _search(followers, word, low, end)
                there = at < end
                there[there] = followers[at[there]] == word[there]
                o[0][hit[there]] = counts[at[there]]
        return out


def _search(values: np.ndarray, wanted: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each wanted value, its place in its own sorted stretch of ``values``."""
    low, high = low.copy(), end.copy()
    left = np.flatnonzero(low < high)
    while len(left):
        middle = (low[left] + high[left]) >> 1
        less = values[middle] < wanted[left]
        low[left[less]] = middle[less] + 1
        high[left[~less]] = middle[~less]
        left = left[low[left] < high[left]]
    return low


#: Of a bigram shard: its file and numbers, or partial sums by word id for a shard of ids.
PARTIAL = "kind string, shard int, path string, n long, size int, keys binary, a binary, b binary, c binary, d binary, of_counts array<long>"
_PARTIAL = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("size", pa.int32()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("of_counts", pa.list_(pa.int64()))])


def _row(**values) -> dict:
    return {name: values.get(name) for name in _PARTIAL.names}


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _wide(vocabulary: int, bits: int) -> int:
    """Word ids of a shard of statistics, which are those with the same lowest bits."""
    return -(-(vocabulary + 1) // (1 << bits))


def _save_bigrams(folder: str, bits: int):
    low = (1 << bits) - 1

    def partial(kind: str, ids: np.ndarray, values: list[np.ndarray]) -> Iterator[dict]:
        order = np.argsort(ids & low, kind="stable")
        shard = (ids & low)[order]
        starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True):
            at = order[a:b]
            yield _row(kind=kind, shard=int(shard[a]), n=int(b - a), keys=pack((ids[at] >> bits).astype("<u8")), **{c: squeeze(v[at]) for c, v in zip("abcd", values, strict=False)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in by_key(batches, "shard"):
            above = [_row(kind="trigrams", shard=shard, path=r["path"], of_counts=r["of_counts"]) for r in rows if r.get("path")]
            if above:
                yield pa.RecordBatch.from_pylist(above, _PARTIAL)
            rows = [r for r in rows if not r.get("path")]
            if not rows:
                continue
            keys, counts = sorted_counts(np.concatenate([_keys_of(r) for r in rows]), np.concatenate([widen(r["counts"], r["n"]) for r in rows]))
            narrow = small(counts)
            path = save(folder, f"bigrams-{shard:03d}", [keys, narrow])
            both = unmix(keys)
            first, second = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
            contexts, back = np.unique(first, return_inverse=True)
            sums = [np.bincount(back, w, len(contexts)).astype(np.int64) for w in (counts.astype(np.float64), counts == 1, counts == 2, counts >= 3)]
            followers, types = np.unique(second, return_counts=True)
            out = [_row(kind="file", shard=shard, path=path, n=len(keys), size=narrow.dtype.itemsize, of_counts=_of_counts(counts)), *partial("context", contexts, sums), *partial("follower", followers, [types])]
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_pylist(out[at : at + 64], _PARTIAL)

    return run


def _save_stats(folder: str, vocabulary: int, bits: int):
    wide = _wide(vocabulary, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in by_key(batches, "shard"):
            total = np.zeros((5, wide), "<i8")  # context total, types seen once, twice, more; continuation count
            for r in rows:
                at = unpack(r["keys"], r["n"], "<u8").astype(np.int64)
                for k, c in zip((0, 1, 2, 3) if r["kind"] == "context" else (4,), "abcd", strict=False):
                    total[k][at] += widen(r[c], r["n"]).astype(np.int64)
            path = save(folder, f"stats-{shard:03d}", [total])
            cont = total[4]
            yield pa.RecordBatch.from_pylist([_row(kind="stats", shard=shard, path=path, n=int((cont > 0).sum()), of_counts=[*_of_counts(cont), int((cont >= 3).sum()), int(cont.sum())])], _PARTIAL)

    return run


def train(docs: DataFrame, bits: int | None = None, order: int = 3, first_bits: int = FIRST_BITS) -> Ngrams:
    """Count all texts of ``docs`` (null: empty) and write the model's files, ``2 ** bits`` of a
    kind (else by the bytes of the texts); counting tasks cut by ``first_bits`` at most. The order is 2 or 3. No rows give a model that calls
    everything unknown."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    folder = scratch_path(spark, "ngrams")
    texts = docs.select("text")
    if bits is None:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        bits = min(MOST_BITS, max(LEAST_BITS, (size // SHARD_BYTES).bit_length()))
    cut_bits = min(bits, first_bits)
    found = written(_by_shard(texts.mapInArrow(_count_words(cut_bits), BLOBS), first_bits, bits, _finer_words, BLOBS).mapInArrow(_save_words(folder), "shard int, path string, n long, total long, of_class array<long>"), "words").collect()
    by = {r["shard"]: r for r in found}
    sizes = np.zeros((CLASSES, 1 << bits), np.int64)
    for s, r in by.items():
        sizes[:, s] = r["of_class"]
    upto = int(sizes.sum())
    base = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
    if upto >= (1 << 32) - 1:
        raise ValueError("more than 2^32 distinct words: ids need a wider key")
    model = Ngrams(sum(r["total"] for r in found), upto, {s: (r["path"], r["n"]) for s, r in by.items()}, base, bits, order)
    if not model.tokens:
        return model
    sent = spark.sparkContext.broadcast(model)  # a path for each shard
    counted = _by_shard(texts.mapInArrow(_count_ngrams(sent, cut_bits), GRAMS), first_bits, bits, _finer_grams, GRAMS)
    if order == 3:
        counted = _by_shard(counted.mapInArrow(_save_trigrams(folder, cut_bits), PAIRS), first_bits, bits, _finer_pairs, PAIRS)
    parts = written(counted.mapInArrow(_save_bigrams(folder, bits), PARTIAL), "bigrams")
    files = parts.where("kind = 'file'").select("shard", "path", "n", "size", "of_counts").collect()
    above = parts.where("kind = 'trigrams'").select("shard", "path", "of_counts").collect()
    stats = written(parts.where("kind IN ('context', 'follower')").repartition("shard").sortWithinPartitions("shard").mapInArrow(_save_stats(folder, upto, bits), PARTIAL), "stats").select("shard", "path", "n", "of_counts").collect()
    total = lambda rows, k: sum(r["of_counts"][k] for r in rows)
    model.bigram_files = {r["shard"]: (r["path"], r["n"], r["size"]) for r in files}
    model.stat_files = {r["shard"]: (r["path"], r["n"]) for r in stats}
    model.trigram_files = {r["shard"]: r["path"] for r in above}
    model.trigram_discounts = discounts([total(above, k) for k in range(4)])
    model.bigram_discounts = discounts([total(files, k) for k in range(4)])
    model.word_discounts = discounts([total(stats, k) for k in range(4)])
    d = model.word_discounts
    model.left_over = d[0] * total(stats, 0) + d[1] * total(stats, 1) + d[2] * total(stats, 4)
    model.bigram_types = total(stats, 5)
    return model


class Scorer:
    """log10 probabilities over mapped shards; one for each worker."""

    def __init__(self, m: Ngrams):
        self.m, self.words, self.trigrams, self.bigrams, self.stats = m, Words(m), Trigrams(m), {}, {}
        self.wide = _wide(m.vocabulary, m.bits)

    def _bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for s, a, b in runs(keys, self.m.bits):
            if s in self.m.bigram_files:
                if s not in self.bigrams:
                    path, n, size = self.m.bigram_files[s]
                    raw = bytes_of(path)
                    self.bigrams[s] = raw[: 8 * n].view("<u8"), raw[8 * n : 8 * n + size * n].view(f"<u{size}")
                known, c = self.bigrams[s]
                at = np.minimum(np.searchsorted(known, keys[a:b]), len(known) - 1)
                hit = known[at] == keys[a:b]
                out[a:b][hit] = c[at[hit]]
        return out

    def _stats(self, ids: np.ndarray) -> np.ndarray:
        """Five statistics of each id (from 0)."""
        out = np.zeros((5, len(ids)), np.int64)
        if not len(ids):
            return out
        low = (1 << self.m.bits) - 1
        order = np.argsort(ids & low, kind="stable")
        shard = (ids & low)[order]
        starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True):
            s, at = int(shard[a]), order[a:b]
            if s in self.m.stat_files:
                if s not in self.stats:
                    self.stats[s] = bytes_of(self.m.stat_files[s][0]).view("<i8").reshape(5, self.wide)
                out[:, at] = self.stats[s][:, ids[at] >> self.m.bits]
        return out

    @staticmethod
    def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0)

    def score(self, hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: known tokens, base score, model score."""
        m, begins = self.m, np.append(0, ends[:-1])
        unique, back = np.unique(hashes, return_inverse=True)
        ids, counts = self.words.find(unique)
        base = np.log10((counts + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1)))
        token, known = ids[back], (counts > 0)[back]
        before = _pairs(token, ends, m.vocabulary)
        # Statistics of each id in this slice, the context of a text's start included.
        own = np.unique(np.append(ids[ids >= 0], m.vocabulary))
        stats = self._stats(own)
        at, ctx = np.searchsorted(own, np.maximum(token, 0)), np.searchsorted(own, np.maximum(before, 0))
        at, ctx = np.minimum(at, len(own) - 1), np.minimum(ctx, len(own) - 1)
        cont = np.where(token >= 0, stats[4][at], 0)
        types = max(m.bigram_types, 1)
        p = (self._discounted(cont, m.word_discounts) + (m.left_over if m.bigram_types else 1.0) / (m.vocabulary + 1)) / types
        total, n1, n2, n3 = (np.where(before >= 0, stats[k][ctx], 0) for k in range(4))
        keys = mix(_both(np.maximum(before, 0), np.maximum(token, 0)))
        pairs, back = np.unique(keys, return_inverse=True)
        c = np.where((before >= 0) & (token >= 0), self._bigram_counts(pairs)[back], 0)
        d = m.bigram_discounts
        seen = total > 0
        safe = np.where(seen, total, 1)
        p = np.where(seen, (self._discounted(c, d) + (d[0] * n1 + d[1] * n2 + d[2] * n3) * p) / safe, p)
        if m.order == 3:
            p = self._third(_pairs(before, ends, m.vocabulary), before, token, p)
        return np.add.reduceat(known.astype(np.int64), begins), np.add.reduceat(base[np.searchsorted(unique, hashes)], begins), np.add.reduceat(np.log10(p), begins)


    def _third(self, first: np.ndarray, second: np.ndarray, token: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities after two words, interpolated with those after one."""
        whole = np.flatnonzero((first >= 0) & (second >= 0))
        keys, words = mix(_both(second[whole], first[whole])), token[whole]
        order = np.lexsort((words, keys))
        whole, keys, words = whole[order], keys[order], words[order]
        distinct = np.append(True, (keys[1:] != keys[:-1]) | (words[1:] != words[:-1]))[: len(keys)]
        c, total, n1, n2, n3 = self.trigrams.find(keys[distinct], words[distinct])[:, np.cumsum(distinct) - 1]
        d, seen = self.m.trigram_discounts, total > 0
        p = p.copy()
        at = whole[seen]
        p[at] = ((self._discounted(c, d) + (d[0] * n1 + d[1] * n2 + d[2] * n3) * p[whole]) / np.maximum(total, 1))[seen]
        return p


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for part in slices(batches, "text", chars=4 << 20):
            hashes, ends = _tokens(part)
            known, base, score = scorer.score(hashes, ends)
            kept = part.schema.names
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)], [*kept, "n_tokens", "n_known", "base_score", "score"])

    return run


def scored(docs: DataFrame, model: Ngrams) -> DataFrame:
    """Add n_tokens (with the end), n_known, base_score and score (log10 probabilities of
    the whole text under smoothed single words, and under the model) to every row.

    A null or empty text is its end alone. Perplexity is ``10 ** (-score / n_tokens)``.
    Columns with these names become ``<name>_in``.
    """
    docs = renamed(docs, ["n_tokens", "n_known", "base_score", "score"])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score(sent), schema_with(docs, ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())))


def split_scores(docs: DataFrame, order: int = 3) -> DataFrame:
    """Learn from rows whose id's crc32 mod 5 isn't 1 and score all rows. A null id is
    neither learned from nor held out."""
    mod = crc_mod(F.col("doc_id"), 5)
    model = train(docs.where(mod != 1), order=order)
    told = scored(docs.select("doc_id", "text"), model)
    return told.select("doc_id", F.coalesce(mod == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
