"""Mixing sources to target weights by fixed-length blocks.

Each source's documents form one stream of words, in the order of a hash bucket of
the id and then the id; the stream is cut into blocks of ``block`` words. The mix has
as many block slots as the corpus has blocks. They're split among output shards by a
binary tree: at each node a multinomial draw says how many of the left half's slots each
source fills, and the right half takes what is left, so that a source's total hits its
target to within half a block. A node's draw has a seed of its own, so each task draws the
nodes above its own shards and no table of draws passes through the driver. Slot k of a source stands for block ``perm(k mod n)`` of its n blocks,
where a keyed Feistel permutation (a new one for each pass over the source) shuffles
the indexes without a table. Slots and blocks meet in a join by (source, block).

Nothing is random between runs: seeds are fixed, streams have a total order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, renamed, written


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    #: A source gives at most this many times its size.
    most: float = 3.0
    block: int = 128
    #: Slots of an output shard, and the number of shards at which shards grow instead.
    shard_slots: int = 8192
    max_shards: int = 1 << 20
    #: Hash buckets of a source's stream: so many at least, and one for each ``bucket_words`` of the
    #: corpus, so that a source of any size is ordered in bounded tasks.
    buckets: int = 1024
    bucket_words: int = 1 << 25
    seed: int = 20240101
    #: Above this many sources the per-source table is joined, not broadcast.
    broadcast_sources: int = 10_000


def targets(sizes: list[int], weights: tuple[float, ...], most: float) -> list[float]:
    """Share sum(sizes) by repeating weights; none above ``most`` times its size, the
    excess going to the others by weight until none is above."""
    size = np.array(sizes, np.float64)
    w = np.resize(np.array(weights, np.float64), len(sizes))
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), float(sum(sizes))
    while free.any():
        share = left * w / w[free].sum()
        over = free & (share > most * size)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = most * size[over]
        free &= ~over
        left = float(sum(sizes)) - float(out.sum())
    return out.tolist()


def shard_number(total: int, config: MixConfig) -> int:
    return int(min(config.max_shards, max(1, -(-total // config.shard_slots))))


def drawn(left: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """``want`` of the sources' slots by multinomial draws of what they have left; none is overdrawn."""
    got = np.zeros_like(left)
    while want:
        free = left - got
        draw = np.minimum(rng.multinomial(want, free / free.sum()), free)
        got += draw
        want -= int(draw.sum())
    return got


def shard_counts(slots: np.ndarray, shards: int, low: int, high: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source, slots of each source in earlier shards) of the shards from ``low``
    to before ``high``; over all shards the totals are exactly ``slots``. A shard has the same
    counts whichever shards are asked for."""
    total = int(slots.sum())

    def visit(a: int, b: int, counts: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if b <= low or a >= high:
            return
        if b - a == 1:
            yield a, counts, first
            return
        mid = (a + b) // 2
        got = drawn(counts, total * mid // shards - total * a // shards, np.random.Generator(np.random.PCG64([seed, a, b])))
        yield from visit(a, mid, got, first)
        yield from visit(mid, b, counts - got, first + got)

    yield from visit(0, shards, slots, np.zeros_like(slots))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n): four Feistel rounds, walked until inside the range."""
    half = max(1, (int(max(n - 1, 1)).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            mixed = (right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _blocks_of_slots(known, shards: int, step: int, seed: int, chunk: int = 1 << 16):
    """Numbers of groups of ``step`` shards to one row (shard, slot, src, block) for each slot. A keyed
    permutation of a shard's slots mixes its sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots_of, blocks_of = known.value
        for batch in batches:
            for group in batch.column("id").to_pylist():
                for shard, counts, first in shard_counts(slots_of, shards, group * step, min((group + 1) * step, shards), seed):
                    here, before, held, rows = int(counts.sum()), 0, [], 0
                    for src in np.flatnonzero(counts).tolist():
                        n, at, stop_at = int(blocks_of[src]), int(first[src]), int(first[src] + counts[src])
                        while at < stop_at:
                            turn = at // n
                            stop = min(at + chunk, stop_at, (turn + 1) * n)
                            block = permuted(np.arange(at, stop) - turn * n, n, seed * 1_000_003 + src * 31 + turn)
                            slot = permuted(np.arange(at, stop) - int(first[src]) + before, here, seed * 1_000_003 + 500_009 + shard)
                            held.append((slot, np.full(len(block), src, np.int32), block))
                            rows += len(block)
                            at = stop
                            if rows >= chunk:
                                yield _slot_batch(shard, held)
                                held, rows = [], 0
                        before += int(counts[src])
                    if held:
                        yield _slot_batch(shard, held)

    return run


def _slot_batch(shard: int, held: list[tuple]) -> pa.RecordBatch:
    slot, src, block = (np.concatenate(c) for c in zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), shard, np.int32)), pa.array(slot), pa.array(src), pa.array(block)], ["shard", "slot", "src", "block"])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash of the text that tells repeated ids apart."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("hash"))


def _dealt(docs: DataFrame, config: MixConfig) -> tuple[DataFrame, DataFrame]:
    """The slots (shard, slot, src, block), and the rows with their start in their source's stream."""
    spark: SparkSession = docs.sparkSession
    rows = written(sized(docs), "sizes")
    # One row a source: the driver needs their sizes for the shares.
    found = sorted(((r["source"], int(r["size"])) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [s for _, s in found]
    want = targets(sizes, config.weights, config.most)
    n_blocks = [-(-s // config.block) for s in sizes]
    slots = [min(int(config.most * n), round(t * n / s)) if s else 0 for n, s, t in zip(n_blocks, sizes, want, strict=True)]
    total = sum(slots)
    shards = shard_number(total, config)
    groups = min(shards, 4 * spark.sparkContext.defaultParallelism + shards // 64)
    # Two numbers a source go to the tasks; what they draw goes nowhere else.
    shared = spark.sparkContext.broadcast((np.array(slots, np.int64), np.array(n_blocks, np.int64)))
    slots_of = spark.range(0, -(-shards // -(-shards // groups)), 1, groups).mapInArrow(_blocks_of_slots(shared, shards, -(-shards // groups), config.seed), "shard int, slot long, src int, block long")
    names = pa.table({"source": pa.array([name for name, _ in found], pa.string()), "src": pa.array(range(len(found)), pa.int32()), "source_size": pa.array(sizes, pa.int64()), "target": pa.array(want, pa.float64())})
    sources = spark.createDataFrame(names)
    if len(found) <= config.broadcast_sources:
        sources = F.broadcast(sources)
    buckets = max(config.buckets, sum(sizes) // config.bucket_words)

    # The place of each row in its source's stream: sums of whole buckets, then sums inside one.
    known = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(buckets)).cast("int"))
    bucket_sums = known.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = bucket_sums.select("src", "bucket", (F.sum("bucket_size").over(Window.partitionBy("src").orderBy("bucket")) - F.col("bucket_size")).alias("before"))
    inside = Window.partitionBy("src", "bucket").orderBy("doc_id", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = known.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside)).join(before, ["src", "bucket"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    return slots_of, placed


def mixed_blocks(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix by output shard: shard, slot (from 0 in each shard), source, block, words (an
    array; the last block of a source may be short)."""
    slots_of, placed = _dealt(docs, config)
    b = F.lit(config.block)
    texts = docs.select(F.col("doc_id").alias("id_"), F.xxhash64("text").alias("hash_"), "text").dropDuplicates(["id_", "hash_"])
    met = placed.where("size > 0").join(texts, placed["doc_id"].eqNullSafe(texts["id_"]) & (placed["hash"] == texts["hash_"]))
    split = F.array(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    numbers = F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))

    def cut(w, k):
        low = F.greatest(k * b - F.col("start"), F.lit(0))
        return F.struct(k.alias("block"), F.slice(w, (low + 1).cast("int"), (F.least((k + 1) * b - F.col("start"), F.col("size")) - low).cast("int")).alias("words"))

    pieces = met.select("src", "source", "start", F.explode(F.transform(split, lambda w: F.transform(numbers, lambda k: cut(w, k)))[0]).alias("p"))
    blocks = pieces.groupBy("src", "source", "p.block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "p.words"))), lambda x: x["words"])).alias("words"))
    return slots_of.join(blocks.hint("merge"), ["src", "block"]).select("shard", "slot", "source", "block", "words")


def mix_plan(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """How often the mix takes each part of each row: doc_id, source, size, hash,
    source_size, target, taken, and spans (array of from, to, times: words of the row).

    A null or empty text has size 0 and is never taken; a null source is a source of
    its own, the last; a null or repeated doc_id is a row like any other (rows alike in
    all of id, source and text are interchangeable). An empty table gives no rows.
    """
    slots_of, placed = _dealt(docs, config)
    times = slots_of.groupBy("src", "block").agg(F.count("*").alias("times"))
    b = F.lit(config.block)
    last = F.col("start") + F.col("size") - 1
    pieces = placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), F.floor(last / b))).otherwise(F.array(F.lit(-1).cast("long")))))
    pieces = pieces.withColumn("from", F.greatest(F.col("block") * b - F.col("start"), F.lit(0))).withColumn("to", F.least((F.col("block") + 1) * b - F.col("start"), F.col("size")))
    # Both sides grow with the corpus; the hint keeps a low estimate from broadcasting one.
    joined = pieces.join(times.hint("merge"), ["src", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return (
        joined.groupBy("src", "bucket", "start", "nth", "doc_id", "source", "size", "hash", "source_size", "target")
        .agg(F.sum(F.when(F.col("size") > 0, (F.col("to") - F.col("from")) * F.col("times")).otherwise(F.lit(0))).alias("taken"), F.array_sort(F.collect_list(F.when((F.col("size") > 0) & (F.col("times") > 0), F.struct("from", "to", "times")))).alias("spans"))
        .drop("src", "bucket", "start", "nth")
    )


def mixed_documents(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix as documents with the columns of ``docs``: each row's text as often as the
    mix takes it whole, and one more row with the words of the blocks taken once more.

    A part of a text is its words joined by single spaces; ``n_chars``, if there, is the
    length of the new text. Rows that the mix never takes are gone, as are rows without words.
    """
    columns = docs.columns
    plan = mix_plan(docs, config)
    keys = Window.partitionBy("doc_id", "hash", "source").orderBy("size")
    # Rows alike in id, source and text differ only in their place: number them on both sides.
    plan = plan.where(F.col("taken") > 0).withColumn("nth_", F.row_number().over(keys)).select(F.col("doc_id").alias("id_"), F.col("hash").alias("hash_"), F.col("source").alias("source_"), "nth_", F.col("size").alias("size_"), F.col("spans").alias("spans_"))
    # In the order of their other columns, so that a rerun repeats the same ones.
    others = [F.col(c) for c in columns if c not in ("doc_id", "text", "source")]
    mine = Window.partitionBy("doc_id", F.col("hash_in_"), "source").orderBy("other_in_")
    rows = docs.withColumn("hash_in_", F.xxhash64("text")).withColumn("other_in_", F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)).withColumn("nth_in_", F.row_number().over(mine))
    met = rows.join(plan, rows["doc_id"].eqNullSafe(plan["id_"]) & (rows["hash_in_"] == plan["hash_"]) & rows["source"].eqNullSafe(plan["source_"]) & (rows["nth_in_"] == plan["nth_"]))
    whole = F.when(F.aggregate("spans_", F.lit(0).cast("long"), lambda acc, s: acc + s["to"] - s["from"]) == F.col("size_"), F.array_min(F.transform("spans_", lambda s: s["times"]))).otherwise(F.lit(0).cast("long"))
    most = F.array_max(F.transform("spans_", lambda s: s["times"]))
    met = met.withColumn("whole_", whole).withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    taken = F.filter("spans_", lambda s: s["times"] >= F.col("copy_"))
    # One array around the words binds them to a variable: they're split once a row.
    split = F.array(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    part = F.transform(split, lambda w: F.array_join(F.flatten(F.transform(taken, lambda s: F.slice(w, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), " "))[0]
    met = met.withColumn("text_", F.when(F.col("copy_") <= F.col("whole_"), F.col("text")).otherwise(part))
    made = {"text": F.col("text_"), "n_chars": F.length("text_").cast("long")}
    return met.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns])


def mix_report(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    return mix_plan(renamed(docs, []), config).select("doc_id", "size", "source_size", "target", "taken")
