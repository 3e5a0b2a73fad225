"""Vector code compression: product codes, found exactly behind segment-mean lower bounds.

Vectors become integers and are cut into parts; a part's code is the nearest entry of that
position's codebook. An entry is left out where a lower bound of its distance exceeds the
distance of an entry already looked at. For any cut of a part into blocks,

    |x - c|^2 >= sum over blocks of length * (mean(x) - mean(c))^2 + (rest(x) - rest(c))^2,

``rest`` being the norm of what the block means leave. The bound is taken with one block,
then with finer and finer blocks, each leaving out more; what survives gets exact integer
distances. Bounds are in double precision and are lowered by more than their rounding,
so an entry is never left out wrongly, ties included.

A round is one scan: tasks assign their rows and give counts and sums of each entry, at
most 4 * 256 rows a task and vector length; these are added up by key. Only the codebooks
pass through the driver (256 vectors of a length) and go to the tasks by broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, slices, small_side, written


@dataclass(frozen=True)
class CodebookConfig:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    #: Blocks of the lower bounds, from coarse to fine.
    blocks: tuple[int, ...] = (1, 2, 4, 8)


#: Entries of the least bounds whose distances are computed before the finest level filters.
LOOKS = 8


class Bounds:
    """Block means and residual norms of rows, at every fineness: rows of numbers whose squared
    distance is at most that of the rows themselves."""

    def __init__(self, x: np.ndarray, blocks: tuple[int, ...]):
        self.x = x
        wide = x.astype(np.float64)
        self.norm = (wide * wide).sum(axis=1)
        self.levels = []
        for b in sorted({min(b, x.shape[1]) for b in blocks}):
            edge = np.linspace(0, x.shape[1], b + 1).astype(int)
            size = np.diff(edge)
            mean = np.add.reduceat(wide, edge[:-1], axis=1) / size
            rest = np.sqrt(((wide - np.repeat(mean, size, axis=1)) ** 2).sum(axis=1))
            self.levels.append(np.concatenate([mean * np.sqrt(size), rest[:, None]], axis=1))


def _distances(x: np.ndarray, i: np.ndarray, c: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of row pairs, some at a time: integers, held as doubles where these
    hold all numbers that come up."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * largest * largest * x.shape[1] < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
    out = np.empty(len(i), np.int64)
    step = max(1, (1 << 17) // x.shape[1])
    for at in range(0, len(i), step):
        d = np.take(x, i[at : at + step], axis=0)
        d -= np.take(c, j[at : at + step], axis=0)
        out[at : at + step] = np.einsum("ij,ij->i", d, d)
    return out


def assigned(x: np.ndarray, book: Bounds, blocks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of integer rows: the index of the nearest entry (the lower of equals), its squared
    distance, and how many distances were computed exactly. A level's bounds are one matrix
    product for all rows; an entry that a coarser level has left out stays out."""
    rows, exact, best = Bounds(x, blocks), 0, None
    # More than the rounding of the bounds and of their sums, which are of numbers this large.
    slack = 1e-11 * (rows.norm[:, None] + book.norm[None, :])
    kept = np.ones(slack.shape, bool)
    for mine, theirs in zip(rows.levels, book.levels, strict=True):
        bound = (mine * mine).sum(axis=1)[:, None] + (theirs * theirs).sum(axis=1)[None, :] - 2 * (mine @ theirs.T) - slack
        bound[~kept] = np.inf
        # A row's entries of the least bounds are looked at: the nearest so far makes the filter sharp.
        looks = min(LOOKS if mine is rows.levels[-1] else 1, bound.shape[1])
        at = np.argpartition(bound, looks - 1, axis=1)[:, :looks] if looks > 1 else bound.argmin(axis=1)[:, None]
        found = _distances(x, np.repeat(np.arange(len(x)), looks), book.x, at.ravel()).reshape(-1, looks).min(axis=1)
        exact += looks * len(x)
        best = found if best is None else np.minimum(best, found)
        kept = bound <= best[:, None]
    i, j = np.nonzero(kept)
    found = _distances(x, i, book.x, j)
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    smallest = np.minimum.reduceat(found, starts)
    hit = np.flatnonzero(found == np.repeat(smallest, np.diff(np.append(starts, len(i)))))
    first = hit[np.flatnonzero(np.diff(i[hit], prepend=-1))]
    return j[first], smallest, exact + len(i)


def most_component(size: int) -> int:
    """The largest integer component whose exact distances fit in 63 bits, for vectors of a size."""
    return int((2**62 / size) ** 0.5) // 2


def integers(vectors: DataFrame, config: CodebookConfig = CodebookConfig()) -> DataFrame:
    """Rows (vec_id, label, size, x) of the vectors that are kept: floor(scale * component),
    zeros added up to a multiple of the parts. Components beyond ``most_component`` (131,072
    for 64 of them) are taken as that, so that sums and distances stay exact."""
    v = F.col("embedding")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", "label", v.alias("v"))
    size = F.greatest(F.ceil(F.size("v") / config.parts), F.lit(1)).cast("int") * config.parts
    most = F.floor(F.floor(F.sqrt(F.lit(float(2**62)) / F.col("size"))) / 2)
    number = F.transform("v", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double"), F.lit(1e15)), F.lit(-1e15)) * config.scale), F.col("most")), -F.col("most")).cast("int"))
    wide = rows.withColumn("size", size).withColumn("most", most)
    return wide.select("vec_id", "label", "size", F.concat(number, F.array_repeat(F.lit(0), F.col("size") - F.size("v"))).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for part in slices(batches, rows=1024):
        sizes = part.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            yield size, part.filter(pa.array(sizes == size))


def starting(rows: DataFrame, config: CodebookConfig = CodebookConfig()) -> dict[int, np.ndarray]:
    """By vector size the parts (position, entry, component) of the vectors with the smallest
    ids: at most ``entries`` vectors a size come to the driver. Rows without an id come last,
    rows of one id in the order of their components."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    some = rows.select("vec_id", "size", "x", F.pmod(F.spark_partition_id(), F.lit(256)).alias("some"))
    # Each task keeps its first ones; groups of tasks do, then all: no task gets the rows of very many.
    for keys in (["size", "some"], ["size"]):
        some = some.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= config.entries)
    found: dict[int, list] = {}
    for r in some.select("size", "nth", "x").orderBy("size", "nth").collect():
        found.setdefault(r["size"], []).append(r["x"])
    return {size: np.array(xs, np.int64).reshape(len(xs), config.parts, -1).transpose(1, 0, 2).copy() for size, xs in found.items()}


def _sums(books, config: CodebookConfig):
    """Rows to (size, part, entry, sums): of each entry's rows the component sums, and at the end their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {size: [Bounds(b, config.blocks) for b in book] for size, book in books.value.items()}
        total = {size: np.zeros((*book.shape[:2], book.shape[2] + 1), np.int64) for size, book in books.value.items()}
        for size, part in _by_size(batches):
            x = _matrix(part.column("x")).reshape(part.num_rows, config.parts, -1)
            for p, book in enumerate(known[size]):
                index, _, _ = assigned(x[:, p], book, config.blocks)
                np.add.at(total[size][p], index, np.concatenate([x[:, p], np.ones((len(x), 1), np.int64)], axis=1))
        for size, sums in total.items():
            p, e = np.nonzero(sums[:, :, -1])
            if len(p):
                flat = sums[p, e]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), size, np.int32)), pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), lists], ["size", "part", "entry", "sums"])

    return run


def improved(rows: DataFrame, books: dict[int, np.ndarray], config: CodebookConfig = CodebookConfig()) -> dict[int, np.ndarray]:
    """One round: every part goes to its nearest entry, entries become the floor of their parts' means."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    sums = rows.select("size", "x").mapInArrow(_sums(shared, config), "size int, part int, entry int, sums array<long>")
    added = sums.select("size", "part", "entry", F.posexplode("sums").alias("at", "v")).groupBy("size", "part", "entry", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    got: dict[tuple, dict[int, int]] = {}
    for r in added.collect():  # a number for each component of the codebooks
        got.setdefault((r["size"], r["part"], r["entry"]), {})[r["at"]] = int(r["v"])
    shared.unpersist()
    new = {size: book.copy() for size, book in books.items()}
    for (size, p, e), v in got.items():
        last = len(v) - 1
        new[size][p, e] = [v[k] // v[last] for k in range(last)]
    return new


def digest(book: np.ndarray) -> str:
    """SHA-256 of a codebook's components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, books: dict[int, np.ndarray], config: CodebookConfig = CodebookConfig()) -> DataFrame:
    """Rows (vec_id, label, code, error, codebooks_sha256) by given codebooks."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kind = {"vec_id": rows.schema["vec_id"].dataType.simpleString(), "label": rows.schema["label"].dataType.simpleString()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {size: ([Bounds(b, config.blocks) for b in book], digest(book)) for size, book in shared.value.items()}
        for size, part in _by_size(batches):
            x = _matrix(part.column("x")).reshape(part.num_rows, config.parts, -1)
            found = [assigned(x[:, p], book, config.blocks) for p, book in enumerate(known[size][0])]
            codes = np.stack([index for index, _, _ in found], axis=1).astype(np.uint8)
            error = sum(d for _, d, _ in found)
            columns = [part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error), pa.array([known[size][1]] * part.num_rows)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return rows.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long, codebooks_sha256 string")


def trained(rows: DataFrame, config: CodebookConfig = CodebookConfig()) -> dict[int, np.ndarray]:
    """Codebooks of integer rows, by vector size."""
    books = starting(rows, config)
    for _ in range(config.rounds):
        books = improved(rows, books, config)
    return books


def coded(vectors: DataFrame, config: CodebookConfig = CodebookConfig()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that can be coded.

    Vectors that are null or hold null, NaN or infinite components are dropped. Lengths have
    codebooks of their own; a length that the parts don't divide is filled up with zeros, and an
    empty vector is all zeros. With fewer vectors than entries a codebook has as many entries as
    vectors. Repeated rows and ids count as often as they come; a null id is coded like any
    other, and starts an entry only if ids are too few. A null label is a label. An empty
    table, or one with no vector to code, gives no rows. Other columns aren't looked at.
    """
    rows = written(integers(vectors, config), "integers")
    told = written(encoded(rows, trained(rows, config), config), "codes")
    sums = checkpoint(told.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    met = told.join(small_side(sums), F.col("label").eqNullSafe(F.col("_label")), "left")
    return met.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle(config: CodebookConfig = CodebookConfig()) -> str:
    """Plain exhaustive rounds for vectors of one length that the parts divide, in SQL."""
    near = """a{r} AS (SELECT rid, p, m // 256 AS d, m % 256 AS e FROM (
  SELECT rid, x.p, min(256 * list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x.c, b.c)])::BIGINT + b.e) AS m
  FROM x JOIN b{r} b ON x.p = b.p GROUP BY rid, x.p))"""
    step = """s{r} AS (SELECT p, e, list(v ORDER BY pos) AS c FROM (
  SELECT p, e, pos, (s - ((s % n) + n) % n) // n AS v FROM (
    SELECT a.p, a.e, u.pos, sum(u.v)::BIGINT AS s, count(*) AS n
    FROM a{r} a JOIN (SELECT rid, p, unnest(c) AS v, generate_subscripts(c, 1) AS pos FROM x) u ON a.rid = u.rid AND a.p = u.p GROUP BY a.p, a.e, u.pos)) GROUP BY p, e),
b{n} AS (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{r} b LEFT JOIN s{r} s ON b.p = s.p AND b.e = s.e)"""
    last = config.rounds
    rounds = ",\n".join(near.format(r=r) + ",\n" + step.format(r=r, n=r + 1) for r in range(last))
    return f"""WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid, vec_id, label, v FROM (
    SELECT vec_id, label, [floor({config.scale} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND coalesce(len([x for x in embedding if x IS NULL OR NOT isfinite(x)]), 0) = 0)),
x AS MATERIALIZED (SELECT rid, p, v[p * len(v) // {config.parts} + 1 : (p + 1) * len(v) // {config.parts}] AS c FROM k, (SELECT unnest(range({config.parts})) AS p)),
b0 AS (SELECT p, rid AS e, c FROM x WHERE rid < {config.entries}),
{rounds},
{near.format(r=last)},
told AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY rid),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN told USING (rid), sha""".replace("AS (SELECT rid, p, m", "AS MATERIALIZED (SELECT rid, p, m")


ORACLE_SQL = _oracle()
