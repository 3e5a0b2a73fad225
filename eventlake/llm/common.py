"""Helpers shared by the corpus operators: words, scratch tables, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of characters other than space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(c, _UPPER, _LOWER)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """Texts as the bytes that the table holds; bytes that aren't UTF-8 are kept."""
    return column.cast(pa.binary()).to_pylist()


def texts(column: pa.Array) -> list[str | None]:
    """Texts as strings; bytes that aren't UTF-8 become U+FFFD."""
    return [None if t is None else t.decode("utf-8", "replace") for t in raw_texts(column)]


def words(text: str | bytes | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased; none for a null.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is exactly the
    case folding and the white space that the word definition asks for.
    """
    if not text:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split()


def crc_mod(id_column: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a small number; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % F.lit(modulus)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the setting
    is absent, a local master gets a temporary folder (tests); any other raises ValueError."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/scratch-{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(hadoop_path)  # only what exists can be marked
    files.deleteOnExit(hadoop_path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise a small table in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Materialise a large table as Parquet in the shared folder and reread it."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str | None = None, rows: int = 1024, chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has at most ``rows`` rows and, unless one row
    alone is longer, at most about ``chars`` bytes of the column ``text``."""
    for batch in batches:
        start, n = 0, batch.num_rows
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy().tolist() if text else [0] * n
        while start < n:
            stop, total = start, 0
            while stop < n and stop - start < rows and (stop == start or total + sizes[stop] <= chars):
                total += sizes[stop]
                stop += 1
            yield batch.slice(start, stop - start)
            start = stop


def whole_buckets(batches: Iterator[pa.RecordBatch], names: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by ``names``, cut between buckets: each batch has the whole of
    some buckets, and about ``rows`` rows if none alone is larger. The rest isn't held."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = np.zeros(size - 1, bool)
        for name in names:
            values = all_.column(name).to_numpy(zero_copy_only=False)
            new |= values[1:] != values[:-1]
        cuts = np.flatnonzero(new)
        if len(cuts):
            at = int(cuts[-1]) + 1
            yield all_.slice(0, at)
            all_ = all_.slice(at)
        held, size = [all_], all_.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def dealt(rows: DataFrame, bucket: list[str], by: str, most: int) -> DataFrame:
    """Add ``part``, ``low`` and ``high``: a bucket with over ``most`` rows is cut into parts by a
    hash of ``by``, and each pair of parts, (low, high), becomes a bucket of its own, so that all
    its pairs meet in bounded tasks however its rows are spread. Sorted by bucket in partitions."""
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > most)
    large = checkpoint(sizes.select(*bucket, F.ceil(F.col("size") / most).cast("int").alias("parts")))
    marked = rows.join(large, bucket, "left") if large.limit(1).count() else rows.withColumn("parts", F.lit(None).cast("int"))
    marked = marked.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("parts"))).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("low"), F.greatest(p, F.col("part")).alias("high")))
    alone = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))
    whole = [*bucket, "low", "high"]
    return marked.withColumn("pair", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(pairs))).select("*", "pair.low", "pair.high").drop("parts", "pair").repartition(*whole).sortWithinPartitions(*whole)


def starts_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Where each bucket of a sorted batch begins, and the number of rows."""
    new = np.ones(batch.num_rows, bool)
    if batch.num_rows:
        new[1:] = False
    for name in names:
        values = batch.column(name).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def small_side(df: DataFrame, most: int = 50_000) -> DataFrame:
    """A materialised table to join with: broadcast if it has at most ``most`` rows (of a few
    numbers each); a larger one meets by a shuffle, whose skewed partitions Spark splits."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def renamed(df: DataFrame, made: list[str]) -> DataFrame:
    """Rename input columns that an operator is about to make: they get a trailing ``_in``."""
    out = df
    for c in df.columns:
        if c.lower() in {m.lower() for m in made}:
            out = out.withColumnRenamed(c, fresh(out, f"{c}_in"))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])
