"""The ``winlog`` data source: log files as partitioned, fault-tolerant relations.

A partition is a range of chunks of one file, so a large file is many tasks. The files
are listed and read through pyarrow's file systems (local paths, ``file:`` and the
schemes that pyarrow knows); where only Spark reaches a store, ``decode_files`` decodes
files that Spark's own ``binaryFile`` reader delivers.

Options: ``view`` (records, arrow, chunks, record_headers, template_instances, states, files),
``mode`` (permissive, dropmalformed, failfast), ``separateAttributes``, ``xml``,
``json``, ``indent``, ``ansiCodec``, ``validateChecksums``, ``chunksPerPartition`` (256, or
more so that a scan has at most 50,000 tasks), ``recursive``, ``extensions``,
``templateCache``, ``recordIds``, ``limit``, ``packed``, ``firstRanges``.

A scan's ranges of chunks are tasks. With ``packed`` (the default unless ``chunksPerPartition`` is given)
neighbouring ranges, of one or several files, share a task of at most 256 chunks, because a task
of Python costs as much as the decoding of some files. ``firstRanges`` reads so many ranges only.

``recordIds`` (``5,120-130``) gives the rows with these ids alone and skips chunks by
their first and last id. Predicates on ``record_id`` filter rows; they aren't pushed into
the source, because Spark keeps one pushed state for all uses of a loaded relation, so
that two filters on one DataFrame would prune each other's chunks. ``sources.zones`` prunes
chunks by ids, times, providers and other columns for each filter of its own.

``limit`` stops the scan of a range after so many good rows; ``first_records`` gives so many in
all. The view ``arrow`` has a row for each chunk, with its good records as an uncompressed
Arrow IPC stream of one batch, and a row for each error.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schema as S
from ..binxml.columnar import BlockDecoder
from ..binxml.reader import CHUNK, HEADER_BLOCK, Chunk, Settings, chunk_places, decode_chunk, error, file_header, iterate_chunks, safe_time, signed
from ..binxml.values import DecodeError
from ..operators.filters import parse_ranges

VIEWS = {"records": S.RECORDS, "states": S.STATES, "arrow": S.ARROW, "chunks": S.CHUNKS, "record_headers": S.HEADERS, "template_instances": S.INSTANCES, "files": S.FILES}
#: Rows of a batch; of the view arrow, where a row is a chunk, fewer.
BATCH, CHUNK_BATCH = 1024, 16
#: Chunks of a task unless an option says more or less, tasks of a scan, and bytes read at once.
PER_TASK, MOST_TASKS, READ = 256, 50_000, 1 << 20
#: Chunks decoded together, and rows of a batch that they give.
BLOCK, ROWS = 64, 4096


#: Facets that a chunk's state counts, and their columns.
STATE_FACETS = {"level": "Level", "provider": "Provider", "channel": "Channel", "event_id": "EventID"}


@dataclass
class ChunkRange(InputPartition):
    path: str
    size: int
    first: int
    stop: int


@dataclass
class Ranges(InputPartition):
    """Ranges that a task reads one after another."""

    ranges: list[ChunkRange]


class Ids:
    """Sorted ranges of ids without overlaps: a lookup doesn't grow with their number."""

    def __init__(self, ranges: tuple[tuple[int, int], ...]):
        self.lows: list[int] = []
        self.highs: list[int] = []
        for low, high in sorted(r for r in ranges if r[0] <= r[1]):
            if self.highs and low <= self.highs[-1] + 1:
                self.highs[-1] = max(self.highs[-1], high)
            else:
                self.lows.append(low)
                self.highs.append(high)
        fit = [(low, min(high, (1 << 63) - 1)) for low, high in zip(self.lows, self.highs, strict=True) if low < 1 << 63]
        self._bounds = np.array(fit, np.int64).reshape(-1, 2)

    def meets(self, first: int, last: int) -> bool:
        """Whether any of the ids from first to last is in a range."""
        at = bisect_left(self.highs, first)
        return at < len(self.lows) and self.lows[at] <= last

    def among(self, ids: pa.Array) -> pa.Array:
        """For each id (signed, or null) whether it is in a range."""
        known = pa.compute.fill_null(ids, -1).to_numpy(zero_copy_only=False)
        if not len(self._bounds):
            return pa.array(np.zeros(len(known), bool))
        at = np.searchsorted(self._bounds[:, 1], known)
        return pa.array((at < len(self._bounds)) & (self._bounds[np.minimum(at, len(self._bounds) - 1), 0] <= known))


@dataclass
class Options:
    view: str = "records"
    mode: str = "permissive"
    settings: Settings = field(default_factory=Settings)
    xml: bool = False
    json: bool = True
    chunks_per_partition: int | None = None
    recursive: bool = False
    extensions: tuple[str, ...] = ()
    template_cache: str | None = None
    record_ids: tuple[tuple[int, int], ...] = ()
    limit: int | None = None
    packed: bool = True
    first_ranges: int | None = None

    @staticmethod
    def of(options: dict[str, str]) -> Options:
        o = {k.lower(): v for k, v in options.items()}
        flag = lambda k, default: str(o.get(k, default)).lower() == "true"
        view, mode = o.get("view", "records").lower(), o.get("mode", "permissive").lower()
        if view not in VIEWS:
            raise ValueError(f"view is one of {', '.join(VIEWS)}; not {view!r}")
        if mode not in ("permissive", "dropmalformed", "failfast"):
            raise ValueError(f"mode is permissive, dropmalformed or failfast; not {mode!r}")
        settings = Settings(flag("separateattributes", True), flag("indent", True), o.get("ansicodec", "windows-1252"), flag("validatechecksums", False))
        extensions = tuple(e.strip().lower().lstrip(".") for e in o.get("extensions", "").split(",") if e.strip())
        return Options(view, mode, settings, flag("xml", False), flag("json", True), int(o["chunksperpartition"]) if o.get("chunksperpartition") else None, flag("recursive", False), extensions, o.get("templatecache"), tuple(parse_ranges(o["recordids"])) if o.get("recordids") else (), int(o["limit"]) if o.get("limit") else None, flag("packed", not o.get("chunksperpartition")), int(o["firstranges"]) if o.get("firstranges") else None)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def expand_paths(paths: list[str], *, recursive: bool = False, extensions: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(path, size), sorted, each once. A named file is taken as it is; folders give files
    with one of the extensions, those below only if recursive."""
    found: dict[str, int] = {}
    for path in paths:
        fs, inner = _open(path)
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == pafs.FileType.File:
            found[path] = info.size
            continue
        for i in fs.get_file_info(pafs.FileSelector(inner, recursive=recursive)):
            if i.type == pafs.FileType.File and (not extensions or i.extension.lower() in extensions):
                prefix = path.rstrip("/")
                found[prefix + i.path[len(inner.rstrip("/")) :]] = i.size
    return sorted(found.items())


def with_templates(o: Options) -> Options:
    """The options of a worker, which reads the template cache's file if there is one."""
    if not o.template_cache:
        return o
    from ..templates.cache import load

    return replace(o, settings=Settings(**{**o.settings.__dict__, "offline": load(o.template_cache).body}))


def ipc_stream(batch: pa.RecordBatch) -> bytes:
    """A batch of the view ``records`` as an Arrow IPC stream."""
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, batch.schema) as stream:
            stream.write_batch(batch)
        return out.getvalue().to_pybytes()


def chunk_state(batch: pa.RecordBatch) -> dict:
    """What is kept of a chunk's records to skip it or to count by it: bounds of ids and times,
    and counts by facet."""
    good = batch.filter(batch.column("error").is_null())
    span = lambda c: pa.compute.min_max(good.column(c)).as_py().values()
    (low, high), (first, last) = span("record_id"), span("ts")
    facets = []
    for facet, column in STATE_FACETS.items():
        counts = pa.compute.value_counts(good.column(column).cast(pa.string()))
        facets += sorted(({"facet": facet, "key": c["values"], "cnt": c["counts"]} for c in counts.to_pylist()), key=lambda f: (f["key"] is not None, f["key"]))
    return {"records": good.num_rows, "errors": batch.num_rows - good.num_rows, "untimed": good.column("ts").null_count, "first_id": low, "last_id": high, "first_ts": first, "last_ts": last, "facets": facets}


def rows_of_chunk(path: str, n: int, data: bytes, o: Options, ordinal: int | None = None, decoder: BlockDecoder | None = None) -> Iterator[dict]:
    """Rows of one chunk in a view; an error is a row with ``error`` set. A decoder that has met the
    templates before spares their parsing."""
    base = {"file": path, "chunk_no": n}
    if o.view == "records":
        for row in decode_chunk(data, o.settings, xml=o.xml, json=o.json):
            yield base | {"record_seq": (n << 32) + row.pop("row_in_chunk")} | row
        return
    if o.view in ("states", "arrow"):
        decoder = decoder or BlockDecoder(to_arrow_schema(S.RECORDS), o.settings, o.json or o.view == "states", o.xml and o.view == "arrow")
        batch = decoder.decode(path, [(n, data)]) if len(data) == CHUNK and (decoder.json or decoder.xml) else pa.RecordBatch.from_pylist(list(rows_of_chunk(path, n, data, replace(o, view="records", json=decoder.json, xml=decoder.xml))), decoder.schema)
        yield from rows_of_batch(base, batch, o)
        return
    try:
        chunk = Chunk(data, o.settings)
        header_ok, events_ok = chunk.checksums()
        if o.view != "chunks" and o.settings.validate_checksums and not (header_ok and events_ok):
            raise DecodeError("ChecksumMismatch", "a chunk's checksum doesn't fit")
    except DecodeError as e:
        yield base | {"error": error(e)}
        return
    if o.view == "chunks":
        yield base | {"chunk_ordinal": ordinal, "header_ok": header_ok, "events_ok": events_ok} | {k: signed(v) if v >= 0 else v for k, v in chunk.header.items()}
        return
    for i, r in enumerate(chunk.records()):
        if isinstance(r, DecodeError):
            yield base | {"error": error(r)}
            continue
        at, size, record_id, time = r
        if o.view == "record_headers":
            yield base | {"record_seq": (n << 32) + i, "record_id": signed(record_id), "ts": safe_time(time), "offset": at, "size": size}
            continue
        try:
            for k, made in enumerate(chunk.instances(at, size)):
                yield base | {"record_id": signed(record_id), "instance": k} | made
        except DecodeError as e:
            yield base | {"record_id": signed(record_id), "error": error(e)}


def rows_of_batch(base: dict, batch: pa.RecordBatch, o: Options) -> Iterator[dict]:
    """Rows of the views ``states`` and ``arrow`` from a chunk's records."""
    if o.view == "states":
        yield base | chunk_state(batch)
        return
    bad = batch.column("error").is_valid()
    yield from (base | {"error": e} for e in batch.column("error").filter(bad).to_pylist())
    good = batch.filter(pa.compute.invert(bad))
    yield base | {"record_count": good.num_rows, "ipc": ipc_stream(good)}


def rows_of_blocks(items: Iterator[dict | tuple[str, int, bytes]], o: Options) -> Iterator[dict]:
    """Rows of the views ``states`` and ``arrow``: chunks of a file are decoded together, and their
    records dealt to the chunks again."""
    decoder = BlockDecoder(to_arrow_schema(S.RECORDS), o.settings, o.json or o.view == "states", o.xml and o.view == "arrow")
    held: list[tuple[int, bytes]] = []
    path = None

    def made() -> Iterator[dict]:
        batch = decoder.decode(path, held)
        numbers = [n for n, _ in held]
        at = np.searchsorted(batch.column("chunk_no").to_numpy(), [*numbers, numbers[-1] + 1]).tolist()
        for n, a, b in zip(numbers, at, at[1:], strict=False):
            yield from rows_of_batch({"file": path, "chunk_no": n}, batch.slice(a, b - a), o)

    for item in items:
        whole = isinstance(item, tuple) and isinstance(item[1], int) and isinstance(item[2], bytes) and len(item[2]) == CHUNK and (decoder.json or decoder.xml)
        if held and (not whole or item[0] != path or item[1] <= held[-1][0] or len(held) >= BLOCK):
            yield from made()
            held = []
        if whole:
            path = item[0]
            held.append(item[1:3])
        elif isinstance(item, dict):
            yield item
        else:
            yield from rows_of_chunk(*item[:3], o, *item[3:], decoder=decoder)
    if held:
        yield from made()


def handled(rows: Iterator[dict], mode: str) -> Iterator[dict]:
    for row in rows:
        if row.get("error") and mode != "permissive":
            if mode == "failfast":
                raise ValueError(f"{row.get('file')}, chunk {row.get('chunk_no')}: {row['error']['message']}")
            continue
        yield row


def ahead(read: Callable[[int, int], bytes], part: ChunkRange) -> Callable[[int, int], bytes]:
    """Reads one after another, taken from blocks of READ bytes that don't go beyond the task's chunks."""
    block, start = b"", 0
    end = min(part.size, 2 * HEADER_BLOCK + part.stop * CHUNK)

    def get(at: int, n: int) -> bytes:
        nonlocal block, start
        if at < start or at + n > start + len(block):
            block, start = read(at, min(max(n, READ), max(n, end - at))), at
        return block[at - start : at - start + n]

    return get


def wanted(rows: Iterator[dict], o: Options, ids: Ids | None = None) -> Iterator[dict]:
    """The rows with ids that were asked for, if any were; chunks and files have none."""
    if not o.record_ids or o.view in ("chunks", "files", "states", "arrow"):
        yield from rows
        return
    ids = ids or Ids(o.record_ids)
    for row in rows:
        if row.get("record_id") is not None and ids.meets(row["record_id"], row["record_id"]):
            yield row


def stopped(rows: Iterator[dict], limit: int | None) -> Iterator[dict]:
    """Rows until so many good ones have come."""
    good = 0
    while limit is None or good < limit:
        row = next(rows, None)
        if row is None:
            return
        good += not row.get("error")
        yield row


def batches(rows: Iterator[dict], schema: StructType) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    most = CHUNK_BATCH if schema == S.ARROW else BATCH
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def decoded(items: Iterator[dict | tuple[str, int, bytes]], o: Options, schema: StructType) -> Iterator[pa.RecordBatch]:
    """Batches in any view from chunks and from rows that are ready."""
    if columnar(o):
        yield from record_batches(items, o)
        return
    if o.view in ("states", "arrow"):
        rows = rows_of_blocks(items, o)
    else:
        ids = Ids(o.record_ids)
        rows = (row for item in items for row in ([item] if isinstance(item, dict) else wanted(rows_of_chunk(*item[:3], o, *item[3:]), o, ids)))
    yield from batches(stopped(handled(rows, o.mode), o.limit), schema)


def columnar(o: Options) -> bool:
    """Whether rows can be made by columns: records with a text or record headers, and no scan that stops early."""
    return o.limit is None and (o.view == "records" and (o.json or o.xml) or o.view == "record_headers")


def record_batches(items: Iterator[dict | tuple[str, int, bytes]], o: Options) -> Iterator[pa.RecordBatch]:
    """Batches of the views ``records`` and ``record_headers`` from chunks (file, number, bytes), some
    decoded together, and from rows that are ready; mode and ids as the options say."""
    arrow = to_arrow_schema(VIEWS[o.view])
    decoder = BlockDecoder(arrow, o.settings, o.json, o.xml)
    decode = decoder.decode if o.view == "records" else decoder.headers
    ids = Ids(o.record_ids)

    def picked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if o.record_ids:
            batch = batch.filter(ids.among(batch.column("record_id")))
        if o.mode != "permissive" and batch.column("error").null_count < batch.num_rows:
            if o.mode == "failfast":
                list(handled((r for r in batch.to_pylist()), o.mode))
            batch = batch.filter(batch.column("error").is_null())
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)

    held: list[tuple[int, bytes]] = []
    path = None
    for item in items:
        whole = isinstance(item, tuple) and isinstance(item[2], bytes) and len(item[2]) == CHUNK
        if held and (not whole or item[0] != path or len(held) >= BLOCK):
            yield from picked(decode(path, held))
            held = []
        if whole:
            path = item[0]
            held.append(item[1:3])
        elif isinstance(item, dict):
            yield from picked(pa.RecordBatch.from_pylist([item], arrow))
        else:
            yield from picked(pa.RecordBatch.from_pylist(list(rows_of_chunk(*item[:3], o)), arrow))
    if held:
        yield from picked(decode(path, held))


def packed(ranges: list, most: int) -> list[Ranges]:
    """Tasks of neighbouring ranges with ``most`` chunks at most, or of a larger range alone."""
    out: list[Ranges] = []
    room = 0
    for r in ranges:
        n = r.stop - r.first
        if out and n <= room:
            out[-1].ranges.append(r)
        else:
            out.append(Ranges([r]))
            room = most
        room -= n
    return out


class WinlogReader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str], options: Options):
        self.schema, self.paths, self.options = schema, paths, options

    def _wanted(self, data: bytes, ids: Ids) -> bool:
        """Whether a chunk may have a wanted id, by its header alone. A header whose checksum
        doesn't fit tells nothing, nor do ids that a signed number doesn't hold."""
        try:
            chunk = Chunk(data)
        except DecodeError:
            return True
        first, last = chunk.header["first_record_id"], chunk.header["last_record_id"]
        if not chunk.checksums()[0] or not 0 <= first <= last < 1 << 63:
            return True
        return ids.meets(first, last)

    def partitions(self) -> list[Ranges]:
        out = []
        files = expand_paths(self.paths, recursive=self.options.recursive, extensions=self.options.extensions)
        step = self.options.chunks_per_partition or max(PER_TASK, sum(chunk_places(size) for _, size in files) // MOST_TASKS)
        for path, size in files:
            n = max(1, chunk_places(size))
            out += [ChunkRange(path, size, a, min(a + step, n)) for a in range(0, n if self.options.view != "files" else 1, step)]
        return packed(out[: self.options.first_ranges], max(PER_TASK, step) if self.options.packed else 0)

    def _items(self, part: ChunkRange, o: Options, ids: Ids) -> Iterator[dict | tuple[str, int, bytes]]:
        """A range's chunks, or a row that tells why there are none."""
        fs, inner = _open(part.path)
        with fs.open_input_file(inner) as f:
            read = lambda at, n: f.read_at(n, at)
            try:
                head = file_header(read(0, 128))
            except DecodeError as e:
                yield {"file": part.path, "error": error(e)}
                return
            if o.view == "files":
                yield {"file": part.path, **{k: signed(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in head.items()}}
                return
            get = (lambda at, k: read(at, 512) if k == CHUNK and not self._wanted(read(at, 512), ids) else read(at, k)) if o.record_ids else ahead(read, part)
            for n, data in iterate_chunks(get, part.size, part.first, part.stop):
                if len(data) == CHUNK:
                    yield part.path, n, data

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        o, ids = with_templates(self.options), Ids(self.options.record_ids)
        if o.limit is None:
            yield from decoded((item for part in partition.ranges for item in self._items(part, o, ids)), o, self.schema)
            return
        for part in partition.ranges:
            yield from decoded(self._items(part, o, ids), o, self.schema)


class WinlogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "winlog"

    def schema(self) -> StructType:
        return VIEWS[Options.of(self.options).view]

    def reader(self, schema: StructType) -> WinlogReader:
        paths = [p.strip() for p in self.options.get("path", "").split(",") if p.strip()]
        if not paths:
            raise ValueError("winlog needs a path")
        return WinlogReader(schema, paths, Options.of(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        from .stream import WinlogStreamReader

        return WinlogStreamReader(schema, [p.strip() for p in self.options["path"].split(",") if p.strip()], Options.of(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WinlogSource)


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    reader = spark.read.format("winlog")
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    rows = reader.load(path)
    return with_ordinals(rows) if Options.of({k: str(v) for k, v in options.items()}).view == "chunks" else rows


def with_ordinals(chunks: DataFrame) -> DataFrame:
    """Number the non-empty chunks of each file in ``chunk_ordinal``, once all tasks have read theirs."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("chunk_no")) - 1
    return chunks.withColumn("chunk_ordinal", F.when(F.col("error").isNull(), place))


def first_records(spark: SparkSession, path: str, n: int, **options: object) -> DataFrame:
    """``n`` good rows, or all if there are fewer; no task reads on after its n-th. As few of the first
    ranges are read as hold so many rows: one, then four times as many."""
    ranges = 1
    while True:
        rows = read(spark, path, limit=n, firstRanges=ranges, **options).where("error IS NULL")
        if rows.count() >= n:
            return rows.limit(n)
        o = {k: str(v) for k, v in options.items()}
        most = len(WinlogReader(None, [p.strip() for p in path.split(",") if p.strip()], replace(Options.of(o), packed=False)).partitions())
        if ranges >= most:
            return rows
        ranges *= 4


def decode_files(files: DataFrame, *, content: str = "content", path: str = "path", **options: object) -> DataFrame:
    """Decode whole files in a BINARY column (as ``binaryFile`` gives them) in a view. All options
    of the source hold that say how chunks are read (``limit`` for each task, as there)."""
    o = Options.of({k: str(v) for k, v in options.items()})
    schema = VIEWS[o.view]

    def items(batch: pa.RecordBatch) -> Iterator[dict | tuple[str, int, bytes, int]]:
        for name, data in zip(batch.column(path).to_pylist(), batch.column(content).to_pylist(), strict=True):
            try:
                if data is None:
                    raise DecodeError("Input", "null content")
                head = file_header(data[:128])
                if o.view == "files":
                    yield {"file": name, **{k: signed(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in head.items()}}
                    continue
                for i, (n, chunk) in enumerate(iterate_chunks(lambda at, k: data[at : at + k], len(data))):  # noqa: B023
                    yield name, n, chunk, i
            except DecodeError as e:
                yield {"file": name, "error": error(e)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from decoded((item for batch in it for i in range(batch.num_rows) for item in items(batch.slice(i, 1))), with_templates(o), schema)

    return files.select(path, content).mapInArrow(run, schema)


def one_by_one(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows, made when they're asked for: Spark's batches hold 64 MB of chunks, which would stand in memory twice."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def decode_chunks(chunks: DataFrame, *, content: str = "chunk", path: str = "file", number: str = "chunk_no", **options: object) -> DataFrame:
    """Decode a column of 64 KiB chunks; options hold as for ``decode_files``."""
    o = Options.of({k: str(v) for k, v in options.items()})
    schema = VIEWS[o.view]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = with_templates(o)
        yield from decoded((c for batch in it for c in one_by_one(batch.select([path, number, content]))), known, schema)

    return chunks.select(path, number, content).mapInArrow(run, schema)
