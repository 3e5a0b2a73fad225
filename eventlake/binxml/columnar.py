"""Records of many chunks at once: values by column, text by Arrow's kernels.

Records that are one template instance are grouped by template and shape (the kinds of
their values and which are empty). A group's descriptors are one matrix; each value that
the output shows is gathered for all records of the group at once, becomes a column of
text, and the shape's program joins its literals with these columns. Only columns that are
shown are made. Templates met in an earlier chunk are known again by their bytes and the
names that they point to, so a program is made once, not in every chunk.

Everything else (other tokens, odd sizes, kinds without a column form, damage) takes the
plain way, record by record; rows come out in the order of the records.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import values as V
from .program import compiled, shape_of
from .quick import _JSON_ODD, _guid, _sid, column_slots, integer
from .reader import CHUNK, RECORD_HEADER, RECORD_MAGIC, RECORDS_AT, Chunk, Settings, error, plain_row, safe_time, signed
from .render import escape_json
from .values import DecodeError

_INTS = {V.INT8: "<i1", V.UINT8: "<u1", V.INT16: "<i2", V.UINT16: "<u2", V.INT32: "<i4", V.UINT32: "<u4", V.INT64: "<i8", V.UINT64: "<u8", V.HEX32: "<u4", V.HEX64: "<u8", V.FILETIME: "<u8", V.BOOL: "<u4"}
_SIZES = np.full(256, -9, np.int64)
for _k, _t in _INTS.items():
    _SIZES[_k] = np.dtype(_t).itemsize
_SIZES[[V.GUID, V.STRING, V.NULL, V.SID]] = 16, -1, -2, -3
#: FILETIME of 1970 in microseconds, and microseconds of the last moment of the year 9999.
_UNIX, _LAST = 11_644_473_600_000_000, 253_402_300_799_999_999
_MOST_TEMPLATES = 4096
RECORD = int.from_bytes(RECORD_MAGIC, "little")
_WEIGHTS = np.random.Generator(np.random.PCG64(1)).integers(1 << 40, 1 << 62, 1024) | 1


def _gather(buf: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """Numbers of a kind at places of a buffer."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(buf[at[:, None] + np.arange(size)]).view(kind)[:, 0]


def _strings(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _replaced(column: pa.Array, *pairs: tuple[str, str]) -> pa.Array:
    for old, new in pairs:
        column = pc.replace_substring(column, old, new)
    return column


@dataclass
class Slot:
    """The values of one slot of a group of records."""

    buf: np.ndarray
    at: np.ndarray
    size: np.ndarray
    kind: int
    _text: pa.Array | None = None
    _json: pa.Array | None = None

    def numbers(self) -> np.ndarray:
        return _gather(self.buf, self.at, _INTS[self.kind])

    def raw(self) -> list[bytes]:
        whole = self.buf.tobytes() if len(self.at) > 64 else None
        return [whole[a : a + n] if whole else self.buf[a : a + n].tobytes() for a, n in zip(self.at.tolist(), self.size.tolist(), strict=True)]

    def text(self) -> pa.Array:
        if self._text is None:
            self._text = self._made()
        return self._text

    def _made(self) -> pa.Array:
        kind = self.kind
        if kind in (-1, -2):
            return pa.array([""] * len(self.at), pa.string())
        if kind == V.STRING:
            return self._utf16()
        if kind == V.GUID:
            return pa.array(map(_guid, self.raw()), pa.string(), size=len(self.at))
        if kind == V.SID:
            return pa.array(map(_sid, self.raw()), pa.string(), size=len(self.at))
        x = self.numbers()
        if kind == V.BOOL:
            return pa.array(np.where(x != 0, "true", "false").astype(object), pa.string())
        if kind == V.FILETIME:
            shown = pa.array((x // 10).astype(np.int64) - _UNIX, pa.timestamp("us")).cast(pa.string())
            return pc.binary_join_element_wise(pc.binary_replace_slice(shown, 10, 11, "T"), "Z", "")
        if kind in (V.HEX32, V.HEX64):
            return pa.array(map(hex, x.tolist()), pa.string(), size=len(x))
        return pa.array(x).cast(pa.string())

    def _utf16(self) -> pa.Array:
        units = self.size // 2
        total = int(units.sum())
        first = np.cumsum(units) - units
        place = np.repeat(self.at - 2 * first, units) + 2 * np.arange(total)
        low, high = self.buf[place], self.buf[place + 1]
        if not high.any() and (not total or low.max() < 0x80 and low.min() > 0):
            # ASCII without NULs: a byte a character.
            if not (low < 0x20).any():
                out = _strings(units, low)
                odd = bool(((low == 0x22) | (low == 0x5C)).any())
                self._json = _replaced(out, ("\\", "\\\\"), ('"', '\\"')) if odd else out
                return out
            return _strings(units, low)
        return pa.array([t.partition("\0")[0] for t in (b.decode("utf-16-le", "ignore") for b in self.raw())], pa.string())

    def json(self) -> pa.Array:
        """The text as it stands inside of a JSON string."""
        text = self.text()
        if self.kind != V.STRING:
            return text
        if self._json is None:
            self._json = pa.array([escape_json(t) if _JSON_ODD.search(t) else t for t in text.to_pylist()], pa.string())
        return self._json

    def xml(self, attribute: bool) -> pa.Array:
        text = self.text()
        if self.kind != V.STRING:
            return text
        marks = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&apos;")] if attribute else [])
        return _replaced(text, *marks)


@dataclass
class Programs:
    """What a template's shape renders to, and where its columns come from; None: the plain way."""

    json: object = None
    xml: object = None


@dataclass
class BlockDecoder:
    """Decodes blocks of chunks to batches with the columns of the view ``records``."""

    schema: pa.Schema
    settings: Settings = field(default_factory=Settings)
    json: bool = True
    xml: bool = False
    known: dict = field(default_factory=dict)
    programs: dict = field(default_factory=dict)
    templates: int = 0

    def decode(self, path: str | None, chunks: list[tuple[int, bytes]]) -> pa.RecordBatch:
        """Rows of chunks (number, bytes of CHUNK), in order."""
        made, errors = self._opened(chunks)
        plain: list[tuple[int, dict]] = []
        failed = {k: {"chunk_no": chunks[k][0], "record_seq": chunks[k][0] << 32, "error": e} for k, e in errors.items()}
        buf = np.frombuffer(b"".join(d for _, d in chunks), np.uint8)
        walk, odd = self._walk(buf, made)
        counts = np.bincount(walk[:, 1], minlength=len(chunks)) if len(walk) else np.zeros(len(chunks), np.int64)
        slow = {k: list(made[k].records()) for k in odd}
        for k in failed:
            counts[k] = 1
        for k, found in slow.items():
            counts[k] = len(found)
        first = np.cumsum(counts) - counts
        plain += [(int(first[k]), row) for k, row in failed.items()]
        more = []
        for k, found in slow.items():
            for i, r in enumerate(found):
                o, number = int(first[k]) + i, chunks[k][0]
                if isinstance(r, DecodeError):
                    plain.append((o, {"chunk_no": number, "record_seq": (number << 32) + i, "error": error(r)}))
                elif r[2] < 1 << 63 and r[3] < 1 << 63:
                    more.append((o, k, i, *r))
                else:
                    plain.append((o, self._plain(made[k], number, i, r)))
        if len(walk):
            walk[:, 0] = first[walk[:, 1]] + walk[:, 2]
            walk = walk[np.argsort(walk[:, 0])]
        rows = np.concatenate([walk, np.array(more, np.int64)]) if more else walk
        batches, orders = [], []
        if len(rows):
            left = np.ones(len(rows), bool)
            for at, batch in self._groups(buf, rows, chunks, made):
                left[at] = False
                batches.append(batch)
                orders.append(rows[at, 0])
            for o, k, i, *r in rows[left].tolist():
                plain.append((o, self._plain(made[k], chunks[k][0], i, tuple(r))))
        if plain or not batches:
            batches.append(pa.RecordBatch.from_pylist([r for _, r in plain], self.schema))
            orders.append(np.array([o for o, _ in plain], np.int64))
        order = np.concatenate(orders)
        table = pa.Table.from_batches(batches, self.schema)
        if len(order) and (np.diff(order) < 0).any():
            table = table.take(pa.array(np.argsort(order, kind="stable")))
        out = table.combine_chunks().to_batches()
        batch = out[0] if out else pa.RecordBatch.from_pylist([], self.schema)
        return batch.set_column(0, self.schema.field(0), pa.repeat(pa.scalar(path, pa.string()), batch.num_rows))

    def _opened(self, chunks: list[tuple[int, bytes]]) -> tuple[list[Chunk | None], dict[int, dict]]:
        """The chunks, None for those that can't be read, and the errors of these."""
        made: list[Chunk | None] = []
        errors: dict[int, dict] = {}
        for k, (_, data) in enumerate(chunks):
            made.append(None)
            try:
                c = Chunk(data, self.settings)
                if self.settings.validate_checksums and not all(c.checksums()):
                    raise DecodeError("ChecksumMismatch", "a chunk's checksum doesn't fit")
                made[k] = c
            except DecodeError as e:
                errors[k] = error(e)
        return made, errors

    def headers(self, path: str | None, chunks: list[tuple[int, bytes]]) -> pa.RecordBatch:
        """Rows of the view ``record_headers``, in order."""
        made, errors = self._opened(chunks)
        walk, odd = self._walk(np.frombuffer(b"".join(d for _, d in chunks), np.uint8), made)
        number = np.array([n for n, _ in chunks], np.int64)[walk[:, 1]]
        micros = walk[:, 6] // 10 - _UNIX
        out = {"chunk_no": number.astype(np.int32), "record_seq": (number << 32) + walk[:, 2], "record_id": walk[:, 5], "offset": walk[:, 3], "size": walk[:, 4]}
        columns = {k: pa.array(v) for k, v in out.items()} | {"ts": pa.array(micros, mask=micros > _LAST).cast(self.schema.field("ts").type)}
        batches = [pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(len(walk), f.type) for f in self.schema], schema=self.schema)]
        order = [walk[:, 1] << 32 | walk[:, 2]]
        rows = [(k << 32, {"chunk_no": chunks[k][0], "error": e}) for k, e in errors.items()]
        for k in odd:
            n = chunks[k][0]
            for i, r in enumerate(made[k].records()):
                told = {"error": error(r)} if isinstance(r, DecodeError) else {"record_seq": (n << 32) + i, "record_id": signed(r[2]), "ts": safe_time(r[3]), "offset": r[0], "size": r[1]}
                rows.append((k << 32 | i, {"chunk_no": n, **told}))
        if rows:
            batches.append(pa.RecordBatch.from_pylist([r for _, r in rows], self.schema))
            order.append(np.array([o for o, _ in rows], np.int64))
        table = pa.Table.from_batches(batches).take(pa.array(np.argsort(np.concatenate(order), kind="stable"))).combine_chunks()
        batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], self.schema)
        return batch.set_column(0, self.schema.field(0), pa.repeat(pa.scalar(path, pa.string()), batch.num_rows))

    def _walk(self, buf: np.ndarray, made: list[Chunk | None]) -> tuple[np.ndarray, list[int]]:
        """Records of all chunks, a step in each chunk at a time: rows (0, chunk, row, offset, size, id,
        FILETIME), and the chunks with anything unusual, which have no rows here."""
        live = np.array([k for k, c in enumerate(made) if c is not None], np.int64)
        end = np.array([min(c.header["free_space_offset"], CHUNK) if c else 0 for c in made], np.int64)
        last = np.array([c.header["last_record_id"] if c else 0 for c in made], np.uint64)
        at = np.full(len(made), RECORDS_AT, np.int64)
        steps, odd = [], np.zeros(len(made), bool)
        head = np.arange(RECORD_HEADER)
        while len(live):
            live = live[at[live] + RECORD_HEADER <= end[live]]
            raw = np.ascontiguousarray(buf[(live * CHUNK + at[live])[:, None] + head])
            magic, size = raw[:, :4].copy().view("<u4")[:, 0], raw[:, 4:8].copy().view("<u4")[:, 0].astype(np.int64)
            ids = raw[:, 8:24].copy().view("<u8")
            fine = (magic == RECORD) & (size >= RECORD_HEADER + 4) & (at[live] + size <= CHUNK) & (ids < 1 << 63).all(axis=1)
            odd[live[~fine & (magic != 0)]] = True
            live, size, ids = live[fine], size[fine], ids[fine]
            steps.append(np.stack([np.zeros_like(live), live, np.full_like(live, len(steps)), at[live], size, *ids.astype(np.int64).T], axis=1))
            at[live] += size
            live = live[ids[:, 0] != last[live]]
        rows = np.concatenate(steps) if steps else np.zeros((0, 7), np.int64)
        return rows[~odd[rows[:, 1]]], np.flatnonzero(odd).tolist()

    def _plain(self, c: Chunk, number: int, i: int, r: tuple) -> dict:
        row = plain_row(c, i, r, json=self.json, xml=self.xml)
        return {"chunk_no": number, "record_seq": (number << 32) + row.pop("row_in_chunk"), **row}

    def _groups(self, buf: np.ndarray, rows: np.ndarray, chunks: list, made: list):
        """(row indexes, batch) of the groups that programs can render."""
        base, at, size = rows[:, 1] * CHUNK, rows[:, 3] + rows[:, 1] * CHUNK, rows[:, 4]
        start, end = at + RECORD_HEADER, at + size - 4
        ok = end - start >= 14 + 4
        ok &= rows[:, 6] // 10 - _UNIX <= _LAST
        idx = np.flatnonzero(ok)
        idx = idx[(buf[start[idx]] == 0x0F) & (buf[start[idx] + 4] == 0x0C)]
        if not len(idx):
            return
        offset = _gather(buf, start[idx] + 10, "<u4").astype(np.int64)
        p = start[idx] + 14
        inline = p - base[idx] == offset
        if inline.any():  # the definition stands before the values
            here = np.flatnonzero(inline)
            fits = p[here] + 24 + 4 <= end[idx[here]]
            p[here[fits]] += 24 + _gather(buf, p[here[fits]] + 20, "<u4").astype(np.int64)
            p[here[~fits]] = len(buf)
        keep = p + 4 <= end[idx]
        idx, offset, p = idx[keep], offset[keep], p[keep]
        n = _gather(buf, p, "<u4").astype(np.int64)
        p = p + 4
        keep = (n <= 1024) & (p + 4 * n <= end[idx])
        idx, offset, p, n = idx[keep], offset[keep], p[keep], n[keep]
        if not len(idx):
            return
        places, which = np.unique(rows[idx, 1] << 32 | offset, return_inverse=True)
        names = np.array([self._template(chunks[x >> 32][1], x & 0xFFFFFFFF) for x in places.tolist()], np.int64)
        template = names[which]
        for key in np.unique(np.stack([template, n], axis=1), axis=0).tolist():
            mine = np.flatnonzero((template == key[0]) & (n == key[1]))
            if key[0] >= 0:
                yield from self._shapes(buf, rows, idx[mine], p[mine], key[1], end[idx[mine]], key[0], chunks, made)

    def _template(self, data: bytes, offset: int) -> int:
        """The number of a template, equal for equal definitions; -1 if it can't be read."""
        if offset + 24 > len(data):
            return -1
        stop = offset + 24 + struct.unpack_from("<I", data, offset + 20)[0]
        if stop > len(data):
            return -1
        body = data[offset + 4 : stop]
        for names, number in self.known.get((offset, body), ()):
            if all(data[a : a + len(raw)] == raw for a, raw in names):
                return number
        if self.templates >= _MOST_TEMPLATES:
            self.known.clear()
            self.programs.clear()
            self.templates = 0
        c = Chunk(data, self.settings)
        try:
            c.decoder.template(offset)
        except (DecodeError, struct.error, RecursionError):
            return -1
        self.templates += 1
        number = self.templates
        names = [(a, bytes(data[a:after])) for a, (_, after) in c.known.items()]
        self.known.setdefault((offset, body), []).append((names, number))
        return number

    def _shapes(self, buf, rows, idx, p, n, end, template, chunks, made):
        where = p[:, None] + 4 * np.arange(n)
        size = buf[where].astype(np.int64) | buf[where + 1].astype(np.int64) << 8
        kind = buf[where + 2].astype(np.int64)
        stop = (p + 4 * n)[:, None] + np.cumsum(size, axis=1)
        at = stop - size
        last = stop[:, -1] if n else p
        need = _SIZES[kind]
        fits = np.where(need >= 0, size == need, np.where(need == -1, size % 2 == 0, need != -9))
        good = fits.all(axis=1) & (last <= end)
        good &= (last == end) | (buf[np.minimum(last, len(buf) - 1)] == 0)
        sids = need == -3
        if sids.any():
            r, s = np.nonzero(sids & good[:, None])
            count = buf[np.minimum(at[r, s] + 1, len(buf) - 1)].astype(np.int64)
            good[r[(size[r, s] < 8) | (size[r, s] != 8 + 4 * count)]] = False
        idx, at, size, kind = idx[good], at[good], size[good], kind[good]
        if not len(idx):
            return
        text = kind == V.STRING
        shape = kind.astype(np.int16)
        shape[kind == V.NULL] = -2
        r, s = np.nonzero(text)
        nothing = size[r, s] == 0
        begin = np.minimum(at[r, s], len(buf) - 2)
        nothing |= (buf[begin] == 0) & (buf[begin + 1] == 0)
        shape[r[nothing], s[nothing]] = -1
        times = kind == V.FILETIME
        if times.any():
            r, s = np.nonzero(times)
            late = _gather(buf, at[r, s], "<u8") // 10 > _LAST + _UNIX
            good = np.ones(len(idx), bool)
            good[r[late]] = False
            idx, at, size, shape = idx[good], at[good], size[good], shape[good]
        if not len(idx):
            return
        if n:
            # Shapes are told apart by a sum with odd weights, which is then held against the shapes themselves.
            mixed = (shape.astype(np.int64) * _WEIGHTS[:n]).sum(axis=1)
            _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
            if not np.array_equal(shape[first[which]], shape):
                _, first, which = np.unique(shape, axis=0, return_index=True, return_inverse=True)
        else:
            first, which = np.zeros(1, np.int64), np.zeros(len(idx), np.int64)
        for g, f in enumerate(first.tolist()):
            mine = np.flatnonzero(which == g)
            key = template, tuple(shape[f].tolist())
            if key not in self.programs:
                self.programs[key] = self._program(made[rows[idx[f], 1]], rows[idx[f]], key[1])
            program = self.programs[key]
            if program is not None:
                yield idx[mine], self._batch(buf, rows[idx[mine]], at[mine], size[mine], key[1], program, chunks)

    def _program(self, c: Chunk, row: np.ndarray, shape: tuple) -> Programs | None:
        """A shape's programs, from a record of it; None if the plain way is needed."""
        try:
            found = c.single_instance(int(row[3]), int(row[4]))
            if found is None or shape_of(found.values) != shape:
                return None
            tree = c.decoder.template(found.offset)
            made = Programs(*(compiled(tree, found.values, xml=x, separate=self.settings.separate_attributes, indent=self.settings.indent) if asked else None for x, asked in ((False, self.json), (True, self.xml))))
        except (DecodeError, struct.error, RecursionError):
            return None
        if self.json:
            if made.json is None or not made.json.unique or made.json.marked is None:
                return None
            made.json.columns = column_slots(made.json.marked, shape)
            if made.json.columns is None:
                return None
        return None if self.xml and made.xml is None else made

    def _batch(self, buf, rows, at, size, shape, program, chunks) -> pa.RecordBatch:
        m = len(rows)
        slots: dict[int, Slot] = {}

        def slot(s: int) -> Slot:
            if s not in slots:
                slots[s] = Slot(buf, at[:, s], size[:, s], shape[s])
            return slots[s]

        def joined(p, texts: list[pa.Array]) -> pa.Array:
            if not texts:
                return pa.array([p.literals[0]] * m, pa.string())
            parts = [p.literals[0]]
            for t, literal in zip(texts, p.literals[1:], strict=True):
                parts += [t, literal]
            return pc.binary_join_element_wise(*(pa.scalar(x) if isinstance(x, str) else x for x in parts), pa.scalar(""))

        out: dict[str, pa.Array] = {}
        number = np.array([n for n, _ in chunks], np.int64)[rows[:, 1]]
        out["chunk_no"] = pa.array(number.astype(np.int32))
        out["record_seq"] = pa.array((number << 32) + rows[:, 2])
        out["record_id"] = pa.array(rows[:, 5])
        out["ts"] = pa.array(rows[:, 6] // 10 - _UNIX).cast(self.schema.field("ts").type)
        if self.json:
            out["Raw"] = joined(program.json, [slot(s).json() for s, _ in program.json.holes])
            for name, (constant, s) in zip(("EventID", "Level", "Provider", "Channel"), program.json.columns, strict=True):
                if s is None:
                    out[name] = pa.repeat(pa.scalar(constant, self.schema.field(name).type), m)
                elif name in ("Provider", "Channel"):
                    out[name] = slot(s).text()
                elif shape[s] == V.STRING:
                    out[name] = pa.array([integer(t) for t in slot(s).text().to_pylist()], pa.int32())
                else:
                    out[name] = pa.array(slot(s).numbers().astype(np.int32))
        if self.xml:
            out["xml"] = joined(program.xml, [slot(s).xml(a) for s, a in program.xml.holes])
        return pa.RecordBatch.from_arrays([out[f.name] if f.name in out else pa.nulls(m, f.type) for f in self.schema], schema=self.schema)
