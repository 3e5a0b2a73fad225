"""Telephony audio columns: companded or ADPCM bytes in WAV form, decoded to PCM.

Any bytes can be stored as 8-bit companded samples (or as ADPCM blocks) and come back
bit for bit. Decoding expands mu-law and A-law by tables of 256 entries and IMA ADPCM
by numpy over all blocks of a batch at once (samples in a block depend on each other,
blocks don't), then resamples to ``rate_out``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import raw_texts, renamed, schema_with, slices

#: Format tags of the WAV container.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
#: The IMA ADPCM step sizes and index changes.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
INDEX_CHANGE = [-1, -1, -1, -1, 2, 4, 6, 8]


@dataclass(frozen=True)
class MediaConfig:
    codec: str = "mulaw"
    #: Payloads are padded with ``pad`` to a positive multiple of this; an ADPCM block has this size.
    block: int = 576
    pad: int = 255
    rate_in: int = 8000
    rate_out: int = 16000


@cache
def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    magnitude = ((((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, low = (a & 0x70) >> 4, ((a & 0x0F) << 4) + 8
    magnitude = np.where(exponent == 0, low, (low + 0x100) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM: uint8 (blocks, size) to int16 (blocks, samples). A block has a
    16-bit first sample, a step index and a reserved byte, then two samples a byte."""
    steps, change = np.array(STEPS, np.int32), np.array([*INDEX_CHANGE, *INDEX_CHANGE], np.int32)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    size = blocks.shape[1] - 4
    out = np.empty((2 * size + 1, len(blocks)), np.int16)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    # change in value by (index, code), so that a step is two look-ups and two clips
    code = np.arange(16)
    s = steps[:, None]
    delta = (s >> 3) + np.where(code & 4, s, 0) + np.where(code & 2, s >> 1, 0) + np.where(code & 1, s >> 2, 0)
    moves = np.where(code & 8, -delta, delta).astype(np.int32).ravel()
    following = np.clip(np.arange(len(STEPS))[:, None] + change[None, :], 0, len(STEPS) - 1).astype(np.int32).ravel()
    for k in range(size):
        for half in (0, 1):
            at = index * 16 + ((body[k] >> (4 * half)) & 15)
            value = np.clip(value + moves[at], -32768, 32767)
            index = following[at]
            out[2 * k + half + 1] = value
    return out.T


def to_wav(payload: bytes, n_bytes: int, config: MediaConfig = MediaConfig()) -> bytes:
    """The payload as the data chunk of a WAV; its fact chunk holds the unpadded length."""
    bits, align = (4, config.block) if config.codec == "ima_adpcm" else (8, 1)
    extra = struct.pack("<HH", 2, 2 * (config.block - 4) + 1) if bits == 4 else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", TAGS[config.codec], 1, config.rate_in, config.rate_in * bits // 8, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, n_bytes) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def from_wav(media: bytes) -> tuple[str, bytes, int]:
    """(codec, payload, unpadded length) of a WAV; ValueError if it isn't one of ours."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV")
    at, found = 12, {}
    while at + 8 <= len(media):
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        found[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if len(found.get(b"fmt ", b"")) < 16 or len(found.get(b"fact", b"")) < 4 or b"data" not in found:
        raise ValueError("a WAV without format, fact or data chunk")
    tag = struct.unpack_from("<H", found[b"fmt "])[0]
    codec = next((c for c, t in TAGS.items() if t == tag), None)
    if codec is None:
        raise ValueError(f"format tag {tag}")
    return codec, found[b"data"], struct.unpack_from("<I", found[b"fact"])[0]


def resampled(pcm: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    """Linear interpolation between neighbours; the last sample is held."""
    if rate_in == rate_out or not len(pcm):
        return pcm
    if rate_out == 2 * rate_in:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    n = len(pcm) * rate_out // rate_in
    return np.rint(np.interp(np.arange(n) * (rate_in / rate_out), np.arange(len(pcm)), pcm)).astype(np.int16)


def decoded(codec: str, payload: bytes, block: int) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8)
    if codec == "ima_adpcm":
        return adpcm_decode(raw.reshape(-1, block)).reshape(-1)
    return (mulaw_table() if codec == "mulaw" else alaw_table())[raw]


def summary(pcm: np.ndarray) -> str:
    """Samples, peak, root mean square and sign changes."""
    if not len(pcm):
        return "0,0,0,0"
    signs, power = pcm < 0, 0
    for at in range(0, len(pcm), 1 << 20):  # bounded for a text of any length
        wide = pcm[at : at + (1 << 20)].astype(np.int64)
        power += int((wide * wide).sum())
    peak = max(int(pcm.max()), -int(pcm.min()))
    return f"{len(pcm)},{peak},{int(np.sqrt(power / len(pcm)) * 1000)},{int((signs[1:] != signs[:-1]).sum())}"


def _store(column: str, config: MediaConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, rows=512, chars=4 << 20):
            made = []
            for text in raw_texts(part.column(column)):
                raw = text or b""
                size = max(1, -(-len(raw) // config.block)) * config.block
                made.append(to_wav(raw.ljust(size, bytes([config.pad])), len(raw), config))
            kept = [c for c in part.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(made, pa.binary())], [*kept, "media"])

    return run


def stored(df: DataFrame, column: str = "text", config: MediaConfig = MediaConfig()) -> DataFrame:
    """Replace a text column by ``media``, a WAV of its padded UTF-8 bytes. Null is empty:
    one block of padding. Equal texts give equal bytes; a column ``media`` becomes ``media_in``."""
    df = renamed(df, ["media"])
    schema = T.StructType([*(f for f in df.schema.fields if f.name != column), T.StructField("media", T.BinaryType())])
    return df.mapInArrow(_store(column, config), schema)


def _decode(config: MediaConfig, with_pcm: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", rows=256, chars=4 << 20):
            read, errors = [], []
            for m in part.column("media").to_pylist():
                try:
                    told = None if m is None else from_wav(m)
                    if told and told[0] == "ima_adpcm" and len(told[1]) % config.block:
                        raise ValueError(f"ADPCM data of {len(told[1])} bytes, blocks of {config.block}")
                    read.append(told)
                    errors.append(None)
                except ValueError as e:
                    read.append(None)
                    errors.append(str(e))
            # The ADPCM reading of all payloads of this slice at once: blocks side by side.
            whole = [r for r in read if r and len(r[1]) % config.block == 0]
            joined = np.frombuffer(b"".join(r[1] for r in whole), np.uint8).reshape(-1, config.block)
            blocks = iter(np.split(adpcm_decode(joined), np.cumsum([len(r[1]) // config.block for r in whole])[:-1]) if whole else [])
            columns: list[list] = [[], [], [], []]
            for r in read:
                if r is None:
                    for c in columns:
                        c.append(None)
                    continue
                codec, payload, n = r
                adpcm = next(blocks).reshape(-1) if len(payload) % config.block == 0 else None
                pcm = adpcm if codec == "ima_adpcm" else decoded(codec, payload, config.block)
                out = resampled(pcm, config.rate_in, config.rate_out).astype("<i2").tobytes()
                other = decoded("alaw" if codec == "mulaw" else "mulaw", payload, config.block)
                feature = f"{codec}:{summary(pcm)};pcm{config.rate_out}:{zlib.crc32(out):08x};{'alaw' if codec == 'mulaw' else 'mulaw'}:{summary(other)};adpcm:{'no blocks' if adpcm is None else summary(adpcm)}"
                for c, v in zip(columns, (payload, n, out if with_pcm else None, feature), strict=True):
                    c.append(v)
            kept = [c for c in part.schema.names if c != "media"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), part.column("media"), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary(), pa.string()), strict=True)), pa.array(errors, pa.string())], [*kept, "media", "payload", "n_bytes", "pcm", "feature", "media_error"])

    return run


def loaded(df: DataFrame, config: MediaConfig = MediaConfig(), *, with_pcm: bool = True) -> DataFrame:
    """Read ``media`` back: payload, n_bytes (unpadded), pcm (resampled 16-bit samples)
    and feature (of the stored codec, of the resampled PCM, and of the payload's other
    readings). A null media gives nulls; so do bytes that are no WAV of ours, with the reason
    in media_error. Payloads of other codecs that are no whole blocks have no ADPCM reading."""
    df = renamed(df, ["payload", "n_bytes", "pcm", "feature", "media_error"])
    kept = T.StructType([*(f for f in df.schema.fields if f.name != "media"), T.StructField("media", T.BinaryType())])
    df = df.select(*(f.name for f in kept.fields))
    return df.mapInArrow(_decode(config, with_pcm), schema_with(df, ("payload", T.BinaryType()), ("n_bytes", T.LongType()), ("pcm", T.BinaryType()), ("feature", T.StringType()), ("media_error", T.StringType())))
