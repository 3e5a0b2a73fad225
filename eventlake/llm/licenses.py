"""License scans: MinHash bands over overlapping windows, then exact containment.

Words are runs of letters, digits and underscores, lower-cased; shingles have five
words. A template with m shingles is there where a run of m + m // 4 + 1 shingles holds
``containment`` (0.8) of its distinct shingles or more. Templates of similar lengths, up to
M shingles, are a class: windows of 2 M + M // 4 + 1 shingles every M shingles hold any such
run of theirs whole, whatever its place, so a window's Jaccard similarity to the template has
a lower bound; a class has as many bands as two sets that similar need to share one with
probability ``retrieval``. The shingles' permuted values are made once and serve the windows
of all classes; a class keeps its templates' values sorted by band, and windows look theirs
up there, so that work grows with classes (the logarithm of the lengths) and with hits, not
with templates. Windows that share a band with a template are candidates, and every run
near them is verified.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, texts

SHINGLE = 5
_WORD = re.compile(r"\w+")
#: Statements and headers of public licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


@dataclass(frozen=True)
class LicenseConfig:
    containment: float = 0.8
    #: Probability that a window with a template at the least similarity shares a band with it.
    retrieval: float = 0.9999
    #: Rows of a band.
    rows: int = 1
    seed: int = 11
    #: Longest template of a class by its shortest.
    spread: float = 1.25
    templates: tuple[tuple[str, str], ...] = tuple(sorted(TEMPLATES.items()))


def slack(m: int) -> int:
    return m // 4 + 1


def bands_needed(m: int, longest: int, config: LicenseConfig) -> int:
    """Bands at which a window of a class is retrieved that holds a run with a template of m shingles."""
    held = math.ceil(config.containment * m)
    jaccard = held / (2 * longest + slack(longest) + m - held)
    return math.ceil(math.log(1 - config.retrieval) / math.log(1 - jaccard**config.rows)) if jaccard < 1 else 1


class _Hashes(dict):
    """Hashes of words, each computed once in a worker; emptied when it has very many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    w = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hash of each run of five words; none if there are fewer."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Class:
    """Templates of similar lengths: their sets of shingles, and their values by band, sorted."""

    names: list[str]
    sets: list[np.ndarray]
    bands: int
    values: list[np.ndarray]
    order: list[np.ndarray]

    @property
    def longest(self) -> int:
        return max(map(len, self.sets))


class Index:
    """Templates in classes by length, with their signatures."""

    def __init__(self, config: LicenseConfig):
        self.config = config
        made = []
        for name, text in config.templates:
            s = np.unique(shingles(word_hashes(text)))
            if not len(s):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            made.append((len(s), name, s))
        groups: list[list[tuple]] = []
        for t in sorted(made, key=lambda t: t[:2]):
            if groups and t[0] <= config.spread * groups[-1][0][0]:
                groups[-1].append(t)
            else:
                groups.append([t])
        needed = [bands_needed(g[0][0], g[-1][0], config) for g in groups]
        n = max(needed, default=0) * config.rows
        rng = np.random.Generator(np.random.PCG64(config.seed))
        self.factors = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.classes = []
        for g, bands in zip(groups, needed, strict=True):
            signatures = [self.joined([np.array([self.values(t, k).min() for _, _, t in g]) for k in range(b * config.rows, (b + 1) * config.rows)]) for b in range(bands)]
            order = [np.argsort(v, kind="stable") for v in signatures]
            self.classes.append(Class([name for _, name, _ in g], [t for _, _, t in g], bands, [v[o] for v, o in zip(signatures, order, strict=True)], order))

    def values(self, s: np.ndarray, k: int) -> np.ndarray:
        """The k-th permutation of shingle hashes, 32 bits."""
        return ((s * self.factors[k]) >> np.uint64(32)).astype(np.uint32)

    def joined(self, least: list[np.ndarray]) -> np.ndarray:
        """The key of a band: its rows' least values as one number."""
        if len(least) == 1:
            return least[0]
        out = np.zeros(len(least[0]), np.uint64)
        for v in least:
            out = (out ^ v.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return out

    def candidates(self, s: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Of texts' shingles one after another (``ends``: where each text's stop): the windows
        (text, start, stop) that share a band with a template, by (class, template)."""
        if not len(s):
            return {}
        begins, sizes = np.append(0, ends[:-1]), np.diff(np.append(0, ends))
        windows, levels = [], []
        for c in self.classes:
            m = c.longest
            n = -(-sizes // m)
            text = np.repeat(np.arange(len(sizes)), n)
            start = begins[text] + m * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
            stop = np.minimum(start + 2 * m + slack(m), ends[text])
            windows.append(np.stack([text, start, stop], axis=1))
            # The least of a window is that of two runs of a power of two: its first and its last.
            size = np.frexp(stop - start)[1] - 1
            levels.append([(k, here, start[here], stop[here] - (1 << k)) for k in np.unique(size).tolist() for here in [np.flatnonzero(size == k)]])
        hits: dict[tuple[int, int], list[int]] = {}
        r, top = self.config.rows, max(k for each in levels for k, *_ in each)
        for band in range(max(c.bands for c in self.classes)):
            tables = []
            for i in range(band * r, band * r + r):
                runs = [self.values(s, i)]
                for k in range(top):
                    runs.append(np.minimum(runs[k][: -(1 << k)], runs[k][1 << k :]))
                tables.append(runs)
            for x, c in enumerate(self.classes):
                if band >= c.bands:
                    continue
                least = [np.empty(len(windows[x]), np.uint32) for _ in tables]
                for out, runs in zip(least, tables, strict=True):
                    for k, here, first, last in levels[x]:
                        out[here] = np.minimum(runs[k][first], runs[k][last])
                key, known = self.joined(least), c.values[band]
                low = np.minimum(np.searchsorted(known, key), len(known) - 1) if len(known) > 1 else np.zeros(len(key), np.int64)
                found = np.flatnonzero(known[low] == key)
                high = np.searchsorted(known, key[found], "right")
                for w, a, b in zip(found.tolist(), low[found].tolist(), high.tolist(), strict=True):
                    for t in c.order[band][a:b].tolist():
                        hits.setdefault((x, t), []).append(w)
        return {(x, t): windows[x][np.unique(w)] for (x, t), w in hits.items()}

    def places(self, s: np.ndarray, ends: np.ndarray) -> list[tuple[int, str, int, int, float]]:
        """(text, template, first shingle, shingles, containment) of the best runs near candidates, disjoint."""
        out = []
        begins = np.append(0, ends[:-1])
        for (x, t), windows in self.candidates(s, ends).items():
            template = self.classes[x].sets[t]
            run = len(template) + slack(len(template))
            regions: list[list[int]] = []
            for text, start, stop in windows.tolist():
                a, b = max(int(begins[text]), start - run), min(int(ends[text]), stop + run)
                if regions and regions[-1][0] == text and a <= regions[-1][2]:
                    regions[-1][2] = max(regions[-1][2], b)
                else:
                    regions.append([text, a, b])
            for text, a, b in regions:
                out += [(text, self.classes[x].names[t], first - int(begins[text]), n, share) for first, n, share in best_runs(s[a:b], template, run, self.config.containment, a)]
        return out


def best_runs(s: np.ndarray, t: np.ndarray, run: int, least: float, base: int) -> list[tuple[int, int, float]]:
    """Disjoint runs of at most ``run`` shingles with the share ``least`` of t's, from the left: as
    many as there can be; of those the fullest, then the shortest, then the first. As (start, length, share)."""
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    where = np.flatnonzero(t[at] == s)
    place, kind = where.tolist(), at[where].tolist()
    counts: dict[int, int] = {}
    # Of the hits before each: (runs, shingles held, minus length) of the best choice, and its last run.
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    last: list[tuple[int, int, int] | None] = [None]
    low = 0
    for high, k in enumerate(kind):
        counts[k] = counts.get(k, 0) + 1
        # A hit that comes again inside the run adds nothing to it, nor to any later one.
        while place[high] - place[low] >= run or counts[kind[low]] > 1:
            counts[kind[low]] -= 1
            if not counts[kind[low]]:
                del counts[kind[low]]
            low += 1
        top, chosen, held = best[high], None, len(counts)
        if held >= least * len(t):
            left = dict(counts)
            for first in range(low, high + 1):
                if held < least * len(t):
                    break
                n, full, length = best[first]
                value = (n + 1, full + held, length - (place[high] + 1 - place[first]))
                if value > top:
                    top, chosen = value, (first, high, held)
                left[kind[first]] -= 1
                held -= not left[kind[first]]
        best.append(top)
        last.append(chosen)
    out: list[tuple[int, int, float]] = []
    end = len(place)
    while end:
        if last[end] is None:
            end -= 1
        else:
            first, high, held = last[end]
            out.append((base + place[first], place[high] + 1 - place[first], held / len(t)))
            end = first
    return out[::-1]


@cache
def index(config: LicenseConfig) -> Index:
    return Index(config)


MATCHES = T.StructType([T.StructField("license", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType()), T.StructField("containment", T.DoubleType())])


def _scan(config: LicenseConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index(config)
        names = [f.name for f in MATCHES.fields]
        for part in slices(batches, "text", chars=4 << 20):
            each = [shingles(word_hashes(t)) for t in texts(part.column("text"))]
            rows = ix.places(np.concatenate(each), np.cumsum([len(e) for e in each])) if each else []
            rows = sorted(((text, name, first, n + SHINGLE - 1, share) for text, name, first, n, share in rows), key=lambda r: (r[0], r[2], r[1]))
            taken = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(taken), *(pa.array([r[i + 1] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64())))], ["doc_id", *names])

    return run


def scanned(docs: DataFrame, config: LicenseConfig = LicenseConfig()) -> DataFrame:
    """A row for each place of a template: doc_id, license, first_word, words, containment.

    Words count from 0 in the whole text. A null text, or one of fewer than five words,
    has no place. A null doc_id stays null; repeated rows give repeated places.
    """
    schema = T.StructType([docs.schema["doc_id"], *MATCHES.fields])
    return docs.select("doc_id", "text").mapInArrow(_scan(config), schema)
