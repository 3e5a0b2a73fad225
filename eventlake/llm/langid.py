"""Language identification by words first, then by shorter and shorter n-grams.

A known word scores its log frequency in each language. A word that no language
knows backs off to its character n-grams (with ``_`` at its ends): the longest
length of which any n-gram is known decides, with the mean log frequency of the
known n-grams of that length. A text's language is the one with the largest sum.

The tables are a classifier, so they're fitted on a bounded, documented sample of
labelled rows (``max_rows``), of which every word and n-gram is kept. They are counted
in Spark and stay in sorted hash arrays in the shared folder, which workers map into
memory; only their paths and totals reach the driver. Prediction reads every whole
text: the words of a slice are told apart once, those not seen before are looked up
together, and a text's score is a sum of rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, renamed, schema_with, scratch_path, slices, texts, written
from .hasharrays import CountTable, by_key, cut, pack, save, sorted_counts, squeeze, unpack, widen

UND = "und"
#: A run of letters; marks and the rare numeric signs that are no letters go later.
_RUN = re.compile(r"[^\W\d_]+")
#: Shards of each table by the top bits of a key. The sample is bounded, so their number is fixed.
SHARD_BITS = 3
#: Words that a counting task holds before it sends what it has.
HELD = 300_000


@dataclass(frozen=True)
class LangIdConfig:
    #: Labelled rows that training takes in expectation, drawn by a hash of the id.
    max_rows: int = 20_000
    #: Longest n-gram of the back-off.
    longest: int = 5
    smoothing: float = 0.5
    #: Distinct labels; more raise ValueError, as they can't be languages.
    most_langs: int = 1000


@dataclass
class LangModel:
    """Where the count tables are (0: words, k: n-grams of k characters) and their totals."""

    langs: list[str]
    longest: int
    smoothing: float
    files: list[dict[int, tuple[str, int]]] = field(default_factory=list)
    #: Entries of each table, and counts by table and language.
    entries: list[int] = field(default_factory=list)
    totals: np.ndarray | None = None


def gram_keys(words: list[str], longest: int) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """Of each position of the padded words: its word's index, the characters from there to
    the word's end; and for each length 1..longest a hash of the n-gram that starts there."""
    characters = np.frombuffer("".join(f"_{w}_" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    left = np.cumsum(size)[word] - np.arange(len(characters))

    def keys() -> Iterator[np.ndarray]:
        h = np.full(len(characters), 0x9E3779B97F4A7C15, np.uint64)
        for k in range(longest):
            h[: len(h) - k] ^= characters[k:]
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            yield h * np.uint64(0xC4CEB9FE1A85EC53)

    return word, left, keys()


def word_keys(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def _letters(text: str | None) -> list[str]:
    """The text's words: letters only, lower-cased; a run without a letter is no word."""
    found = _RUN.findall(text.lower()) if text else []
    return found if "".join(found).isalpha() or not found else [w for run in found if (w := run if run.isalpha() else "".join(filter(str.isalpha, run)))]


_COUNTED = "shard int, tab int, lang int, n long, keys binary, counts binary"


def _count(place: dict[str, int], longest: int):
    """Sorted counts by table, language and shard."""

    def flush(counts: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            words, n = list(c), np.fromiter(c.values(), np.int64, len(c))
            tables = [(word_keys(words), n)]
            at, left, keys = gram_keys(words, longest)
            for k, h in enumerate(keys, 1):
                whole = left >= k
                tables.append((h[whole], n[at[whole]]))
            for tab, (keys_, of) in enumerate(tables):
                known, sums = sorted_counts(keys_, of)
                rows = [(s, tab, lang, b - a, pack(known[a:b]), squeeze(sums[a:b])) for s, a, b in cut(known, SHARD_BITS)]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["shard", "tab", "lang", "n", "keys", "counts"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}
        for part in slices(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), texts(part.column("text")), strict=True):
                if found := _letters(text):
                    counts.setdefault(place[lang], Counter()).update(found)
            if sum(map(len, counts.values())) > HELD:
                yield from flush(counts)
        yield from flush(counts)

    return run


def _save_tables(folder: str, width: int):
    """Merge the parts of each (shard, table) into a file: keys, then a row of counts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, tab), rows in by_key(batches, "shard", "tab"):
            each = [(unpack(r["keys"], r["n"], "<u8"), widen(r["counts"], r["n"]), r["lang"]) for r in rows]
            known = np.unique(np.concatenate([keys for keys, _, _ in each]))
            counts = np.zeros((len(known), width), np.int64)
            for keys, n, lang in each:
                counts[np.searchsorted(known, keys), lang] += n.astype(np.int64)
            path = save(folder, f"table-{tab}-{shard}", [known, np.minimum(counts, 0xFFFFFFFF).astype("<u4")])
            yield pa.RecordBatch.from_pylist([{"shard": shard, "tab": tab, "path": path, "n": len(known), "totals": counts.sum(axis=0).tolist()}], pa.schema([("shard", pa.int32()), ("tab", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("totals", pa.list_(pa.int64()))]))

    return run


def _usable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1)).select("doc_id", "lang", "text")


def training_rows(docs: DataFrame, n: int, config: LangIdConfig = LangIdConfig()) -> DataFrame:
    """Labelled rows to learn from: the id's crc32 mod 3 isn't 1, then, if these ``n`` rows are
    over ``max_rows``, a hash of the id keeps about so many of them, whole texts each."""
    usable = _usable(docs)
    if n > config.max_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * config.max_rows / n))
    return usable.where(F.col("text").isNotNull()).select("lang", "text")


def train(docs: DataFrame, config: LangIdConfig = LangIdConfig()) -> LangModel:
    """Count the tables. Rows with a null id, label or text teach nothing; repeated rows count
    as often as they come. No labelled text with a letter gives a model without languages,
    which calls every text ``und``."""
    found = _usable(docs).groupBy("lang").agg(F.count("*").alias("n")).limit(config.most_langs + 1).collect()
    if len(found) > config.most_langs:
        raise ValueError(f"over {config.most_langs} distinct labels")
    langs, n = sorted(r["lang"] for r in found), sum(r["n"] for r in found)
    if not langs:
        return LangModel([], config.longest, config.smoothing)
    folder = scratch_path(docs.sparkSession, "langid")
    counted = training_rows(docs, n, config).mapInArrow(_count({lang: i for i, lang in enumerate(langs)}, config.longest), _COUNTED)
    parts = counted.repartition(1 << SHARD_BITS, "shard").sortWithinPartitions("shard", "tab").mapInArrow(_save_tables(folder, len(langs)), "shard int, tab int, path string, n long, totals array<long>")
    model = LangModel(langs, config.longest, config.smoothing, [{} for _ in range(config.longest + 1)], [0] * (config.longest + 1), np.zeros((config.longest + 1, len(langs))))
    for r in written(parts, "langid-tables").collect():  # a row for each shard and table
        model.files[r["tab"]][r["shard"]] = (r["path"], r["n"])
        model.entries[r["tab"]] += r["n"]
        model.totals[r["tab"]] += r["totals"]
    return model


class Scorer:
    """Rows of new words: a log frequency for each language, whether the word is known, and
    how long its evidence is (1 for a known word, else the share of the longest n-gram)."""

    def __init__(self, m: LangModel):
        self.m, self.width = m, len(m.langs)
        self.tables = [CountTable(files, SHARD_BITS, self.width) for files in m.files]
        #: A label whose texts have no letter is no candidate.
        self.never = np.where(m.totals[0] > 0, 0.0, -np.inf) if self.width else np.zeros(0)

    def _logs(self, tab: int, counts: np.ndarray) -> np.ndarray:
        a = self.m.smoothing
        return np.log((counts + a) / (self.m.totals[tab] + a * (self.m.entries[tab] + 1)))

    def rows(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.width + 2))
        there, counts = self.tables[0].find(word_keys(words))
        out[there, : self.width] = self._logs(0, counts[there])
        out[there, self.width :] = 1
        open_ = np.flatnonzero(~there)
        if not len(open_):
            return out
        at, left, keys = gram_keys([words[i] for i in open_], self.m.longest)
        by_length = list(keys)
        pending = np.ones(len(open_), bool)
        for k in range(self.m.longest, 0, -1):
            place = np.flatnonzero((left >= k) & pending[at])
            there, counts = self.tables[k].find(by_length[k - 1][place])
            if there.any():
                word, logs = at[place[there]], self._logs(k, counts[there])
                n = np.bincount(word, minlength=len(open_))
                hit = n > 0
                for lang in range(self.width):
                    out[open_[hit], lang] = np.bincount(word, logs[:, lang], len(open_))[hit] / n[hit]
                out[open_[hit], self.width + 1] = k / self.m.longest
                pending &= ~hit
        return out


class _Places(dict):
    """Word to its row; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _predictor(sent, cached: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LangModel = sent.value
        scorer = Scorer(m) if m.langs else None
        places, table, filled = _Places(), np.zeros((1 << 16, len(m.langs) + 2)), 0
        for part in slices(batches, "text"):
            if len(places) > cached:  # frequent words come back at once
                places, filled = _Places(), 0
            get = places.__getitem__
            each = [np.fromiter(map(get, found), np.int64, len(found)) for found in map(_letters, texts(part.column("text")))]
            if len(places) > filled:
                new = list(places)[filled:] if not filled else [w for w, at in places.items() if at >= filled]
                if len(places) > len(table):
                    table = np.concatenate([table, np.zeros((max(len(table), len(places)), table.shape[1]))])
                if scorer:
                    for at in range(0, len(new), 1 << 15):
                        table[filled + at : filled + at + len(new[at : at + (1 << 15)])] = scorer.rows(new[at : at + (1 << 15)])
                filled = len(places)
            langs, scores, fits = [], [], []
            for ids in each:
                n = len(ids)
                if not n or not scorer:
                    told = (UND, 0.0, 0.0)
                else:
                    total = sum(table[ids[at : at + (1 << 16)]].sum(axis=0) for at in range(0, n, 1 << 16))
                    sums = total[:-2] + scorer.never
                    best = int(np.argmax(sums))
                    told = (m.langs[best], float(1.0 / np.exp(np.minimum(sums - sums[best], 0)).sum()), float(total[-1] / n)) if sums[best] > -np.inf else (UND, 0.0, 0.0)
                for made, x in zip((langs, scores, fits), told, strict=True):
                    made.append(x)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())], [*part.schema.names, "lang_pred", "score", "fit"])

    return run


def identify(docs: DataFrame, model: LangModel, *, cached: int = 400_000) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``fit`` to every row; the text alone is looked at.

    score is the language's posterior share. It nears 1 after some words whatever they are;
    fit doesn't grow with the text: the mean over words of 1 for a known word, else of the
    length of its known n-grams as a share of the longest. A null text, or one without a
    letter, is ``und`` with score and fit 0. Of languages that score alike the first by code
    point wins. Bytes that aren't UTF-8 count as U+FFFD. Columns that already have these
    names are kept as ``<name>_in``. Repeated rows get repeated, equal answers.
    """
    docs = renamed(docs, ["lang_pred", "score", "fit"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # paths and totals only
    return docs.mapInArrow(_predictor(sent, cached), schema_with(docs, ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("fit", T.DoubleType())))


def accepted(docs: DataFrame, model: LangModel, *, least: float = 0.4, least_fit: float = 0.5) -> DataFrame:
    """Rows whose language is told with a posterior share of ``least`` or more and whose words
    are like those of the languages (fit ``least_fit`` or more), whatever their length."""
    columns = docs.columns
    told = identify(docs, model).where((F.col("lang_pred") != UND) & (F.col("score") >= least) & (F.col("fit") >= least_fit))
    return told.select(*columns)
