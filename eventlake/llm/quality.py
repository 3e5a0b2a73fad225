"""Quality rules whose thresholds follow the data: quantile sketches by language and source.

A rule is a rate of two counts of a document (symbols a word, say), held as an integer of
``SCALE`` parts. The sketch of a group is a histogram of such values rounded down to their
seven leading bits: values below 128 are exact, others within 1/64. It is a table (keys,
rule, value, n), so that sketches of tasks, sources or days merge by adding counts, in any
order, to the same result; a group has at most some 2,000 rows a rule, however many
documents it has, and they combine before the shuffle.

A document fails a rule if its value lies outside the group's fence: the quartiles widened
by ``reach`` times their distance, and by the rule's own ``slack`` where a group hardly
varies. A group with under ``least_docs`` documents takes the merged sketch of its
language, and a small language that of all documents. Sketches describe the documents
that the fixed base rules leave, as those are the ones to be judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, checkpoint, raw_texts, renamed, schema_with, slices, small_side, written

#: Parts of one that a rate is held in.
SCALE = 10_000
_STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    name: str
    part: str
    whole: str
    #: Added to the fence, in parts of SCALE.
    slack: int
    low: bool = False


@dataclass(frozen=True)
class QualityConfig:
    rules: tuple[Rule, ...] = (
        Rule("symbols", "n_symbols", "n_words", 1_000),
        Rule("word_length", "word_chars", "n_words", 5_000, low=True),
        Rule("dup_lines", "n_dup_lines", "n_lines", 4_000),
        Rule("repeats", "n_repeat_words", "n_words", 4_000),
    )
    keys: tuple[str, ...] = ("lang", "source")
    least_docs: int = 200
    reach: int = 3
    #: Base rules: fewest words, and percent of words in repeated windows.
    least_words: int = 50
    most_repeats: int = 50


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BLANKS = np.zeros(256, bool)
_BLANKS[list(b" \t\n\v\f\r")] = True


def _repeated(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document the number of words in three-word windows that it has twice or more.
    ``ids`` are the words of all documents one after another, ``doc`` says whose each is."""
    count = np.zeros(n_docs, np.int64)
    if len(ids) < 3:
        return count
    inside = np.flatnonzero(doc[2:] == doc[:-2])
    # Windows are told apart step by step, so that no number grows beyond rows times words.
    most = np.int64(ids.max()) + 1
    key = doc[inside]
    for k in range(3):
        key = np.unique(key * most + ids[inside + k], return_inverse=True)[1] if k < 2 else key * most + ids[inside + k]
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    found = inside[times[which] > 1]
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[found + k] = True
    return np.bincount(doc[covered], minlength=n_docs)


def counted(texts: list[bytes | None]) -> list[np.ndarray]:
    """The counts ``_STATS`` of each text, as bytes; a null has none of anything."""
    n = len(texts)
    split = [t.split() if t else [] for t in texts]
    words = np.fromiter(map(len, split), np.int64, n)
    flat = [w for s in split for w in s]
    ids = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy() if flat else np.zeros(0, np.int32)
    repeats = _repeated(ids.astype(np.int64), np.repeat(np.arange(n), words), n)
    chars, symbols, lines, dups = (np.zeros(n, np.int64) for _ in range(4))
    for i, t in enumerate(texts):
        if not t:
            continue
        b = np.frombuffer(t, np.uint8)
        chars[i] = np.count_nonzero((b & 0xC0) != 0x80) - np.count_nonzero(_BLANKS[b])
        symbols[i] = np.count_nonzero(_SYMBOLS[b])
        with_words = [line for line in t.split(b"\n") if not line.isspace() and line]
        lines[i], dups[i] = len(with_words), len(with_words) - len(set(with_words))
    return [words, chars, symbols, lines, dups, repeats]


def measured(docs: DataFrame) -> DataFrame:
    """Documents with their counts: n_words, word_chars (code points in words), n_symbols,
    n_lines (with a word), n_dup_lines (equal to an earlier one), n_repeat_words (in windows of
    three words found twice or more). Columns of these names get a trailing ``_in``."""
    rows = renamed(docs, _STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = counted(raw_texts(part.column("text")))
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, found)], [*part.schema.names, *_STATS])

    return rows.mapInArrow(run, schema_with(rows, *((s, T.LongType()) for s in _STATS)))


def base_failed(config: QualityConfig = QualityConfig()) -> Column:
    """The fixed rules: too few words, or too many in repeated windows."""
    return (F.col("n_words") < config.least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * config.most_repeats)


def rate(rule: Rule) -> Column:
    """A rule's value of a document, in parts of SCALE, rounded down; 0 of nothing is 0."""
    return F.expr(f"{rule.part} * {SCALE}L div greatest({rule.whole}, 1L)")


def rounded(value: Column) -> Column:
    """An integer from 0 on with its seven leading bits kept and the others zero."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Quantile sketches (keys, rule, value, n) of named integer columns by key; null values are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), v.alias("value")) for name, v in values.items())))
    return rows.select(*keys, pairs.alias("p")).where("p.value IS NOT NULL").select(*keys, F.col("p.rule").alias("rule"), rounded(F.col("p.value")).alias("value")).groupBy(*keys, "rule", "value").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups, or of unions: counts added up."""
    return sketches.groupBy(*keys, "rule", "value").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], percents: dict[str, int]) -> DataFrame:
    """For each group and rule ``docs`` (its rows) and, by name, the least value that so many
    percent of the rows don't exceed."""
    from pyspark.sql import Window

    group = Window.partitionBy(*keys, "rule")
    ranked = sketches.withColumn("below", F.sum("n").over(group.orderBy("value"))).withColumn("docs", F.sum("n").over(group))
    return ranked.groupBy(*keys, "rule").agg(F.max("docs").alias("docs"), *(F.min(F.when(F.col("below") * 100 >= F.col("docs") * p, F.col("value"))).alias(name) for name, p in percents.items()))


def thresholds(rows: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """A row for each group of keys with ``<rule>_low`` and ``<rule>_high`` of every rule, from
    measured rows. Keys may be null. ``level`` says whose sketch it is: 0 its own, 1 its first
    key's, 2 everybody's."""
    first, own = config.keys[0], list(config.keys)
    leaf = checkpoint(sketch(rows.where(~base_failed(config)), own, {r.name: rate(r) for r in config.rules}))
    percents = {"q1": 25, "q3": 75}
    # Groups whose documents all fail the base rules have no sketch of their own, but get thresholds.
    groups = checkpoint(rows.select(*own).distinct())
    told = groups
    for level, keys in enumerate((own, [first], [])):
        q = quantiles(merged(leaf, keys), keys, percents)
        names = [F.max(F.when(F.col("rule") == r.name, F.struct("docs", "q1", "q3"))).alias(f"{r.name}_{level}") for r in config.rules]
        flat = checkpoint(q.groupBy(*keys).agg(*names)) if keys else checkpoint(q.agg(*names))
        if keys:
            right = flat.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in flat.columns if c not in keys))
            on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            told = told.join(small_side(right), on, "left").drop(*(f"_{k}" for k in keys))
        else:  # one row
            told = told.join(F.broadcast(flat), how="cross")
    out = []
    for r in config.rules:
        levels = [F.when(F.col(f"{r.name}_{k}.docs") >= config.least_docs, F.col(f"{r.name}_{k}")) for k in range(2)]
        q = F.coalesce(*levels, F.col(f"{r.name}_2"))
        wide = (q["q3"] - q["q1"]) * config.reach + r.slack
        out += [(q["q1"] - wide if r.low else F.lit(None).cast("long")).alias(f"{r.name}_low"), (q["q3"] + wide).alias(f"{r.name}_high")]
    some = config.rules[0].name
    level = F.when(F.col(f"{some}_0.docs") >= config.least_docs, 0).when(F.col(f"{some}_1.docs") >= config.least_docs, 1).otherwise(2)
    return told.select(*own, level.alias("level"), *out)


def judged(rows: DataFrame, fences: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Measured rows joined with their group's thresholds: ``base_failed``, ``failed_rules``
    (names, null if none) and ``kept``. A missing threshold fails nobody."""
    fences = small_side(checkpoint(fences))
    right = fences.select(*(F.col(k).alias(f"_{k}") for k in config.keys), *(c for c in fences.columns if c not in (*config.keys, "level")))
    met = rows.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in config.keys], "left")
    outside = [F.when((rate(r) < F.coalesce(f"{r.name}_low", F.lit(-(1 << 62)))) | (rate(r) > F.coalesce(f"{r.name}_high", F.lit(1 << 62))), r.name) for r in config.rules]
    failed = F.nullif(F.concat_ws(",", *outside), F.lit(""))
    return met.select(*rows.columns, base_failed(config).alias("base_failed"), failed.alias("failed_rules"), (~base_failed(config) & failed.isNull()).alias("kept"))


def filtered(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents that the base rules and the thresholds of their group keep, with their columns alone."""
    fences = checkpoint(thresholds(measured(docs.select("text", *config.keys)), config))
    mark = "_quality_row"
    rows = judged(measured(docs.select("text", *config.keys, F.struct(*docs.columns).alias(mark))), fences, config)
    return rows.where("kept").select(f"{mark}.*")


def report(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, text, lang, source).

    A null or empty text has no words and fails the base rules. Null languages and sources
    are groups of their own. Rows alike are judged alike; an empty table gives no rows;
    further columns aren't looked at, whatever their names.
    """
    rows = written(measured(docs.select("doc_id", "text", *config.keys)).drop("text"), "measured")
    out = judged(rows, thresholds(rows, config), config)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def _rate_sql(rule: Rule) -> str:
    return f"({rule.part} * {SCALE} // greatest({rule.whole}, 1))"


def _oracle(config: QualityConfig = QualityConfig()) -> str:
    """The same in SQL: windows are joined texts, sketches are plain groupings."""
    rules = config.rules
    values = "\n  UNION ALL ".join(f"SELECT lang, source, '{r.name}' AS rule, {_rate_sql(r)} AS v FROM good" for r in rules)
    levels = []
    for k, keys in enumerate((["lang", "source"], ["lang"], [])):
        by = ", ".join([*keys, "rule"])
        levels.append(f"""m{k} AS (SELECT {by}, value, sum(n) AS n FROM leaf GROUP BY {by}, value),
r{k} AS (SELECT {by}, value, sum(n) OVER (PARTITION BY {by} ORDER BY value) AS below, sum(n) OVER (PARTITION BY {by}) AS docs FROM m{k}),
q{k} AS (SELECT {by}, max(docs) AS docs, min(value) FILTER (WHERE below * 100 >= docs * 25) AS q1, min(value) FILTER (WHERE below * 100 >= docs * 75) AS q3 FROM r{k} GROUP BY {by})""")
    spec = ", ".join(f"('{r.name}', {r.slack}, {str(r.low).lower()})" for r in rules)
    value = "CASE f.rule " + " ".join(f"WHEN '{r.name}' THEN {_rate_sql(r)}" for r in rules) + " END"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '{WORD}') AS ws FROM d)),
tri AS (SELECT rid, i, CASE WHEN lead(w, 2) OVER o IS NOT NULL THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o END AS g, w FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i, w, g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 AS twice FROM tri),
cov AS (SELECT rid, w, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit FROM rep WINDOW o AS (PARTITION BY rid ORDER BY i)),
ws AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE hit) AS n_repeat_words FROM cov GROUP BY rid),
ls AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}') GROUP BY rid),
s AS (SELECT d.rid, doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN ws USING (rid) LEFT JOIN ls USING (rid)),
b AS (SELECT *, n_words < {config.least_words} OR 100 * n_repeat_words > {config.most_repeats} * n_words AS base_failed FROM s),
good AS (SELECT * FROM b WHERE NOT base_failed),
vals AS ({values}),
leaf AS (SELECT lang, source, rule, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS value, count(*) AS n FROM vals GROUP BY ALL),
{",\n".join(levels)},
spec(rule, slack, low) AS (VALUES {spec}),
picked AS (SELECT g.lang, g.source, spec.rule, slack, low,
  CASE WHEN q0.docs >= {config.least_docs} THEN q0.q1 WHEN q1.docs >= {config.least_docs} THEN q1.q1 ELSE q2.q1 END AS a,
  CASE WHEN q0.docs >= {config.least_docs} THEN q0.q3 WHEN q1.docs >= {config.least_docs} THEN q1.q3 ELSE q2.q3 END AS z
  FROM (SELECT DISTINCT lang, source FROM b) g, spec
  LEFT JOIN q0 ON q0.rule = spec.rule AND q0.lang IS NOT DISTINCT FROM g.lang AND q0.source IS NOT DISTINCT FROM g.source
  LEFT JOIN q1 ON q1.rule = spec.rule AND q1.lang IS NOT DISTINCT FROM g.lang LEFT JOIN q2 ON q2.rule = spec.rule),
f AS (SELECT lang, source, rule, CASE WHEN low THEN a - {config.reach} * (z - a) - slack END AS least, z + {config.reach} * (z - a) + slack AS most FROM picked),
hits AS (SELECT b.rid, string_agg(f.rule, ',' ORDER BY list_position([{", ".join(f"'{r.name}'" for r in rules)}], f.rule)) AS failed_rules
  FROM b JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source WHERE {value} > most OR {value} < least GROUP BY b.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules IS NULL AS kept, failed_rules
FROM b LEFT JOIN hits USING (rid)"""


ORACLE_SQL = _oracle()
