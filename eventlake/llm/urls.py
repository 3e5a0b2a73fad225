"""URL filters: block and allow rules by host and path, and boosted trees for the rest.

A rule fits its host and all subdomains if the path starts with the rule's path; the
longest rule wins. URLs that no rule fits are judged by gradient-boosted trees on
lexical features, trained from labelled URLs: those of a label column (``train``), or
those that the rules label. The trees are a classifier and are fitted on at most ``max_rows``
different labelled URLs, those with the least hashes, a repeated one with more weight; the
suffix statistics count all labelled rows, in ``suffix_buckets`` hash buckets.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Trees, fit
from .common import lower_ascii, renamed, schema_with, slices, texts

BLOCK, ALLOW = "block", "allow"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: The production rules.
RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))


@dataclass(frozen=True)
class UrlConfig:
    rules: tuple[tuple[str, str], ...] = RULES
    #: Different labelled URLs that the trees are fitted on, at most.
    max_rows: int = 20_000
    suffix_buckets: int = 4096
    rounds: int = 40
    depth: int = 4


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, config: UrlConfig = UrlConfig()) -> DataFrame:
    """Add host, path, rule and rule_verdict. A null URL, or one without ``://``, has an
    empty host and path and fits no rule."""
    pages = renamed(pages, ["host", "path", "rule", "rule_verdict"])
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(config.rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tried first
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return out.withColumns({"rule": rule, "rule_verdict": verdict})


def suffixes(host: str) -> tuple[str, str]:
    """The last label and the last two labels of a host."""
    parts = host.rsplit(".", 2)
    return parts[-1], ".".join(parts[-2:])


def bucket(text: str, buckets: int) -> int:
    return xxhash.xxh64_intdigest(text.encode(), 7) % buckets


PRIOR = 20.0
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "upper_ratio", "entropy", "parameters", "longest_segment", "hyphens", "has_fragment", "suffix", "suffix2"]


def features(url: str | None, stats: np.ndarray) -> list[float]:
    """Lexical features of a URL. The suffix rates lean to one half by ``PRIOR`` rows, so
    that a rare suffix doesn't tell a training row its own label."""
    url = url or ""
    head, sep, rest = url.partition("://")
    rest = rest if sep else ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut].translate(_LOWER), rest[cut:]
    path = tail.split("#")[0].split("?")[0]
    query = tail.split("#")[0].partition("?")[2]
    n = max(1, len(url))
    counts = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    rates = []
    for s in suffixes(host):
        seen, blocked = stats[bucket(s, len(stats))]
        rates.append((blocked + PRIOR / 2) / (seen + PRIOR))
    segments = path.split("/")
    return [len(url), len(host), len(path), path.count("/"), host.count(".") + 1, sum(c.isdigit() for c in url) / n, sum(c.isupper() for c in url) / n, entropy, query.count("&") + 1 if query else 0, max(map(len, segments)), host.count("-"), float("#" in tail), *rates]


@dataclass
class UrlModel:
    trees: Trees
    stats: np.ndarray

    def block_share(self, urls: list[str | None]) -> np.ndarray:
        x = np.array([features(u, self.stats) for u in urls], np.float64).reshape(-1, len(FEATURES))
        return 1 / (1 + np.exp(-self.trees.score(x)))


def _suffix_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, blocked = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for part in slices(batches, rows=4096):
            for host, label in zip(texts(part.column("host")), part.column("label").to_pylist(), strict=True):
                for s in suffixes(host):
                    at = bucket(s, buckets)
                    seen[at] += 1
                    blocked[at] += label
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at]), pa.array(blocked[at])], ["bucket", "seen", "blocked"])

    return run


def train(labelled: DataFrame, config: UrlConfig = UrlConfig()) -> UrlModel:
    """Fit on rows (url, label); label is 1 for URLs to block, 0 for others, and rows without one
    teach nothing. Labels of a repeated URL are averaged; it weighs 1 + log2 of its rows, so that one
    with very many doesn't drown the rest. Without any label the odds are even."""
    known = labelled.where(F.col("label").isNotNull()).select("url", host_of(F.col("url")).alias("host"), F.col("label").cast("int").alias("label"))
    stats = np.zeros((config.suffix_buckets, 2))
    for r in known.select("host", "label").mapInArrow(_suffix_counts(config.suffix_buckets), "bucket int, seen long, blocked long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("blocked").alias("blocked")).collect():
        stats[r["bucket"]] = r["seen"], r["blocked"]
    hashed = known.select("url", "label", F.xxhash64("url").alias("h"))
    # Few more URLs than are taken pass the hash, so what is grouped and sent is bounded.
    different = max(1, hashed.agg(F.approx_count_distinct("h", 0.02).alias("n")).first()["n"])
    share = 1.5 * config.max_rows / different
    some = hashed.where(F.col("h") < int((1 << 64) * share) - (1 << 63)) if share < 1 else hashed
    rows = some.groupBy("h", "url").agg(F.avg("label").alias("label"), F.count("*").alias("n")).orderBy("h", "url").limit(config.max_rows).collect()
    x = np.array([features(r["url"], stats) for r in rows], np.float64).reshape(-1, len(FEATURES))
    weight = 1 + np.log2(np.array([r["n"] for r in rows], np.float64))
    return UrlModel(fit(x, np.array([r["label"] for r in rows], np.float64), weight, rounds=config.rounds, depth=config.depth), stats)


def rule_labels(ruled: DataFrame) -> DataFrame:
    """(url, label) of the rows of ``with_rule`` that rules label."""
    return ruled.where(F.col("rule_verdict").isNotNull()).select("url", (F.col("rule_verdict") == BLOCK).cast("int").alias("label"))


def _judge(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: UrlModel = sent.value
        for part in slices(batches, rows=2048):
            share = model.block_share(texts(part.column("url")))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(share, pa.float64())], [*part.schema.names, "block_share"])

    return run


def judged(pages: DataFrame, config: UrlConfig = UrlConfig(), model: UrlModel | None = None) -> DataFrame:
    """Add host, path, rule (null if none fits), verdict (the rule's, else the trees') and
    block_share (the trees' probability) to every row. ``model`` comes from labels of one's own
    (``train``); without it the URLs that rules label teach the trees.

    An even chance is allowed. Columns with these names become ``<name>_in``; repeated
    rows get equal answers; an empty table gives no rows.
    """
    pages = renamed(pages, ["host", "path", "rule", "rule_verdict", "block_share", "verdict"])
    ruled = with_rule(pages, config)
    sent = pages.sparkSession.sparkContext.broadcast(model or train(rule_labels(ruled), config))  # trees and suffix_buckets rows
    scored = ruled.mapInArrow(_judge(sent), schema_with(ruled, ("block_share", T.DoubleType())))
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_share") > 0.5, BLOCK).otherwise(ALLOW))
    return scored.withColumn("verdict", verdict).drop("rule_verdict")


def filtered(pages: DataFrame, config: UrlConfig = UrlConfig()) -> DataFrame:
    """The rows whose URL is allowed, with the columns of ``pages``."""
    marked = judged(pages.withColumn("url_", F.col("url")), config)
    names = {c.lower() for c in ("host", "path", "rule", "rule_verdict", "block_share", "verdict")}
    return marked.where("verdict = 'allow'").select(*[F.col(f"{c}_in").alias(c) if c.lower() in names else F.col(c) for c in pages.columns])


#: Host, path and rule as DuckDB SQL (the trees' verdicts can't be: see tests/llm).
RULE_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
FROM parts
"""
