"""How filters interact: a trie of filter orders, walked depth first over survivors.

A node of the trie of permutations is a prefix of filters already applied. What is left
of the documents depends on the prefix as a set only, so each set is visited once, by
whichever order comes first, and remembered. A node's survivors are a persisted DataFrame
made by applying one filter to its parent's; one aggregation over them counts, for every
filter that may come next, the documents which that filter really removes there. With n
filters 2^n - 1 sets are visited instead of the n! orders, and at most n + 1 frames are
persisted at once: a node's frame goes when its subtree is done.

Survivors are narrow rows (part, outcomes, marks) of the documents, written once in the
shared folder, so that a lost executor's blocks are computed anew from there. Counts are
a table (part, set of filters applied), written node by node; only static tables of the
filters' orders are in the plan besides.
"""

from __future__ import annotations

import itertools
import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, written

_BLANK = r"[\x20\x09-\x0D]+"
_LETTERS = "ABCDE"


def outcomes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row (part, A, B, C, D, E, good, toxic) of every row of ``docs``: which filters it
    fails, and how ``labels`` marks it.

    A: under 200 words; B: distinct words are under half of the words; C: more than 2% of the
    characters are in A-Z; D: holds any of #$%&*|; E: some smaller doc_id has the identical
    text. Texts meet by two 64-bit hashes with seeds of their own; of a group of copies only
    the least id travels back, and it's combined before the shuffle. A null text is empty, a
    null source the part ''. Without an id a row never fails E, nor makes another fail it, and
    has no label; rows of the same id don't make each other fail E. A document is good (or
    toxic) if any of its label rows says so. Other columns aren't looked at.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, _BLANK), "")
    read = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    rows = written(
        read.select(
            "id",
            "part",
            (F.size("words") < 200).alias("A"),
            (F.size(F.array_distinct("words")) * 100 < F.size("words") * 50).alias("B"),
            (F.regexp_count("text", F.lit("[A-Z]")).cast("long") * 100 > F.length("text") * 2).alias("C"),
            F.col("text").rlike("[#$%&*|]").alias("D"),
            F.xxhash64(F.lit(1), "text").alias("k1"),
            F.xxhash64(F.lit(2), "text").alias("k2"),
        ),
        "outcomes",
    )
    copies = rows.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1 AND least IS NOT NULL").drop("n")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    met = rows.join(copies, ["k1", "k2"], "left").drop("k1", "k2").join(marks, "id", "left")
    no = F.lit(False)
    return met.select("part", "A", "B", "C", "D", F.coalesce(F.col("id") > F.col("least"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def walked(rows: DataFrame, filters: list[str], marks: list[str], part: str = "part") -> DataFrame:
    """Walk the trie over ``rows``, which say by boolean columns which filters they fail and
    which marks they have. A row (part, state, total, removed, lost) for each part and set of
    filters applied (a bit each, in the order of ``filters``) that any rows survive:
    ``removed[f]`` rows would go next by filter f, ``lost[f][m]`` of them with mark m."""
    spark = rows.sparkSession
    path = scratch_path(spark, "trie")
    seen: set[int] = set()

    # The same expressions at every node, so that they are compiled once: filters applied before remove nothing.
    counts = [_count(F.col(f), f"r{k}") for k, f in enumerate(filters)] + [_count(F.col(f) & F.col(m), f"l{k}_{j}") for k, f in enumerate(filters) for j, m in enumerate(marks)]
    removed = F.array(*(F.col(f"r{k}") for k in range(len(filters))))
    lost = F.array(*(F.array(*(F.col(f"l{k}_{j}") for j in range(len(marks)))) for k in range(len(filters))))

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        at = survivors.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("total"), *counts)
        at.select("part", "total", removed.alias("removed"), lost.alias("lost")).coalesce(8).write.parquet(f"{path}/state={state}")
        todo = [k for k in range(len(filters)) if not state >> k & 1]
        for k in todo:
            below = state | 1 << k
            if len(todo) == 1 or below in seen:  # nothing is left to count below, or another order has counted it
                continue
            left = survivors.where(~F.col(filters[k])).persist(StorageLevel.MEMORY_AND_DISK)
            visit(below, left)
            left.unpersist()

    top = rows.select(part, *filters, *marks).persist(StorageLevel.MEMORY_AND_DISK)
    visit(0, top)
    top.unpersist()
    return spark.read.schema(f"part {rows.schema[part].dataType.simpleString()}, total long, removed array<long>, lost array<array<long>>, state int").parquet(path)


def orders(filters: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, filter, set of filters before) of every step of every permutation."""
    found = []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order):
            found.append(("".join(filters[i] for i in order), step + 1, k, before))
            before |= 1 << k
    return found


def interactions(walk: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """A row for each part, order and step, from the counts of ``walked``: part, filter_order,
    step, kept, removed, redundant, unique_fails, <mark>_lost for each mark, and shapley."""
    n = len(filters)
    whole = (1 << n) - 1
    by_part = walk.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("total", "removed", "lost").alias("v")))).alias("at"))

    def removed(state: Column, k: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("at"), state)["removed"][k], F.lit(0))

    def weighted(k: int) -> Column:
        """Removals by filter k, summed over the orders: each set before it has |set|! (n - 1 - |set|)! of them."""
        total = F.lit(0).cast("long")
        for state in range(1 << n):
            if not state >> k & 1:
                ways = math.factorial(state.bit_count()) * math.factorial(n - 1 - state.bit_count())
                total = total + removed(F.lit(state), F.lit(k)) * F.lit(ways)
        return total

    steps = F.expr("array(" + ", ".join(f"named_struct('filter_order', '{o}', 'step', {s}, 'k', {k}, 'before', {b})" for o, s, k, b in orders(filters)) + ")")
    each = by_part.select("part", "at", F.array(*(weighted(k) for k in range(n))).alias("shapley"), F.explode(steps).alias("o"))
    here = F.try_element_at(F.col("at"), F.col("o.before"))
    gone = removed(F.col("o.before"), F.col("o.k"))
    alone = F.array(*(F.lit(whole - (1 << k)) for k in range(n)))[F.col("o.k")]
    return each.select(
        "part",
        F.col("o.filter_order").alias("filter_order"),
        F.col("o.step").alias("step"),
        (F.coalesce(here["total"], F.lit(0)) - gone).alias("kept"),
        gone.alias("removed"),
        (removed(F.lit(0), F.col("o.k")) - gone).alias("redundant"),
        removed(alone, F.col("o.k")).alias("unique_fails"),
        *(F.coalesce(here["lost"][F.col("o.k")][j], F.lit(0)).alias(f"{m}_lost") for j, m in enumerate(marks)),
        F.col("shapley")[F.col("o.k")].alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over documents: 600 rows for each source. No documents, no rows."""
    rows = written(outcomes(docs, labels), "audit")
    names = list(_LETTERS)
    return interactions(walked(rows, names, ["good", "toxic"]), names, ["good", "toxic"])


#: Written from the definitions: outcomes are counted by mask, then every step looks at all masks.
ORACLE_SQL = r"""WITH marks AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM texts LEFT JOIN marks ON marks.doc_id = texts.doc_id
), masks AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, mask
), letters AS (SELECT unnest(range(5)) AS k), perms AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS (
  SELECT array_to_string([substr('ABCDE', (x + 1)::INT, 1) for x in ks], '') AS filter_order, s AS step,
    (1 << ks[s]::INT) AS f, coalesce(list_sum([1 << x::INT for x in ks[1:s - 1]]), 0)::BIGINT AS before
  FROM perms, (SELECT unnest(range(1, 6)) AS s)
), each_step AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER (WHERE mask & (before | f) = 0) AS kept,
    sum(n) FILTER (WHERE mask & before = 0 AND mask & f <> 0) AS removed,
    sum(n) FILTER (WHERE mask & before <> 0 AND mask & f <> 0) AS redundant,
    sum(n) FILTER (WHERE mask = f) AS unique_fails,
    sum(good) FILTER (WHERE mask & before = 0 AND mask & f <> 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & before = 0 AND mask & f <> 0) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM each_step"""
