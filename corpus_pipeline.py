"""A corpus pipeline of four stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; its result is written as Parquet and reread as the next one's documents. All but
the last return the columns of documents, and further columns whatever their names.

A null or empty text has no language, so the first stage drops it. A row without an id
isn't learned from, is never a duplicate, and is mixed and packed like any other. Rows
that are alike in id and text are one document after the second stage. Texts may be of
any length; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlake.llm import langid, mixing, neardup, packing
from eventlake.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told and whose words are like those of the languages."""
    return langid.accepted(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the least doc_id. SimHash tries
    find candidates; five-word shingles at a Jaccard similarity of 0.8 decide."""
    return neardup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut and drop documents so that sources have their target shares of words."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mix into token sequences."""
    return packing.pack_report(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: The stages learn, hash and solve; SQL can't express them. tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
