"""The operators as queries over whole tables: thin wrappers that make digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import audit, chat, codebooks, langid, licenses, media, mixing, ngram, packing, quality, simhash, urls, vectors
from .common import crc_mod, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 64 bits, three-word shingles, links at three bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    told = urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"))
    return told.select("page_id", "host", "path", "rule", "verdict", "block_share")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's stored WAV, of the payload read back, and of features computed from it."""
    kept = media.loaded(media.stored(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return kept.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.crc32("pcm").alias("pcm_crc32"),
    )


def op4_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document; four fifths of the ids teach."""
    return ngram.split_scores(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted examples of every conversation, and of conversation -1, read back as."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{tricky}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.read_back(chat.examples(turns.union(more)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source size, target and taken words of every document."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each place of a licence text in any document."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.95."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_report(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; two thirds of the ids teach."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    told = langid.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "fit")


def op11_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and the digest of the final codebooks of every vector that can be coded."""
    return codebooks.coded(table(spark, sf_dir, "embeddings"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, what the base rules say, and whether its group's thresholds keep it."""
    return quality.report(table(spark, sf_dir, "documents"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all 120 orders, by source."""
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op2_urls."""
    return op2_urls(spark, sf_dir).select("page_id", "host", "path", "rule")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op6_mixing: sizes, targets, that no document exceeds three times its
    size, and that the words taken of its source come within a block or 2% of the target."""
    docs = table(spark, sf_dir, "documents")
    told = mixing.mix_plan(docs)
    near = F.abs(F.sum("taken").over(Window.partitionBy("source")) - F.col("target")) <= F.greatest(F.lit(float(mixing.MixConfig().block)), F.col("target") * 0.02)
    return told.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("bounded"), near.alias("near"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op3_media."""
    return op3_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes")


QUERIES = {
    "url_rules": url_rules,
    "mixing_targets": mixing_targets,
    "media_payloads": media_payloads,
    "op1_simhash": op1_simhash,
    "op2_urls": op2_urls,
    "op3_media": op3_media,
    "op4_ngram": op4_ngram,
    "op5_chat": op5_chat,
    "op6_mixing": op6_mixing,
    "op7_licenses": op7_licenses,
    "op8_vectors": op8_vectors,
    "op9_packing": op9_packing,
    "op10_langid": op10_langid,
    "op11_codebooks": op11_codebooks,
    "op12_quality": op12_quality,
    "op13_audit": op13_audit,
}

#: A word in DuckDB's regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"

#: Only what SQL can express over whole tables; tests/llm holds the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_chat": chat.ORACLE_SQL,
    "op11_codebooks": codebooks.ORACLE_SQL,
    "op12_quality": quality.ORACLE_SQL,
    "op13_audit": audit.ORACLE_SQL,
    "url_rules": urls.RULE_SQL,
    "mixing_targets": f"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD_SQL}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT 0 AS k, source, size, w, false AS cap, true AS go FROM s
  UNION ALL SELECT k + 1, source, size, w, cap OR over, bool_or(over AND NOT cap) OVER () FROM (
    SELECT *, coalesce((sum(size) OVER () - coalesce(sum(3 * size) FILTER (WHERE cap) OVER (), 0)) * w / sum(w) FILTER (WHERE NOT cap) OVER () > 3 * size, false) AS over FROM r WHERE go)),
t AS (SELECT source, size, CASE WHEN cap THEN 3 * size ELSE (sum(size) OVER () - coalesce(sum(3 * size) FILTER (WHERE cap) OVER (), 0)) * w / sum(w) FILTER (WHERE NOT cap) OVER () END AS target
  FROM r WHERE k = (SELECT max(k) FROM r))
SELECT doc_id, d.size, t.size::BIGINT AS source_size, round(target, 3) AS target, true AS bounded, true AS near FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
    "media_payloads": """SELECT doc_id, n AS n_bytes, CAST(576 * greatest(1, (n + 575) // 576) AS BIGINT) AS payload_bytes
FROM (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n FROM documents)""",
}
