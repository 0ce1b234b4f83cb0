"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_wrapper, language_model, licenses, mil_classifier, packing, positional_index, quality_rules, sharding, simhash, warc
from .common import new_path, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_wrapper.main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(quality_rules.text_stats(table(spark, sf_dir, "documents"), ["doc_id"]), "op2")
    rules = quality_rules.fit(stats, table(spark, sf_dir, "labels"))
    return quality_rules.judge(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    written = warc.write(warc.resolve(table(spark, sf_dir, "pages")), path)
    records = stage(warc.read(spark, path), "records")  # without payloads
    if (n := records.count()) != written:
        raise RuntimeError(f"{written} records were written, {n} read")
    broken = F.raise_error(F.lit("an archive's payload doesn't match its headers"))
    return records.select(
        F.when(F.col("sound"), F.col("page_id")).otherwise(broken).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mil_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = mil_classifier.score(docs, model, ["doc_id"])
    return scored.select("doc_id", mil_classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return marked.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_texts(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    join = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", join("base_labels"), join("labels"), "score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), ["doc_id"])


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_html_extraction, op2_quality_rules, op3_benchmark_decontamination, op4_simhash_near_dedup, op5_best_fit_packing, op6_warc_revisits, op7_quality_classifier,
        op8_license_scans, op9_sharding, op10_lm_scoring,
    )}


WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT rn, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT rn, i, n, item_id FROM grams JOIN win USING (n, g)),
hit AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rn, i, n FROM occ)) GROUP BY rn),
item AS (SELECT rn, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rn) LEFT JOIN item USING (rn)
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": OP3_SQL, "op6_warc_revisits": OP6_SQL, "op8_license_scans": licenses.oracle_sql()}
