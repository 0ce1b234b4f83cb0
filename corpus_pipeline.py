"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of documents, for the documents that they keep:

1. the quality classifier's rejected documents go (score under 0.7);
2. documents that fail the base rules or a learned quality rule go;
3. one document of each near-duplicate class stays, that of the smallest doc_id; links are
   similarities of 0.8 or more of the sets of five-word shingles, found by SimHash fingerprints
   and, beyond their radius, by minimum hashes (README: why both);
4. contaminated documents go; a document with less benchmark text than that loses the
   passages that windows of the benchmark cover, and its n_chars follows;
5. what is left is packed into sequences of 2048 tokens.

NULL and empty texts are judged as empty texts; very long ones are read whole.  Rows repeated
whole are one document to stage 3; rows of one doc_id with other contents are documents of their
own, as are rows without doc_id; of ties the least hash stays.  Empty tables give empty tables.
Extra columns, whatever they are named, are not carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import mil_classifier, near_copies, packing, positional_index, quality_rules
from clickloom.llm.common import apart, delete, new_path, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Two independent hashes of 64 bits stand for a row or a text: one would meet another at some 10^9 rows.
KEYS = ["_key", "_key2"]


def _keyed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``KEYS`` of the columns; NULL and the empty text of a column differ."""
    said = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return df.withColumn(KEYS[0], F.xxhash64(*said)).withColumn(KEYS[1], F.xxhash64(F.lit(1), *reversed(said)))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the attention model scores 0.7 or more; one pass, no shuffle of texts."""
    docs = docs.select(*COLUMNS)
    model = mil_classifier.fit(docs, _table(spark, sf_dir, "labels"))
    return mil_classifier.score(docs, model, list(COLUMNS)).where("score >= 0.7").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the base rules and the decision list learned from labelled rows."""
    docs = docs.select(*COLUMNS)
    # statistics twice, once without texts for learning: cheaper than moving texts about
    stats = stage(quality_rules.text_stats(docs, ["doc_id"]), "stats")
    found = quality_rules.fit(stats, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(quality_rules.text_stats(docs, list(COLUMNS)), found).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class: that of the class's smallest doc_id."""
    docs = _keyed(docs.select(*COLUMNS), *COLUMNS)
    classes = near_copies.near_copies(docs, KEYS)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.struct(*KEYS) == F.col("keeper"))
    rows = stage(classes.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max(stays).alias("stays")), "classes")
    gone = rows.where(~F.col("stays")).select(*KEYS)
    clear, doubt = apart(docs, KEYS[0], gone.select(KEYS[0]))
    left = clear.unionByName(doubt.join(gone, KEYS, "left_anti"))
    repeated = rows.where("stays AND n > 1").select(*KEYS)
    if not repeated.head(1):
        return left.select(*COLUMNS)
    clear, doubt = apart(left, KEYS[0], repeated.select(KEYS[0]))
    alone = clear.unionByName(doubt.join(repeated, KEYS, "left_anti"))  # rows repeated whole: one of them
    one = doubt.join(repeated, KEYS, "left_semi").groupBy(*KEYS).agg(F.min(F.struct(*COLUMNS)).alias("r"))
    return alone.select(*COLUMNS).unionByName(one.select("r.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents and cut benchmark passages out of the others."""
    docs = _keyed(docs.select(*COLUMNS), "text")
    found = positional_index.decontaminate(docs.select("text", *KEYS), _table(spark, sf_dir, "benchmark"), KEYS)
    hit = stage(found.where("n_hit > 0").select(*KEYS, "contaminated", "hits").dropDuplicates(KEYS), "hit")
    clear, doubt = apart(docs, KEYS[0], hit.select(KEYS[0]))
    met = doubt.join(hit, KEYS, "left").where("contaminated IS NULL OR NOT contaminated")
    return clear.select(*COLUMNS).unionByName(positional_index.without_hits(met.select(*COLUMNS, "hits")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequence and place."""
    found = packing.pack_texts(docs, ["doc_id"])
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: Learned models can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each staged in the shared folder."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, f in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
