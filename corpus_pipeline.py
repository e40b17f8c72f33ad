"""A corpus pipeline over documents; each stage's result is written as Parquet and read again as the next one's documents.

1. language_id: documents whose language can't be told (no text, no letter, or too little likeness to all learned languages) go.
2. ngram_jaccard: of each group of near copies the document of the smallest doc_id stays; documents without words are no copies of each other.
3. secret_scan: secrets in texts are replaced by a mark.
4. source_mix: a document is repeated as often as the mix to target weights takes it, so what it doesn't take goes.
5. byte_bpe: each document's ids, their number and digests.

Defined results: stages 2 and 4 tell rows apart by a digest of the whole row, so a null doc_id, or one with several texts, loses nothing; in stage 2 a null doc_id counts as the largest, and rows without words and doc_id all stay. Other columns than text and n_chars pass unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwell.llm import bpe, language_id, secrets_crf, shingle_join, source_mix
from tagwell.llm.common import remove, shared_dir, small_batches, table

def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    langs, prototypes = language_id.fit(language_id.labelled_part(docs))
    return language_id.with_known_language(docs, langs, prototypes)


def keyed(docs: DataFrame) -> DataFrame:
    """_key, a digest of the whole row, which only equal rows share, the row as a struct, so that no column's name matters, and its text and source."""
    key = F.xxhash64(*(docs[c] for c in docs.columns), *(docs[c].isNull() for c in docs.columns)).alias("_key")
    return docs.select(key, F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"], docs["source"])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = keyed(docs)
    groups = shingle_join.join_documents(rows.select(F.col("_key").alias("doc_id"), "text")).distinct().withColumnRenamed("doc_id", "of")
    placed = rows.select(F.col("_key").alias("key"), F.col("row.doc_id").alias("doc_id")).distinct().join(groups, F.col("key") == F.col("of"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key", "n_shingles")).alias("one")
    kept = placed.groupBy("component_id").agg(first).select(F.col("one.key").alias("of"), (F.col("one.unknown") & (F.col("one.n_shingles") == 0)).alias("apart"))
    found = rows.select("_key", "row").join(kept, F.col("_key") == F.col("of"))
    return found.where("NOT apart").dropDuplicates(["_key"]).select("row.*").unionByName(found.where("apart").select("row.*"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets_crf.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = keyed(docs)
    sizes = rows.select(F.col("_key").alias("doc_id"), "text", "source")
    taken = source_mix.mix(sizes).where("taken > 0").groupBy(F.col("doc_id").alias("of")).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("times"))
    repeated = rows.select("_key", "row").dropDuplicates(["_key"]).join(taken, F.col("_key") == F.col("of"))
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode_documents(docs, digested=True)


STAGES = [("language_id", known_language), ("ngram_jaccard", without_near_copies), ("secret_scan", without_secrets), ("source_mix", mixed), ("byte_bpe", encoded)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
