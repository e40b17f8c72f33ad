"""Content-addressed archive and partitioned Parquet exports with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def archive_key(digest: Column) -> Column:
    return F.concat_ws("/", F.lit("sha256"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def archive(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """New contents by digest, each once: digest, key, length and content of files whose digest isn't known."""
    rows = files.select(F.sha2("content", 256).alias("digest"), F.octet_length("content").alias("length"), "content").dropDuplicates(["digest"])
    rows = rows if known is None else rows.join(known.select("digest"), "digest", "left_anti")
    return rows.select("digest", archive_key(F.col("digest")).alias("key"), "length", "content")


def export(rows: DataFrame, entity: str, path: str, retailer: str = "retailer_id", at: str = "at", most_partitions: int = 1000) -> DataFrame:
    """Write rows under path/entity=/retailer_id=/date= and return the manifest: each partition's rows and bytes, and its files' digests in order."""
    spark = rows.sparkSession
    dated = rows.withColumn("entity", F.lit(entity)).withColumn("retailer_id", F.col(retailer)).withColumn("date", F.date_format(at, "yyyy-MM-dd"))
    plan = dated.groupBy("retailer_id", "date").agg(F.count(F.lit(1)).alias("n_rows"))
    found = plan.limit(most_partitions + 1).count()
    if found > most_partitions:
        raise ValueError(f"more than {most_partitions} partitions")
    dated.repartition("retailer_id", "date").write.mode("errorifexists").partitionBy("entity", "retailer_id", "date").parquet(path)
    return manifest(spark, path).join(plan, ["retailer_id", "date"])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    part = lambda name: F.url_decode(F.regexp_extract("path", f"/{name}=([^/]*)/", 1))
    parts = files.select(part("retailer_id").alias("retailer_id"), part("date").alias("date"), "length", F.sha2("content", 256).alias("sha256"))
    return parts.groupBy("retailer_id", "date").agg(F.sum("length").alias("bytes"), F.sort_array(F.collect_list("sha256")).alias("digests"))
