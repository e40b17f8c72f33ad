"""Listings of publishers' portals: JSON catalogues, HTML pages and dated indexes as one table of files on offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwell.functions import text
from tagwell.sources import html_links

LISTING = ("portal", "name", "url", "document_type", "compression", "published", "size", "remote_id", "position")
NAMES, SIZES, DATES, URLS = ("FileNm", "fileName", "name"), ("FileSize", "fileSize", "size"), ("fileDate", "lastModified", "date"), ("SPath", "url", "href")


def described(files: DataFrame, portal: Column) -> DataFrame:
    """portal, name, url and position of files, and what their names tell."""
    return files.select(
        portal.alias("portal"), "name", "url", text.document_type(F.col("name")).alias("document_type"), text.compression(F.col("name")).alias("compression"),
        F.coalesce("published", text.file_timestamp(F.col("name"))).alias("published"), "size", F.when(F.col("url").contains("://"), text.remote_id(F.col("url"))).otherwise(F.col("name")).alias("remote_id"), "position",
    )


def byte_size(c: Column) -> Column:
    """A plain number of bytes; a size with a unit is rounded by the portal and counts as unknown."""
    return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("long"))


def json_catalogue(spark: SparkSession, path: str, portal: str, array: str) -> DataFrame:
    """A JSON document whose field `array` lists files under any of the known names."""
    lines = spark.read.text(path, wholetext=True).select(F.from_json("value", f"{array} array<map<string,string>>")[array].alias("files"))
    rows = lines.select(F.posexplode("files").alias("position", "f"))
    any_of = lambda names: F.coalesce(*[F.nullif(F.trim(F.col("f")[n]), F.lit("")) for n in names])
    files = rows.select(any_of(NAMES).alias("name"), any_of(URLS).alias("url"), any_of(DATES).alias("published"), byte_size(any_of(SIZES)).alias("size"), "position").where("name IS NOT NULL")
    return described(files.withColumn("url", F.coalesce("url", "name")), F.lit(portal))


def html_listing(pages: DataFrame, portal: str) -> DataFrame:
    """Links of pages (page_id, html) whose file name is of a known document type."""
    rows = html_links.extract(pages)
    name = F.regexp_extract(F.regexp_replace(F.col("href"), "[?#].*$", ""), r"([^/]*)$", 1)
    files = rows.select(name.alias("name"), F.col("href").alias("url"), F.lit(None).cast("string").alias("published"), F.lit(None).cast("long").alias("size"), (F.col("page_id") * 100_000 + F.col("position")).alias("position"))
    return described(files, F.lit(portal)).where("document_type IS NOT NULL")


def latest_day(listing: DataFrame) -> DataFrame:
    """Of a dated index the files of its last day."""
    day = F.substring(F.regexp_replace("published", "[^0-9]", ""), 1, 8)
    last = listing.groupBy("portal").agg(F.max(day).alias("last"))
    return listing.join(last, "portal").where(day == F.col("last")).drop("last")


def distinct_files(listing: DataFrame) -> DataFrame:
    """The first entry of each remote id, ordered by it."""
    first = F.row_number().over(Window.partitionBy("portal", "remote_id").orderBy("position"))
    return listing.withColumn("_n", first).where("_n = 1").drop("_n").orderBy("portal", "remote_id")


def page(listing: DataFrame, after: str | None, size: int) -> DataFrame:
    """The next files behind a cursor (the last remote id), and one more."""
    rows = listing if after is None else listing.where(F.col("remote_id") > after)
    return rows.orderBy("remote_id").limit(size + 1)
