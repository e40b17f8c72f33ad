"""Rebuilding derived tables: what a rebuild changed, which ids it keeps, and how its rows relate to those before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwell.functions.text import fingerprint
from tagwell.operators.history import same_rows
from tagwell.operators.relational import first_of


def payload(rows: DataFrame, ignored: list[str]) -> DataFrame:
    """rows with a digest of all columns but the ignored ones."""
    return rows.withColumn("payload", fingerprint(*[F.col(c) for c in sorted(rows.columns) if c not in ignored]))


def kept_ids(before: DataFrame, after: DataFrame, id_: str, ignored: list[str]) -> DataFrame:
    """after, where rows that were there before but for the ignored columns keep the smallest id that they had; an id is given once."""
    old = payload(before, [id_, *ignored]).groupBy("payload").agg(F.min(id_).alias("old_id"))
    new = first_of(payload(after, [id_, *ignored]), ["payload"], [F.col(id_)]).select("payload", F.col(id_).alias("first_id"))
    rows = payload(after, [id_, *ignored]).join(old, "payload", "left").join(new, "payload")
    own = F.when(F.col(id_) == F.col("first_id"), F.coalesce("old_id", id_)).otherwise(F.col(id_))
    return rows.withColumn(id_, own).select(after.columns)


def equivalent(before: DataFrame, after: DataFrame, ignored: list[str]) -> DataFrame:
    """Rows that one side holds more often than the other, but for the ignored columns; none if a rebuild changed nothing."""
    kept = [c for c in before.columns if c not in ignored]
    return same_rows(before.select(kept), after.select(kept))


def outcomes(before: DataFrame, after: DataFrame, ignored: list[str]) -> DataFrame:
    """Rows from before: preserved if they are there again, superseded otherwise."""
    there = payload(after, ignored).select("payload").distinct().withColumn("_there", F.lit(True))
    marked = payload(before, ignored).join(there, "payload", "left")
    return marked.withColumn("outcome", F.when(F.col("_there"), "preserved").otherwise("superseded")).select(*before.columns, "outcome")


def material(files: DataFrame) -> DataFrame:
    """Whether a rebuild's files hold a correction by the parser, and whether all that is new is archived only."""
    return files.agg(F.coalesce(F.bool_or("parser_corrected"), F.lit(False)).alias("parser_correction"), F.coalesce(F.bool_or("archive_only"), F.lit(False)).alias("archive_only"))


def first_originals(before: DataFrame, after: DataFrame, key: list[str], order: str) -> DataFrame:
    """after with the id of the first row from before of the same key, if there is one."""
    first = first_of(before, key, [F.col(order), F.col("id")]).select(*key, F.col("id").alias("original"))
    return after.join(first, key, "left")
