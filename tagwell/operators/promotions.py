"""Promotions: versions told apart by fingerprint, absence, and where they apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwell.operators.history import Applied
from tagwell.operators.relational import contains, latest_of

KEY = ["subchain", "scope_store", "promotion"]


def apply_promotions(open_rows: DataFrame, incoming: DataFrame, applied_at: Column, full: bool) -> Applied:
    """Versions (KEY, fingerprint, items, stores, valid_from, valid_to) after a file (KEY, fingerprint, items, stores).

    A changed fingerprint closes the open version and opens another; an equal one stays; a full file closes what it lacks in the scopes that it covers.
    """
    new = latest_of(incoming, KEY, ["fingerprint"]).withColumn("_in", F.lit(1)).alias("i")
    now = open_rows.where("valid_to IS NULL").withColumn("_was", F.lit(1)).alias("o")
    both = new.join(now, [F.col(f"i.{k}").eqNullSafe(F.col(f"o.{k}")) for k in KEY], "full_outer")
    scopes = incoming.select(F.col("subchain").alias("s_subchain"), F.col("scope_store").alias("s_store"), F.lit(True).alias("in_scope")).distinct()
    both = both.join(scopes, F.col("o.subchain").eqNullSafe(F.col("s_subchain")) & F.col("o.scope_store").eqNullSafe(F.col("s_store")), "left")
    there, known = F.col("i._in").isNotNull(), F.col("o._was").isNotNull()
    gone = F.lit(full) & F.coalesce("in_scope", F.lit(False))
    outcome = F.when(~known, "inserted").when(there & (F.col("i.fingerprint") != F.col("o.fingerprint")), "updated").when(there, "unchanged").when(gone, "unavailable").otherwise("untouched")
    marked = both.withColumn("outcome", outcome)
    end = F.when(F.col("outcome").isin("updated", "unavailable"), applied_at)
    kept = marked.where(known).select(*[end.alias("valid_to") if c == "valid_to" else F.col(f"o.{c}").alias(c) for c in open_rows.columns])
    fresh = marked.where("outcome IN ('inserted', 'updated')").select(*[applied_at.alias(c) if c == "valid_from" else F.lit(None).cast("timestamp").alias(c) if c == "valid_to" else F.col(f"i.{c}").alias(c) for c in open_rows.columns])
    closed = open_rows.where("valid_to IS NOT NULL")
    after = closed.unionByName(kept).unionByName(fresh)
    return Applied(after.where("valid_to IS NULL"), after, marked.where("outcome <> 'untouched'").groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))


def applies_in(promotions: DataFrame, store: str) -> DataFrame:
    """Promotions of a store: those that name it and those that name none."""
    return promotions.where((F.size(F.coalesce("stores", F.array().cast("array<string>"))) == 0) | F.array_contains("stores", store))


def active(promotions: DataFrame, at: Column) -> DataFrame:
    """Promotions whose version is valid and whose period holds the instant, unless they are marked inactive."""
    return promotions.where(contains(F.col("valid_from"), F.col("valid_to"), at) & contains(F.col("starts_at"), F.col("ends_at"), at, end_inclusive=True) & F.coalesce("is_active", F.lit(True)))


def of_product(promotions: DataFrame, matches: DataFrame, product: str) -> DataFrame:
    """Promotions of a product through the items that are confirmed to be it, each once."""
    items = matches.where(F.col("product") == product).select("item").distinct()
    hit = promotions.select(*KEY, "valid_from", F.explode("items").alias("item")).join(items, "item").select(*KEY, "valid_from").distinct()
    return promotions.join(hit, [*KEY, "valid_from"], "left_semi")
