"""Barcodes of items as evidence: assertions of files, groups and identifiers that follow from them, matches, and products of items that nothing matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwell.operators.identity import structured_score
from tagwell.operators.relational import bounded_children, first_of

AUTOMATIC = ("exact_provisional_gtin", "exact_validated_gtin")


def assert_items(assertions: DataFrame, items: DataFrame, file: Column, applied_at: Column) -> DataFrame:
    """assertions (item, kind, value, file, superseded_at) after a file's items (item, kind, value): those of other files are superseded, even by an equal value; the file's own stand once."""
    touched = items.select("item").distinct().withColumn("_touched", F.lit(True))
    end = F.when(F.col("_touched") & F.col("superseded_at").isNull() & (F.col("file") != file), applied_at).otherwise(F.col("superseded_at"))
    old = assertions.join(touched, "item", "left").withColumn("superseded_at", end).drop("_touched")
    fresh = items.where("value IS NOT NULL").dropDuplicates(["item", "kind"]).withColumn("file", file)
    fresh = fresh.join(assertions.select("item", "kind", "file"), ["item", "kind", "file"], "left_anti").withColumn("superseded_at", F.lit(None).cast("timestamp"))
    return old.unionByName(fresh.select(old.columns))


def live(assertions: DataFrame, items: DataFrame) -> DataFrame:
    """gtin, retailer and portal of the assertions that stand."""
    rows = assertions.where("superseded_at IS NULL AND kind = 'gtin'").select("item", F.col("value").alias("gtin"))
    return rows.join(items.select(F.col("id").alias("item"), "retailer", "portal"), "item").select("gtin", "retailer", "portal").distinct()


def affected(before: DataFrame, after: DataFrame) -> DataFrame:
    """Barcodes that items carried before a file or carry after it."""
    return before.select("gtin").union(after.select("gtin")).where("gtin IS NOT NULL").distinct()


def without_automatic(matches: DataFrame, items: DataFrame) -> DataFrame:
    """Matches but the automatic ones of these items."""
    mine = items.select("item").distinct().withColumn("_mine", F.lit(True))
    return matches.join(mine, "item", "left").where(~(F.coalesce("_mine", F.lit(False)) & F.col("method").isin(*AUTOMATIC) & F.col("confirmed_by").startswith("system"))).drop("_mine")


def groups(items: DataFrame, known: DataFrame, validated: DataFrame) -> DataFrame:
    """gtin, its representative item (the smallest code) and product: the validated one, the known group's, or a new one named by the barcode."""
    first = first_of(items.where("gtin IS NOT NULL").select("gtin", "code", "id"), ["gtin"], [F.col("code"), F.col("id")]).select("gtin", F.col("id").alias("representative"))
    rows = first.join(validated.select("gtin", F.col("product").alias("sure")), "gtin", "left").join(known.select("gtin", F.col("product").alias("grouped")), "gtin", "left")
    return rows.select("gtin", "representative", F.coalesce("sure", "grouped", F.sha2(F.col("gtin"), 256)).alias("product"))


def scoped(known: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provisional identifiers of (gtin, retailer, portal), those that live evidence holds, and the stale ones that go."""
    key = ["gtin", "retailer", "portal"]
    return evidence.select(*key).distinct(), known.select(*key).join(evidence, key, "left_anti").distinct()


def confirmed(matches: DataFrame, items: DataFrame, grouped: DataFrame, validated: DataFrame) -> DataFrame:
    """matches with one for each item whose barcode has a group, unless the item has one or another product holds the barcode globally."""
    rows = items.where("gtin IS NOT NULL").select(F.col("id").alias("item"), "gtin").join(grouped.select("gtin", "product"), "gtin")
    rows = rows.join(validated.select("gtin", F.col("product").alias("sure")), "gtin", "left").where(F.col("sure").isNull() | (F.col("sure") == F.col("product")))
    fresh = rows.join(matches.select("item"), "item", "left_anti")
    method = F.when(F.col("sure").isNull(), AUTOMATIC[0]).otherwise(AUTOMATIC[1])
    return matches.unionByName(fresh.select("item", "product", method.alias("method"), F.lit("system:gtin").alias("confirmed_by")).select(matches.columns))


def evidence_counts(evidence: DataFrame, gtins: DataFrame) -> DataFrame:
    """How many retailers and portals report the affected barcodes now."""
    return gtins.join(evidence, "gtin", "left").groupBy("gtin").agg(F.countDistinct("retailer").alias("retailers"), F.countDistinct("retailer", "portal").alias("portals"))


def isolated(items: DataFrame, matches: DataFrame) -> DataFrame:
    """A product of its own for each item without a match."""
    return items.join(matches.select(F.col("item").alias("id")), "id", "left_anti").select(F.col("id").alias("item"), F.sha2(F.concat(F.lit("item:"), F.col("id").cast("string")), 256).alias("product"), F.lit("isolated").alias("method"), F.lit("system:bootstrap").alias("confirmed_by"))


def projected(facts: DataFrame, matches: DataFrame, items: DataFrame) -> DataFrame:
    """Facts of items with the product that each is matched to, if any, and its retailer."""
    return facts.join(items.select(F.col("id").alias("item"), "retailer"), "item").join(matches.select("item", "product"), "item", "left")


def score_pairs(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Given pairs of items (item, other) with their score; equal barcodes make 1, and are confirmed by themselves if the retailers differ."""
    met = pairs.join(items.alias("a"), F.col("item") == F.col("a.id")).join(items.alias("b"), F.col("other") == F.col("b.id"))
    same = F.coalesce(F.col("a.gtin") == F.col("b.gtin"), F.lit(False))
    score = F.when(same, F.lit(1).cast("decimal(5,3)")).otherwise(structured_score("a", "b"))
    return met.select("item", "other", score.alias("score"), (same & (F.col("a.retailer") != F.col("b.retailer"))).alias("auto_confirm"))


def decorated(products: DataFrame, items: DataFrame, matches: DataFrame, identifiers: DataFrame, most: int = 32) -> DataFrame:
    """Products with their representative, the first item by id, and up to `most` identifiers in order."""
    first = matches.join(items.select(F.col("id").alias("item"), "code"), "item").groupBy("product").agg(F.min(F.struct("item", "code")).alias("one"))
    listed = bounded_children(identifiers, ["product"], [F.col("kind"), F.col("value")], F.concat_ws(":", "kind", "value"), most, "listed").drop("truncated")
    rows = products.join(first, F.col("id") == F.col("product"), "left").drop("product").join(listed, F.col("id") == F.col("product"), "left")
    return rows.select(*[F.col(c) for c in products.columns], F.col("one.item").alias("representative"), F.col("one.code").alias("code"), F.coalesce("listed", F.array().cast("array<string>")).alias("identifiers"))
