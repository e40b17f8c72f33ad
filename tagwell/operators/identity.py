"""Product identity: validated barcodes, conflicts, scored candidates for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwell.functions import text
from tagwell.operators.relational import ranked

#: Weights of the structured score, in hundredths, and the least score of a proposal.
NAME, BRAND, MANUFACTURER, QUANTITY, PACKAGING, CONFLICT, LEAST, MOST = 40, 20, 15, 20, 5, 25, 65, 99
#: Parts that the index of a common trigram is dealt into.
SALTS = 16


def validated(evidence: DataFrame) -> DataFrame:
    """gtin, its retailers and whether two independent ones report it, from live (gtin, retailer, portal); portals of one retailer count once."""
    return evidence.select("gtin", "retailer").distinct().groupBy("gtin").agg(F.count(F.lit(1)).alias("retailers")).withColumn("validated", F.col("retailers") >= 2)


def conflicts(matches: DataFrame) -> DataFrame:
    """Items that carry several barcodes, and barcodes that point to several products, from (item, gtin, product)."""
    several = lambda key, of, reason: matches.groupBy(key).agg(F.min(of).alias("a"), F.max(of).alias("b")).where("a <> b").select(F.lit(reason).alias("reason"), F.col(key).cast("string").alias("subject"))
    return several("item", "gtin", "item_has_several_gtins").unionByName(several("gtin", "product", "gtin_has_several_products")).unionByName(several("item", "product", "item_has_several_products"))


def structured_score(a: str, b: str) -> Column:
    """Score of two products (aliases a and b) with name, brand, manufacturer, quantity (struct) and packaging, to three places; a different quantity counts against it."""
    c = lambda x: (F.col(f"{a}.{x}"), F.col(f"{b}.{x}"))
    same = lambda x: F.coalesce(text.ascii_search_text(c(x)[0]) == text.ascii_search_text(c(x)[1]), F.lit(False)).cast("int")
    q, r = c("quantity")
    points = text.token_jaccard(*c("name")) * NAME + same("brand") * BRAND + same("manufacturer") * MANUFACTURER + F.coalesce(q == r, F.lit(False)).cast("int") * QUANTITY + same("packaging") * PACKAGING - F.coalesce(q != r, F.lit(False)).cast("int") * CONFLICT
    return F.bround(F.greatest(F.lit(0), F.least(F.lit(MOST), points)).cast("decimal(20,10)") / 100, 3).cast("decimal(5,3)")


def name_sets(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The distinct trigram sets of the names (set, named by its smallest id; grams and n), and each id (as key) with its set; names without words have none."""
    named = rows.select(F.col("id").alias(key), F.sort_array(text.trigrams(F.col("name"))).alias("grams")).where(F.size("grams") > 0)
    sets = named.groupBy("grams").agg(F.min(key).alias("set")).withColumn("n", F.size("grams"))
    return sets, named.join(sets.select("grams", "set"), "grams").select(key, "set")


def nearest_sets(own: DataFrame, others: DataFrame, k: int, least_common: int) -> DataFrame:
    """For each set of own the k sets of others (of, by trigram similarity, then by id) that share least_common trigrams at least; exact.

    A set's trigrams are ordered from rare to common. The rare ones, and the rarest in any case, find the first candidates. If the kth of them has
    similarity t, a set as near shares t * n of the n trigrams at least, so one of the first n - t * n + 1: these find all that can matter,
    however common they are. The places of a common trigram in the index are salted.
    """
    index = others.select(F.col("set").alias("of"), F.explode("grams").alias("gram"))
    total = others.agg(F.count(F.lit(1)).alias("total"))
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("held")).crossJoin(total).withColumn("rare", F.col("held") <= F.greatest(F.lit(k), F.col("total") / 100)).drop("total")
    index = index.withColumn("salt", F.pmod(F.xxhash64("of"), F.lit(SALTS)).cast("int"))
    probes = ranked(own.select("set", "n", F.explode("grams").alias("gram")).join(held, "gram", "left").withColumn("held", F.coalesce("held", F.lit(0))), ["set"], [F.col("held"), F.col("gram")], "at").where("held > 0")
    first = F.col("rare") | (F.col("at") == F.col("first_at"))
    probes = probes.join(probes.groupBy("set").agg(F.min("at").alias("first_at")), "set")

    def scored(probing: DataFrame) -> DataFrame:
        salted = probing.select("set", "gram", F.explode(F.when(F.col("rare"), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("salt"))
        kept = index.join(held.select("gram", "rare"), "gram").select("of", "gram", F.when(F.col("rare"), F.lit(-1)).otherwise(F.col("salt")).alias("salt"))
        pairs = salted.join(kept, ["gram", "salt"]).select("set", "of").distinct()
        full = pairs.join(own.select("set", "grams"), "set").join(others.select(F.col("set").alias("of"), F.col("grams").alias("of_grams")), "of")
        common = full.withColumn("common", F.size(F.array_intersect("grams", "of_grams")).cast("long")).where(F.col("common") >= least_common)
        near = common.select("set", "of", "common", (F.col("common") / (F.size("grams") + F.size("of_grams") - F.col("common"))).alias("similarity"))
        return ranked(near, ["set"], [F.col("similarity").desc(), F.col("of")], "place").where(F.col("place") <= k)

    reached = scored(probes.where(first)).where(F.col("place") == k).select("set", F.col("similarity").alias("reached"))
    bounded = probes.join(reached, "set", "left").where(F.col("at") <= F.col("n") - F.greatest(F.lit(1), F.ceil(F.coalesce("reached", F.lit(0.0)) * F.col("n") - 1e-9)) + 1)
    return scored(bounded).drop("place")


def candidates(items: DataFrame, products: DataFrame, k: int = 20, least_common: int = 1) -> DataFrame:
    """For each item its k candidate products: those of equal barcode first, then by trigram similarity of the names, at most k; products that share no trigram are none."""
    own, item_set = name_sets(items, "item")
    others, product_set = name_sets(products, "product")
    sets = nearest_sets(own, others, k, least_common)
    few = ranked(product_set, ["set"], [F.col("product")], "copy").where(F.col("copy") <= k).select(F.col("set").alias("of"), "product")
    near_set = ranked(sets.join(few, "of"), ["set"], [F.col("similarity").desc(), F.col("product")], "place").where(F.col("place") <= k).drop("place", "of")
    near = item_set.join(near_set, "set").select("item", "product", F.lit(1).alias("priority"), "common", "similarity")
    exact = items.where("gtin IS NOT NULL").select(F.col("id").alias("item"), "gtin").join(products.select(F.col("id").alias("product"), "gtin"), "gtin").select("item", "product", F.lit(0).alias("priority"), F.lit(0).cast("long").alias("common"), F.lit(0.0).alias("similarity"))
    best = exact.unionByName(near).groupBy("item", "product").agg(F.min("priority").alias("priority"), F.max("common").alias("common"), F.max("similarity").alias("similarity"))
    return ranked(best, ["item"], [F.col("priority"), F.col("similarity").desc(), F.col("product")], "place").where(F.col("place") <= k)


def proposals(items: DataFrame, products: DataFrame, k: int = 20) -> DataFrame:
    """item, product, score and reason of the candidates that reach the least score."""
    pairs = candidates(items, products, k)
    rows = pairs.join(items.alias("a"), F.col("a.id") == F.col("item")).join(products.alias("b"), F.col("b.id") == F.col("product"))
    same = F.coalesce(F.col("a.gtin") == F.col("b.gtin"), F.lit(False))
    score = F.when(same, F.lit("1.000").cast("decimal(5,3)")).otherwise(structured_score("a", "b"))
    return rows.select("item", "product", score.alias("score"), F.when(same, "gtin").otherwise("structured").alias("reason")).where(F.col("score") >= F.lit(LEAST / 100).cast("decimal(5,3)"))


def reviewed(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Candidates after another run: reviewed ones stay, pending ones are replaced."""
    kept = existing.where("status <> 'pending'")
    fresh = proposed.join(kept.select("item", "product"), ["item", "product"], "left_anti").withColumn("status", F.lit("pending"))
    return kept.select("item", "product", "score", "reason", "status").unionByName(fresh.select("item", "product", "score", "reason", "status"))


def accept(candidates_: DataFrame, item: int, product: int) -> DataFrame:
    """The item's candidate is accepted, its other pending ones are superseded."""
    mine = (F.col("item") == item) & (F.col("status") == "pending")
    return candidates_.withColumn("status", F.when(mine & (F.col("product") == product), "accepted").when(mine, "superseded").otherwise(F.col("status")))
