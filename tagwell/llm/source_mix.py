"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Sources share the total by weight, none above `cap` times its
size. Each source takes all its documents as often as its target holds them whole. For what is left of the budget,
documents are counted by exact size: each size gives its share, rounded down, of all but a reserve, then bounded-knapsack dynamic
programming fills the reserve from the documents not yet taken. Which documents of a size are
taken follows a seeded hash of doc_id: a size's documents are dealt into buckets by hash, whole buckets are taken in
order, and only the last one is sorted, so no task holds all copies of a size.

Defined results: null and empty texts have size 0 and are never taken; texts of any length count whole; the null source comes last; rows with one doc_id
and source compete like different documents, and rows without doc_id by their place in the table; equal hashes go to the smaller doc_id; an empty table gives no row; columns besides doc_id, text and
source are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwell.llm.common import cut, table

WEIGHTS, CAP, SEED, BUCKET_ROWS = (5, 2, 1), 3, 2, 8192
STEPS = 1 << 22
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size and target, from rows of source and size: one row for each source, shared out by windows over these few rows.

    In order of size to weight, sources stop at their cap as long as it is below their part of what the ones before leave; the others share the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, here_on, up_to = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, 0)
    wide = lambda c: c.cast("decimal(38,0)")
    rows = (
        totals.withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap)
        .withColumn("rest", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(here_on))
        .withColumn("capped", F.min((wide(F.col("limit")) * wide(F.col("rest_weight")) <= wide(F.col("rest")) * wide(F.col("weight"))).cast("int")).over(up_to) == 1)
    )
    first = F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("weight")).alias("at"), -F.col("rest_weight"), "rest", "rest_weight"))).over(Window.partitionBy())
    return rows.withColumn("first", first).select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(F.col("first.rest") * F.col("weight") / F.col("first.rest_weight")).cast("double").alias("target"),
    )


def nearest_sum(weights: np.ndarray, counts: np.ndarray, target: int, most: int) -> np.ndarray:
    """How many of each weight to take for the sum nearest to target (the lower of two) and at most `most`, by dynamic programming over sums."""
    taken = np.zeros(len(weights), np.int64)
    usable = [i for i in np.argsort(-weights, kind="stable") if 0 < weights[i] <= most and counts[i]]  # the longest first, so that short ones are left for what remains
    reach = np.zeros(most + 1, bool)
    reach[0] = True
    by = np.full(most + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in usable:
        left, n = min(int(counts[i]), most // int(weights[i])), 1
        while left and not reach[target]:
            n = min(n, left)
            weight = n * int(weights[i])
            fresh = np.flatnonzero(reach[: most + 1 - weight] & ~reach[weight:]) + weight
            reach[fresh] = True
            by[fresh] = len(items)
            items.append((i, n))
            left, n = left - n, 2 * n
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - target))])
    while at:
        i, n = items[by[at]]
        taken[i] += n
        at -= n * int(weights[i])
    return taken


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, steps: int = STEPS) -> np.ndarray:
    """How many of each length to take for the sum nearest to budget (the lower of two), by dynamic programming over sums.

    No sum is nearer than none at all if it is above twice the budget. If there are more than `steps` of these, lengths count in steps of several words, rounded up, so the
    budget isn't passed; what that leaves is filled in finer steps from the lengths that are left, down to single words.
    """
    taken = np.zeros(len(lengths), np.int64)
    while (step := -(-2 * budget // steps)) > 1:
        some = nearest_sum(-(-lengths // step), counts - taken, budget // step, budget // step)
        gained = sum(int(a) * int(b) for a, b in zip(lengths, some, strict=True))
        if not gained:  # all that is left is longer, or as good as
            left = np.flatnonzero((counts > taken) & (lengths > 0))
            if len(left) and abs(int(lengths[i := left[np.argmin(np.abs(lengths[left] - budget))]]) - budget) < budget:
                taken[i] += 1
            return taken
        taken += some
        budget -= gained
    return taken + nearest_sum(lengths, counts - taken, budget, 2 * budget)


def fit_budget(lengths: np.ndarray, counts: np.ndarray, target: float, cap: int = CAP) -> tuple[int, np.ndarray]:
    """How often all documents are taken, and how many of each length once more.

    Each length gives its share of the budget above a reserve of twice the longest; what rounding leaves goes to the longest first, and the reserve to the knapsack.
    """
    total = sum(int(a) * int(b) for a, b in zip(lengths, counts, strict=True))
    extra = np.zeros(len(lengths), np.int64)
    if total == 0:
        return 0, extra
    budget = round(target)
    whole = min(cap, budget // total)
    rest = budget - whole * total if whole < cap else 0
    reserve = 2 * int(lengths.max())
    for i, (a, b) in enumerate(zip(lengths, counts, strict=True)):
        extra[i] = int(b) * max(0, rest - reserve) // total if a else 0
    rest -= sum(int(a) * int(b) for a, b in zip(lengths, extra, strict=True))
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] and (n := min(int(counts[i] - extra[i]), max(0, rest - reserve) // int(lengths[i]))):
            extra[i] += n
            rest -= n * int(lengths[i])
    return whole, extra + knapsack(lengths, counts - extra, rest)


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: the words that the mix takes of each document, repeats counted."""
    sizes = cut(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), F.regexp_count(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.monotonically_increasing_id().alias("place")))
    targets = source_targets(sizes, weights, cap)
    counts = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False, ignore_index=True)
        whole, extra = fit_budget(rows["size"].to_numpy(), rows["n"].to_numpy(), float(rows["target"].iloc[0]), cap)
        return rows.assign(whole=whole, extra=extra)

    plans = cut(known.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, whole long, extra long"))
    share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("place"))), 11) / F.lit(float(1 << 53))
    rows = (
        sizes.join(plans.withColumnsRenamed({"source": "of", "size": "of_size"}), F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size"))).drop("of", "of_size")
        .withColumn("share", share).withColumn("bucket", F.floor(F.col("share") * F.ceil(F.col("n") / BUCKET_ROWS)))
    )
    partly = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    in_order = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        rows.where(partly).groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("held"), F.first("extra").alias("extra"))
        .withColumn("before", F.coalesce(F.sum("held").over(in_order), F.lit(0)))
        .select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("bucket").alias("of_bucket"), (F.col("extra") - F.col("before")).alias("room"), "held")
    )
    placed = rows.where(partly).join(buckets, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")) & (F.col("bucket") == F.col("of_bucket")))
    clear = placed.where("room <= 0 OR room >= held").withColumn("more", (F.col("room") > 0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("share", "doc_id", "place"))
    split = placed.where("room > 0 AND room < held").withColumn("more", (rank <= F.col("room")).cast("long"))
    sure = rows.where(~partly).withColumn("more", (F.col("extra") > 0).cast("long"))
    columns = ("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more"))).alias("taken"))
    return sure.select(*columns).unionByName(clear.select(*columns)).unionByName(split.select(*columns))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
