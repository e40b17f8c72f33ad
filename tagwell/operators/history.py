"""Current state and validity history: slowly changing intervals, full snapshots and deltas, absence, guards, source order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwell.operators.relational import differs, latest_of

#: Least number of records in a full price file, and the largest accepted part that may be missing or rejected.
LEAST_RECORDS, MOST_DROPPED, MOST_REJECTED = 100, 0.5, 0.1


def intervals(observations: DataFrame, key: list[str], at: str, change: list[str]) -> DataFrame:
    """Half-open intervals [valid_from, valid_to) in which the change columns of a key stay the same; the last one is open.

    All history at once: one shuffle by key gives the last observation of each instant, the changes, and their ends.
    """
    last = latest_of(observations.select(*key, at, *change), [*key, at], change)
    by_time = Window.partitionBy(*key).orderBy(at)
    before = [F.lag(c).over(by_time) for c in change]
    changed = F.lag(F.lit(True)).over(by_time).isNull() | differs([F.col(c) for c in change], before)
    kept = last.withColumn("_changed", changed).where("_changed")
    return kept.select(*key, F.col(at).alias("valid_from"), F.lead(at).over(by_time).alias("valid_to"), *change)


@dataclass
class Applied:
    """What applying a file gives: the new current state, the history with intervals closed and opened, and a row of counts."""

    current: DataFrame
    history: DataFrame
    counts: DataFrame


def apply_file(current: DataFrame, history: DataFrame, incoming: DataFrame, key: list[str], change: list[str], applied_at: Column) -> Applied:
    """Incoming rows (key, change columns, others) onto the current state: unchanged keys keep their interval, changed ones close it and open another, new ones open one.

    One full outer join finds all outcomes; keys that the file lacks stay as they are. Other columns are overwritten without history.
    """
    new = latest_of(incoming, key, [c for c in incoming.columns if c not in key])
    there, known = F.col("i._in").isNotNull(), F.col("c._was").isNotNull()
    both = new.withColumn("_in", F.lit(1)).alias("i").join(current.withColumn("_was", F.lit(1)).alias("c"), [F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key], "full_outer")
    moved = differs([F.col(f"i.{x}") for x in change], [F.col(f"c.{x}") for x in change])
    outcome = F.when(~there, "absent").when(~known, "inserted").when(moved, "updated").otherwise("unchanged")
    marked = both.withColumn("outcome", outcome)
    now = marked.select(*[F.when(there, F.col(f"i.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in current.columns])
    fresh = marked.where("outcome IN ('inserted', 'updated')").select(*[F.col(f"i.{k}").alias(k) for k in key], applied_at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), *[F.col(f"i.{x}").alias(x) for x in change])
    gone = marked.where("outcome = 'updated'").select(*[F.col(f"i.{k}").alias(k) for k in key])
    return Applied(now, close(history, gone, key, applied_at).unionByName(fresh), marked.where("outcome <> 'absent'").groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))


def close(history: DataFrame, keys: DataFrame, key: list[str], applied_at: Column) -> DataFrame:
    """End the open intervals of these keys."""
    marked = history.alias("h").join(keys.dropDuplicates(key).withColumn("_close", F.lit(1)).alias("k"), [F.col(f"h.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key], "left")
    end = F.when(F.col("k._close").isNotNull() & F.col("h.valid_to").isNull(), applied_at).otherwise(F.col("h.valid_to"))
    return marked.select(*[end.alias("valid_to") if c == "valid_to" else F.col(f"h.{c}").alias(c) for c in history.columns])


def absent(current: DataFrame, incoming: DataFrame, key: list[str], scope: list[str], available: Column) -> DataFrame:
    """Available keys in the scopes of a full file that the file lacks."""
    scopes = incoming.select(*scope).distinct()
    return current.where(available).join(scopes, scope, "left_semi").join(incoming.select(*key).distinct(), key, "left_anti")


def drops(prior: DataFrame, incoming: DataFrame, scope: list[str], most: float = MOST_DROPPED, least: int = 0) -> DataFrame:
    """For each scope the rows before and now, what part is missing in millionths, and whether a full file must not be applied."""
    before = prior.groupBy(*scope).agg(F.count(F.lit(1)).alias("prior"))
    now = incoming.groupBy(*scope).agg(F.count(F.lit(1)).alias("incoming"))
    both = before.join(now, scope, "full_outer").fillna(0, ["prior", "incoming"])
    part = F.when(F.col("prior") > 0, F.expr("greatest(prior - incoming, 0) * 1000000 div prior")).otherwise(F.lit(0))
    return both.withColumn("dropped_ppm", part.cast("long")).withColumn("refused", (F.col("dropped_ppm") > int(most * 1_000_000)) | ((F.col("prior") == 0) & (F.col("incoming") < least)))


def regressions(files: DataFrame, scope: list[str], arrival: list[str], source_time: str, digest: str | None = None) -> DataFrame:
    """Files in order of arrival with the scope's watermark before each, and a verdict: accepted, regression (older), or conflict (the watermark's time, another digest)."""
    window = Window.partitionBy(*scope).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.max(source_time).over(window)
    out = files.withColumn("watermark", mark)
    verdict = F.when(F.col(source_time) < F.col("watermark"), "source_timestamp_regression")
    if digest:
        last = F.max(F.struct(F.col(source_time), F.col(digest))).over(window)
        verdict = verdict.when((F.col(source_time) == F.col("watermark")) & (F.col(digest) != last[digest]), "source_timestamp_conflict")
    return out.withColumn("verdict", verdict.otherwise("accepted"))


def accepted_file(accepted: int, rejected: int, quarantined: bool = False, most: float = MOST_REJECTED) -> bool:
    """Whether a parsed file may be applied."""
    return not quarantined and (rejected == 0 or accepted > 0 and rejected <= most * (accepted + rejected))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables holds more often than the other: none if they are the same multiset."""
    columns = a.columns
    counted = a.withColumn("_n", F.lit(1)).unionByName(b.select(columns).withColumn("_n", F.lit(-1)))
    return counted.groupBy(*columns).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")
