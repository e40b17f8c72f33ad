"""Applying whole files: stores, prices with availability and absence behind their guards, and what promotions need."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwell.operators import history
from tagwell.operators.relational import differs, latest_of, tidy

PRICE_KEY, PRICE_CHANGE, AVAILABILITY_CHANGE = ["store", "item"], ["price", "unit_price", "allow_discount"], ["is_available", "item_status"]


class Refused(ValueError):
    """A file that a guard keeps from being applied."""


@dataclass
class Prices:
    """Current prices and availability, and the history of both; after a file, also the keys that have both, side by side."""

    prices: DataFrame
    price_history: DataFrame
    availability: DataFrame
    availability_history: DataFrame
    both: DataFrame | None = None


def apply_stores(current: DataFrame, incoming: DataFrame, key: list[str], seen_at: Column) -> history.Applied:
    """A roster of stores, which is always full: all attributes are overwritten and rows are active; stores that it lacks become inactive and keep when they were last seen.

    current: key, attributes, is_active, last_seen; incoming: key and attributes. `history` holds the names that changed (key, alias).
    """
    attributes = [c for c in incoming.columns if c not in key]
    new = latest_of(incoming, key, attributes).withColumn("_in", F.lit(1)).alias("i")
    both = new.join(current.withColumn("_was", F.lit(1)).alias("c"), [F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key], "full_outer")
    there, known, active = F.col("i._in").isNotNull(), F.col("c._was").isNotNull(), F.col("c.is_active")
    moved = differs([F.col(f"i.{a}") for a in attributes], [F.col(f"c.{a}") for a in attributes]) | ~active
    outcome = F.when(~known, "inserted").when(there & moved, "updated").when(there, "unchanged").when(active, "unavailable").otherwise("untouched")
    marked = both.withColumn("outcome", outcome)
    pick = lambda c: F.when(there, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c)
    now = marked.select(*map(pick, (*key, *attributes)), there.alias("is_active"), F.when(there, seen_at).otherwise(F.col("c.last_seen")).alias("last_seen"))
    aliases = marked.where(known & there & (F.col("i.name") != F.col("c.name"))).select(*[F.col(f"i.{k}").alias(k) for k in key], F.col("c.name").alias("alias")).distinct()
    return history.Applied(now, aliases, marked.where("outcome <> 'untouched'").groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))


def with_placeholders(known: DataFrame, codes: DataFrame, key: str, name: Column) -> DataFrame:
    """known with a row for each code that it lacks, named until a better name comes; known names stay."""
    fresh = codes.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")
    return known.unionByName(fresh.withColumn("name", name).select(*[c if c in (key, "name") else F.lit(None).cast(t).alias(c) for c, t in known.dtypes]))


def attach(relations: DataFrame, incoming: DataFrame, open_rows: DataFrame, key: list[str], child: str) -> DataFrame:
    """relations (version, child) with those that a file's rows (key, child) bring to the open versions (key, version), each once."""
    fresh = incoming.join(open_rows.select(*key, "version"), key).select("version", child).distinct()
    return relations.unionByName(fresh.join(relations, ["version", child], "left_anti"))


def guarded(prior: DataFrame, incoming: DataFrame, scope: list[str], most: float, least: int, total: int = 0) -> DataFrame:
    """history.drops, with the file as a whole refused if it has fewer than `total` rows."""
    few = incoming.limit(total).count() < total if total else False
    return history.drops(prior, incoming, scope, most, least).withColumn("refused", F.col("refused") | F.lit(few))


def met(state: Prices, incoming: DataFrame) -> DataFrame:
    """A row for each key of the state or a file, with p, a and i: its price, its availability and its last row in the file, each null where there is none. One shuffle brings all three together; null keys are equal."""
    parts = {"p": state.prices, "a": state.availability, "i": incoming}
    kinds = {name: f"struct<{','.join(f'{c}:{t}' for c, t in df.dtypes if c not in PRICE_KEY)}>" for name, df in parts.items()}
    held = lambda of, name: F.struct(*[c for c in parts[of].columns if c not in PRICE_KEY]) if of == name else F.lit(None).cast(kinds[name])
    p, a, i = (df.select(*PRICE_KEY, *[held(of, name).alias(name) for name in parts]) for of, df in parts.items())
    return p.unionByName(a).unionByName(i).groupBy(*PRICE_KEY).agg(*[F.max(name).alias(name) for name in parts])


def apply_prices(state: Prices, incoming: DataFrame, applied_at: Column, full: bool, most: float = history.MOST_DROPPED, least: int = history.LEAST_RECORDS, scopes: DataFrame | None = None) -> tuple[Prices, DataFrame]:
    """The state after a file (store, item, price, unit_price, allow_discount, item_status), and a row of counts: inserted, updated, unchanged, unavailable and history_events.

    A full file is held against the available rows of its stores first, and makes unavailable what it lacks there; its prices stay. A missing status means available. `scopes` are stores that it covers without
    a row, such as the header's. All that comes out is of the rows that `met` gives.
    """
    new = latest_of(incoming, PRICE_KEY, [c for c in incoming.columns if c not in PRICE_KEY])
    own = incoming.select("store").distinct()
    covered = own if scopes is None else own.unionByName(scopes.select("store")).distinct()
    if full and (most < 1 or new.limit(least).count() < least):  # no store can lack more than all of its rows
        prior = state.availability.where("is_available").join(covered, "store", "left_semi")
        bad = guarded(prior, new, ["store"], most, 0, least).where("refused").limit(1).collect()
        if bad:
            raise Refused(f"store {bad[0].store}: {bad[0].incoming} rows after {bad[0].prior}")
    tidy(incoming.sparkSession)
    rows = met(state, incoming)
    if full:
        rows = rows.join(covered.select(F.col("store").alias("_store"), F.lit(True).alias("_covered")), F.col("store") == F.col("_store"), "left")
    there, known, seen = F.col("i").isNotNull(), F.col("p").isNotNull(), F.col("a").isNotNull()
    gone = ~there & F.col("a.is_available") & F.col("_covered").isNotNull() if full else F.lit(False)
    was = F.struct(*[F.col(f"a.{c}").alias(c) for c in AVAILABILITY_CHANGE])
    now = F.when(there, F.struct(F.coalesce(F.col("i.item_status") != 0, F.lit(True)).alias("is_available"), F.col("i.item_status").alias("item_status"))).when(gone, F.struct(F.lit(False).alias("is_available"), F.lit(None).cast(incoming.schema["item_status"].dataType).alias("item_status")))
    moved = differs([F.col(f"i.{c}") for c in PRICE_CHANGE], [F.col(f"p.{c}") for c in PRICE_CHANGE])
    rows = rows.withColumn("now", now).withColumn("priced", F.when(there & ~known, "inserted").when(there & moved, "updated").when(there, "unchanged"))
    rows = rows.withColumn("switched", F.when(F.col("now").isNull(), False).otherwise(~seen | ~F.col("now").eqNullSafe(was)))

    def columns(current: DataFrame, new: str, old: str) -> list[Column]:
        return [F.col(c) if c in PRICE_KEY else F.when(F.col(new).isNotNull(), F.col(f"{new}.{c}")).otherwise(F.col(f"{old}.{c}")).alias(c) for c in current.columns]

    def opened(before: DataFrame, changed: Column, closed: Column, new: str, change: list[str]) -> DataFrame:
        fresh = rows.where(changed).select(*PRICE_KEY, applied_at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), *[F.col(f"{new}.{c}").alias(c) for c in change])
        return history.close(before, rows.where(changed & closed).select(*PRICE_KEY), PRICE_KEY, applied_at).unionByName(fresh)

    after = Prices(
        rows.where(known | there).select(*columns(state.prices, "i", "p")), opened(state.price_history, F.col("priced").isin("inserted", "updated"), known, "i", PRICE_CHANGE),
        rows.where(seen | F.col("now").isNotNull()).select(*columns(state.availability, "now", "a")), opened(state.availability_history, F.col("switched"), seen, "now", AVAILABILITY_CHANGE),
        rows.where((known | there) & (seen | F.col("now").isNotNull())).select(*columns(state.prices, "i", "p"), *columns(state.availability.drop(*PRICE_KEY), "now", "a")),
    )
    off = F.col("switched") & ~F.col("now.is_available") & (~seen | F.col("a.is_available"))
    counts = rows.agg(*[F.count_if(F.coalesce(F.col("priced") == c, F.lit(False))).alias(c) for c in ("inserted", "updated", "unchanged")], F.count_if(off).alias("unavailable"), F.count_if(F.col("switched")).alias("moved"))
    return after, counts.select("inserted", "updated", "unchanged", "unavailable", (F.col("inserted") + F.col("updated") + F.col("moved")).alias("history_events"))
