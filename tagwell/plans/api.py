"""The read queries over a state of tables, each a page behind a cursor.

`tables` maps names to DataFrames: retailers(id, name), portals(id, retailer), stores(id, retailer, portal, name, city, search_name), products(id, name, brand, search_name, status), identifiers(product, kind, value, validated),
matches(item, product), items(id, retailer, code, gtin), prices(id, product, store, price, observed_at), history(id, product, store, price, valid_from, valid_to), availability(id, product, store, is_available, observed_at),
files(id, portal, status, downloaded_at, finished_at), issues(id, file, record_index, code). Filters that aren't given don't stand in the plan.
"""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwell.functions import text
from tagwell.operators.relational import after, at_most, overlaps, page

#: Least similarity of names in searches, and of store names.
NAME_LIKENESS, STORE_LIKENESS = 0.3, 0.2


def encode_cursor(route: str, filters: dict, last: list) -> str:
    """A cursor bound to its route and filters."""
    body = base64.urlsafe_b64encode(json.dumps([route, filters, last], sort_keys=True, default=str).encode()).decode().rstrip("=")
    return f"{body}.{hashlib.sha256(body.encode()).hexdigest()[:32]}"


def decode_cursor(cursor: str, route: str, filters: dict) -> list:
    body, _, seal = cursor.partition(".")
    if hashlib.sha256(body.encode()).hexdigest()[:32] != seal:
        raise ValueError("damaged cursor")
    found = json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
    if found[:2] != json.loads(json.dumps([route, filters], sort_keys=True, default=str)):
        raise ValueError("the cursor belongs to another query")
    return found[2]


def given(df: DataFrame, **equal) -> DataFrame:
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def behind(df: DataFrame, cursor: list | None, *order: tuple[str, bool]) -> DataFrame:
    return df if cursor is None else df.where(after([(F.col(c), F.lit(v), up) for (c, up), v in zip(order, cursor, strict=True)]))


def retailers(tables: dict, cursor: list | None = None, size: int = 50) -> DataFrame:
    return page(behind(tables["retailers"], cursor, ("id", True)), [F.col("id")], size)


def stores(tables: dict, name: str | None = None, city: str | None = None, retailer: str | None = None, cursor: list | None = None, size: int = 50) -> DataFrame:
    """By part or likeness of the name, city, and retailer."""
    rows = given(tables["stores"], retailer=retailer)
    if city is not None:
        rows = rows.where(text.ascii_search_text(F.col("city")) == text.ascii_search_text(F.lit(city)))
    if name is not None:
        sought = text.ascii_search_text(F.lit(name))
        rows = rows.where(F.col("search_name").contains(sought) | (text.trigram_similarity(F.col("search_name"), sought) >= STORE_LIKENESS))
    return page(behind(rows, cursor, ("id", True)), [F.col("id")], size)


def search_products(tables: dict, name: str, cursor: list | None = None, size: int = 20, most: int | None = 10_000, quantity: tuple | None = None) -> DataFrame:
    """Products by rank, from four streams of candidates: a barcode (100 validated, 90 otherwise), the whole name (50), its beginning (20 and the likeness), a like name, or the like name of a matched item (10 and that likeness).

    Names count for active products only. An item of the sought (value, unit) adds 2. More than `most` candidates of one kind are refused; None takes any number.
    """
    sought = text.ascii_search_text(F.lit(name))
    similarity = lambda: text.trigram_similarity(F.col("search_name"), sought)
    known = tables["identifiers"].where((F.col("kind") == "gtin") & (F.col("value") == name)).groupBy(F.col("product").alias("id")).agg(F.bool_or("validated").alias("validated"))
    like = tables["items"].withColumn("alias", similarity()).where(F.col("alias") >= NAME_LIKENESS) if "search_name" in tables["items"].columns else None
    if like is not None:
        same = F.coalesce((F.col("quantity") == quantity[0]) & (F.col("unit") == quantity[1]), F.lit(False)) if quantity else F.lit(False)
        like = like.join(tables["matches"], F.col("id") == F.col("item")).groupBy(F.col("product").alias("id")).agg(F.max("alias").alias("alias"), F.bool_or(same).alias("same_quantity"))
    else:
        like = known.select("id", F.lit(None).cast("double").alias("alias"), F.lit(False).alias("same_quantity")).where("false")
    named = tables["products"].where("status = 'active'").where(F.col("search_name").startswith(sought) | (similarity() >= NAME_LIKENESS))
    for kind, rows in (("named", named), ("known", known), ("like", like)):
        at_most(rows, most, kind)
    found = named.select("id").union(known.select("id")).union(like.select("id")).distinct()
    rank = F.when(F.col("validated"), 100.0).when(F.col("validated").isNotNull(), 90.0).when(F.col("search_name") == sought, 50.0).when(F.col("search_name").startswith(sought), 20 + similarity())
    rank = rank.otherwise(F.greatest(similarity(), 10 + F.coalesce("alias", F.lit(0.0)))) + F.when(F.col("same_quantity"), 2.0).otherwise(0.0)
    rows = tables["products"].join(found, "id").join(known, "id", "left").join(like, "id", "left").withColumn("rank", F.round(rank, 6)).drop("validated", "alias", "same_quantity")
    return page(behind(rows, cursor, ("rank", False), ("id", True)), [F.col("rank").desc(), F.col("id")], size)


def store_window(tables: dict, name: str, cursor: list | None = None, scanned: int = 10_000, size: int = 5) -> tuple[DataFrame, list | None]:
    """Stores with a like name among the next `scanned` ones by id, and the cursor behind these: a window may hold none and still have a next one."""
    window = page(behind(tables["stores"], cursor, ("id", True)), [F.col("id")], scanned)
    ids = window.select("id").orderBy("id").collect()  # scanned and one more at most
    inside = window.where(F.col("id") <= F.lit(ids[min(len(ids), scanned) - 1].id)) if ids else window
    sought = text.ascii_search_text(F.lit(name))
    rows = inside.where(F.col("search_name").contains(sought) | (text.trigram_similarity(F.col("search_name"), sought) >= STORE_LIKENESS))
    return page(rows, [F.col("id")], size), [ids[scanned - 1].id] if len(ids) > scanned else None


def by_barcode(tables: dict, gtin: str) -> DataFrame:
    """Products of a barcode, validated ones first; more than one without a validated one is for the caller to refuse."""
    hit = tables["identifiers"].where((F.col("kind") == "gtin") & (F.col("value") == gtin)).groupBy("product").agg(F.max("validated").alias("validated"))
    return tables["products"].join(hit, F.col("id") == F.col("product")).drop("product").orderBy(F.col("validated").desc(), "id").limit(2)


def by_item_code(tables: dict, retailer: str, code: str) -> DataFrame:
    items = tables["items"].where((F.col("retailer") == retailer) & (F.col("code") == text.normalized_identifier(F.lit(code)))).select(F.col("id").alias("item"))
    return tables["products"].join(items.join(tables["matches"], "item").select(F.col("product").alias("id")).distinct(), "id", "left_semi").orderBy("id").limit(2)


def product(tables: dict, id_: str) -> DataFrame:
    """A product with its identifiers in order."""
    listed = tables["identifiers"].where(F.col("product") == id_).groupBy("product").agg(F.sort_array(F.collect_list(F.struct("kind", "value", "validated"))).alias("identifiers"))
    return tables["products"].where(F.col("id") == id_).join(listed, F.col("id") == F.col("product"), "left").drop("product")


def named(tables: dict, rows: DataFrame) -> DataFrame:
    """Rows with the store's name and its retailer's."""
    places = tables["stores"].select(F.col("id").alias("store"), F.col("name").alias("store_name"), "retailer")
    who = tables["retailers"].select(F.col("id").alias("retailer"), F.col("name").alias("retailer_name"))
    return rows.join(places, "store").join(who, "retailer")


def prices(tables: dict, product_: str, store: str | None = None, retailer: str | None = None, cursor: list | None = None, size: int = 28) -> DataFrame:
    """Current prices of a product, cheapest first; without a store this is the comparison. Only the page is joined with names, unless the retailer is asked for."""
    rows = given(tables["prices"], product=product_, store=store)
    if retailer is not None:
        rows = rows.join(tables["stores"].where(F.col("retailer") == retailer).select(F.col("id").alias("store")), "store", "left_semi")
    order = [F.col("price"), F.col("id")]
    return named(tables, page(behind(rows, cursor, ("price", True), ("id", True)), order, size)).orderBy(*order)


def price_history(tables: dict, product_: str, since: Column, until: Column, store: str | None = None, cursor: list | None = None, size: int = 28) -> DataFrame:
    """Intervals that meet [since, until), latest first."""
    rows = given(tables["history"], product=product_, store=store).where(overlaps(F.col("valid_from"), F.col("valid_to"), since, until))
    order = [F.col("valid_from").desc(), F.col("id").desc()]
    return named(tables, page(behind(rows, cursor, ("valid_from", False), ("id", False)), order, size)).orderBy(*order)


def availability(tables: dict, product_: str, store: str | None = None, cursor: list | None = None, size: int = 28) -> DataFrame:
    return named(tables, page(behind(given(tables["availability"], product=product_, store=store), cursor, ("id", True)), [F.col("id")], size)).orderBy("id")


def freshness(tables: dict, cap: int = 1000) -> DataFrame:
    """Each store's capped number of available products and its latest observation; stores without any stand with none."""
    seen = tables["availability"].groupBy("store").agg(F.count_if(F.col("is_available")).alias("n"), F.max("observed_at").alias("last_observed"))
    rows = tables["stores"].select("id").join(seen, F.col("id") == F.col("store"), "left")
    return rows.select("id", F.least(F.coalesce("n", F.lit(0)), F.lit(cap)).alias("available"), F.coalesce(F.col("n") > cap, F.lit(False)).alias("truncated"), "last_observed").orderBy("id")


def source_status(tables: dict) -> DataFrame:
    """Each portal's latest file, its latest good one, and whether they are the same."""
    latest = lambda condition: F.max(F.when(condition, F.struct("downloaded_at", "id", "status")))
    seen = tables["files"].groupBy("portal").agg(latest(F.lit(True)).alias("latest"), latest(F.col("status") == "completed").alias("good"))
    rows = tables["portals"].select("id", "retailer").join(seen, F.col("id") == F.col("portal"), "left")
    return rows.select("id", "retailer", F.col("latest.id").alias("latest_file"), F.col("latest.status").alias("latest_status"), F.col("good.id").alias("good_file"), F.coalesce(F.col("latest.id") == F.col("good.id"), F.lit(False)).alias("healthy")).orderBy("id")


def platform_status(tables: dict, maintenance: DataFrame) -> DataFrame:
    """source_status with the state of maintenance, a table of one row or none, in every row."""
    one = maintenance.limit(1).collect()
    return source_status(tables).select("*", *[F.lit(one[0][c] if one else None).alias(f"maintenance_{c}") for c in maintenance.columns])


def candidates_page(candidates: DataFrame, tables: dict, status: str = "pending", cursor: list | None = None, size: int = 50) -> DataFrame:
    """Proposed matches (item, product, score, reason, status), the best first, with the names of both."""
    rows = page(behind(candidates.where(F.col("status") == status), cursor, ("score", False), ("item", True), ("product", True)), [F.col("score").desc(), F.col("item"), F.col("product")], size)
    items = tables["items"].select(F.col("id").alias("item"), F.col("retailer"), F.col("code"))
    products = tables["products"].select(F.col("id").alias("product"), F.col("name").alias("product_name"))
    return rows.join(items, "item").join(products, "product").orderBy(F.col("score").desc(), "item", "product")


def failures(tables: dict, statuses: tuple[str, ...] = ("failed_retryable", "failed_permanent"), cursor: list | None = None, size: int = 200) -> DataFrame:
    return page(behind(tables["files"].where(F.col("status").isin(*statuses)), cursor, ("id", True)), [F.col("id")], size)


def quarantine(tables: dict, cursor: list | None = None, size: int = 200) -> DataFrame:
    """Quarantined files and the number of their issues."""
    rows = page(behind(tables["files"].where("status = 'quarantined'"), cursor, ("id", True)), [F.col("id")], size)
    counted = tables["issues"].groupBy("file").agg(F.count(F.lit(1)).alias("issues"))
    return rows.join(counted, F.col("id") == F.col("file"), "left").drop("file").fillna(0, ["issues"]).orderBy("id")


def issues(tables: dict, file: str, size: int = 1000) -> DataFrame:
    return tables["issues"].where(F.col("file") == file).orderBy("record_index", "id").limit(size + 1)


def replay_range(tables: dict, since: Column, until: Column, cursor: list | None = None, size: int = 200) -> DataFrame:
    """Archived files of a span of download times, in their order."""
    rows = tables["files"].where((F.col("downloaded_at") >= since) & (F.col("downloaded_at") < until))
    return page(behind(rows, cursor, ("downloaded_at", True), ("id", True)), [F.col("downloaded_at"), F.col("id")], size)


def stale_jobs(tables: dict, now: Column, active: tuple[str, ...] = ("downloading", "parsing", "applying"), hours: int = 6, size: int = 1000) -> DataFrame:
    """Jobs that have been active for too long, as failed and retryable, the oldest first."""
    old = tables["files"].where(F.col("status").isin(*active) & (F.col("downloaded_at") < now - F.expr(f"INTERVAL {hours} HOURS")))
    return old.orderBy("downloaded_at", "id").limit(size).withColumn("status", F.lit("failed_retryable"))


def sequence(tables: dict) -> DataFrame:
    """Files in the order in which a rebuild applies them; numbered in one window, for there is a row for each file only."""
    return tables["files"].withColumn("sequence", F.row_number().over(Window.orderBy(F.coalesce("finished_at", "downloaded_at"), "id")))
