"""The test tables as the state that the read queries work on, and the same as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwell.functions import text
from tagwell.operators import history, relational
from tagwell.plans.tables import LATEST, OBSERVATIONS, SPANS, observations, read

LAST = ["observed_on", "order_no", "line_no", "price", "on_sale", "available"]
STATUS = {"purchase": "completed", "error": "failed_retryable", "signup": "quarantined", "click": "parsing"}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A nation is a retailer and its portal, a supplier a store, a part a product that two retailers sell as an item each; an event is a file."""
    nation, supplier, part, events = (read(spark, sf_dir, t) for t in ("nation", "supplier", "part", "events"))
    id_ = F.col("p_partkey")
    barcode = F.lpad((id_ % 700).cast("string"), 8, "0")
    of_retailer = F.explode(F.array(F.lit(0), F.lit(1)))
    items = part.select(id_, "p_name", of_retailer.alias("k")).select((id_ * 2 + F.col("k")).alias("id"), ((id_ + 7 * F.col("k")) % 25).alias("retailer"), F.concat(F.lit("I"), (id_ % 900).cast("string")).alias("code"), barcode.alias("gtin"), text.ascii_search_text(F.col("p_name")).alias("search_name"))
    now = relational.latest_of(observations(spark, sf_dir), ["product", "store"], LAST).withColumn("id", F.col("product") * 100_000 + F.col("store")).withColumnRenamed("observed_on", "observed_at")
    past = history.intervals(observations(spark, sf_dir), ["product", "store"], "observed_on", ["price"]).withColumn("id", F.col("product") * 100_000 + F.col("store"))
    status = F.coalesce(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col("event_type")], F.lit("downloaded"))
    seen = F.col("ts").cast("timestamp")
    return {
        "retailers": nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "portals": nation.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("retailer")),
        "stores": supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("retailer"), F.col("s_nationkey").alias("portal"), F.col("s_name").alias("name"), F.col("n_name").alias("city"), text.ascii_search_text(F.col("s_name")).alias("search_name")),
        "products": part.select(id_.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), text.ascii_search_text(F.col("p_name")).alias("search_name"), F.when(F.col("p_size") % 10 == 0, "retired").otherwise("active").alias("status")),
        "identifiers": part.select(id_.alias("product"), F.lit("gtin").alias("kind"), barcode.alias("value"), (F.col("p_size") % 2 == 0).alias("validated")),
        "items": items, "matches": items.where("id % 5 <> 0").select(F.col("id").alias("item"), F.expr("id div 2").alias("product")),
        "prices": now.select("id", "product", "store", "price", "observed_at"),
        "availability": now.select("id", "product", "store", F.col("available").alias("is_available"), "observed_at"),
        "history": past.select("id", "product", "store", "price", "valid_from", "valid_to"),
        "files": events.select(F.col("event_id").alias("id"), (F.col("user_id") % 25).alias("portal"), status.alias("status"), seen.alias("downloaded_at"), F.when(F.col("event_type") == "purchase", seen).alias("finished_at")),
        "issues": events.where("value < 3").select(F.col("event_id").alias("id"), (F.col("event_id") - F.col("event_id") % 10).alias("file"), (F.col("event_id") % 10).alias("record_index"), F.col("event_type").alias("code")),
    }


NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
BARCODE = "lpad(CAST(p_partkey % 700 AS VARCHAR), 8, '0')"
ITEMS = f"items AS (SELECT p_partkey * 2 + k AS id, (p_partkey + 7 * k) % 25 AS retailer, 'I' || CAST(p_partkey % 900 AS VARCHAR) AS code, {BARCODE} AS gtin, {NORM.format('p_name')} AS search_name FROM part, (SELECT unnest([0, 1]) AS k))"
FILES = f"files AS (SELECT event_id AS id, user_id % 25 AS portal, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in STATUS.items())} ELSE 'downloaded' END AS status, ts AS downloaded_at, CASE WHEN event_type = 'purchase' THEN ts END AS finished_at FROM events)"
DIMENSIONS = f"""retailers AS (SELECT n_nationkey AS id, n_name AS name FROM nation),
stores AS (SELECT s_suppkey AS id, s_nationkey AS retailer, s_name AS name, n_name AS city, {NORM.format('s_name')} AS search_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
products AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, {NORM.format('p_name')} AS search_name, CASE WHEN p_size % 10 = 0 THEN 'retired' ELSE 'active' END AS status FROM part),
identifiers AS (SELECT p_partkey AS product, 'gtin' AS kind, {BARCODE} AS value, p_size % 2 = 0 AS validated FROM part), {ITEMS},
matches AS (SELECT id AS item, id // 2 AS product FROM items WHERE id % 5 <> 0), {FILES},
issues AS (SELECT event_id AS id, event_id - event_id % 10 AS file, event_id % 10 AS record_index, event_type AS code FROM events WHERE value < 3)"""
PRICES = f"""{LATEST}, prices AS (SELECT product * 100000 + store AS id, product, store, price, available AS is_available, observed_on AS observed_at FROM latest)"""
HISTORY = SPANS[len(OBSERVATIONS) :] + ", history AS (SELECT product * 100000 + store AS id, * FROM spans)"
