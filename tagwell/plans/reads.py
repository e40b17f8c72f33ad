"""The read queries, over the whole test tables: pages, searches, details, history, status, and what operators of the service ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwell.operators import relational
from tagwell.plans import api
from tagwell.plans.catalog import GRAMS
from tagwell.plans.prices import INSTANT, SINCE, UNTIL, query
from tagwell.plans.state import DIMENSIONS, FILES, HISTORY, PRICES, tables
from tagwell.plans.tables import OBSERVATIONS, day, read

PRODUCT, BARCODE, SOUGHT, STORE = 12, "00000012", "red bolt", "supplier 12"
AT = "TIMESTAMP '2024-01-01 06:00:00'"
SIM = "length(list_intersect(g, q)) / length(list_distinct(list_concat(g, q)))"


def _grams(name: str, table: str) -> str:
    return f"q AS (SELECT {GRAMS} AS q FROM (SELECT '{name}' AS norm)), {table}_g AS (SELECT x.*, {SIM} AS sim FROM (SELECT *, {GRAMS} AS g FROM (SELECT *, search_name AS norm FROM {table})) x, q)"


@query(f"WITH {DIMENSIONS} SELECT id, name FROM retailers WHERE id > 5 ORDER BY id LIMIT 11")
def retailers_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.retailers(tables(spark, sf_dir), [5], 10)


@query(f"WITH {DIMENSIONS}, {_grams(STORE, 'stores')} SELECT id, name, city FROM stores_g WHERE id > 10 AND (contains(search_name, '{STORE}') OR sim >= 0.2) ORDER BY id LIMIT 6")
def stores_by_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.stores(tables(spark, sf_dir), name=STORE, cursor=[10], size=5).select("id", "name", "city")


@query(f"WITH {DIMENSIONS} SELECT id, name, city FROM stores WHERE lower(city) = 'nation_3' AND retailer = 3 ORDER BY id LIMIT 6")
def stores_of_a_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.stores(tables(spark, sf_dir), city="Nation 3", retailer=3, size=5).select("id", "name", "city")


@query(f"WITH {DIMENSIONS}, {_grams(STORE, 'stores')}, w AS (SELECT * FROM stores_g WHERE id > 2 ORDER BY id LIMIT 5) SELECT id, name FROM w WHERE contains(search_name, '{STORE}') OR sim >= 0.2 ORDER BY id LIMIT 6")
def store_scan_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores with a like name among the next five by id."""
    return api.store_window(tables(spark, sf_dir), STORE, [2], 5)[0].select("id", "name")


def _search(name: str) -> str:
    return f"""WITH {DIMENSIONS}, {_grams(name, 'products')}, i_g AS (SELECT x.*, {SIM} AS sim FROM (SELECT *, {GRAMS} AS g FROM (SELECT *, search_name AS norm FROM items)) x, q),
ident AS (SELECT product AS id, bool_or(validated) AS validated FROM identifiers WHERE value = '{name}' GROUP BY 1),
alias AS (SELECT product AS id, max(sim) AS alias FROM i_g JOIN matches ON i_g.id = item WHERE sim >= 0.3 GROUP BY 1),
found AS (SELECT id FROM products_g WHERE status = 'active' AND (starts_with(search_name, '{name}') OR sim >= 0.3) UNION SELECT id FROM ident UNION SELECT id FROM alias),
r AS (SELECT id, name, brand, round(CASE WHEN validated THEN 100 WHEN validated IS NOT NULL THEN 90 WHEN search_name = '{name}' THEN 50 WHEN starts_with(search_name, '{name}') THEN 20 + sim ELSE greatest(sim, 10 + coalesce(alias, 0)) END, 6) AS rank
  FROM products_g JOIN found USING (id) LEFT JOIN ident USING (id) LEFT JOIN alias USING (id))
SELECT id, name, brand, rank FROM r"""


@query(f"{_search(SOUGHT)} ORDER BY rank DESC, id LIMIT 21")
def product_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.search_products(tables(spark, sf_dir), SOUGHT, most=None).select("id", "name", "brand", "rank")


@query(f"{_search(SOUGHT)} WHERE rank < 10.5 OR (rank = 10.5 AND id > 40) ORDER BY rank DESC, id LIMIT 21")
def product_search_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.search_products(tables(spark, sf_dir), SOUGHT, [10.5, 40], most=None).select("id", "name", "brand", "rank")


@query(f"{_search(BARCODE)} ORDER BY rank DESC, id LIMIT 21")
def product_search_by_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.search_products(tables(spark, sf_dir), BARCODE, most=None).select("id", "name", "brand", "rank")


@query(f"WITH {DIMENSIONS} SELECT id, name, validated FROM products JOIN (SELECT product, bool_or(validated) AS validated FROM identifiers WHERE value = '{BARCODE}' GROUP BY 1) ON id = product ORDER BY validated DESC, id LIMIT 2")
def product_by_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.by_barcode(tables(spark, sf_dir), BARCODE).select("id", "name", "validated")


@query(f"WITH {DIMENSIONS} SELECT id, name FROM products WHERE id IN (SELECT product FROM matches JOIN items ON item = items.id WHERE retailer = 12 AND code = 'I12') ORDER BY id LIMIT 2")
def product_by_item_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.by_item_code(tables(spark, sf_dir), 12, " I1 2").select("id", "name")


@query(f"WITH {DIMENSIONS} SELECT id, name, brand, status, string_agg(kind || ':' || value || ':' || validated, ',' ORDER BY kind, value) AS identifiers FROM products JOIN identifiers ON id = product WHERE id = {PRODUCT} GROUP BY ALL")
def product_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_join(F.transform("identifiers", lambda x: F.concat_ws(":", x["kind"], x["value"], x["validated"].cast("string"))), ",")
    return api.product(tables(spark, sf_dir), PRODUCT).select("id", "name", "brand", "status", listed.alias("identifiers"))


NAMED = f"{DIMENSIONS}, {PRICES}, named AS (SELECT p.*, s.name AS store_name, s.retailer, r.name AS retailer_name FROM prices p JOIN stores s ON store = s.id JOIN retailers r ON s.retailer = r.id)"


@query(f"WITH {NAMED} SELECT id, store, price, store_name, retailer_name, observed_at FROM named WHERE product = {PRODUCT} ORDER BY price, id LIMIT 29")
def current_prices_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.prices(tables(spark, sf_dir), PRODUCT).select("id", "store", "price", "store_name", "retailer_name", "observed_at")


@query(f"WITH {NAMED} SELECT id, store, price, store_name, retailer_name FROM named WHERE product = {PRODUCT} AND retailer = 3 ORDER BY price, id LIMIT 29")
def current_prices_of_a_retailer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.prices(tables(spark, sf_dir), PRODUCT, retailer=3).select("id", "store", "price", "store_name", "retailer_name")


@query(f"WITH {DIMENSIONS}, {OBSERVATIONS}{HISTORY} SELECT h.id, h.store, h.price, valid_from, valid_to, s.name AS store_name FROM history h JOIN stores s ON h.store = s.id WHERE product = {PRODUCT} AND valid_from < '{UNTIL}' AND (valid_to IS NULL OR valid_to > '{SINCE}') ORDER BY valid_from DESC, h.id DESC LIMIT 29")
def price_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.price_history(tables(spark, sf_dir), PRODUCT, F.lit(SINCE), F.lit(UNTIL)).select("id", "store", "price", "valid_from", "valid_to", "store_name")


@query(f"WITH {NAMED} SELECT id, store, is_available, observed_at, store_name FROM named WHERE product = {PRODUCT} AND id > {PRODUCT * 100_000 + 20} ORDER BY id LIMIT 29")
def availability_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.availability(tables(spark, sf_dir), PRODUCT, cursor=[PRODUCT * 100_000 + 20]).select("id", "store", "is_available", "observed_at", "store_name")


@query(f"""WITH {DIMENSIONS}, {PRICES}, a AS (SELECT store, count(*) FILTER (is_available) AS n, max(observed_at) AS last_observed FROM prices GROUP BY 1)
SELECT id, least(coalesce(n, 0), 300) AS available, coalesce(n > 300, false) AS truncated, last_observed FROM stores LEFT JOIN a ON id = store""")
def store_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.freshness(tables(spark, sf_dir), 300)


STATUS_SQL = f"""WITH {FILES}, a AS (SELECT portal, arg_max(id, (downloaded_at, id)) AS latest_file, arg_max(status, (downloaded_at, id)) AS latest_status, arg_max(id, (downloaded_at, id)) FILTER (status = 'completed') AS good_file FROM files GROUP BY 1)
SELECT n_nationkey AS id, latest_file, latest_status, good_file, coalesce(latest_file = good_file, false) AS healthy FROM nation LEFT JOIN a ON n_nationkey = portal"""


@query(STATUS_SQL)
def portal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.source_status(tables(spark, sf_dir)).drop("retailer")


@query(f"SELECT *, 'rebuilding' AS maintenance_state, 7 AS maintenance_version FROM ({STATUS_SQL})")
def platform_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.platform_status(tables(spark, sf_dir), spark.createDataFrame([("rebuilding", 7)], "state string, version int")).drop("retailer")


@query(f"WITH {FILES} SELECT id, portal, status FROM files WHERE status IN ('failed_retryable', 'failed_permanent') AND id > 50 ORDER BY id LIMIT 201")
def failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.failures(tables(spark, sf_dir), cursor=[50]).select("id", "portal", "status")


@query(f"WITH {DIMENSIONS}, p AS (SELECT * FROM files WHERE status = 'quarantined' ORDER BY id LIMIT 201) SELECT p.id, p.portal, count(i.id) AS issues FROM p LEFT JOIN issues i ON i.file = p.id GROUP BY ALL")
def quarantined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.quarantine(tables(spark, sf_dir)).select("id", "portal", "issues")


@query(f"WITH {DIMENSIONS} SELECT id, record_index, code FROM issues WHERE file = 30 ORDER BY record_index, id LIMIT 1001")
def issues_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.issues(tables(spark, sf_dir), 30).select("id", "record_index", "code")


@query(f"WITH {FILES} SELECT id, portal, status FROM files WHERE downloaded_at >= {AT} AND downloaded_at < {AT} + INTERVAL 2 DAY AND (downloaded_at, id) > ((SELECT downloaded_at FROM files WHERE id = 120), 120) ORDER BY downloaded_at, id LIMIT 201")
def replay_range_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, at = tables(spark, sf_dir), F.expr(AT)
    cursor = files["files"].where("id = 120").select("downloaded_at").first()
    return api.replay_range(files, at, at + F.expr("INTERVAL 2 DAYS"), [cursor.downloaded_at, 120]).select("id", "portal", "status")


@query(f"WITH {FILES} SELECT id, portal, 'failed_retryable' AS status FROM files WHERE status IN ('parsing', 'downloaded') AND downloaded_at < {AT} + INTERVAL 1 DAY - INTERVAL 6 HOUR ORDER BY downloaded_at, id LIMIT 1000")
def stale_job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.stale_jobs(tables(spark, sf_dir), F.expr(AT) + F.expr("INTERVAL 1 DAY"), ("parsing", "downloaded")).select("id", "portal", "status")


PROMOTIONS = "p AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS starts, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS ends, o_orderpriority AS kind FROM orders)"


@query(f"""WITH {PROMOTIONS}, page AS (SELECT * FROM p WHERE starts < '{UNTIL}' AND ends > '{INSTANT}' ORDER BY starts DESC, id LIMIT 10),
c AS (SELECT id, l_partkey, l_suppkey, row_number() OVER (PARTITION BY id ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM page JOIN lineitem ON l_orderkey = id)
SELECT page.id, starts, ends, kind, string_agg(l_partkey || ':' || l_suppkey, ',' ORDER BY rn) FILTER (rn <= greatest(1, 21 // (10 * 3))) AS items, coalesce(max(rn) > greatest(1, 21 // (10 * 3)), false) AS truncated FROM page LEFT JOIN c USING (id) GROUP BY ALL""")
def promotion_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotions (orders of 30 days) that meet a span, the latest first, with as many items each as the page's budget allows; only the page's items are read further."""
    orders, size = read(spark, sf_dir, "orders"), 10
    end = day(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    hit = orders.where(F.col("o_orderdate") < F.lit(UNTIL).cast("timestamp")).select(F.col("o_orderkey").alias("id"), day("o_orderdate").alias("starts"), end.alias("ends"), F.col("o_orderpriority").alias("kind"))
    rows = hit.where(relational.overlaps(F.col("starts"), F.col("ends"), F.lit(INSTANT), F.lit(UNTIL))).orderBy(F.col("starts").desc(), "id").limit(size)
    most = max(1, min(7, 21 // (size * 3)))
    items = read(spark, sf_dir, "lineitem").join(rows.select(F.col("id").alias("l_orderkey")), "l_orderkey")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    children = relational.bounded_children(items, ["l_orderkey"], order, F.concat_ws(":", "l_partkey", "l_suppkey"), most, "items")
    joined = rows.join(children, F.col("id") == F.col("l_orderkey"), "left")
    return joined.select("id", "starts", "ends", "kind", F.array_join("items", ",").alias("items"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


@query("SELECT n_nationkey, least(7, 21 // (greatest(least(n_nationkey, 10), 1) * 3)) AS budget FROM nation")
def page_child_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", relational.child_budget(F.col("n_nationkey"), 10).alias("budget"))


@query(f"""WITH {NAMED} SELECT id, product, store, store_name, retailer, retailer_name, price, is_available, observed_at, substr(observed_at, 1, 7) AS month FROM named WHERE observed_at >= '{SINCE}' AND observed_at <= '{UNTIL}'""")
def export_current_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the entity current_prices: last observed within a span, both ends included."""
    t = tables(spark, sf_dir)
    rows = t["prices"].join(t["availability"].select("id", "is_available"), "id").where((F.col("observed_at") >= SINCE) & (F.col("observed_at") <= UNTIL))
    return api.named(t, rows).select("id", "product", "store", "store_name", "retailer", "retailer_name", "price", "is_available", "observed_at", F.substring("observed_at", 1, 7).alias("month"))


@query(f"""WITH {DIMENSIONS}, {OBSERVATIONS}{HISTORY} SELECT h.id, product, store, s.name AS store_name, s.retailer, h.price, valid_from, valid_to FROM history h JOIN stores s ON store = s.id WHERE valid_from <= '{UNTIL}' AND coalesce(valid_to, '9999') > '{SINCE}'""")
def export_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the entity price_history: intervals that meet a span whose end is included."""
    t = tables(spark, sf_dir)
    rows = t["history"].where(relational.overlaps(F.col("valid_from"), F.col("valid_to"), F.lit(SINCE), F.lit(UNTIL), until_inclusive=True))
    return api.named(t, rows).select("id", "product", "store", "store_name", "retailer", "price", "valid_from", "valid_to")
