"""Queries of applying files, of barcodes as evidence, of rebuilds, and of the values that publishers write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwell.functions import json, text, values
from tagwell.operators import apply, assertions, rebuild, relational
from tagwell.plans.prices import INSTANT, NEW, OLD, TWO, query, snapshot
from tagwell.plans.state import DIMENSIONS, NORM, tables
from tagwell.plans.tables import read

def at():
    return F.lit(INSTANT).cast("timestamp")


def applied(spark: SparkSession, sf_dir: str) -> tuple[apply.Prices, DataFrame]:
    """The second half of the observations as a full file onto the state after the first."""
    file = lambda when: snapshot(spark, sf_dir, when).select("store", F.col("product").alias("item"), "price", F.col("price").alias("unit_price"), F.col("on_sale").alias("allow_discount"), F.col("available").cast("int").alias("item_status"))
    old = file(OLD)
    seen = old.select("store", "item", (F.col("item_status") != 0).alias("is_available"), "item_status")
    none = lambda columns: spark.createDataFrame([], f"store long, item long, valid_from timestamp, valid_to timestamp, {columns}").where("false")
    state = apply.Prices(old.drop("item_status"), none("price decimal(14,4), unit_price decimal(14,4), allow_discount boolean"), seen, none("is_available boolean, item_status int"))
    return apply.apply_prices(state, file(NEW), at(), full=True, most=1.0, least=1)


ABSENT = "gone AS (SELECT store, product FROM old WHERE available AND store IN (SELECT store FROM new) AND (store, product) NOT IN (SELECT (store, product) FROM new))"


@query(f"""WITH {TWO}, {ABSENT}, m AS (SELECT new.*, old.product AS known, old.price AS was_price, old.on_sale AS was_on_sale, old.available AS was_available FROM new LEFT JOIN old USING (product, store)),
c AS (SELECT count(*) FILTER (known IS NULL) AS inserted, count(*) FILTER (known IS NOT NULL AND (price, on_sale) IS DISTINCT FROM (was_price, was_on_sale)) AS updated, count(*) FILTER (known IS NOT NULL AND (price, on_sale) IS NOT DISTINCT FROM (was_price, was_on_sale)) AS unchanged,
  count(*) FILTER (NOT available AND (known IS NULL OR was_available)) AS off, count(*) FILTER (known IS NULL OR available <> was_available) AS moved FROM m), g AS (SELECT count(*) AS n FROM gone)
SELECT inserted, updated, unchanged, off + n AS unavailable, inserted + updated + moved + n AS history_events FROM c, g""")
def apply_full_price_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What applying a full file counts."""
    return applied(spark, sf_dir)[1]


@query(f"""WITH {TWO}, {ABSENT} SELECT coalesce(new.store, old.store) AS store, coalesce(new.product, old.product) AS item, coalesce(new.price, old.price) AS price, CASE WHEN new.product IS NOT NULL THEN new.available WHEN (old.store, old.product) IN (SELECT (store, product) FROM gone) THEN false ELSE old.available END AS is_available
FROM new FULL JOIN old ON new.product = old.product AND new.store = old.store""")
def state_after_full_price_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and availability after it: what the file lacks keeps its price and is unavailable."""
    state, _ = applied(spark, sf_dir)
    return state.both.select("store", "item", "price", "is_available")


@query(f"""WITH {TWO}, {ABSENT}, m AS (SELECT new.product, new.store, new.available, old.available AS was FROM new LEFT JOIN old USING (product, store))
SELECT store, product AS item, available AS is_available FROM m WHERE was IS NULL OR available <> was UNION ALL SELECT store, product, false FROM gone""")
def availability_events_of_full_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals of availability that it opens."""
    state, _ = applied(spark, sf_dir)
    return state.availability_history.where("valid_to IS NULL").select("store", "item", "is_available")


def roster(spark: SparkSession, sf_dir: str):
    supplier = read(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    current = supplier.where(key % 5 != 0).select(key.alias("store"), F.when(key % 7 == 0, F.concat(F.lit("Old "), "s_name")).otherwise(F.col("s_name")).alias("name"), F.col("s_nationkey").alias("city"), (key % 3 != 0).alias("is_active"), F.lit("1995-01-01").cast("timestamp").alias("last_seen"))
    return apply.apply_stores(current, supplier.where(key % 4 != 1).select(key.alias("store"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("city")), ["store"], at())


ROSTER = "r AS (SELECT s_suppkey AS k, s_suppkey % 5 <> 0 AS known, s_suppkey % 4 <> 1 AS here, s_suppkey % 3 <> 0 AS active, s_suppkey % 7 = 0 AS renamed, s_name FROM supplier)"


@query(f"""WITH {ROSTER} SELECT CASE WHEN here AND NOT known THEN 'inserted' WHEN here AND (renamed OR NOT active) THEN 'updated' WHEN here THEN 'unchanged' ELSE 'unavailable' END AS outcome, count(*) AS n FROM r WHERE here OR (known AND active) GROUP BY 1""")
def apply_store_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What applying a roster of stores counts."""
    return roster(spark, sf_dir).counts


@query(f"""WITH {ROSTER} SELECT k AS store, CASE WHEN NOT here AND renamed THEN 'Old ' || s_name ELSE s_name END AS name, here AS is_active, CASE WHEN here THEN '{INSTANT}' ELSE '1995-01-01' END AS last_seen FROM r WHERE here OR known""")
def stores_after_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster(spark, sf_dir).current.select("store", "name", "is_active", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


@query("SELECT s_suppkey AS store, s_name AS name FROM supplier UNION ALL SELECT DISTINCT o_custkey, 'Store ' || o_custkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def placeholder_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known stores, and a placeholder for each code that only promotions name."""
    known = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("store"), F.col("s_name").alias("name"))
    codes = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("store"))
    return apply.with_placeholders(known, codes, "store", F.concat(F.lit("Store "), F.col("store").cast("string")))


@query("SELECT DISTINCT l_orderkey * 10 AS version, l_partkey AS item FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 OR o_orderstatus = 'O'")
def attach_promotion_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of promotions, with those that a file brings to open versions."""
    lines = read(spark, sf_dir, "lineitem")
    known = lines.where("l_linenumber = 1").select((F.col("l_orderkey") * 10).alias("version"), F.col("l_partkey").alias("item")).distinct()
    versions = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("promotion"), (F.col("o_orderkey") * 10).alias("version"))
    return apply.attach(known, lines.select(F.col("l_orderkey").alias("promotion"), F.col("l_partkey").alias("item")), versions, ["promotion"], "item")


@query("""WITH a AS (SELECT o_orderstatus AS scope, count(*) AS prior FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01' GROUP BY 1), b AS (SELECT o_orderstatus AS scope, count(*) AS incoming FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' GROUP BY 1)
SELECT scope, coalesce(prior, 0) AS prior, coalesce(incoming, 0) AS incoming, CASE WHEN prior > 0 THEN greatest(prior - coalesce(incoming, 0), 0) * 1000000 // prior ELSE 0 END AS dropped_ppm, CASE WHEN prior > 0 THEN greatest(prior - coalesce(incoming, 0), 0) * 1000000 // prior > 400000 ELSE false END AS refused FROM a FULL JOIN b USING (scope)""")
def promotion_drop_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each scope how many open promotions a full file lacks; scopes without any before have no least number."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("scope"), "o_orderdate")
    return apply.guarded(orders.where(F.col("o_orderdate") < at()), orders.where(F.col("o_orderdate") >= at()), ["scope"], 0.4, 0, total=10)


def evidence(spark: SparkSession, sf_dir: str) -> tuple[dict, DataFrame]:
    t = tables(spark, sf_dir)
    return t, t["items"].select(F.col("id").alias("item"), F.lit("gtin").alias("kind"), F.col("gtin").alias("value"))


@query(f"WITH {DIMENSIONS} SELECT id AS item, 'file ' || id % 3 AS file, id % 2 = 0 AND id % 3 <> 1 AS superseded FROM items UNION ALL SELECT id, 'file 1', false FROM items WHERE id % 2 = 0 AND id % 3 <> 1")
def superseded_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions of barcodes after a file that holds every other item."""
    _, rows = evidence(spark, sf_dir)
    old = rows.withColumn("file", F.concat(F.lit("file "), (F.col("item") % 3).cast("string"))).withColumn("superseded_at", F.lit(None).cast("timestamp"))
    out = assertions.assert_items(old, rows.where("item % 2 = 0"), F.lit("file 1"), at())
    return out.select("item", "file", F.col("superseded_at").isNotNull().alias("superseded"))


SCOPED = f"{DIMENSIONS}, live AS (SELECT DISTINCT gtin, retailer FROM items WHERE id % 4 <> 0), known AS (SELECT DISTINCT gtin, retailer FROM items WHERE id % 3 = 0)"


@query(f"WITH {SCOPED} SELECT gtin, retailer, 'live' AS state FROM live UNION ALL SELECT gtin, retailer, 'stale' FROM known WHERE (gtin, retailer) NOT IN (SELECT (gtin, retailer) FROM live)")
def scoped_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional identifiers of barcodes at a retailer: those that live assertions hold, and the stale ones."""
    t, rows = evidence(spark, sf_dir)
    items = t["items"].withColumn("portal", F.col("retailer"))
    standing = rows.withColumn("superseded_at", F.when(F.col("item") % 4 == 0, at()))
    known = items.where("id % 3 = 0").select("gtin", "retailer", "portal").distinct()
    live, stale = assertions.scoped(known, assertions.live(standing, items))
    return live.withColumn("state", F.lit("live")).unionByName(stale.withColumn("state", F.lit("stale"))).drop("portal")


@query(f"WITH {SCOPED}, x AS (SELECT gtin FROM known UNION SELECT gtin FROM items WHERE id % 5 = 1) SELECT x.gtin, count(DISTINCT retailer) AS retailers, count(DISTINCT retailer) AS portals FROM x LEFT JOIN live USING (gtin) GROUP BY 1")
def affected_barcode_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many retailers still report the barcodes that items carried before a file or after it."""
    items = tables(spark, sf_dir)["items"].withColumn("portal", F.col("retailer"))
    gtins = assertions.affected(items.where("id % 3 = 0"), items.where("id % 5 = 1"))
    return assertions.evidence_counts(items.where("id % 4 <> 0").select("gtin", "retailer", "portal").distinct(), gtins)


METHOD = "CASE item % 3 WHEN 0 THEN 'exact_provisional_gtin' WHEN 1 THEN 'exact_validated_gtin' ELSE 'manual' END"


@query(f"WITH {DIMENSIONS} SELECT item, product, {METHOD} AS method FROM matches WHERE NOT (item % 2 = 0 AND item % 3 <> 2 AND item % 7 <> 0)")
def matches_without_automatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches but those that the system made for the items of a file."""
    found = tables(spark, sf_dir)["matches"].withColumn("method", F.expr(METHOD)).withColumn("confirmed_by", F.when(F.col("item") % 7 == 0, "someone").otherwise("system:gtin"))
    return assertions.without_automatic(found, found.where("item % 2 = 0").select("item")).drop("confirmed_by")


GROUPS = f"""{DIMENSIONS}, sure AS (SELECT gtin, CAST(min(id) AS VARCHAR) AS product FROM items WHERE gtin < '00000100' GROUP BY 1), grouped AS (SELECT gtin, CAST(max(id) AS VARCHAR) AS product FROM items WHERE gtin < '00000200' GROUP BY 1),
g AS (SELECT gtin, arg_min(id, (code, id)) AS representative FROM items GROUP BY 1), groups AS (SELECT gtin, representative, coalesce(sure.product, grouped.product, sha256(gtin)) AS product FROM g LEFT JOIN sure USING (gtin) LEFT JOIN grouped USING (gtin))"""


def grouped(spark: SparkSession, sf_dir: str) -> tuple[dict, DataFrame, DataFrame]:
    t = tables(spark, sf_dir)
    named = lambda f, below: t["items"].where(F.col("gtin") < below).groupBy("gtin").agg(f("id").cast("string").alias("product"))
    sure = named(F.min, "00000100")
    return t, assertions.groups(t["items"], named(F.max, "00000200"), sure), sure


@query(f"WITH {GROUPS} SELECT gtin, representative, product FROM groups")
def barcode_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group for each barcode: its representative item and its product."""
    return grouped(spark, sf_dir)[1]


@query(f"""WITH {GROUPS}, m AS (SELECT item, CAST(product AS VARCHAR) AS product, 'manual' AS method FROM matches)
SELECT item, product, method FROM m UNION ALL SELECT items.id, groups.product, CASE WHEN sure.gtin IS NULL THEN 'exact_provisional_gtin' ELSE 'exact_validated_gtin' END FROM items JOIN groups USING (gtin) LEFT JOIN sure USING (gtin) WHERE items.id NOT IN (SELECT item FROM m)""")
def confirmed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches, with one by barcode for each item that had none."""
    t, groups, sure = grouped(spark, sf_dir)
    old = t["matches"].select("item", F.col("product").cast("string").alias("product"), F.lit("manual").alias("method"), F.lit("someone").alias("confirmed_by"))
    return assertions.confirmed(old, t["items"], groups, sure).drop("confirmed_by")


@query(f"WITH {DIMENSIONS} SELECT id AS item, sha256('item:' || id) AS product FROM items WHERE id NOT IN (SELECT item FROM matches)")
def isolated_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a match get a product of their own."""
    t = tables(spark, sf_dir)
    return assertions.isolated(t["items"], t["matches"]).select("item", "product")


@query(f"WITH {DIMENSIONS}, f AS (SELECT l_partkey * 2 + l_linenumber % 2 AS item, count(*) AS n FROM lineitem GROUP BY 1) SELECT f.item, n, retailer, product FROM f JOIN items ON f.item = items.id LEFT JOIN matches USING (item)")
def projected_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of items with the product and the retailer that queries ask for."""
    t = tables(spark, sf_dir)
    facts = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") * 2 + F.col("l_linenumber") % 2).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return assertions.projected(facts, t["matches"], t["items"]).select("item", "n", "retailer", "product")


TOKENS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"


@query(f"""WITH p AS (SELECT p_partkey AS id, {TOKENS.format(NORM.format('p_name'))} AS t, p_brand, p_type, p_size, p_partkey % 700 AS gtin FROM part),
s AS (SELECT a.id AS item, b.id AS other, a.gtin = b.gtin AS same, coalesce(length(list_intersect(a.t, b.t)) / nullif(length(list_distinct(list_concat(a.t, b.t))), 0), 0) * 40 + CASE WHEN a.p_brand = b.p_brand THEN 20 ELSE 0 END + CASE WHEN a.p_type = b.p_type THEN 20 ELSE 0 END + CASE WHEN a.p_size = b.p_size THEN 20 ELSE -25 END AS points
  FROM p a JOIN p b ON b.id = a.id + 7)
SELECT item, other, round(CASE WHEN same THEN 1 ELSE greatest(0, least(99, points)) / 100 END, 3) AS score, same AS auto_confirm FROM s""")
def scored_item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of given pairs of items."""
    part = read(spark, sf_dir, "part")
    items = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("manufacturer"), F.col("p_type").alias("packaging"), F.col("p_size").alias("quantity"), (F.col("p_partkey") % 700).alias("gtin"), F.col("p_partkey").alias("retailer"))
    pairs = part.select(F.col("p_partkey").alias("item"), (F.col("p_partkey") + 7).alias("other"))
    return assertions.score_pairs(pairs, items).withColumn("score", F.col("score").cast("double"))


@query(f"""WITH {DIMENSIONS}, r AS (SELECT product, min(item) AS representative FROM matches GROUP BY 1)
SELECT products.id, representative, items.code, kind || ':' || value AS identifiers FROM products LEFT JOIN r ON products.id = r.product LEFT JOIN items ON representative = items.id LEFT JOIN identifiers ON identifiers.product = products.id""")
def decorated_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with their representative item and identifiers."""
    t = tables(spark, sf_dir)
    return assertions.decorated(t["products"], t["items"], t["matches"], t["identifiers"]).select("id", "representative", "code", F.array_join("identifiers", ",").alias("identifiers"))


@query("""WITH c AS (SELECT event_id AS id, user_id % 10 AS u, event_type, CAST(floor(value) AS BIGINT) AS v FROM events), old AS (SELECT u, event_type, v, min(id) AS old_id FROM c WHERE id % 2 = 0 GROUP BY ALL), new AS (SELECT id + 1000000 AS id, u, event_type, v FROM c), first AS (SELECT u, event_type, v, min(id) AS first_id FROM new GROUP BY ALL)
SELECT CASE WHEN id = first_id THEN coalesce(old_id, id) ELSE id END AS id, u, event_type, v FROM new JOIN first USING (u, event_type, v) LEFT JOIN old USING (u, event_type, v)""")
def rebuilt_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a rebuild with the ids that equal rows had before."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("u"), "event_type", F.floor("value").alias("v"))
    return rebuild.kept_ids(rows.where("id % 2 = 0"), rows.withColumn("id", F.col("id") + 1_000_000), "id", [])


@query(f"WITH {TWO} SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN (product, store, price) IN (SELECT (product, store, price) FROM new) THEN 'preserved' ELSE 'superseded' END AS outcome FROM old) GROUP BY 1")
def rebuild_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a rebuild preserves and supersedes."""
    old, new = (snapshot(spark, sf_dir, when).select("product", "store", "price") for when in (OLD, NEW))
    return rebuild.outcomes(old, new, []).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TWO}, a AS (SELECT store, price FROM old), b AS (SELECT store, price FROM new) SELECT store, price, sum(n) AS surplus FROM (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL HAVING sum(n) <> 0")
def rebuild_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rebuild changed, but for the product."""
    old, new = (snapshot(spark, sf_dir, when).select("product", "store", "price") for when in (OLD, NEW))
    return rebuild.equivalent(old, new, ["product"])


@query("SELECT bool_or(event_type = 'error' AND value > 20) AS parser_correction, bool_or(event_type = 'nothing') AS archive_only FROM events")
def material_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "events").select(((F.col("event_type") == "error") & (F.col("value") > 20)).alias("parser_corrected"), (F.col("event_type") == "nothing").alias("archive_only"))
    return rebuild.material(files)


@query("SELECT n.event_id AS id, n.user_id, n.event_type, o.original FROM events n LEFT JOIN (SELECT user_id, event_type, arg_min(event_id, (value, event_id)) AS original FROM events WHERE event_id % 3 = 0 GROUP BY ALL) o USING (user_id, event_type) WHERE n.event_id % 3 = 1")
def first_original_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilt rows with the first original of their key."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value")
    return rebuild.first_originals(rows.where("id % 3 = 0"), rows.where("id % 3 = 1").drop("value"), ["user_id", "event_type"], "value")


@query("SELECT n_regionkey AS region, to_json(list({'id': n_nationkey, 'name': n_name} ORDER BY n_nationkey)) AS nations FROM nation GROUP BY 1")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a key as an ordered array of objects."""
    return read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(json.build_array([F.col("n_nationkey")], id=F.col("n_nationkey"), name=F.col("n_name")).alias("nations"))


@query("""SELECT event_id, '{"event":' || event_id || ',"kind":"' || event_type || '","nothing":null}' AS row, '{"k":"' || (CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) + 1) || '","type":"' || event_type || '"}' AS merged, '{}' AS bare FROM events""")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row as an object; an object with a key set and another added; and one with its key taken away."""
    rows = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int") + 1
    return rows.select(
        "event_id", json.build_object(event=F.col("event_id"), kind=F.col("event_type"), nothing=F.lit(None).cast("string")).alias("row"), json.to_object(json.merged(F.col("props"), k=k, type=F.col("event_type"))).alias("merged"),
        json.to_object(json.without(F.col("props"), "k")).alias("bare"),
    )


@query("SELECT event_id, user_id % 5 = value_key AS held FROM (SELECT event_id, user_id, event_id % 5 AS value_key FROM events)")
def json_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an array in JSON holds a value."""
    listed = F.to_json(F.array((F.col("user_id") % 5).cast("string")))
    return read(spark, sf_dir, "events").select("event_id", json.holds(listed, (F.col("event_id") % 5).cast("string")).alias("held"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size + 0.25 WHEN 2 THEN 1000 + p_size + 0.75 WHEN 3 THEN 1000000 + p_size WHEN 5 THEN p_size END AS price,
CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN -p_size END AS n, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM part""")
def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and flags as publishers write them: commas before a fraction or between thousands, no-break spaces, what is no number, and Hebrew yes."""
    size = F.col("p_size").cast("string")
    pick = lambda n, *texts: F.element_at(F.array(*texts), (F.col("p_partkey") % n + 1).cast("int"))
    price = pick(6, F.concat(size, F.lit(",5")), F.concat(F.lit(" "), size, F.lit(",250")), F.concat(F.lit("1,"), F.lpad(size, 3, "0"), F.lit(".75")), F.concat(F.lit("1,000,"), F.lpad(size, 3, "0")), F.concat(F.lit("-"), size, F.lit(".1")), F.concat(size, F.lit(" .00")))
    whole = pick(3, F.concat(F.lit(" +"), size), F.concat(F.lit("-"), size), F.concat(size, F.lit(".0")))
    flag = pick(4, F.lit("Yes"), F.lit(" לא "), F.lit("כן"), F.lit("maybe"))
    return read(spark, sf_dir, "part").select("p_partkey", values.decimal_of(price).cast("double").alias("price"), values.int_of(whole).alias("n"), values.flag_of(flag).alias("flag"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 16:05:06' AS listed, strftime(o_orderdate, '%Y-%m-%d') || ' 09:30:00' AS local FROM orders")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of listings and files, read as the publishers' wall time and shown as such."""
    wall = lambda c: F.date_format(F.from_utc_timestamp(c, values.ZONE), "yyyy-MM-dd HH:mm:ss")
    rows = read(spark, sf_dir, "orders")
    listed = values.listing_instant(F.date_format("o_orderdate", "M/d/yyyy' 4:05:06 PM'"))
    local = values.instant_of(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy' 09:30'")).otherwise(F.date_format("o_orderdate", "yyyyMMdd'093000'")))
    return rows.select("o_orderkey", wall(listed).alias("listed"), wall(local).alias("local"))


@query("""SELECT p_partkey, lower(regexp_replace(p_name || '! (' || p_type || ')', '[[:punct:][:space:]]+', ' ', 'g')) AS search_column, p_size || ' g | package ' || p_partkey % 12 AS packaging, regexp_matches(sha256(p_name), '^[0-9a-f]{64}$') AS is_digest, regexp_matches(CAST(p_partkey AS VARCHAR), '^[0-9]{3,4}$') AS is_code FROM part""")
def search_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored search text of a name (not trimmed), the packaging's text, and checks of formats."""
    name = F.concat("p_name", F.lit("! ("), "p_type", F.lit(")"))
    return read(spark, sf_dir, "part").select(
        "p_partkey", text.search_column(name).alias("search_column"), text.packaging(F.col("p_size").cast("string"), F.lit("g"), (F.col("p_partkey") % 12).cast("string")).alias("packaging"),
        F.sha2("p_name", 256).rlike("^[0-9a-f]{64}$").alias("is_digest"), F.col("p_partkey").cast("string").rlike("^[0-9]{3,4}$").alias("is_code"),
    )


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events WHERE user_id < 20)
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY v ASC NULLS FIRST, event_id) AS nulls_first, row_number() OVER (PARTITION BY user_id ORDER BY v ASC NULLS LAST, event_id) AS nulls_last FROM e""")
def orders_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where("user_id < 20").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    place = lambda c: F.row_number().over(Window.partitionBy("user_id").orderBy(c, "event_id"))
    return rows.select("event_id", place(F.col("v").asc_nulls_first()).alias("nulls_first"), place(F.col("v").asc_nulls_last()).alias("nulls_last"))


@query("""SELECT l_partkey AS item, min(CAST(l_suppkey AS VARCHAR)) AS store, arg_min(l_tax, (CAST(l_suppkey AS VARCHAR), l_orderkey, l_linenumber, l_tax)) AS tax FROM lineitem GROUP BY 1""")
def item_attributes_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's attributes from the smallest store that reports it, stores as text."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.min(F.struct(F.col("l_suppkey").cast("string").alias("store"), "l_orderkey", "l_linenumber", "l_tax")).alias("one"))
    return rows.select("item", "one.store", F.col("one.l_tax").alias("tax"))


@query("""SELECT o_orderkey AS promotion, CAST(o_custkey AS VARCHAR) || CASE WHEN o_custkey <> 5 THEN ',5' ELSE '' END AS stores FROM orders""")
def effective_promotion_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A promotion's stores with the header's, each once, in order."""
    stores = F.array_distinct(F.concat(F.array(F.col("o_custkey").cast("string"), F.col("o_custkey").cast("string")), F.array(F.lit("5"))))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("promotion"), F.array_join(stores, ",").alias("stores"))
