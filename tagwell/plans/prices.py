"""Price queries: current prices, comparison, history, snapshots, availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwell.operators import history, relational
from tagwell.plans.tables import LATEST, OBSERVATIONS, SPANS, day, observations, read, stores

PAGE, INSTANT, NEXT, SINCE, UNTIL = 28, "1997-06-01", "1997-06-02", "1996-01-01", "1998-01-01"
LAST = ["observed_on", "order_no", "line_no", "price", "on_sale", "available"]
QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest_of(observations(spark, sf_dir), ["product", "store"], LAST)


@query(f"WITH {LATEST} SELECT product, store, observed_on, price FROM latest")
def current_price_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last observed price of each product in each store."""
    return latest(spark, sf_dir).select("product", "store", "observed_on", "price")


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    cheapest = Window.partitionBy("product").orderBy("price", "store")
    top = latest(spark, sf_dir).withColumn("place", F.row_number().over(cheapest)).where(F.col("place") <= PAGE)
    return top.join(stores(spark, sf_dir), "store").select("product", "place", "store", "store_name", "retailer", "price", "observed_on")


@query(f"""WITH {LATEST}, top AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY price, store) AS place FROM latest)
SELECT product, place, store, s_name AS store_name, n_name AS retailer, price, observed_on FROM top JOIN supplier ON store = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE place <= {PAGE}""")
def compare_prices_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest first, a page for each product, with the store and its retailer."""
    return compared(spark, sf_dir)


@query(f"""WITH {LATEST}, ranked AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY price, store) AS place FROM latest),
cursor AS (SELECT product AS p, price AS c_price, store AS c_store FROM ranked WHERE place = 5),
next AS (SELECT product, store, price, row_number() OVER (PARTITION BY product ORDER BY price, store) AS place FROM latest JOIN cursor ON product = p WHERE price > c_price OR (price = c_price AND store > c_store))
SELECT product, place, store, price FROM next WHERE place <= 5""")
def keyset_page_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of five of each product, from the first one's last row as cursor."""
    rows = latest(spark, sf_dir)
    cheapest = Window.partitionBy("product").orderBy("price", "store")
    cursor = rows.withColumn("place", F.row_number().over(cheapest)).where("place = 5").select("product", F.col("price").alias("c_price"), F.col("store").alias("c_store"))
    behind = relational.after([(F.col("price"), F.col("c_price"), True), (F.col("store"), F.col("c_store"), True)])
    return rows.join(cursor, "product").where(behind).withColumn("place", F.row_number().over(cheapest)).where("place <= 5").select("product", "place", "store", "price")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.intervals(observations(spark, sf_dir), ["product", "store"], "observed_on", ["price"])


@query(f"WITH {SPANS} SELECT product, store, valid_from, valid_to, price FROM spans")
def price_history_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole price history as half-open intervals."""
    return spans(spark, sf_dir)


@query(f"""WITH {SPANS}, hit AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY valid_from DESC, store) AS place FROM spans WHERE valid_from < '{UNTIL}' AND (valid_to IS NULL OR valid_to > '{SINCE}'))
SELECT product, place, store, valid_from, valid_to, price FROM hit WHERE place <= {PAGE}""")
def price_history_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that meet a span of time, latest first, a page for each product."""
    hit = spans(spark, sf_dir).where(relational.overlaps(F.col("valid_from"), F.col("valid_to"), F.lit(SINCE), F.lit(UNTIL)))
    place = F.row_number().over(Window.partitionBy("product").orderBy(F.col("valid_from").desc(), "store"))
    return hit.withColumn("place", place).where(F.col("place") <= PAGE).select("product", "place", "store", "valid_from", "valid_to", "price")


@query(f"WITH {SPANS} SELECT product, store, valid_from, price FROM spans WHERE valid_from <= '{INSTANT}' AND (valid_to IS NULL OR '{INSTANT}' < valid_to)")
def price_as_of_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price that held at an instant."""
    until = history.intervals(observations(spark, sf_dir, before=NEXT), ["product", "store"], "observed_on", ["price"])  # what comes later ends intervals only
    return until.where("valid_to IS NULL").select("product", "store", "valid_from", "price")


def snapshot(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    """The last price of each key among the observations of one half: OLD or NEW."""
    rows = observations(spark, sf_dir, before=INSTANT) if condition == OLD else observations(spark, sf_dir, since=INSTANT)
    return relational.latest_of(rows, ["product", "store"], LAST).select("product", "store", "price", "on_sale", "available")


def _snapshot(name: str, condition: str) -> str:
    return f"""{name} AS (SELECT product, store, price, on_sale, available FROM (SELECT *, row_number() OVER (PARTITION BY product, store ORDER BY observed_on DESC, order_no DESC, line_no DESC, price DESC, on_sale DESC, available DESC) AS rn FROM obs WHERE {condition}) WHERE rn = 1)"""


OLD, NEW = f"observed_on < '{INSTANT}'", f"observed_on >= '{INSTANT}'"
TWO = f"{OBSERVATIONS}, {_snapshot('old', OLD)}, {_snapshot('new', NEW)}"


@query(f"""WITH {TWO} SELECT CASE WHEN old.product IS NULL THEN 'inserted' WHEN old.price IS DISTINCT FROM new.price OR old.on_sale IS DISTINCT FROM new.on_sale THEN 'updated' ELSE 'unchanged' END AS outcome, count(*) AS n
FROM new LEFT JOIN old USING (product, store) GROUP BY ALL""")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applying the second half of the observations to the state after the first: inserted, updated and unchanged keys."""
    old, new = snapshot(spark, sf_dir, OLD), snapshot(spark, sf_dir, NEW)
    none = spark.createDataFrame([], "product long, store long, valid_from timestamp, valid_to timestamp, price decimal(14,4), on_sale boolean")
    return history.apply_file(old, none, new, ["product", "store"], ["price", "on_sale"], F.lit(INSTANT).cast("timestamp")).counts


@query(f"WITH {TWO} SELECT product, store, price FROM old WHERE available AND store IN (SELECT store FROM new) AND (product, store) NOT IN (SELECT (product, store) FROM new)")
def absent_after_full_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available keys of the first half that a full file of the second half lacks in the stores that it covers."""
    return history.absent(snapshot(spark, sf_dir, OLD), snapshot(spark, sf_dir, NEW), ["product", "store"], ["store"], F.col("available")).select("product", "store", "price")


@query(f"""WITH {TWO}, a AS (SELECT store, count(*) AS prior FROM old GROUP BY store), b AS (SELECT store, count(*) AS incoming FROM new GROUP BY store),
c AS (SELECT store, coalesce(prior, 0) AS prior, coalesce(incoming, 0) AS incoming FROM a FULL JOIN b USING (store))
SELECT *, CASE WHEN prior > 0 THEN greatest(prior - incoming, 0) * 1000000 // prior ELSE 0 END AS dropped_ppm, coalesce(CASE WHEN prior > 0 THEN greatest(prior - incoming, 0) * 1000000 // prior > 50000 ELSE incoming < 100 END, false) AS refused FROM c""")
def snapshot_drop_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each store how much of the first half a full file of the second half lacks, and whether it is refused at a twentieth."""
    return history.drops(snapshot(spark, sf_dir, OLD), snapshot(spark, sf_dir, NEW), ["store"], 0.05, 100)


@query(f"""WITH {OBSERVATIONS}, last AS (SELECT product, store, observed_on, max(available) AS available FROM obs GROUP BY ALL),
moved AS (SELECT *, lag(available) OVER w AS before FROM last WINDOW w AS (PARTITION BY product, store ORDER BY observed_on))
SELECT product, store, observed_on, available FROM moved WHERE before IS NULL OR available <> before""")
def availability_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When products became available or unavailable in stores."""
    return history.intervals(observations(spark, sf_dir), ["product", "store"], "observed_on", ["available"]).select("product", "store", F.col("valid_from").alias("observed_on"), "available")


@query(f"""WITH {OBSERVATIONS}, r AS (SELECT DISTINCT product, n_name AS retailer FROM obs JOIN supplier ON store = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT product, count(*) AS retailers, count(*) >= 2 AS validated FROM r GROUP BY product""")
def corroboration_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent retailers that report a product; two validate it."""
    pairs = observations(spark, sf_dir).select("product", "store").distinct().join(stores(spark, sf_dir), "store")
    return pairs.groupBy("product").agg(F.countDistinct("retailer").alias("retailers")).withColumn("validated", F.col("retailers") >= 2)


@query(f"""WITH {OBSERVATIONS}, a AS (SELECT product, 'price_conflict' AS reason FROM obs GROUP BY product, store, observed_on HAVING count(DISTINCT price) > 1),
b AS (SELECT product, 'availability_conflict' AS reason FROM obs GROUP BY product, store, observed_on HAVING count(DISTINCT available) > 1),
c AS (SELECT product, 'sale_conflict' AS reason FROM obs GROUP BY product, store, observed_on HAVING count(DISTINCT on_sale) > 1) SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c""")
def conflict_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with conflicting observations of one store and day, by reason; one aggregate finds all three."""
    spread = lambda c: F.max(c) > F.min(c)
    marked = observations(spark, sf_dir).groupBy("product", "store", "observed_on").agg(spread("price").alias("price_conflict"), spread("available").alias("availability_conflict"), spread("on_sale").alias("sale_conflict"))
    reasons = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("price_conflict", "availability_conflict", "sale_conflict")]))
    return marked.select("product", F.explode(reasons).alias("reason")).distinct()


@query(f"""SELECT o_orderkey AS promotion, strftime(o_orderdate, '%Y-%m-%d') AS starts_on, o_orderpriority AS kind, o_custkey AS store FROM orders
WHERE strftime(o_orderdate, '%Y-%m-%d') <= '{INSTANT}' AND '{INSTANT}' <= strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AND (o_orderstatus = 'F' OR o_custkey IN (SELECT s_suppkey FROM supplier))""")
def promo_active_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as promotions of 30 days that hold an instant; those of status F apply in all stores, others where their store is known."""
    orders = read(spark, sf_dir, "orders")
    active = orders.where(relational.contains(day("o_orderdate"), day(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")), F.lit(INSTANT), end_inclusive=True))
    known = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_custkey"))
    rows = active.where("o_orderstatus = 'F'").unionByName(active.where("o_orderstatus <> 'F'").join(known, "o_custkey", "left_semi"))
    return rows.select(F.col("o_orderkey").alias("promotion"), day("o_orderdate").alias("starts_on"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("store"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
SELECT l_orderkey AS promotion, string_agg(l_partkey || ':' || l_suppkey, ',' ORDER BY rn) FILTER (rn <= 3) AS items, max(rn) > 3 AS truncated FROM r GROUP BY l_orderkey""")
def bounded_children_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three items of each order, and whether there are more."""
    child = F.concat_ws(":", "l_partkey", "l_suppkey")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    rows = relational.bounded_children(read(spark, sf_dir, "lineitem"), ["l_orderkey"], order, child, 3, "items")
    return rows.select(F.col("l_orderkey").alias("promotion"), F.array_join("items", ",").alias("items"), "truncated")


@query(f"""WITH {LATEST} SELECT store, least(count(*), 500) AS prices, count(*) > 500 AS truncated, max(observed_on) AS last_observed, arg_max(product, (observed_on, order_no, line_no, product)) AS last_product FROM latest GROUP BY store""")
def freshness_per_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped number of current prices of each store and its latest contributor."""
    last = F.max(F.struct("observed_on", "order_no", "line_no", "product"))
    rows = latest(spark, sf_dir).groupBy("store").agg(F.count(F.lit(1)).alias("n"), last.alias("last"))
    return rows.select("store", F.least("n", F.lit(500)).alias("prices"), (F.col("n") > 500).alias("truncated"), F.col("last.observed_on").alias("last_observed"), F.col("last.product").alias("last_product"))


@query(f"""WITH {LATEST}, a AS (SELECT product, store, price FROM latest), b AS (SELECT product, store, arg_max(price, (observed_on, order_no, line_no, price)) AS price FROM obs GROUP BY ALL)
SELECT product, store, price, sum(n) AS surplus FROM (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL HAVING sum(n) <> 0""")
def multiset_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current prices by window against those by maximum: no row if both are the same multiset."""
    order = [F.col(c).desc() for c in LAST]
    a = relational.first_of(observations(spark, sf_dir), ["product", "store"], order).select("product", "store", "price")
    return history.same_rows(a, latest(spark, sf_dir).select("product", "store", "price"))


@query("SELECT n_name AS retailer, strftime(l_shipdate, '%Y-%m-%d') AS date, count(*) AS n_rows FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def export_partition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each export partition, by retailer and day; lines are counted by store first."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("store"), day("l_shipdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return lines.join(stores(spark, sf_dir), "store").groupBy("retailer", "date").agg(F.sum("n").alias("n_rows"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS sequence FROM orders")
def rebuild_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which files are applied again, by time and id: days are counted first, and only rows of one day are sorted together."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    days = orders.groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("o_orderdate").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = days.select(F.col("o_orderdate").alias("day"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
    return orders.withColumn("place", place).join(first, F.col("o_orderdate") == F.col("day")).select("o_orderkey", (F.col("before") + F.col("place")).alias("sequence"))
