"""Queries of ingestion: remote ids, gates, evidence of issues, set differences of snapshots, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwell.functions import text
from tagwell.operators import relational
from tagwell.plans.prices import NEW, OLD, TWO, latest, query, snapshot
from tagwell.plans.tables import LATEST, OBSERVATIONS, observations, read

STALE_DAYS, SAMPLE = 30, 10


@query("""SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS remote_id, min(page_id) AS first_page, count(*) AS copies FROM pages GROUP BY 1""")
def canonical_remote_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host and path, each id's first page and its copies."""
    rows = read(spark, sf_dir, "pages").select("page_id", text.remote_id(F.col("url")).alias("remote_id"))
    return rows.groupBy("remote_id").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("copies"))


@query("""WITH c AS (SELECT user_id AS file, count(*) FILTER (value >= 3) AS accepted, count(*) FILTER (value < 3) AS rejected FROM events GROUP BY 1)
SELECT *, rejected > 0 AND (accepted = 0 OR rejected * 10 > accepted + rejected) AS quarantined FROM c""")
def file_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (a user's events) with more than a tenth of their records rejected are quarantined."""
    ok = F.col("value") >= 3
    counts = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file")).agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))
    return counts.withColumn("quarantined", (F.col("rejected") > 0) & ((F.col("accepted") == 0) | (F.col("rejected") * 10 > F.col("accepted") + F.col("rejected"))))


@query(f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events WHERE value < 3)
SELECT event_type AS code, count(*) AS issues, CAST(sum(64 + strlen(props)) AS BIGINT) AS n_bytes, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (rn <= {SAMPLE}) AS sample FROM i GROUP BY 1""")
def issue_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact number and bytes of each code's issues, and the first of them as evidence; counts combine before the shuffle, and only the sample is ranked."""
    issues = read(spark, sf_dir, "events").where("value < 3").select(F.col("event_type").alias("code"), "event_id", "props")
    counts = issues.groupBy("code").agg(F.count(F.lit(1)).alias("issues"), F.sum(64 + F.octet_length("props")).alias("n_bytes"))
    sample = relational.bounded_children(issues, ["code"], [F.col("event_id")], F.col("event_id").cast("string"), SAMPLE, "ids")
    return counts.join(sample, "code").select("code", "issues", "n_bytes", F.array_join("ids", ",").alias("sample"))


@query("SELECT CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER) AS k, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a field of their JSON."""
    k = F.from_json("props", "k int")["k"]
    return read(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


@query(f"""WITH {TWO}, a AS (SELECT product, store, price FROM old), b AS (SELECT product, store, price FROM new)
SELECT *, 'gone' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of either snapshot that the other lacks."""
    a, b = (snapshot(spark, sf_dir, c).select("product", "store", "price") for c in (OLD, NEW))
    return a.subtract(b).withColumn("side", F.lit("gone")).unionByName(b.subtract(a).withColumn("side", F.lit("new")))


@query(f"""WITH {LATEST}, m AS (SELECT max(observed_on) AS today FROM obs)
SELECT product, store, observed_on, CAST(date_diff('day', CAST(observed_on AS DATE), CAST(today AS DATE)) AS INTEGER) AS age, date_diff('day', CAST(observed_on AS DATE), CAST(today AS DATE)) > {STALE_DAYS} AS stale FROM latest, m""")
def price_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since each current price was observed, up to the last observation of all (a table of one row)."""
    today = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("today"))
    age = F.datediff(F.to_date("today"), F.to_date("observed_on"))
    return latest(spark, sf_dir).crossJoin(F.broadcast(today)).select("product", "store", "observed_on", age.alias("age"), (age > STALE_DAYS).alias("stale"))


@query(f"""WITH {OBSERVATIONS} SELECT product, min(price) AS lowest, max(price) AS highest, bool_or(on_sale) AS ever_on_sale, bool_and(available) AS always_available, count(DISTINCT store) AS stores, CAST(count(*) FILTER (on_sale) AS BIGINT) AS sales FROM obs GROUP BY product""")
def price_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of each product's prices and what was ever or always so."""
    rows = observations(spark, sf_dir).groupBy("product")
    return rows.agg(F.min("price").alias("lowest"), F.max("price").alias("highest"), F.bool_or("on_sale").alias("ever_on_sale"), F.bool_and("available").alias("always_available"), F.countDistinct("store").alias("stores"), F.count_if(F.col("on_sale")).alias("sales"))
