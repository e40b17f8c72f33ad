"""The test tables in the roles of the price domain.

A part is a product, a supplier a store, its nation the retailer, the region the portal; a line item with its order's date is an
observed price of a product in a store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def observations(spark: SparkSession, sf_dir: str, since: str | None = None, before: str | None = None) -> DataFrame:
    """product, store, observed_on (text, which orders like the date), price, on_sale, available and the line's number; of [since, before), where the scan of orders skips what lies outside."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    if since:
        orders = orders.where(F.col("o_orderdate") >= F.lit(since).cast(dict(orders.dtypes)["o_orderdate"]))
    if before:
        orders = orders.where(F.col("o_orderdate") < F.lit(before).cast(dict(orders.dtypes)["o_orderdate"]))
    return lines.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("store"), day("o_orderdate").alias("observed_on"), F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no"),
        F.col("l_extendedprice").cast("decimal(14,4)").alias("price"), (F.col("l_discount") > 0).alias("on_sale"), (F.col("l_linestatus") == "O").alias("available"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("store"), F.col("s_name").alias("store_name"), F.col("n_name").alias("retailer"), F.col("n_regionkey").alias("portal"))


#: DuckDB text of `observations`, for the counterparts.
OBSERVATIONS = """obs AS (SELECT l_partkey AS product, l_suppkey AS store, strftime(o_orderdate, '%Y-%m-%d') AS observed_on, l_orderkey AS order_no, l_linenumber AS line_no,
  CAST(l_extendedprice AS DECIMAL(14,4)) AS price, l_discount > 0 AS on_sale, l_linestatus = 'O' AS available FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LATEST = OBSERVATIONS + """, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product, store ORDER BY observed_on DESC, order_no DESC, line_no DESC, price DESC, on_sale DESC, available DESC) AS rn FROM obs) WHERE rn = 1)"""
SPANS = OBSERVATIONS + """, last AS (SELECT product, store, observed_on, max(price) AS price FROM obs GROUP BY ALL),
  moved AS (SELECT *, lag(price) OVER w AS before, lag(1) OVER w AS any_before FROM last WINDOW w AS (PARTITION BY product, store ORDER BY observed_on)),
  spans AS (SELECT product, store, observed_on AS valid_from, lead(observed_on) OVER (PARTITION BY product, store ORDER BY observed_on) AS valid_to, price FROM moved WHERE any_before IS NULL OR price IS DISTINCT FROM before)"""
