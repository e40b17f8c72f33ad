"""Queries that the driver runs, by name, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagwell.plans import applying, catalog, ingest, prices, reads  # noqa: F401  they register their queries
from tagwell.plans.prices import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest-first price comparison."""
    return prices.compare_prices_product(spark, sf_dir)
