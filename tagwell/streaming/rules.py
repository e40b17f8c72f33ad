"""Rules that streams and batches share: allowed transitions and rolling budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Which event may follow which.
ALLOWED = (("signup", "view"), ("signup", "click"), ("view", "click"), ("view", "view"), ("view", "purchase"), ("click", "view"), ("click", "purchase"), ("click", "click"), ("purchase", "view"), ("error", "view"), ("view", "error"), ("click", "error"))


def rolling_totals(buckets: DataFrame, key: list[str], bucket: str, sums: list[str], seconds: int) -> DataFrame:
    """Sums over the buckets of the last seconds, both ends included, at each bucket (epoch seconds)."""
    window = Window.partitionBy(*key).orderBy(bucket).rangeBetween(-seconds, 0)
    return buckets.select(*key, bucket, *[F.sum(c).over(window).alias(c) for c in sums])
