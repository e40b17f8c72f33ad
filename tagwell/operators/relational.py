"""Small relational operators: last row of a key, duplicates, intervals, pages, bounded children."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def differs(a: list[Column], b: list[Column]) -> Column:
    """Null-safe inequality of rows."""
    return ~F.struct(*[c.alias(f"c{i}") for i, c in enumerate(a)]).eqNullSafe(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(b)]))


def ranked(df: DataFrame, key: list[str], order: list[Column], name: str = "occurrence") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in this order."""
    return ranked(df, key, order).where("occurrence = 1").drop("occurrence")


def latest_of(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """One row of each key, the largest by these columns and then by all others: a maximum, so tasks combine before the shuffle and a hot key costs one row from each."""
    rest = [c for c in df.columns if c not in key and c not in by]
    best = df.groupBy(*key).agg(F.max(F.struct(*by, *rest)).alias("best"))
    return best.select(*key, *[F.col(f"best.{c}").alias(c) for c in (*by, *rest)]).select(df.columns)


def duplicates_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """All rows of each key but the first in this order, with their number."""
    return ranked(df, key, order).where("occurrence > 1")


def contains(start: Column, end: Column, at: Column, end_inclusive: bool = False) -> Column:
    """Whether an interval, open where an end is null, holds an instant."""
    before_end = at <= end if end_inclusive else at < end
    return (start.isNull() | (start <= at)) & (end.isNull() | before_end)


def overlaps(start: Column, end: Column, since: Column, until: Column, until_inclusive: bool = False) -> Column:
    """Whether [start, end) meets [since, until), or [since, until]."""
    return ((start <= until) if until_inclusive else (start < until)) & (end.isNull() | (end > since))


def after(order: list[tuple[Column, Column, bool]]) -> Column:
    """Keyset predicate: rows behind a cursor, from (column, cursor's value, ascending) in the order's sequence."""
    out, same = F.lit(False), F.lit(True)
    for column, value, ascending in order:
        out = out | (same & ((column > value) if ascending else (column < value)))
        same = same & (column == value)
    return out


def page(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first rows and one more, which tells that there is a next page."""
    return df.orderBy(*order).limit(size + 1)


def bounded_children(df: DataFrame, key: list[str], order: list[Column], child: Column, most: int, name: str = "children") -> DataFrame:
    """For each key its first `most` children in order, and whether there were more."""
    rows = ranked(df.withColumn("_child", child), key, order)
    kept = F.sort_array(F.collect_list(F.when(F.col("occurrence") <= most, F.struct("occurrence", "_child"))))
    return rows.where(F.col("occurrence") <= most + 1).groupBy(*key).agg(F.transform(kept, lambda x: x["_child"]).alias(name), (F.max("occurrence") > most).alias("truncated"))


def at_most(df: DataFrame, most: int | None, what: str) -> None:
    """Refuse more rows than `most`, if there is such a number; no more than one above are counted."""
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: {what}")


def tidy(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of a query that is over: it does so once the driver's objects for it are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def child_budget(rows: Column, size: int, whole: int = 21, each: int = 7, kinds: int = 3) -> Column:
    """How many children of each kind a row of a page may carry, so that all together stay within the response's budget."""
    return F.least(F.lit(each), (F.lit(whole) / (F.greatest(F.least(rows, F.lit(size)), F.lit(1)) * kinds)).cast("int"))
