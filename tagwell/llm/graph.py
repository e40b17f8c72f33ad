"""Connected components of links, by alternating stars on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwell.llm.common import cut, release

LINKS_AT_ONCE = 1 << 20


def hung(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the smallest node that each reaches, by hooks and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, top = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = top[x], top[y]
        open_ = p != q
        if not open_.any():
            return nodes, nodes[top]
        np.minimum.at(top, np.maximum(p, q)[open_], np.minimum(p, q)[open_])
        while ((up := top[top]) != top).any():
            top = up


def hung_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, LINKS_AT_ONCE at a time, as links of each node with the smallest that these reach."""
    held, n = [], 0

    def give() -> pa.RecordBatch:
        node, label = hung(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["a", "b"])

    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n >= LINKS_AT_ONCE:
            yield give()
            held, n = [], 0
    if n:
        yield give()
    held = []
    release()


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node that links reach), for the nodes of links (a, b).

    Up to LINKS_AT_ONCE links are one task's. More are hung together task by task first, and what that leaves goes on with large and small stars in turn: each round hangs a node's neighbours on the smallest of them, with sums by
    node and joins only, until the links stay as they are. Each round is cut into the shared folder.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= LINKS_AT_ONCE:
        return edges.coalesce(1).mapInArrow(hung_together, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("label"))
    edges = cut(edges.mapInArrow(hung_together, "a long, b long").where("a <> b").distinct())
    before = None
    while (now := edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        moved = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        edges = cut(moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
