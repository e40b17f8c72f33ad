"""Exact top-k by inner product, by a three-phase uniform threshold.

Vectors are cut into SLICES runs of components; a block of candidates holds, for each query, a list of partial scores for each slice.
1. Each task gathers the leaders of the lists of its first block and sends the k best of their totals; the k-th best of all that is sent is a safe
   cutoff, for no query's k-th score is below it.
2. All blocks get the cutoffs. A total at the cutoff or above needs, in some slice, at least the lowest partial score there plus an equal
   share of what the cutoff is above the sum of the lowest; only such entries are collected.
3. Their totals are resolved exactly. A task keeps the k best of each query over its blocks, and raises its own cutoff with them; these lists are all that
   moves, and the k best of them are the result.

Candidates stay where they are. Queries go to them in chunks of at most QUERY_BYTES, one after another, whose result is written to the shared folder. Components are integers, and
sums are exact: in 32-bit floats as long as they stay below 2^24, in 64-bit ones below 2^53, otherwise in Python's integers.

Defined results: vectors that are null, or hold null or a component that isn't finite, and rows without vec_id take no part; vectors of
different length don't meet; a row is a candidate for all queries but itself, so copies of it under its own vec_id are; ties go to the
smaller vec_id; fewer candidates than k give all; a score beyond 64 bits counts as the largest or smallest number of 64 bits; vectors of any length are compared
whole; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwell.llm.common import cut, release, shared_dir, table

K, SLICES, SCALE, EVERY = 20, 4, 64, 20
ROWS, AT_ONCE = 4096, 256
BLOCK_BYTES, QUERY_BYTES = 1 << 22, 1 << 23
HELD = 1 << 20
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
BLOCK = "block long, dim int, ids binary, rows binary, vectors binary"
LISTS = "query long, query_id long, vec_id long, score long"


def rows_of(dim: int) -> int:
    """Vectors of a block."""
    return max(1, min(ROWS, BLOCK_BYTES // (8 * max(dim, 1))))


def number_type(most: float, dim: int) -> type:
    """For products of components up to most."""
    total = most * most * max(dim, 1)
    return np.float32 if total < 1 << 24 else np.float64 if total < 1 << 53 else object


def pack(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors of one length, from vec_id and v (array of doubles, rounded down); each vector gets a row number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 32

        def give(dim: int, part: list) -> pa.RecordBatch:
            nonlocal number
            ids = np.array([p[0] for p in part], np.int64)
            vectors = np.floor(np.array([p[1] for p in part], np.float64)).reshape(len(part), dim)
            own = np.arange(number, number + len(part), dtype=np.int64)
            number += len(part)
            return pa.RecordBatch.from_arrays([pa.array([int(own[0])]), pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, own, vectors))], names=["block", "dim", "ids", "rows", "vectors"])

        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                part = held.setdefault(len(v), [])
                part.append((vec_id, v))
                if len(part) >= rows_of(len(v)):
                    yield give(len(v), part)
                    held[len(v)] = []
        for dim, part in held.items():
            if part:
                yield give(dim, part)

    return vectors.mapInArrow(run, BLOCK)


def chosen(blocks: DataFrame, every: int) -> DataFrame:
    """The vectors of blocks whose id is divisible by `every`, as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, ids, rows, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
                vectors, own = np.frombuffer(vectors).reshape(len(ids), dim), ids % every == 0
                if own.any():
                    here = np.flatnonzero(own)
                    yield pa.RecordBatch.from_arrays([pa.array([int(rows[here[0]])]), pa.array([dim], pa.int32()), *(pa.array([x[here].tobytes()], pa.binary()) for x in (ids, rows, vectors))], names=["block", "dim", "ids", "rows", "vectors"])

    return blocks.mapInArrow(run, BLOCK)


def partial_scores(queries: np.ndarray, vectors: np.ndarray, slices: int = SLICES) -> np.ndarray:
    """Scores of each query and vector in each slice; exact."""
    dim = queries.shape[1]
    most = max((float(np.abs(x).max()) for x in (queries, vectors) if x.size), default=0.0)
    kind = number_type(most, dim)
    to = (lambda x: x.astype(kind)) if kind is not object else (lambda x: np.array([[int(c) for c in row] for row in x], object).reshape(x.shape))
    edges = [dim * j // slices for j in range(slices + 1)]
    q, v = to(queries), to(vectors)
    return np.stack([q[:, a:b] @ v[:, a:b].T if b > a else np.zeros((len(q), len(v)), q.dtype) for a, b in zip(edges, edges[1:])])


def leaders(parts: np.ndarray, k: int) -> np.ndarray:
    """For each query, which candidates are among the k first of a slice's list."""
    lead = np.zeros(parts.shape[1:], bool)
    for scores in parts:
        if scores.shape[1] <= k:
            return np.ones_like(lead)
        first = np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.dtype != object else np.array([sorted(range(len(r)), key=lambda i: -r[i])[:k] for r in scores])
        np.put_along_axis(lead, first, True, 1)
    return lead


def reaching(parts: np.ndarray, cutoffs: np.ndarray) -> np.ndarray:
    """Which entries may have a total at or above their query's cutoff, by the uniform threshold on each slice."""
    least = parts.min(2)
    if parts.dtype == object:
        share = [(int(c) - int(sum(least[:, q]))) // len(parts) for q, c in enumerate(cutoffs)]
        return np.array([[[p >= m + s for p in row] for row, m, s in zip(slice_, low, share, strict=True)] for slice_, low in zip(parts, least, strict=True)], bool).any(0)
    share = np.floor((cutoffs.astype(np.float64) - least.sum(0, dtype=np.float64)) / len(parts)) - 1
    out = np.zeros(parts.shape[1:], bool)
    for scores, low in zip(parts, least, strict=True):
        out |= scores >= (low + share)[:, None]
    return out


def totals(parts: np.ndarray, query: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact totals of these entries."""
    found = parts[:, query, vector]
    if parts.dtype == object:
        return np.array([min(max(int(x), LOWEST), HIGHEST) for x in found.sum(0)], np.int64)
    return found.astype(np.float64).sum(0).astype(np.int64)


class Best:
    """The k best entries of each query so far, and the cutoffs that follow: the k-th score, or the given one if it is higher."""

    def __init__(self, cutoffs: np.ndarray, k: int):
        self.cutoffs, self.k, self.size = cutoffs.copy(), k, 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = scores >= self.cutoffs[query]
        if ok.any():
            self.held.append((query[ok], ids[ok], scores[ok]))
            self.size += int(ok.sum())
        if self.size > HELD:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, scores = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else (np.empty(0, np.int64),) * 3
        order = np.lexsort((ids, ~scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        at = np.arange(len(query))
        rank = at - np.maximum.accumulate(np.where(np.concatenate([[True], query[1:] != query[:-1]]), at, 0)) if len(at) else at
        last = rank == self.k - 1
        self.cutoffs[query[last]] = np.maximum(self.cutoffs[query[last]], scores[last])
        keep = rank < self.k
        self.held, self.size = [(query[keep], ids[keep], scores[keep])], int(keep.sum())
        return self.held[0]


def local_lists(blocks: DataFrame, queries: Broadcast, k: int, cutoffs: Broadcast | None) -> DataFrame:
    """Each task's k best entries for each query of a chunk (dim, ids, rows, vectors): without cutoffs of the leaders in its first block, with them of all that reach them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, q_ids, q_rows, q_vectors = queries.value
        best = Best(cutoffs.value if cutoffs else np.full(len(q_ids), LOWEST), k)
        done = False
        for batch in batches:
            for i in range(0 if done else batch.num_rows):
                if batch.column(1)[i].as_py() != dim:
                    continue
                ids, rows = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in (2, 3))
                vectors = np.frombuffer(batch.column(4)[i].as_py()).reshape(len(ids), dim)
                for at in range(0, len(q_ids), AT_ONCE):
                    here = slice(at, at + AT_ONCE)
                    parts = partial_scores(q_vectors[here], vectors)
                    entries = reaching(parts, best.cutoffs[here]) if cutoffs else leaders(parts, k + 1)
                    entries &= q_rows[here][:, None] != rows[None, :]
                    query, vector = np.nonzero(entries)
                    best.add(at + query, ids[vector], totals(parts, query, vector))
                done = cutoffs is None
        query, ids, scores = best.prune()
        yield pa.RecordBatch.from_arrays([pa.array(q_rows[query]), pa.array(q_ids[query]), pa.array(ids), pa.array(scores)], names=["query", "query_id", "vec_id", "score"])
        release()

    return blocks.mapInArrow(run, LISTS)


def chunks(queries: DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Query vectors of one length, QUERY_BYTES at most: dim, ids, rows and vectors. The driver holds one chunk and one block."""
    held: list[tuple] = []
    for r in queries.orderBy("dim").toLocalIterator():
        one = r.dim, np.frombuffer(r.ids, np.int64), np.frombuffer(r.rows, np.int64), np.frombuffer(r.vectors).reshape(-1, r.dim) if r.dim else np.zeros((len(r.ids) // 8, 0))
        if held and (held[0][0] != r.dim or sum(h[3].nbytes + h[1].nbytes for h in held) + one[3].nbytes + one[1].nbytes > QUERY_BYTES):
            yield held[0][0], *(np.concatenate([h[c] for h in held]) for c in (1, 2, 3))
            held = []
        held.append(one)
    if held:
        yield held[0][0], *(np.concatenate([h[c] for h in held]) for c in (1, 2, 3))


def search(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose vec_id is divisible by `every`, the k other rows of highest integer inner product."""
    v = F.transform(embeddings["embedding"], lambda x: x.cast("double") * scale)
    bad = F.exists(embeddings["embedding"], lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    clean = embeddings.where(embeddings["embedding"].isNotNull() & embeddings["vec_id"].isNotNull() & ~bad).select(embeddings["vec_id"].cast("long").alias("vec_id"), v.alias("v"))
    blocks = cut(pack(clean))
    queries = cut(chosen(blocks, every))
    spark = embeddings.sparkSession
    base, n = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}", 0
    in_order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    for chunk in chunks(queries):
        sent = spark.sparkContext.broadcast(chunk)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
        known = {r.query: r.score for r in local_lists(blocks, sent, k, None).withColumn("rank", rank).where(F.col("rank") == k).select("query", "score").toLocalIterator()}  # a row for each query of the chunk
        cutoffs = spark.sparkContext.broadcast(np.array([known.get(int(row), LOWEST) for row in chunk[2]], np.int64))
        found = local_lists(blocks, sent, k, cutoffs).withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
        found.select("query_id", "rank", "vec_id", "score").write.parquet(f"{base}/{n}")
        n += 1
        sent.unpersist()
        cutoffs.unpersist()
    result = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(result).parquet(*[f"{base}/{i}" for i in range(n)]) if n else spark.createDataFrame([], result)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
     WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
     FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 AND len(a.v) = len(b.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
