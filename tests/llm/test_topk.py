import math
import random

import numpy as np
import pytest

from tagwell.llm import topk


def brute(rows, k, every):
    clean = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(clean):
        if i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(clean) if b != a and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)


@pytest.mark.parametrize(("k", "every"), [(20, 20), (3, 2)])
def test_against_brute_force(spark, k, every, monkeypatch):
    monkeypatch.setattr(topk, "AT_ONCE", 7)
    monkeypatch.setattr(topk, "QUERY_BYTES", 4000)
    monkeypatch.setattr(topk, "ROWS", 40)
    monkeypatch.setattr(topk, "HELD", 100)
    rng = random.Random(k)
    rows = [(i, [np.float32(rng.gauss(0, 1)).item() for _ in range(13)], 0) for i in range(-40, 260)]
    rows += [(i, rows[4][1], 0) for i in range(300, 360)]  # one common vector
    rows += [(400, None, 0), (420, [None] + [1.0] * 12, 0), (440, [math.inf] * 13, 0), (460, [math.nan] * 13, 0), (None, [1.0] * 13, 0), (480, [], 0), (500, [1.0, 2.0], 0), (501, [0.5, -2.0], 0), rows[60], rows[60]]
    got = sorted(tuple(r) for r in topk.search(table(spark, rows), k, every).collect())
    assert got == brute(rows, k, every)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**22 + i), float(i), -1.0], 0) for i in range(30)]
    assert sorted(tuple(r) for r in topk.search(table(spark, rows), 5, 10).collect()) == brute(rows, 5, 10)


def test_scores_beyond_64_bits_count_as_the_largest_and_smallest(spark):
    rows = [(0, [1e30, 1.0], 0), (1, [1e30, 2.0], 0), (2, [-1e30, 5.0], 0), (3, [1e-3, 7.0], 0), (4, [3e38, -3e38], 0), (5, [2.0**57, 0.0], 0), (10, [2.0**-3, -(2.0**-3)], 0)]
    clip = lambda x: min(max(x, topk.LOWEST), topk.HIGHEST)
    vectors = {i: [math.floor(64 * np.float32(x).item()) for x in v] for i, v, _ in rows}
    want = []
    for q in (0, 10):
        found = sorted((-clip(sum(x * y for x, y in zip(vectors[q], v))), i) for i, v in vectors.items() if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:4])]
    assert sorted(tuple(r) for r in topk.search(table(spark, rows), 4, 10).collect()) == sorted(want)


def test_few_and_none(spark):
    assert topk.search(table(spark, [(20, [1.0], 0)])).collect() == []
    assert topk.search(table(spark, [(20, [1.0], 0)]).where("false")).collect() == []


def test_threshold_collects_all_that_reach_the_cutoff():
    rng = np.random.default_rng(0)
    parts = topk.partial_scores(rng.integers(-50, 50, (9, 16)).astype(float), rng.integers(-50, 50, (300, 16)).astype(float))
    cutoffs = np.sort(parts.sum(0), 1)[:, -20].astype(np.int64)
    assert not ((parts.sum(0) >= cutoffs[:, None]) & ~topk.reaching(parts, cutoffs)).any()
    assert topk.reaching(parts, cutoffs).mean() < 0.9
