import random
import re
from fractions import Fraction
from itertools import product

import numpy as np
import pytest

from tagwell.llm import source_mix as sm


def targets(sizes, weights=sm.WEIGHTS, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if rest * weight[s] / total >= cap * sizes[s]}
        if not full:
            return out | {s: float(rest * weight[s] / total) for s in free}
        out |= {s: float(cap * sizes[s]) for s in full}
        rest -= sum(cap * sizes[s] for s in full)
        free -= full
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_resharing_by_hand(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 40, 900, 10_000]) for s in ["a", "B", "ä", "z", None, "", "zz"][: 3 + seed]}
    got = sm.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    assert {r.source: pytest.approx(r.target) for r in got} == targets(sizes)


@pytest.mark.parametrize("seed", range(20))
def test_knapsack_against_all_choices(seed):
    rng = random.Random(seed)
    lengths = np.array(rng.sample(range(1, 30), 4))
    counts = np.array([rng.randrange(0, 4) for _ in lengths])
    budget = rng.randrange(0, 90)
    taken = sm.knapsack(lengths, counts, budget)
    best = min((sum(a * b for a, b in zip(lengths, c)) for c in product(*(range(n + 1) for n in counts))), key=lambda s: (abs(s - budget), s))
    assert (taken <= counts).all() and (taken >= 0).all() and int(taken @ lengths) == best


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 7, 20, 90])), rng.choice(["hot", "hot", "hot", "b", None, "c"]), 5) for i in range(900)]
    rows += [(2000, None, "b", 1), (2001, "", "b", 1), (2002, "w w \t\x0b w", "b", 1), (None, "w w", "only", 1), (2003, "w " * 3000, "c", 1)] + [(7, "a b", "b", 1)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")


def test_mix(docs, monkeypatch):
    monkeypatch.setattr(sm, "BUCKET_ROWS", 16)
    rows = sm.mix(docs).collect()
    key = lambda rs: sorted(map(str, rs))
    assert key((r.doc_id, r.source, r.size) for r in rows) == key((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect())
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = targets(sizes)
    for source, size in sizes.items():
        own = [r for r in rows if r.source == source]
        assert all(r.source_size == size and r.target == pytest.approx(want[source]) for r in own)
        assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in own)
        assert abs(sum(r.taken for r in own) - want[source]) <= 1
    assert key(map(tuple, sm.mix(docs.repartition(7)).collect())) == key(map(tuple, rows))


def test_empty_table(docs):
    assert sm.mix(docs.where("false")).collect() == []
    assert [r.taken for r in sm.mix(docs.where("doc_id = 2001")).collect()] == [0]


def test_knapsack_in_steps_comes_as_near():
    rng = np.random.default_rng(5)
    for _ in range(40):
        lengths = np.sort(rng.choice(np.arange(1, 5000), 12, False))[::-1]
        counts = rng.integers(0, 9, 12)
        budget = int(rng.integers(0, 30_000))
        exact, coarse = sm.knapsack(lengths, counts, budget), sm.knapsack(lengths, counts, budget, 500)
        assert ((coarse >= 0) & (coarse <= counts)).all()
        assert abs(int(lengths @ coarse) - budget) <= abs(int(lengths @ exact) - budget) + lengths.max()
    many = np.arange(1, 400)
    for budget in (777, 12_345, 99_999):
        assert abs(many @ sm.knapsack(many, np.full(399, 5), budget, 200) - budget) <= budget // 1000
    assert sm.knapsack(np.array([900]), np.array([1]), 800, 100).tolist() == [1] and sm.knapsack(np.array([900]), np.array([1]), 400, 100).tolist() == [0]


def test_reserve_follows_the_longest_document():
    lengths, counts = np.array([9_000_000, 4_000_000, 700, 31]), np.array([3, 5, 4000, 9000])
    total = int(lengths @ counts)
    whole, extra = sm.fit_budget(lengths, counts, total * 0.37)
    assert whole == 0 and (extra <= counts).all() and abs(int(lengths @ extra) - round(total * 0.37)) <= 31


def test_many_rows_without_doc_id_and_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(sm, "BUCKET_ROWS", 16)
    rows = [(None, "a b c", "s0", 1, 2)] * 300 + [(None, f"x y z{i}", "s0", 1, 2) for i in range(100)] + [(7, "one two", "s1", 1, 2)] * 40 + [(i, "w " * (i % 9), "s2", 3, 4) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, share int, place int").repartition(3)
    out = sm.mix(docs).collect()
    assert len(out) == len(rows) and all(r.taken <= 3 * r.size for r in out)
    for source in ("s0", "s1", "s2"):
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3
    assert sorted(map(str, out)) == sorted(map(str, sm.mix(docs).collect()))
