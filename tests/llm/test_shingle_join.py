import random

import numpy as np
import pytest

from tagwell.llm import shingle_join as sj
from tagwell.llm.graph import components


def shingle_set(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """Component of each place by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), doc_id) if x is not None), default=None)
    return sorted(((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    texts = [[word() for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 30, 120, 400]))] for _ in range(70)]
    passage = [word() for _ in range(40)]
    for _ in range(260):  # copies at all distances, and of copies
        t = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.3:
            t[len(t) // 2 : len(t) // 2] = passage
        texts.append(t)
    rows = [(i * 2, rng.choice([" ", "  ", "\n"]).join(t)) for i, t in enumerate(texts)]
    rows += [(9001, None), (9003, ""), (9005, " \t\n"), (9007, "one"), (9009, "ONE"), (9011, "É x"), (9013, "é x"), (None, rows[0][1]), (9015, "b " * 20_000), (9017, "b " * 15_000)]
    return rows + rows[40:44]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed, monkeypatch):
    for name, value in (("TILE_POSTINGS", 900), ("TILE_CLASSES", 20), ("BLOCK_CLASSES", 7), ("PIVOT_CLASSES", 3), ("COUNT_SHINGLES", 5000)):
        monkeypatch.setattr(sj, name, value)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n int").repartition(3)
    got = sorted((tuple(r) for r in sj.join_documents(docs).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("classes", [7, 1024])
def test_number_of_links_against_all_pairs(spark, classes, monkeypatch):
    monkeypatch.setattr(sj, "BLOCK_CLASSES", classes)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = corpus(3) + [(20_000 + i, " ".join(w if rng.random() > 0.02 else f"{w}x{i}" for w in base)) for i in range(150)]  # one group of different near copies
    sets = [shingle_set(t) for _, t in rows]
    link = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= 75 * len(x | y)
    want = sorted(((d, sum(link(s, o) for k, o in enumerate(sets) if k != i)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sj.join_documents(docs, links=True)
    assert sorted(((r.doc_id, r.n_links) for r in got.collect()), key=str) == want
    assert sorted((tuple(r) for r in got.drop("n_links").collect()), key=str) == brute(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sj.join_documents(empty).collect() == [] and sj.join_documents(empty, links=True).collect() == []


def test_bounds():
    for n in range(1, 400):
        for m in range(n, 2 * n + 2):
            can = 100 * n >= 75 * m
            assert not can or abs(sj.band_of(n) - sj.band_of(m)) <= 1
            if can:
                need = next(i for i in range(n + 1) if 100 * i >= 75 * (n + m - i))
                shared = min(sj.more(n), sj.more(m)) + 1
                assert sj.least_overlap(n, m) == need and n - need + shared <= sj.short_prefix(n) and m - need + shared <= sj.prefix(m)
                assert shared >= sj.least_shared(n) and shared >= sj.least_shared(m) and sj.prefix(m) <= max(m, 1)


def test_bits_bound_the_overlap():
    rng = np.random.default_rng(3)
    x, y = (np.unique(rng.integers(0, 300, 150).astype(np.uint64) * sj.ODD[0]) for _ in range(2))
    p, q = sj.bitmap(x, 256), sj.bitmap(y, 256)
    common = len(np.intersect1d(x, y))
    assert common <= min(len(x) - np.bitwise_count(p & ~q).sum(), len(y) - np.bitwise_count(q & ~p).sum())
    assert (sj.fold(sj.bitmap(x, 1024), 256) == p).all() and sj.linked(x, x) and not sj.linked(x, y)


def test_links_of_a_block_against_all_pairs(monkeypatch):
    monkeypatch.setattr(sj, "SLICE_BITS", 64)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 120, np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(60, 121)], rng.integers(0, 1 << 62, rng.integers(0, 30), np.uint64)])) for _ in range(60)]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if sj.linked(sets[i], sets[j])}
    x, y = sj.links_within(sets, 60, True, 256)
    assert set(zip(x.tolist(), y.tolist())) == want and len(x) == len(want) > 20
    x, y = sj.links_within(sets, 25, False, 256)
    assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i, j in want if i < 25 <= j}
    x, y = sj.links_within(sets, 60, True, 64, np.arange(60) % 3)
    assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i, j in want if i % 3 != j % 3}


def test_blocks_give_no_more_rows_than_labels():
    rng = np.random.default_rng(9)
    bases = [rng.integers(0, 1 << 62, 120, np.uint64) for _ in range(2)]
    rows = [(k + 1, np.sort(np.append(bases[k % 2], np.uint64(k))).tobytes()) for k in range(80)] + [(99, np.sort(rng.integers(0, 1 << 62, 120, np.uint64)).tobytes())]
    a, b = sj.between_components((5, 0, 0), rows, [])  # two groups, in each of which all are linked, and one set alone
    assert dict(zip(a, b, strict=True)) == {k: 2 - k % 2 for k in range(3, 81)} and len(a) == 78
    a, b = sj.between_components((5, 0, 1), rows[:40], rows[40:])
    assert dict(zip(a, b, strict=True)) == {k: 2 - k % 2 for k in range(3, 81)} and len(a) == 78
    assert sj.between_components((5, 0, 0), rows[-1:] + rows[:1], []) == ([], [])


def test_connected_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for e in links for x in e}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: p for x, p in parent.items() if x in got} and all(parent[x] == x for x in parent if x not in got)
