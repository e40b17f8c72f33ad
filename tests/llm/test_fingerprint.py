import hashlib
import random

import numpy as np
import pytest
import xxhash

from tagwell.llm import fingerprint as fp

MASK = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 32)) * int(fp.MULTIPLIER) & MASK
    x ^= x >> 29
    x = x * int(fp.SECOND) & MASK
    return x ^ (x >> 32)


def parse(text):
    """The levels of one text, symbol by symbol."""
    levels = [[ord(c) for c in text]]
    while len(levels[-1]) > 1:
        runs = []
        for x in levels[-1]:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [x if n == 1 else mix((x * int(fp.MULTIPLIER) + n) & MASK) for x, n in runs]
        labels = names
        for _ in range(fp.ROUNDS):
            low = [0] + [((a ^ b) & -(a ^ b)).bit_length() - 1 for a, b in zip(labels, labels[1:])]
            labels = [2 * k + (x >> k & 1) for k, x in zip(low, labels)]
        begins = [0] + [i for i in range(2, len(names) - 1) if labels[i] < labels[i - 1] and labels[i] <= labels[i + 1]]
        levels.append([mix(sum(mix(x) * int(fp.POWERS[min(k, 63)]) for k, x in enumerate(names[a:b])) & MASK) for a, b in zip(begins, [*begins[1:], len(names)])])
    return levels


def sketch(text):
    if not text:
        return []
    levels = parse(text)
    k = min(fp.BASE_LEVEL, len(levels) - 1)
    found = [x for level in levels[k:] for x in level]
    while len(found) < fp.ENOUGH and k > 0:
        k -= 1
        found += levels[k]
    return sorted({mix(x) >> 32 for x in found})[: fp.SKETCH]


def texts():
    rng = random.Random(2)
    out = ["", "a", "aa", "ab", "aaaaaaaa", "abababababab", "né", "🙂🙂a", "x" * 5000]
    out += ["".join(rng.choice("abcde é\n") for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    return out


def test_batches_give_the_sketches_of_single_texts():
    assert [s.tolist() for s in fp.sketches(texts())] == [sketch(t) for t in texts()]
    assert fp.sketches([]) == []


def test_equal_substrings_share_names_wherever_they_stand():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared, a, b = (" ".join(word() for _ in range(300)) for _ in range(3))
    left, right, other = fp.sketches([a[:37] + shared, b[:411] + shared, a + b])
    assert fp.likeness(left, right) > 0.5 and fp.likeness(left, other) < 0.2 and fp.likeness(left, left) == 1
    assert fp.likeness_of_strings(fp.to_string(left), fp.to_string(right)) == fp.likeness(left, right)


@pytest.mark.parametrize("partitions", [1, 4])
def test_query_against_brute_force(spark, partitions):
    rows = [(i * 3, t, "x") for i, t in enumerate(texts())] + [(None, None, "y"), (None, "zz", "y"), (9, "again", "y"), (9, "again", "y")]
    rows += [(12, f"often {i}", "z") for i in range(70)] + [(None, f"none {i} " * i, "z") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tail string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fp.fingerprint_documents(docs, batch_chars=2000).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64_intdigest(r[1].encode(), 42) >> 11, r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        u = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        s, se, su = (np.array(sketch(x), np.uint32) for x in (t, e, u))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.to_string(s), fp.to_string(se), fp.likeness(s, se), fp.likeness(s, su)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_alone_and_empty(spark):
    docs = spark.createDataFrame([(1, "only one text")], "doc_id long, text string")
    assert [(r.near_edited == r.near_next, r.near_next) for r in fp.fingerprint_documents(docs).collect()] in ([(False, 1.0)], [(True, 1.0)])
    assert fp.fingerprint_documents(docs.where("false")).collect() == []
