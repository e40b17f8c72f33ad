import random
import struct
from collections import Counter

import numpy as np
import pytest

from tagwell.llm import suffix_dedup as sd


def brute(texts, length):
    windows = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if windows[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    text = lambda n, letters="abcdefé ": "".join(rng.choice(letters) for _ in range(n))
    passage, base = text(2 * length), text(6 * length)
    texts = [None, "", "a", "a" * (length - 1), "a" * (3 * length), "ab" * length, text(5 * length), base, base, base[3:]]
    for _ in range(25):
        t = list(rng.choice([base, passage + text(length), text(3 * length)]))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    texts += [text(40) + passage[: length + k] + text(40) for k in (-30, -1, 0, 1, 7)] + [text(50) + passage + text(3) + passage]
    return texts


def runs_of(spark, strings, window, owners=None):
    sd.register(spark)
    data = spark.createDataFrame([(bytearray(sd.pack(strings, window, owners)),)], "blob binary").selectExpr(f"{sd.FUNCTION}(blob) AS runs").first().runs
    return [struct.unpack_from(">3i", data, 12 * k) for k in range(len(data) // 12)]


@pytest.mark.parametrize("seed", range(6))
def test_repeated_windows_by_suffix_order(spark, seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab" if seed % 2 else b"abc\xff\x00") for _ in range(rng.randrange(0, 60))) for _ in range(12)] + [b"a" * 30, b"ab" * 15, b""]
    length = rng.randrange(1, 9)
    windows = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    want = {(k, i + j) for k, s in enumerate(strings) for i in range(len(s) - length + 1) if windows[s[i : i + length]] > 1 for j in range(length)}
    assert {(k, i) for k, a, b in runs_of(spark, strings, length) for i in range(a, b)} == want


@pytest.mark.parametrize("seed", range(5))
def test_repeated_words_of_other_owners_by_suffix_order(spark, seed):
    rng = random.Random(seed)
    words = ["a", "ab", "b", "ba", "abb"]
    strings = [b" " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))).encode() + b" " for _ in range(14)]
    owners, n = [rng.randrange(4) for _ in strings], rng.randrange(2, 5)
    places = [list(sd.windows_of(s, -n)) for s in strings]
    held = {}
    for s, owner, own in zip(strings, owners, places):
        for a, b in own:
            held.setdefault(s[a:b], set()).add(owner)
    want = {(k, i) for k, (s, own) in enumerate(zip(strings, places)) for a, b in own if len(held[s[a:b]]) > 1 for i in range(a, b)}
    assert {(k, i) for k, a, b in runs_of(spark, strings, -n, owners) for i in range(a, b)} == want and want


def test_contexts_cover_each_window_once_and_agree_on_equal_windows(monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 700)
    sd.powers.cache_clear()
    rng = random.Random(1)
    shared = bytes(rng.randrange(256) for _ in range(500))
    a, b = (bytes(rng.randrange(256) for _ in range(n)) + shared + bytes(rng.randrange(256) for _ in range(900)) for n in (333, 1201))
    of = {}
    for t in (a, b):
        runs = [x for part in sd.contexts(t) for x in zip(*(c.tolist() for c in part))]
        assert [x for _, p, q in runs for x in range(p, q - sd.LENGTH + 1)] == list(range(len(t) - sd.LENGTH + 1))
        for h, p, q in runs:
            for x in range(p, q - sd.LENGTH + 1):
                assert of.setdefault(t[x : x + sd.LENGTH], h) == h
    sd.powers.cache_clear()


def test_word_contexts_cover_each_window_once_and_agree_on_equal_windows(monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 60)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    shared = [word() for _ in range(70)]
    texts = [(" " + " ".join([word() for _ in range(n)] + shared + [word() for _ in range(150)]) + " ").encode() for n in (30, 211)]
    texts = [b" few words ", texts[0], b" x ", texts[1], (" " + " ".join(shared[:50]) + " ").encode()]
    runs = [x for part in sd.word_contexts(texts) for x in zip(*(c.tolist() for c in part))]
    of = {}
    for k, t in enumerate(texts):
        want = list(sd.windows_of(t, -sd.WORDS))
        found = [(h, w) for i, h, p, q in runs if i == k for w in want if p <= w[0] and w[1] <= q]
        assert sorted(w for _, w in found) == want
        for h, (x, y) in found:
            assert of.setdefault(t[x:y], h) == h
    assert list(sd.word_contexts([b" few words ", b" x "])) == []


def passages(texts, n=50):
    """Of each text how many runs of n words or more another one holds."""
    words = [(t or "").replace("\t", " ").replace("\n", " ").split(" ") for t in texts]
    words = [[w for w in x if w] for x in words]
    held = {}
    for k, x in enumerate(words):
        for i in range(len(x) - n + 1):
            held.setdefault(tuple(x[i : i + n]), set()).add(k)
    out = []
    for x in words:
        hit = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - n + 1):
            if len(held[tuple(x[i : i + n])]) > 1:
                hit[i : i + n] = True
        out.append(int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()))
    return out


@pytest.mark.parametrize("most", [4096, 2])
def test_passages_of_words_that_other_documents_hold(spark, most, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_CONTEXTS", most)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    base, other = text(90), text(51)
    texts = [" ".join(text(n)) for n in (0, 3, 49, 50, 200)] + [None, " \n "]
    texts += [" ".join(text(20) + base[:n] + text(30)) for n in (48, 49, 50, 51, 90)] + ["\n".join(base[5:70]) + "\t  " + " ".join(text(9) + base[30:85])]
    texts += [" ".join(text(4) + other + text(3) + other)] + [" ".join(text(70))] * 2 + [" ".join(other[:30])] * 2 + [" ".join(w.upper() for w in base)] + [" ".join(text(60) * 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_passages for r in sd.deduplicate(docs, words=50).select("doc_id", "n_passages").collect()}
    want = passages(texts)
    assert got == dict(enumerate(want)) and sum(want) >= 7


def test_copies_and_white_space_need_no_further_pass_over_the_texts(spark, tmp_path):
    short, long = " ".join("a" * 49), " ".join("b" * 50)  # 97 and 99 bytes
    texts = [short, short, long, long, " " * 300, " " * 300, "\x0b".join("c" * 50), "\x0c\r ".join("c" * 50), "\u00a0".join("d" * 60), "\u00a0".join("d" * 60), "", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    out = sd.deduplicate(spark.read.parquet(f"{tmp_path}/docs"), words=50)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r.doc_id for r in out.where("n_passages = 1").collect()} == {2, 3, 6, 7} and not out.where("n_passages > 1").count()


@pytest.mark.parametrize(("seed", "most"), [(1, 4096), (2, 3)])
def test_against_all_windows(spark, seed, most, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(sd, "BLOCK_CONTEXTS", most)
    texts = corpus(seed, sd.LENGTH)
    docs = spark.createDataFrame([(None if k == 3 else k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, data string, k1 int").repartition(3)
    got = {r.doc_id: (len(r.data), sum(s.end - s.first for s in r.spans), len(r.spans), bytes(r.kept)) for r in sd.deduplicate(docs).collect()}
    want = brute([(t or "").encode() for t in texts], sd.LENGTH)
    assert got == {None if k == 3 else k: w for k, w in enumerate(want)}


def test_empty_table(spark):
    assert sd.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []
