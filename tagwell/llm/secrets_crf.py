"""Secret scan by a linear-chain conditional random field.

Tokens are runs of word characters, + / and -, and single other characters. The field tags each as the
beginning of a secret, inside one, or outside (B, I, O), from the token's shape, neighbouring words, and features of the file,
and Viterbi decodes the best sequence. The driver trains it on seeded
synthetic text, by maximum likelihood, when it is first used, and tasks get its weights.

Every token has all its features. Scores of a token alone are cached, those of neighbours and of the file are tables by class of
word, so a text's scores are a few array lookups. A token is surely outside if, by the learned weights, putting O there (and B for
an I behind it) improves any sequence; all others, the stretches between sure ones, are decoded, so the result is that of decoding the whole text.

Patterns give the base spans, which always stay; the field adds spans that don't lie within one of them.

Defined results: null is as empty, with no spans; texts of any length are scanned whole; repeated rows are scanned each; any doc_id may occur, null
too; of equal spans the kinds stand in the order assign, access, hex, crf; an empty table gives no row; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tagwell.llm.common import release, slices, table

#: The base patterns, and the least number of characters (of group 2 for assign).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[\w+/-]+|[^\w\s+/-]")
LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}")
KEY_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "bearer", "credential", "private")
KEY = re.compile("|".join(KEY_WORDS), re.IGNORECASE | re.ASCII)
SHORTEST_KEY = min(map(len, KEY_WORDS))
CACHED = 10_000_000
TAGS = "BIO"
B, I, O = range(3)
FORBIDDEN = -1e4


def long_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in LONG.finditer(text)]


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, leftmost and without overlap for each kind; runs: long_runs(text), if known."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for a, b in long_runs(text) if runs is None else runs:  # long enough for the other kinds, whose matches lie within such runs
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= LEAST["access"]]
        if b - a >= LEAST["hex"]:
            found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, a, b) if m.end() - m.start() >= LEAST["hex"]]
    return in_order(found)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def shape(token: str) -> str:
    """Classes of characters in order, each run once, eight at most."""
    classes = ("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in token[:64])
    out = ""
    for c in classes:
        if not out.endswith(c):
            out += c
    return out[:8]


def bits(token: str) -> float:
    """Entropy of its characters."""
    return entropy(tuple(sorted(map(token.count, set(token)))))


@lru_cache(maxsize=1 << 14)
def entropy(counts: tuple[int, ...]) -> float:
    n = sum(counts)
    return -sum(k / n * math.log2(k / n) for k in counts)


def word(token: str) -> str:
    """What a neighbour is known by: a key word, a short common mark, or its class."""
    if m := KEY.search(token):
        return m[0].lower()
    if len(token) == 1 and not token.isalnum():
        return token
    return "long" if len(token) >= 20 else "mixed" if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) else "number" if token.isdigit() else "word"


def file_features(text: str) -> list[str]:
    marks = sum(map(text.count, "={};")) * 200 // max(1, len(text))
    return [f"file:marks{min(marks, 3)}", f"file:lines{min(3, text.count(chr(10)) * 100 // max(1, len(text)))}"]


def own_features(token: str) -> list[str]:
    """Those of the token alone."""
    form = "x" if token.islower() else "X" if token.isupper() else "Xx" if token.istitle() else None
    if form and token.isascii() and token.isalpha():  # most tokens, by fewer steps
        kinds, slashes = {"x": "010", "X": "001", "Xx": "011"}[form], 0
        own = word(token) if len(token) >= SHORTEST_KEY else "word"
    else:
        form, own, slashes = shape(token), word(token), min(token.count("/") + token.count("-"), 3)
        kinds = f"{any(c.isdigit() for c in token):d}{any(c.islower() for c in token):d}{any(c.isupper() for c in token):d}"
    return ["any", f"shape:{form}", f"length:{min(len(token) // 4, 10)}", f"kinds:{kinds}", f"bits:{min(int(2 * bits(token)), 11)}", f"word:{own}", f"slashes:{slashes}"]


def features(tokens: list[str], of_file: list[str]) -> list[list[str]]:
    """The features of each token; those of the file join with the token's class."""
    words = ["<s>", "<s>", *map(word, tokens), "</s>", "</s>"]
    out = []
    for k, token in enumerate(tokens):
        own, before, after = words[k + 2], words[k + 1], words[k + 3]
        out.append([*own_features(token), f"before:{before}", f"two:{words[k]} {before}", f"after:{after}", f"with:{before} {own}", *(f"{f} {own}" for f in of_file)])
    return out


def synthetic(n: int = 320, seed: int = 1) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts and the spans of the secrets in them."""
    rng = random.Random(seed)
    hexes, plain = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    mixed = plain + plain.upper() + "0123456789"
    pick = lambda letters, least, most: "".join(rng.choices(letters, k=rng.randint(least, most)))
    prose = lambda k: " ".join(pick(plain, 2, 9) + rng.choice(["", "", "", ",", "."]) for _ in range(k))
    secrets = [
        lambda: (rng.choice(["password=", "Token: ", 'secret = "', "api_key=", "apikey: "]), pick(mixed, 8, 24), ""),
        lambda: (rng.choice(["password is ", "the token ", "secret key ", "api-key "]), pick(mixed, 12, 30) + "7k", ""),
        lambda: ("Authorization: Bearer ", pick(mixed, 30, 60), ""),
        lambda: ("", rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + pick(mixed, 24, 40), ""),
        lambda: ("", "eyJ" + pick(mixed, 20, 30) + ".eyJ" + pick(mixed, 30, 60) + "." + pick(mixed, 30, 43), ""),
        lambda: ("", "AKIA" + pick(mixed[26:], 16, 16).upper(), ""),
        lambda: (rng.choice(["", "key ", "credential "]), pick(hexes, 24, 48), ""),
        lambda: ("PRIVATE KEY----- ", " ".join(pick(mixed + "+/", 48, 64) for _ in range(rng.randint(1, 3))), " -----END"),
    ]
    clean = [
        lambda: rng.choice(["the password was ", "a token of ", "secret ", "private ", "my credential "]) + prose(3), lambda: "https://www." + pick(plain, 5, 12) + ".com/" + "/".join(pick(plain, 4, 10) for _ in range(4)),
        lambda: "-".join(pick(plain, 4, 9) for _ in range(5)), lambda: pick(plain, 20, 32), lambda: pick("0123456789", 20, 24), lambda: "/".join(pick(plain, 3, 8) for _ in range(6)),
        lambda: "=" * 30, lambda: "-" * 40, lambda: "_".join(pick(plain, 3, 8) for _ in range(5)), lambda: rng.choice(["password", "token", "secret"]) + rng.choice([".", ",", ":", " ="]) + " " + prose(2),
        lambda: pick(plain, 20, 32).capitalize() + rng.choice(["", ".", ","]), lambda: (pick(plain, 2, 4) * 12)[:30], lambda: pick("0123456789", 3, 4) + "-" + "-".join(pick("0123456789", 3, 4) for _ in range(5)),
    ]
    out = []
    for _ in range(n):
        text, spans = prose(rng.randint(0, 12)), []
        for _ in range(rng.randint(1, 3)):
            text += " " if text else ""
            if rng.random() < 0.5:
                before, secret, after = rng.choice(secrets)()
                text += before
                spans.append((len(text), len(text) + len(secret)))
                text += secret + after
            else:
                text += rng.choice(clean)()
            text += " " + prose(rng.randint(0, 9))
        out.append((text, spans))
    return out


class Field:
    """Weights of the features for each tag, and of a tag after another."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        return np.array([sum((self.emit[self.index[f]] for f in row if f in self.index), np.zeros(3)) for row in rows]).reshape(len(rows), 3)

    def decode(self, rows: list[list[str]]) -> str:
        """Viterbi; before the first token stands an O."""
        return self.best(self.scores(rows).tolist())

    def best(self, scores: list[list[float]]) -> str:
        """The best sequence between two O."""
        if not scores:
            return ""
        (bb, bi, bo), (ib, ii, io), (ob, _, oo) = self.move.tolist()
        b, i, o = scores[0][B] + ob, scores[0][I] + FORBIDDEN, scores[0][O] + oo
        back = []
        for sb, si, so in scores[1:]:
            to_b, to_i, to_o = (b + bb, i + ib, o + ob), (b + bi, i + ii, o + FORBIDDEN), (b + bo, i + io, o + oo)
            top = max(to_b), max(to_i), max(to_o)
            back.append((to_b.index(top[0]), to_i.index(top[1]), to_o.index(top[2])))
            b, i, o = top[0] + sb, top[1] + si, top[2] + so
        last = (b + bo, i + io, o + oo)
        tags = [last.index(max(last))]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return "".join(TAGS[t] for t in reversed(tags))

    def __getstate__(self) -> tuple:
        return self.index, self.emit, self.move

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    @cached_property
    def tables(self) -> Tables:
        return Tables(self)


class Tables:
    """A field's scores by class of word, and a bounded cache of those of tokens alone."""

    def __init__(self, model: Field):
        self.model = model
        known = [f.removeprefix("word:") for f in model.index if f.startswith("word:")]
        self.classes = {c: k for k, c in enumerate(["", "<s>", "</s>", *known])}  # the first: marks that training has not seen
        self.n = len(self.classes)
        names = list(self.classes)
        one = lambda form: np.array([self.of(form.format(c)) if c else np.zeros(3) for c in names])
        two = lambda form: np.array([self.of(form.format(c, d)) if c and d else np.zeros(3) for c in names for d in names])
        self.one, self.after, self.two = one, one("after:{}"), two("two:{} {}")
        self.pair = two("with:{} {}") + np.repeat(one("before:{}"), self.n, 0)
        self.files: dict[str, np.ndarray] = {}
        self.clear()
        m = model.move
        self.plain = [min(m[p, O] + m[O, q] - m[p, y] - m[y, q] for p in (B, I, O) for q in (B, O) if (p, y) != (O, I)) for y in (B, I)]
        self.split = [min(m[p, O] + m[O, B] + m[B, r] - m[p, y] - m[y, I] - m[I, r] for p in (B, I, O) for r in (B, I, O) if (p, y) != (O, I)) for y in (B, I)]

    def of(self, feature: str) -> np.ndarray:
        return self.model.emit[self.model.index[feature]] if feature in self.model.index else np.zeros(3)

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.sums: dict[tuple[str, ...], tuple[np.ndarray, int]] = {}
        self.own, self.class_of, self.size = np.zeros((1 << 12, 3)), np.zeros(1 << 12, np.int64), 0

    def add(self, token: str) -> int:
        k = len(self.places)
        if k == len(self.own):
            self.own, self.class_of = np.concatenate([self.own, np.zeros_like(self.own)]), np.concatenate([self.class_of, np.zeros_like(self.class_of)])
        features_ = tuple(own_features(token))
        if features_ not in self.sums:
            self.sums[features_] = sum(map(self.of, features_)), self.classes.get(features_[5].removeprefix("word:"), 0)
        self.own[k], self.class_of[k] = self.sums[features_]
        self.places[token] = k
        self.size += len(token) + 100
        return k

    def scores(self, tokens: list[str], of_file: list[str]) -> np.ndarray:
        if self.size > CACHED:
            self.clear()
        found, add = self.places, self.add
        at = np.array([found[t] if t in found else add(t) for t in tokens], np.int64)
        c = np.concatenate([[1, 1], self.class_of[at], [2]])
        for f in of_file:
            if f not in self.files:
                self.files[f] = self.one(f + " {}")
        own = c[2:-1]
        out = self.own[at] + self.pair[c[1:-2] * self.n + own]
        out += self.two[c[:-3] * self.n + c[1:-2]]
        out += self.after[c[3:]]
        out += sum(self.files[f] for f in of_file)[own]
        return out

    def unsure(self, scores: np.ndarray) -> np.ndarray:
        """Places that some best sequence may tag B or I."""
        to_b, to_i = scores[:, O] - scores[:, B], scores[:, O] - scores[:, I]
        gain = np.minimum(to_b + self.plain[B], to_i + self.plain[I])
        behind = scores[1:, B] - scores[1:, I]
        gain[:-1] = np.minimum(gain[:-1], np.minimum(to_b[:-1] + self.split[B], to_i[:-1] + self.split[I]) + behind)
        return np.flatnonzero(gain <= 1e-6)


@lru_cache(maxsize=1)
def field(steps: int = 120, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """The trained field: gradient steps (Adam) on the likelihood of the synthetic texts, all at once, by forward and backward sums."""
    rows, tags = [], []
    for text, spans in synthetic():
        tokens = list(TOKEN.finditer(text))
        rows.append(features([m[0] for m in tokens], file_features(text)))
        inside = [any(a <= m.start() and m.end() <= b for a, b in spans) for m in tokens]
        tags.append([O if not x else B if any(m.start() == a for a, _ in spans) else I for x, m in zip(inside, tokens, strict=True)])
    index = {f: k for k, f in enumerate(sorted({f for row in rows for x in row for f in x}))}
    n, longest, most = len(rows), max(map(len, rows)), max(len(x) for row in rows for x in row)
    ids, known, gold, want = np.full((n, longest, most), len(index)), np.zeros((n, longest), bool), np.full((n, longest), O), np.zeros((3, 3))
    for k, (row, tag) in enumerate(zip(rows, tags, strict=True)):
        for t, x in enumerate(row):
            ids[k, t, : len(x)] = [index[f] for f in x]
        known[k, : len(row)], gold[k, : len(row)] = True, tag
        for a, b in zip([O, *tag], [*tag, O]):
            want[a, b] += 1
    emit, move = np.zeros((len(index) + 1, 3)), np.zeros((3, 3))
    move[O, I] = FORBIDDEN
    first, second = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    hot = np.eye(3)[gold] * known[:, :, None]
    lengths = known.sum(1)

    def add(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for step in range(1, steps + 1):
        scores = emit[ids].sum(2)
        alpha, beta = np.zeros((longest, n, 3)), np.zeros((longest, n, 3))
        alpha[0] = scores[:, 0] + move[O]
        for t in range(1, longest):
            on = add(alpha[t - 1][:, :, None] + move, 1) + scores[:, t]
            alpha[t] = np.where(known[:, t, None], on, alpha[t - 1])
        beta[longest - 1] = move[:, O]
        for t in range(longest - 2, -1, -1):
            on = add(move + (scores[:, t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(known[:, t + 1, None], on, move[:, O])
        total = add(alpha[longest - 1] + move[:, O], 1)
        marginal = np.exp(alpha.transpose(1, 0, 2) + beta.transpose(1, 0, 2) - total[:, None, None]) * known[:, :, None]
        pairs = np.zeros((3, 3))
        pairs[O] += marginal[:, 0].sum(0)
        pairs[:, O] += marginal[np.arange(n), lengths - 1].sum(0)
        for t in range(1, longest):
            p = alpha[t - 1][:, :, None] + move + (scores[:, t] + beta[t])[:, None, :] - total[:, None, None]
            pairs += (np.exp(p) * known[:, t, None, None]).sum(0)
        slope = np.zeros_like(emit)
        np.add.at(slope, ids.reshape(-1, most), np.repeat((hot - marginal).reshape(-1, 1, 3), most, 1))
        slope[-1] = 0
        for k, (weights, g) in enumerate(((emit, slope / n - decay * emit), (move, (want - pairs) / n))):
            if k:
                g[O, I] = 0
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            weights += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(index, emit, move)


def crf_spans(text: str, model: Field) -> list[tuple[int, int]]:
    """The field's spans: as tagged() of all tokens, but only stretches that aren't surely outside are decoded."""
    names = TOKEN.findall(text)
    if not names:
        return []
    scores = model.tables.scores(names, file_features(text))
    unsure = model.tables.unsure(scores)
    if not len(unsure):
        return []
    out, tokens = [], None
    for stretch in np.split(unsure, np.flatnonzero(np.diff(unsure) > 1) + 1):
        start = int(stretch[0])
        tags = model.best(scores[start : start + len(stretch)].tolist())
        for m in re.finditer("BI*", tags):
            tokens = tokens or [t.span() for t in TOKEN.finditer(text)]
            out.append((tokens[start + m.start()][0], tokens[start + m.end() - 1][1]))
    return out


def tagged(tokens: list[re.Match], of_file: list[str], model: Field) -> list[tuple[int, int]]:
    """Spans from a B to the last I after it."""
    tags = model.decode(features([m[0] for m in tokens], of_file))
    return [(tokens[m.start()].start(), tokens[m.end() - 1].end()) for m in re.finditer("BI*", tags)]


def scan(text: str | None, model: Field) -> list[tuple[int, int, str]]:
    """All spans in order: the patterns', and the field's that reach beyond each of them."""
    text = text or ""
    runs = long_runs(text)
    base = base_spans(text, runs)
    more = [(a, b, "crf") for a, b in crf_spans(text, model) if not any(s <= a and b <= e for s, e, _ in base)]
    return in_order(base + more)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of the secrets in its text: start and end in code points, and kind (assign, access, hex, crf)."""
    model = field()
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(text.as_py(), model)] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, arrow)], names=["doc_id", "spans"])
        release()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)]))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each run of overlapping spans replaced by mark in text, and n_chars, if there is one, counted anew; other columns stay."""
    names, model = docs.columns, field()
    at = names.index("text")

    def clean(text: str) -> str:
        out, last = [], 0
        for a, b, _ in scan(text, model):
            if a >= last:
                out += [text[last:a], mark]
            last = max(last, b)
        return "".join([*out, text[last:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else clean(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([old if t is None else len(t) for t, old in zip(texts, batch.column(k).to_pylist(), strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [[(s["start"], s["end"], s["kind"]) for s in spans] for spans in batch.column(1).to_pylist()]
            base = [[s for s in spans if s[2] != "crf"] for spans in rows]
            counts = [pa.array([sum(s[2] == kind for s in spans) for spans in base], pa.int64()) for kind in KINDS[:3]]
            digests = pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([joined(s) for s in rows], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return find_secrets(table(spark, sf_dir, "documents")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
