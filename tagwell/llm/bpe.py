"""Byte-level BPE by overlapping chunk encoding.

A text is cut into chunks that overlap, and each chunk is pre-tokenised by itself. A chunk's pre-tokens may be wrong at both ends: at its start, because
it may begin inside one, and at its end, because what follows could change them. But pre-tokens follow from their start on. So two
neighbouring chunks resynchronise at the first boundary that both have in their overlap, as far as the left one's text decides it: from there on the right chunk's are
those of the text. Chunks are stitched there. Where the overlap has no such boundary, it is doubled until there is one or the text ends. The pieces' pre-tokens are encoded
each by itself, and the ids join up in order. Decoding concatenates the raw bytes of the ids.

Texts of more than PART code points are dealt out over all tasks in parts that overlap, by the same rule: tasks give the boundaries near both ends of their part, the
common ones are found for each text, and tasks encode what lies between. A text with an overlap without common boundary is stitched in one task.

Ids of pre-tokens are kept in a table of bounded size.

Defined results: null and empty texts have no ids; texts of any length are encoded whole; repeated rows are encoded each; documents may have
any id, null too; an empty table gives no row; columns besides the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwell.llm.common import release, table

CHUNK, OVERLAP = 8192, 64
PART, PART_OVERLAP = 65_536, 256
KEPT, KEPT_LENGTH = 120_000, 48
SEEN_AHEAD = 3  # characters that a pre-token of the pattern's first alternatives needs
RANKS = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=1)
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


class Chunk:
    """The pre-tokens of text[start:end] by itself, their first places in the text, and how many of these the text beyond its end can't move (sure)."""

    def __init__(self, text: str, start: int, end: int, offset: int = 0, ends_text: bool | None = None):
        part = text[start:end]
        self.start, self.end = start + offset, end + offset
        self.tokens = pattern().findall(part)
        ends = np.cumsum(np.fromiter(map(len, self.tokens), np.int64, len(self.tokens)))
        first = ends - np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        if ends_text if ends_text is not None else end >= len(text):
            sure = len(first)
        else:
            n = len(part)
            moved = (ends >= n) | (first + SEEN_AHEAD > n) | (ends > len(part.rstrip()))  # isspace() and \s agree
            sure = int(np.argmax(moved)) + 1 if moved.any() else len(first)
        self.first, self.sure = first + self.start, sure

    def boundaries(self, low: int, high: int) -> np.ndarray:
        """Those from low to high that are sure if one before them is a boundary of the text."""
        found = self.first[: self.sure]
        return found[(found >= low) & (found <= high)]

    def between(self, low: int, high: int) -> list[str]:
        a, b = np.searchsorted(self.first, [low, high])
        return self.tokens[a:b]


def common(left: np.ndarray, right: np.ndarray) -> int | None:
    both = np.intersect1d(left, right, assume_unique=True)
    return int(both[0]) if len(both) else None


def pre_tokens(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The text's pre-tokens, from its chunks."""
    n = len(text)
    chunks = [Chunk(text, at, min(n, at + size + overlap)) for at in range(0, max(1, n), size)]
    if len(chunks) == 1:
        return chunks[0].tokens
    out: list[str] = []
    left, at, k, grown = chunks[0], 0, 1, overlap
    while k < len(chunks):
        right = chunks[k]
        cut = common(left.boundaries(max(at, right.start), left.end), right.boundaries(max(at, right.start), left.end))
        if cut is not None:
            out += left.between(at, cut)
            left, at, k, grown = right, cut, k + 1, overlap
        elif left.end >= right.end:
            k += 1
        else:
            grown *= 2
            left = Chunk(text, at, min(n, left.end + grown))
    return out + left.between(at, n)


class Pieces(dict):
    """Ids of pre-tokens, as bytes; at most KEPT of them."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, token: str) -> bytes:
        ids = array("I", self.encode(token.encode())).tobytes()
        if len(token) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[token] = ids
        return ids


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return Pieces(own._encode_single_piece)


def encode_tokens(tokens: list[str], path: str) -> bytes:
    return b"".join(map(pieces(path).__getitem__, tokens))


def encode(text: str, path: str) -> bytes:
    return encode_tokens(pre_tokens(text), path)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    found = ranks(path)
    out = [b""] * (max(found.values()) + 1)
    for token, i in found.items():
        out[i] = token
    return out


def decode(ids: bytes, path: str) -> bytes:
    return b"".join(map(token_bytes(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _map(df: DataFrame, schema: str, run: Callable[[list], list[list]], rows: int = 512) -> DataFrame:
    """run gets the columns of a slice as lists and returns the new columns, which follow the first."""
    kinds = T._parse_datatype_string(schema)
    arrow = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
    target = [arrow[f.dataType.simpleString()] for f in kinds.fields]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                columns = run([c.to_pylist() for c in part.columns[1:]])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, target[1:], strict=True))], names=kinds.names)
        release()

    return df.mapInArrow(go, kinds)


def stitched(heads: list[list[int]], tails: list[list[int]]) -> list[int] | None:
    """Where parts of a text are stitched, from the boundaries near their starts and ends; None if one pair has none in common."""
    cuts = [common(np.array(tail, np.int64), np.array(head, np.int64)) for tail, head in zip(tails, heads[1:])]
    return None if None in cuts else cuts


def encode_parts(texts: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """key and ids of texts (key, text), each key once, dealt out in parts."""
    dealt = (
        texts.select("key", "text", F.length("text").alias("n"), ((F.length("text") - 1) / size).cast("int").alias("last"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("key", "k", "last", "n", F.expr(f"substring(text, k * {size} + 1, {size + overlap})").alias("part"))
        .repartition("key", "k")
    )

    def chunk(k: int, last: int, part: str) -> Chunk:
        return Chunk(part, 0, len(part), k * size, k == last)

    def ends(columns: list) -> list[list]:
        ks, lasts, parts = columns
        found = [chunk(k, last, part) for k, last, part in zip(ks, lasts, parts, strict=True)]
        return [ks, [c.boundaries(c.start, c.start + overlap).tolist() for c in found], [c.boundaries(c.start + size, c.end).tolist() for c in found]]

    near = _map(dealt.select("key", "k", "last", "part"), "key string, k int, heads array<long>, tails array<long>", ends, 16)
    listed = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "heads", "tails"))).alias("parts"))
    listed = listed.select("key", F.col("parts.heads").alias("heads"), F.col("parts.tails").alias("tails"))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stitched(heads, tails) for heads, tails in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["of", "cuts"])

    cuts = listed.mapInArrow(stitch, "of string, cuts array<long>")
    own = dealt.join(cuts, F.col("key") == F.col("of")).where("cuts IS NOT NULL")
    own = own.select("key", "k", "last", "part", F.expr("CASE WHEN k = 0 THEN 0 ELSE element_at(cuts, k) END").cast("long").alias("low"), F.expr("CASE WHEN k = last THEN n ELSE element_at(cuts, k + 1) END").cast("long").alias("high"))

    def inner(columns: list) -> list[list]:
        return [columns[0], [encode_tokens(chunk(k, last, part).between(low, high), path) for k, last, part, low, high in zip(*columns, strict=True)]]

    encoded = _map(own, "key string, k int, ids binary", inner, 16)
    joined = encoded.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts")).select("key", F.expr("aggregate(parts, X'', (a, p) -> a || p.ids)").alias("ids"))
    unsure = texts.join(cuts.where("cuts IS NULL"), F.col("key") == F.col("of"), "left_semi").select("key", "text")
    return joined.unionByName(_map(unsure, "key string, ids binary", lambda c: [[encode(text, path) for text in c[0]]], 1))


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_columns(found: list[bytes], path: str) -> list[list]:
    return [[len(x) // 4 for x in found], [hashlib.sha256(x).hexdigest() for x in found], [hashlib.sha256(decode(x, path)).hexdigest() for x in found]]


def encode_documents(docs: DataFrame, path: str | None = None, part: int = PART, overlap: int = PART_OVERLAP, digested: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers as binary), or the DIGESTS of these, one row per row of docs. Texts of at most `part` code points are stitched where they are read."""
    path = path or public_tokenizers.path(RANKS)
    schema = f"doc_id long, {DIGESTS if digested else 'ids binary'}"
    finish = (lambda found: digest_columns(found, path)) if digested else (lambda found: [found])
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    short = _map(docs.where(F.length("text") <= part), schema, lambda columns: finish([encode(text, path) for text in columns[0]]))
    long = docs.where(F.length("text") > part).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    done = encode_parts(long.groupBy("key").agg(F.max("text").alias("text")), path, part, overlap)
    rows = long.select("doc_id", "key").join(done, "key").select("doc_id", "ids")
    return short.unionByName(_map(rows, schema, lambda columns: finish(columns[0]), 16) if digested else rows)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the raw bytes that they stand for."""
    path = path or public_tokenizers.path(RANKS)
    return _map(encoded.select("doc_id", "ids"), "doc_id long, ids binary, decoded binary", lambda c: [c[0], [decode(ids, path) for ids in c[0]]])


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Number and digest of each document's ids, and the digest of what they decode to."""
    path = path or public_tokenizers.path(RANKS)
    return _map(encoded.select("doc_id", "ids"), f"doc_id long, {DIGESTS}", lambda columns: digest_columns(columns[0], path))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digested=True)
