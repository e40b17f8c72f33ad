"""Token ids in binary files of independent zstandard frames.

A file is a run of zstandard frames, each with the ids of one document, then a skippable frame with the
document index (ids, lengths), then the seek table of zstandard's seekable format: for each frame its
compressed and uncompressed size and a checksum, the low 32 bits of the xxh64 of the uncompressed bytes. A reader
takes the two tables from the file's end and decompresses the frames of requested documents only.

Documents are dealt by range of doc_id, so file after file they ascend; files hold about SHARD_BYTES of text each. A task writes frame after frame and
keeps the tables only. Files are written under a name of their own and renamed, so a repeated task leaves the same bytes. Ids take 2 bytes where the vocabulary
allows it.

Defined results: null and empty texts hold the end id only; texts of any length are one frame; null doc_ids come first; repeated rows are
written each, equal ids by a hash of the text, and however many there are, they are dealt over several files; an empty table gives no file and no row; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from contextlib import ExitStack
from functools import lru_cache
from itertools import islice
from typing import BinaryIO

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwell.llm import files
from tagwell.llm.common import cut, release, shared_dir, sized_partitions, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
SHARD_BYTES, READ_BYTES, READ_ROWS = 1 << 26, 1 << 20, 4096
SLICE, KEPT_RUNS, KEPT_LENGTH = 128, 1_200_000, 48
#: Fixed values of zstandard's skippable frames and seekable format.
SKIPPABLE_MAGIC, INDEX_MAGIC, SEEK_FOOTER_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
INDEX_TAIL = "<QB"


class Writer:
    """Writes documents to an open file, in order, a frame each."""

    def __init__(self, out: BinaryIO, width: int, level: int = 1):
        self.out, self.dtype = out, f"<u{width}"
        self.pack = zstandard.ZstdCompressor(level=level)
        self.seek, self.ids, self.known, self.lengths = bytearray(), array("q"), array("B"), array("Q")

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        data = tokens.astype(self.dtype).tobytes()
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.seek += struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.lengths.append(len(tokens))

    def finish(self) -> None:
        index = b"".join(np.array(column, kind).tobytes() for column, kind in ((self.ids, "<i8"), (self.known, "<u1"), (self.lengths, "<u8")))
        index = self.pack.compress(index) + struct.pack(INDEX_TAIL, len(self.ids), int(self.dtype[-1]))
        table = bytes(self.seek) + struct.pack("<IBI", len(self.ids), CHECKSUM_FLAG, SEEK_FOOTER_MAGIC)
        self.out.write(b"".join([struct.pack("<II", INDEX_MAGIC, len(index)), index, struct.pack("<II", SKIPPABLE_MAGIC, len(table)), table]))


class Reader:
    """Reads documents from a file; only the frames of those that are wanted are decompressed."""

    def __init__(self, uri: str):
        fs, path = files.resolve(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_FOOTER_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        seek = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.raw_sizes, self.sums = seek[:, 0].astype(np.int64), seek[:, 1], seek[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        at = int(self.starts[-1])
        _, size = struct.unpack("<II", self._at(at, 8))
        index = self._at(at + 8, size)
        tail = struct.calcsize(INDEX_TAIL)
        count, width = struct.unpack(INDEX_TAIL, index[-tail:])
        self.unpack = zstandard.ZstdDecompressor()
        raw = self.unpack.decompress(index[:-tail], max_output_size=17 * count + 1)
        self.dtype = f"<u{width}"
        self.doc_ids, self.known = np.frombuffer(raw, "<i8", count), np.frombuffer(raw, "<u1", count, 8 * count).astype(bool)
        self.lengths = np.frombuffer(raw, "<u8", count, 9 * count).astype(np.int64)

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int, packed: bytes) -> np.ndarray:
        data = self.unpack.decompress(packed, max_output_size=int(self.raw_sizes[k]) or 1)
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, self.dtype)

    def places(self, wanted: Iterable[int]) -> np.ndarray:
        """Places in the file of the documents with these doc_ids, which ascend behind those without one."""
        first = int((~self.known).sum())
        ids = self.doc_ids[first:]
        found = [np.arange(*np.searchsorted(ids, [w, w + 1])) for w in sorted(set(wanted))]
        return first + np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of the documents with the wanted doc_ids, all by default, in order; neighbours are read from the file at once."""
        places = np.arange(len(self.lengths)) if wanted is None else self.places(wanted)
        at = 0
        while at < len(places):
            low = int(places[at])
            end = at + 1
            while end < len(places) and places[end] == places[end - 1] + 1 and self.starts[places[end] + 1] - self.starts[low] <= READ_BYTES:
                end += 1
            base = int(self.starts[low])
            held = memoryview(self._at(base, int(self.starts[places[end - 1] + 1]) - base))
            for k in places[at:end]:
                yield int(self.doc_ids[k]) if self.known[k] else None, self.frame(k, held[int(self.starts[k]) - base : int(self.starts[k + 1]) - base])
            at = end


class NotSure(Exception):
    """A cut that the text around it could move."""


class Runs(dict):
    """Ids of runs between sure boundaries (before a space that a non-space follows), as bytes; at most KEPT_RUNS of them."""

    def __init__(self, encode: Callable[[str], bytes], before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, run: str) -> bytes:
        if self.before and (not run or run[0].isspace()):
            raise NotSure
        ids = self.encode(self.before + run)
        if len(run) <= KEPT_LENGTH:
            if len(self) >= KEPT_RUNS:
                self.clear()
            self[run] = ids
        return ids


def sure_runs(text: str) -> list[str]:
    """Runs of the text; all but the first stand without the space that they begin with."""
    runs: list[list[str]] = []
    for part in text.split(" "):
        if runs and (not part or part[0].isspace()):
            runs[-1].append(part)
        else:
            runs.append([part])
    return [" ".join(run) for run in runs]


class RunEncoder:
    """Encodes texts run by run with any encoder of whole strings that cuts no pre-token differently at a sure boundary."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.first, self.rest = Runs(encode, ""), Runs(encode, " ")

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return self.first[first] + b"".join(map(self.rest.__getitem__, rest))
        except NotSure:
            first, *rest = sure_runs(text)
            return self.first[first] + b"".join(map(self.rest.__getitem__, rest))


class Encoder:
    """Ids of whole texts by the tokenizers library, which gets each run between sure boundaries once, many of them as one string."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]  # these can stand anywhere in a text
        self.size = self.library.get_vocab_size()
        self.lengths = np.zeros(self.size, np.int64)  # bytes of each token: its string has a character for each
        for token, i in self.library.get_vocab().items():
            self.lengths[i] = len(token)
        self.runs = RunEncoder(self.whole)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def whole(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def learn(self, texts: list[str]) -> None:
        """Encode the runs of these texts that aren't known yet."""
        known = self.runs.rest
        runs = set().union(*(text.split(" ")[1:] for text in texts))
        fresh = [run for run in runs if run not in known and run and not run[0].isspace() and len(run) <= KEPT_LENGTH]
        if not fresh:
            return
        if len(known) + len(fresh) > KEPT_RUNS:
            known.clear()
        ids = self.ids(" " + " ".join(fresh))
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(run.encode()) + 1 for run in fresh])) + 1
        data, start = ids.tobytes(), 0
        for run, end in zip(fresh, (4 * ends).tolist(), strict=True):
            known[run] = data[start:end]
            start = end

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [text for text in texts if not any(a in text for a in self.added)]
        self.learn(plain)
        return [self.ids(text) if any(a in text for a in self.added) else np.frombuffer(self.runs(text), "<u4") for text in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_files(docs: DataFrame, uri: str, path: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write them under uri, ascending by doc_id; returns the files: shard, uri, n_docs, n_tokens."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    if partitions is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(sized_partitions(docs.sparkSession), 1 + size // SHARD_BYTES)
    keyed = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())  # however many rows are equal, they can be dealt out
    dealt = keyed.repartitionByRange(partitions, "doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, n_tokens = TaskContext.get().partitionId(), 0
        name = f"{uri}/shard-{shard:06d}.tok.zst"
        with ExitStack() as stack:
            writer = None
            for batch in batches:
                encode = encoder(path)
                if writer is None and batch.num_rows:
                    writer = Writer(stack.enter_context(files.written_once(name)), 2 if max(encode.size, end_id + 1) <= 1 << 16 else 4)
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                        tokens = np.append(ids, np.uint32(end_id))
                        n_tokens += len(tokens)
                        writer.add(doc_id, tokens)
            if writer is not None:
                writer.finish()
        if writer is not None:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [name], "n_docs": pa.array([len(writer.ids)], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})
        release()

    return dealt.mapInArrow(run, "shard int, uri string, n_docs long, n_tokens long")


def read_token_files(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the unsigned crc32 of each document's ids, from the files; a task reads a file."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("uri", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Reader(name).documents()
                while part := list(islice(found, READ_ROWS)):
                    sizes = np.array([len(ids) for _, ids in part], np.int64)
                    sums = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in part]
                    ends = start + np.cumsum(sizes)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id for doc_id, _ in part], pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start = int(ends[-1])

    spread = placed.repartition(sized_partitions(shards.sparkSession), "uri")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = cut(write_token_files(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"))
    return read_token_files(shards)
