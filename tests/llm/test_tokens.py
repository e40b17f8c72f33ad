import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tagwell.llm import bpe, files, token_files

LONG = ("Ein Wort, zwei  Wörter\n and it's 12 more\t" * 400) + "x" * 3000 + "    \n  y " * 50
TEXTS = [None, "", " ", "a", "  two  spaces ", "it's <|endoftext|> here", "né à  \n\n  ça", LONG, LONG, "日本語 text 🙂" * 30, "  em  space"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i, t, "x") for i, t in enumerate(TEXTS)] + [(7, LONG, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def library():
    path = public_tokenizers.path(bpe.RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})


def key(x):
    return (x[0] is None, x[0] or 0, x[1])


@pytest.mark.parametrize(("chunk", "overlap"), [(65_536, 256), (64, 16), (500, 40), (7, 3)])
def test_byte_bpe_is_the_librarys(docs, chunk, overlap):
    own = library()
    want = sorted(((r.doc_id, np.array(own.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect()), key=key)
    got = bpe.decode_documents(bpe.encode_documents(docs, part=chunk, overlap=overlap)).collect()
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got), key=key) == want


def test_byte_bpe_digests(docs):
    own = library()
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encode_documents(docs)).collect()}
    assert rows == {tuple(r) for r in bpe.encode_documents(docs, digested=True).collect()} == {tuple(r) for r in bpe.encode_documents(docs, part=500, overlap=40, digested=True).collect()}
    assert rows == {(r.doc_id, len(i := own.encode_ordinary(r.text or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()}


def test_byte_bpe_of_an_empty_table(docs):
    assert bpe.digests(bpe.encode_documents(docs.where("false"))).collect() == []


def test_token_files_round_trip(docs, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    shards = token_files.write_token_files(docs, f"file://{tmp_path}/out", partitions=3).cache()
    got = sorted(token_files.read_token_files(shards).collect(), key=lambda r: r.start)
    start = 0
    assert len(got) == len(rows)
    for r, g in zip(rows, got, strict=True):
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_of_an_empty_table(docs, tmp_path):
    shards = token_files.write_token_files(docs.where("false"), f"file://{tmp_path}/none", partitions=2).cache()
    assert token_files.read_token_files(shards).collect() == []


def test_reader_decompresses_only_what_is_asked_for_and_finds_damage(tmp_path):
    with files.written_once(f"file://{tmp_path}/f") as out:
        writer = token_files.Writer(out, 2)
        texts = [np.arange(n, dtype=np.uint32) for n in (7, 0, 10, 80, 3, 200, 1)]
        for i, ids in zip([None, *range(0, 12, 2)], texts):
            writer.add(i, ids)
        writer.finish()
    reader = token_files.Reader(f"file://{tmp_path}/f")
    assert [(i, x.tolist()) for i, x in reader.documents()] == [(i, x.tolist()) for i, x in zip([None, *range(0, 12, 2)], texts)]
    asked = []
    frame = reader.frame
    reader.frame = lambda k, packed: (asked.append(k), frame(k, packed))[1]
    assert [(i, x.tolist()) for i, x in reader.documents([8, 3, 2])] == [(2, texts[2].tolist()), (8, texts[5].tolist())] and asked == [2, 5]
    assert list(reader.documents([])) == []
    damaged = bytearray((tmp_path / "f").read_bytes())
    damaged[12] ^= 255
    (tmp_path / "g").write_bytes(damaged)
    with pytest.raises(Exception):
        list(token_files.Reader(f"file://{tmp_path}/g").documents())


def test_token_files_of_many_equal_rows_and_clashing_columns(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    rows = [(None, "same text", 1, 2, "x", "y")] * 300 + [(5, "a", 1, 2, "x", "y"), (None, "word " * 60_000, 3, 4, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, n_tokens long, shard string, place string").repartition(4)
    shards = token_files.write_token_files(docs, f"file://{tmp_path}/many", partitions=6).cache()
    assert shards.count() >= 3
    got = sorted(token_files.read_token_files(shards).collect(), key=lambda r: r.start)
    n = {text: len(t.encode(text, add_special_tokens=False).ids) + 1 for text in {r[1] for r in rows}}
    assert [r.doc_id for r in got] == [None] * 301 + [5] and sorted(r.n_tokens for r in got) == sorted(n[r[1]] for r in rows)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


def test_chunks_are_stitched_where_boundaries_agree():
    own, path = library(), public_tokenizers.path(bpe.RANKS)
    rng = np.random.default_rng(2)
    parts = ["a", "b'", "'re", "'r", " ", "  ", "\n", "\t", "12", "345", "!", "?!", "é", "日", "\u2003", "x" * 30, "don't", "\r\n"]
    texts = ["".join(rng.choice(parts, n)) for n in (5, 60, 400, 3000)] + ["x" * 5000, "1" * 5000, " " * 5000 + "a", "'" * 999 + "re", "\n " * 900, "ab " * 2000]
    for text in texts:
        whole = bpe.pattern().findall(text)
        for size, overlap in ((1, 1), (3, 2), (17, 5), (100, 3), (1000, 64)):
            assert bpe.pre_tokens(text, size, overlap) == whole
        assert bpe.encode(text, path) == np.array(own.encode_ordinary(text), "<u4").tobytes()
    first, second = bpe.Chunk(texts[2], 0, 230), bpe.Chunk(texts[2], 200, 400)
    cut = bpe.common(first.boundaries(200, 230), second.boundaries(200, 230))
    assert 200 <= cut <= 230 and first.between(0, cut) + second.between(cut, 400) == bpe.Chunk(texts[2], 0, 400).between(0, 400)


def test_white_space_of_both_libraries():
    space = bpe.regex.compile(r"\s")
    assert all(chr(c).isspace() for c in range(0x110000) if space.match(chr(c)))


def test_a_million_characters_without_a_space(spark):
    own = library()
    texts = ["x" * 1_000_000, "7" * 300_001, ("ab cd " * 40_000) + "y" * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, texts[0])], "doc_id long, text string")
    got = {r.doc_id: bytes(r.ids) for r in bpe.encode_documents(docs).collect()}
    want = [np.array(own.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert got == {0: want[0], 1: want[1], 2: want[2], 9: want[0]}
