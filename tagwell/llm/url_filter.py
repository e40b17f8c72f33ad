"""URL filter on a sorted digest array.

Rules become 64-bit xxhash keys in one sorted array, in a file that tasks memory-map. A URL is probed
with each (host suffix, path prefix) it could match, by vectorised binary search; a hit counts only
when the stored full string is the same, so colliding keys can't decide.

Defined results: a null URL, or one without "://", has empty host and path and the default verdict; an
empty rule list gives every URL the default verdict; repeated rows are judged each; columns besides the
id and the URL are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tagwell.llm import files
from tagwell.llm.common import shared_dir, table

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
URL = re.compile(r"[^/?#]*")
PATH = re.compile(r"[^?#]*")
SEPARATOR = "\n"

#: The rules that the registered query applies, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("host", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("verdict", T.StringType()),
])


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without "://"."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    host = URL.match(url, at + 3)
    path = PATH.match(url, host.end())
    return host.group().translate(LOWER), path.group()


def digest(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest((host + SEPARATOR + path).encode())


def build(rules, uri: str) -> None:
    """Write the sorted keys, verdicts, string offsets and strings as one file."""
    rows = sorted((digest(h, p), h + SEPARATOR + p, v) for v, h, p in rules)
    strings = [s.encode() for _, s, _ in rows]
    names = sorted({v for _, _, v in rows})
    lengths = sorted({len(p) for _, _, p in rules})
    head = np.array([len(rows), len(lengths)], "<u8").tobytes()
    body = np.array([k for k, _, _ in rows], "<u8").tobytes()
    body += np.cumsum([0, *map(len, strings)]).astype("<u8").tobytes()
    body += np.array([names.index(v) for _, _, v in rows], "<u8").tobytes()
    body += np.array(lengths, "<u8").tobytes()
    tail = "\t".join(names).encode()
    files.write_once(uri, head + body + np.array([len(tail)], "<u8").tobytes() + tail + b"".join(strings))


class DigestArray:
    """The file, memory-mapped where it is local."""

    def __init__(self, uri: str):
        path = files.local_path(uri)
        self.raw = np.memmap(path, dtype=np.uint8, mode="r") if path else np.frombuffer(files.read(uri), np.uint8)
        n, m = (int(x) for x in self.raw[:16].view("<u8"))
        at = 16

        def words(count: int) -> np.ndarray:
            nonlocal at
            part = self.raw[at : at + 8 * count].view("<u8")
            at += 8 * count
            return part

        self.keys, self.offsets, self.verdicts, self.lengths = words(n), words(n + 1), words(n), [int(x) for x in words(m)]
        size = int(words(1)[0])
        self.names = bytes(self.raw[at : at + size]).decode().split("\t")
        self.base = at + size

    def string(self, i: int) -> bytes:
        return bytes(self.raw[self.base + int(self.offsets[i]) : self.base + int(self.offsets[i + 1])])

    def probe(self, strings: list[bytes]) -> np.ndarray:
        """Row of each string, or -1."""
        out = np.full(len(strings), -1, np.int64)
        if not len(self.keys) or not strings:
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        first, end = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(first < end):
            out[i] = next((j for j in range(first[i], end[i]) if self.string(j) == strings[i]), -1)
        return out


@lru_cache(maxsize=4)
def opened(uri: str) -> DigestArray:
    return DigestArray(uri)


def judge(array: DigestArray, urls: list[str | None], default: str) -> tuple[list, list, list, list]:
    hosts, paths, owner, probes = [], [], [], []
    for k, url in enumerate(urls):
        host, path = split_url(url)
        hosts.append(host)
        paths.append(path)
        labels = host.split(".")
        for i in range(len(labels)):
            suffix = ".".join(labels[i:])
            for n in array.lengths:
                if n <= len(path):
                    owner.append(k)
                    probes.append((suffix + SEPARATOR + path[:n]).encode())
    rules, verdicts, best = [None] * len(urls), [default] * len(urls), [(-1, -1)] * len(urls)
    hits = array.probe(probes)
    for i in np.flatnonzero(hits >= 0):
        k = owner[i]
        host, path = probes[i].decode().split(SEPARATOR, 1)
        rank = (len(host) + len(path), len(host))
        if rank > best[k]:
            best[k], rules[k], verdicts[k] = rank, host + path, array.names[int(array.verdicts[hits[i]])]
    return hosts, paths, rules, verdicts


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule and verdict. The longest rule that fits wins; the longer host decides between rules of one length. A URL that no rule fits gets `default`."""
    spark = pages.sparkSession
    name = hashlib.sha256(repr(rules).encode()).hexdigest()[:16]
    uri = f"{shared_dir(spark)}/url-rules-{name}.bin"
    build(rules, uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = opened(uri)
        for batch in batches:
            hosts, paths, found, verdicts = judge(array, batch.column(1).to_pylist(), default)
            text = [pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *text], names=SCHEMA.names)

    return pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].cast("string").alias("url")).mapInArrow(run, SCHEMA)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE = """
WITH r(verdict, h, p) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'),
     ('allow','com','/fr/'), ('block','com','/de/')),
cutoff AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cutoff),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, row_number() OVER () AS rid FROM hosts),
best AS (SELECT rid, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(verdict, length(h || p) * 1000 + length(h)) AS verdict
     FROM parts JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(best.verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (rid)
"""
