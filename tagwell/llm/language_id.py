"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, each
permuted by its place; a document's vector bundles (adds) the vectors of its trigrams. A language's
prototype bundles its documents, each at the same length; a document takes the language whose prototype has the highest
cosine. Letters of a to z have a symbol each; other Latin letters share a few, and so do letters of other scripts.

Prototypes learn from a bounded sample of labelled documents: about `sample` for each language, taken by a
hash of doc_id. Sums are of integers, so reruns agree.

Defined results: a null text, or one without letters, is `und` with score 0, and so is every text when nothing can be
learned; texts of any length are judged whole; a null doc_id isn't held out and isn't learned from; ties go to the smaller language value;
repeated rows are judged each; an empty table gives no row; columns besides doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwell.llm.common import release, table

SYMBOLS, DIMENSION, SEED = 32, 512, 8
CODES = SYMBOLS**3
SAMPLE = 600
UNDETERMINED = "und"
SCALE = 1_000_000
LEAST_LIKENESS, ENOUGH = 0.2, 100


def symbol(point: int) -> int:
    """0 for what is no letter."""
    char = chr(point)
    if not char.isalpha():
        return 0
    low = ord(char.lower()[0])
    if 97 <= low <= 122:
        return low - 96
    mixed = (low * 2654435761 >> 12) & 0xFFFF
    return 27 + mixed % 5 if low < 0x250 else 1 + mixed % 31


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    return np.fromiter(map(symbol, range(0x110000)), np.uint8, 0x110000)


@lru_cache(maxsize=1)
def trigram_vectors() -> np.ndarray:
    """The vector of each trigram code, as rows."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSION))
    first, second = np.roll(letters, 2, 1), np.roll(letters, 1, 1)
    return (first[:, None, None] * second[None, :, None] * letters[None, None, :]).reshape(CODES, DIMENSION)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the trigrams around each letter; beyond the text's ends stands what is no letter."""
    s = symbols()[np.frombuffer(f"\0{text}\0".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    codes = ((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])[s[1:-1] > 0]
    if len(codes) < 4096:
        return np.unique(codes, return_counts=True)
    counts = np.bincount(codes, minlength=CODES)
    found = np.flatnonzero(counts)
    return found, counts[found]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes of length 1, from labelled (doc_id, text, lang)."""
    labelled = labelled.where(labelled["lang"].isNotNull()).select(labelled["doc_id"].cast("long").alias("doc_id"), labelled["lang"].cast("string").alias("lang"), labelled["text"].cast("string").alias("text"))
    counts = labelled.groupBy("lang").count()
    share = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    chosen = labelled.join(F.broadcast(counts), "lang").where(share * F.col("count") < sample).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, n = trigrams(text or "")
                if len(codes):
                    if lang not in sums:
                        sums[lang] = np.zeros(CODES, np.int64)
                    sums[lang][codes] += np.rint(n * (SCALE / np.linalg.norm(n))).astype(np.int64)
        for lang, total in sums.items():
            codes = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int32)), pa.array(total[codes])], names=["lang", "code", "weight"])

    rows = chosen.mapInArrow(run, "lang string, code int, weight long").groupBy("lang", "code").agg(F.sum("weight").alias("weight"))
    profile: dict[str, np.ndarray] = {}
    for r in rows.toLocalIterator():  # at most CODES rows for a language
        profile.setdefault(r.lang, np.zeros(CODES))[r.code] = r.weight / SCALE
    langs = sorted(profile)
    prototypes = np.array([bundle(np.flatnonzero(profile[x]), profile[x][profile[x] != 0]) for x in langs]).reshape(len(langs), DIMENSION)
    return langs, (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def bundle(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the vectors of trigrams, some at a time."""
    out = np.zeros(DIMENSION, np.float32)
    for at in range(0, len(codes), 2048):
        out += weights[at : at + 2048].astype(np.float32) @ trigram_vectors()[codes[at : at + 2048]].astype(np.float32)
    return out


def weighed(text: str | None, langs: list[str], prototypes: np.ndarray) -> tuple[str, float, int]:
    """The language, its likeness, and the number of different trigrams that speak for it."""
    codes, n = trigrams(text or "")
    if not len(codes) or not langs:
        return UNDETERMINED, 0.0, len(codes)
    vector = bundle(codes, n)
    cosines = prototypes @ vector / max(float(np.linalg.norm(vector)), 1e-9)
    best = int(np.argmax(cosines))
    return langs[best], min(1.0, max(0.0, float(cosines[best]))), len(codes)


def judge(text: str | None, langs: list[str], prototypes: np.ndarray) -> tuple[str, float]:
    return weighed(text, langs, prototypes)[:2]


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) and lang_pred and lang_score, which replace columns of these names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "lang_score", "_text")]
    rows = docs.select(*(docs[c] for c in keep), docs["text"].cast("string").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(text.as_py(), langs, prototypes) for text in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def with_known_language(docs: DataFrame, langs: list[str], prototypes: np.ndarray, least: float = LEAST_LIKENESS, enough: int = ENOUGH) -> DataFrame:
    """The rows of docs whose text is as like to some language as `least`, at least, or a part of that as long as it has fewer than `enough` different trigrams; texts without a letter go.

    The defaults come from held-out labelled documents: random letters and languages that weren't learned stay below 0.2 (99 % of them), as the noise of 512 dimensions is 0.04 for each
    language; of labelled documents with 100 different trigrams or more, none does. With fewer trigrams clean texts lie lower, so less is asked of them.
    """
    at = docs.columns.index("text")

    def known(text: str | None) -> bool:
        lang, score, n = weighed(text, langs, prototypes)
        return lang != UNDETERMINED and score >= least * min(1.0, n / enough)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                yield batch.filter(pa.array([known(text.as_py()) for text in batch.column(at)], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_part(docs: DataFrame) -> DataFrame:
    """Documents that a model may learn from."""
    return docs.where(docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"]))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, prototypes = fit(labelled_part(docs))
    out = identify(docs, langs, prototypes, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
