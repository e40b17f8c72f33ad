"""Text expressions: search normalization, similarity, identifiers, quantities and file names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Document types by the beginning of a file's stem, in the order they are tried.
DOCUMENT_TYPES = (
    ("price_full", r"(?i)^prices?full"),
    ("promotion_full", r"(?i)^promos?(?:tions?)?full"),
    ("stores", r"(?i)^stores?full"),
    ("stores", r"(?i)^stores?"),
    ("price_delta", r"(?i)^prices?"),
    ("promotion_delta", r"(?i)^promos?(?:tions?)?"),
)
#: Compression by a file's suffix.
COMPRESSIONS = ((".gz", "gzip"), (".zip", "zip"), (".zst", "zstd"))
#: Units of measure in texts, the unit they convert to, and the factor.
UNITS = (
    ("kg", "g", 1000), ("ק\"ג", "g", 1000), ("קילוגרם", "g", 1000), ("קילוגרמים", "g", 1000), ("g", "g", 1), ("גרם", "g", 1), ("גרמים", "g", 1),
    ("l", "ml", 1000), ("ליטר", "ml", 1000), ("ליטרים", "ml", 1000), ("ml", "ml", 1), ("מ\"ל", "ml", 1), ("מיליליטר", "ml", 1), ("מיליליטרים", "ml", 1),
    ("ea", "each", 1), ("each", "each", 1), ("יחידה", "each", 1), ("יחידות", "each", 1), ("m", "m", 1), ("מטר", "m", 1), ("מטרים", "m", 1),
)
GTIN_LENGTHS = (8, 12, 13, 14)


def ascii_search_text(text: Column) -> Column:
    """Lower case; runs of what is no ASCII letter or digit are one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def search_column(text: Column) -> Column:
    """The search text that is stored with a name: lower case, runs of punctuation and white space are one space, not trimmed. Compatibility forms have to be normalized before."""
    return F.lower(F.regexp_replace(text, r"[\p{Punct}\s]+", " "))


def packaging(quantity_: Column, unit: Column, package: Column) -> Column:
    """Quantity with unit and package, as far as they are known."""
    return F.concat_ws(" | ", F.when(quantity_.isNotNull(), F.concat_ws(" ", quantity_, unit)), F.when(package.isNotNull(), F.concat(F.lit("package "), package)))


def _search(text: str) -> str:
    kept = []
    for c in unicodedata.normalize("NFKC", text).casefold():
        kind = unicodedata.category(c)
        kept.append(c if kind[0] in "LN" else " " if kind[0] in "PSZ" or c in "\t\n\r" else "")
    return " ".join("".join(kept).split())


def _clean(text: str) -> str | None:
    kept = "".join(c for c in unicodedata.normalize("NFKC", text) if c in "\t\n" or unicodedata.category(c)[0] != "C")
    return " ".join(kept.split()) or None


@F.pandas_udf(StringType())
def search_text(text: pd.Series) -> pd.Series:
    """NFKC and case folding; letters and numbers stay, punctuation, symbols and separators are spaces, marks go. Not in Spark's own functions."""
    return text.map(lambda t: None if t is None else _search(t))


@F.pandas_udf(StringType())
def clean_text(text: pd.Series) -> pd.Series:
    """NFKC without control characters, white space collapsed, empty as null."""
    return text.map(lambda t: None if t is None else _clean(t))


def trigrams(text: Column) -> Column:
    """The set of trigrams of each word, two spaces before it and one behind."""
    words = F.filter(F.split(ascii_search_text(text), " "), lambda w: w != "")
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared elements to all elements of two sets; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_search_text(text), " "), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    return set_similarity(tokens(a), tokens(b))


def check_sum(digits: Column) -> Column:
    """Sum of the digits, from the right weighted 1, 3, 1, 3 and so on."""
    places = F.sequence(F.lit(1), F.length(digits))
    weight = lambda i: F.when((F.length(digits) - i) % 2 == 0, F.lit(1)).otherwise(F.lit(3))
    return F.aggregate(F.transform(places, lambda i: F.substring(digits, i, F.lit(1)).cast("int") * weight(i)), F.lit(0), lambda a, x: a + x)


def is_gtin(code: Column) -> Column:
    shape = code.rlike("^[0-9]+$") & F.length(code).isin(*GTIN_LENGTHS)
    return F.when(shape, check_sum(code) % 10 == 0).otherwise(F.lit(False))


def check_digit(body: Column) -> Column:
    """The digit that makes body a GTIN."""
    return ((10 - check_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")


def identifier_kind(code: Column) -> Column:
    return F.when(is_gtin(code), F.lit("gtin")).otherwise(F.lit("retailer_item"))


def normalized_identifier(code: Column) -> Column:
    """Without white space; null beyond 1 to 128 characters."""
    bare = F.regexp_replace(code, r"\s+", "")
    return F.when(F.length(bare).between(1, 128), bare)


def quantity(text: Column) -> Column:
    """struct(value decimal, unit) of the first number with a unit, in base units; null without one."""
    names = "|".join(sorted({u for u, _, _ in UNITS}, key=lambda u: (-len(u), u)))
    pattern = rf"(?i)(?<![0-9])([0-9]+(?:[.,][0-9]+)?)\s*({names})(?![\p{{L}}\p{{N}}])"
    number = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", ".").try_cast("decimal(18,6)")
    found = F.lower(F.regexp_extract(text, pattern, 2))
    unit = factor = None
    for name, base, times in UNITS:
        unit = (F.when if unit is None else unit.when)(found == name, F.lit(base))
        factor = (F.when if factor is None else factor.when)(found == name, F.lit(times))
    value = (number * factor).cast("decimal(18,6)")
    return F.when(unit.isNotNull(), F.struct(value.alias("value"), unit.alias("unit")))


def without_quantity(text: Column) -> Column:
    """Text without its first quantity."""
    names = "|".join(sorted({u for u, _, _ in UNITS}, key=lambda u: (-len(u), u)))
    return F.trim(F.regexp_replace(text, rf"(?is)^(.*?)(?<![0-9])[0-9]+(?:[.,][0-9]+)?\s*(?:{names})(?![\p{{L}}\p{{N}}])", "$1"))


def stem(path: Column) -> Column:
    """File name without folders and known suffixes."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?i)(\.(gz|zip|zst|xml))+$", "")


def document_type(path: Column) -> Column:
    out = None
    for kind, pattern in DOCUMENT_TYPES:
        out = (F.when if out is None else out.when)(stem(path).rlike(pattern), F.lit(kind))
    return out


def compression(path: Column) -> Column:
    out = None
    for suffix, kind in COMPRESSIONS:
        out = (F.when if out is None else out.when)(F.lower(path).endswith(suffix), F.lit(kind))
    return out.otherwise(F.lit("none"))


def file_timestamp(path: Column) -> Column:
    """The last time stamp (yyyyMMdd, HHmm or HHmmss behind it) in a file name, as text; null without one."""
    found = F.regexp_extract_all(path, F.lit(r"(?<![0-9])(20[0-9]{6}(?:[-_T]?[0-9]{4}(?:[0-9]{2})?)?)(?![0-9])"), F.lit(1))
    return F.when(F.size(found) > 0, F.regexp_replace(F.element_at(found, -1), "[-_T]", ""))


def remote_id(url: Column) -> Column:
    """Host and path of a URL, without query and fragment."""
    return F.concat(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))


def fingerprint(*columns: Column) -> Column:
    """Digest of the columns' JSON in the given order; nulls count."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)
