"""Publisher files: compressed bytes in unknown encodings to records, with bad records rejected one by one.

Bytes become generic records (maps of normalized tags to text, and lists of children) in one Python stage on the executors, for
Spark has no reader for them; types, bounds and rejections are expressions on the maps.
"""

from __future__ import annotations

import gzip
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwell.functions import text, values

#: Limits of decompression.
MOST_IN, MOST_OUT, MOST_RATIO, MOST_ENTRIES = 2 << 30, 8 << 30, 250, 16
#: Names of the elements that are records, and of the lists within a promotion.
RECORDS = {"price": {"item", "product"}, "promotion": {"promotion", "sale"}, "store": {"store", "branch"}}
CHILDREN = {"promotionitems": ("item", "itemcode"), "promotionstores": ("store", "storeid"), "clubs": ("club", "clubid")}
#: Fields by the tags that hold them, in the order they are tried.
FIELDS = {
    "chain_id": ("chainid",), "subchain_id": ("subchainid",), "store_id": ("storeid",), "audit_number": ("bikoretno", "auditnumber"), "item_code": ("itemcode",), "item_type": ("itemtype",), "item_name": ("itemname", "itemnm"),
    "manufacturer_name": ("manufacturername", "manufacturename"), "unit_quantity": ("unitqty",), "quantity": ("quantity",), "unit_of_measure": ("unitofmeasure",), "item_price": ("itemprice",),
    "unit_of_measure_price": ("unitofmeasureprice",), "allow_discount": ("allowdiscount",), "item_status": ("itemstatus",), "update_date": ("priceupdatedate",), "update_time": ("priceupdatetime",),
    "promotion_id": ("promotionid",), "description": ("promotiondescription",), "start_date": ("promotionstartdate",), "start_time": ("promotionstarthour", "promotionstarttime"), "end_date": ("promotionenddate",),
    "end_time": ("promotionendhour", "promotionendtime"), "discounted_price": ("discountedprice",), "discount_rate": ("discountrate",), "discount_amount": ("discountamount",), "minimum_quantity": ("minqty",),
    "minimum_purchase": ("minpurchaseamount", "minpurchaseamnt"), "store_name": ("storename",), "address": ("address",), "city": ("city",), "chain_name": ("chainname",), "subchain_name": ("subchainname",),
}
SCHEMA = "source_file_id string, record_index long, context map<string,string>, record map<string,string>, items array<string>, stores array<string>, clubs array<string>, problem string"


class Refused(Exception):
    """A file that can't be read; the message is the code of its quarantine."""


def decompress(data: bytes, most_out: int = MOST_OUT) -> bytes:
    """The one member of a gzip, zip or zstandard file, or the bytes themselves; bounded in size and ratio."""
    if len(data) > MOST_IN:
        raise Refused("input_too_large")
    most = min(most_out, MOST_RATIO * max(len(data), 1))
    try:
        if data[:2] == b"\x1f\x8b":
            with gzip.open(io.BytesIO(data)) as f:
                out = f.read(most + 1)
        elif data[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                members = [m for m in z.infolist() if not m.is_dir()]
                if len(z.infolist()) > MOST_ENTRIES or len(members) != 1:
                    raise Refused("archive_members")
                with z.open(members[0]) as f:
                    out = f.read(most + 1)
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)) as f:
                out = f.read(most + 1)
        else:
            out = data
            most = most_out
    except (OSError, EOFError, zipfile.BadZipFile, ValueError) as e:
        raise Refused("damaged_archive") from e
    if len(out) > most:
        raise Refused("output_too_large")
    return out


def decode(data: bytes) -> str:
    """Text by its byte order mark, by its zero bytes, by its declaration, or by what its bytes can be."""
    if data[:4] in (b"\xff\xfe\0\0", b"\0\0\xfe\xff"):
        raise Refused("unsupported_encoding")
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            names = [name]
            break
    else:
        if data[:4] == b"<\0?\0" or data[1:2] == b"\0" and data[3:4] == b"\0":
            names = ["utf-16-le"]
        elif data[:1] == b"\0" and data[2:3] == b"\0":
            names = ["utf-16-be"]
        else:
            found = re.match(rb"""\s*<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)""", data[:200])
            names = ([found[1].decode()] if found else []) + ["utf-8", "cp1255"]
    for name in names:
        try:
            return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    raise Refused("undecodable")


def tag_of(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.rpartition("}")[2].casefold())


def records(document: str, kind: str) -> Iterator[tuple[dict, dict, dict[str, list]]]:
    """(context, record, children) of each record element; the context is what enclosing elements said so far."""
    if re.search(r"<!(DOCTYPE|ENTITY)", document, re.IGNORECASE):
        raise Refused("document_type_declaration")
    body = re.sub(r"^\s*<\?xml[^>]*\?>", "", document, count=1)
    scopes: list[dict] = [{}]
    depth = inside = 0
    try:
        for event, element in ET.iterparse(io.StringIO(body), ("start", "end")):
            tag = tag_of(element.tag)
            if event == "start":
                depth += 1
                if not inside and tag in RECORDS[kind] and depth > 1:
                    inside = depth
                elif not inside:
                    scopes.append({})
                continue
            if inside == depth:
                fields = {tag_of(c.tag): (c.text or "").strip() for c in element.iter() if c is not element and len(c) == 0}
                own = {tag_of(c.tag): (c.text or "").strip() for c in element if len(c) == 0}
                lists = {name: [_code(x, code) for x in listed if tag_of(x.tag) == child] for listed in element.iter() if (name := tag_of(listed.tag)) in CHILDREN for child, code in [CHILDREN[name]]}
                yield {k: v for scope in scopes for k, v in scope.items()}, own if lists else fields, lists
                element.clear()
                inside = 0
            elif not inside:
                scopes.pop()
                if len(element) == 0 and (element.text or "").strip():
                    scopes[-1][tag] = element.text.strip()
            depth -= 1
    except ET.ParseError as e:
        raise Refused("malformed_xml") from e


def _code(element: ET.Element, code: str) -> str | None:
    if len(element) == 0:
        return (element.text or "").strip() or None
    return next(((c.text or "").strip() or None for c in element if tag_of(c.tag) == code), None)


def parse(files: DataFrame, kind: str) -> DataFrame:
    """Generic records of files (source_file_id, content); a refused file gives one row with its problem and no record."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, content in zip(frame["source_file_id"], frame["content"], strict=True):
                rows = []
                try:
                    for i, (context, record, lists) in enumerate(records(decode(decompress(bytes(content))), kind)):
                        listed = [lists.get(name) for name in CHILDREN]
                        bad = any(x is None for part in listed for x in part or ())
                        rows.append((source, i, context, record, *listed, "malformed_relation" if bad else None))
                        if len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=COLUMNS)
                            rows = []
                except Refused as e:
                    rows.append((source, None, None, None, None, None, None, str(e)))
                yield pd.DataFrame(rows, columns=COLUMNS)

    return files.select("source_file_id", "content").mapInPandas(run, SCHEMA)


COLUMNS = [c.split()[0] for c in re.split(r", (?=\w+ )", SCHEMA)]


def field(name: str) -> Column:
    """A field's text: for each of its tags the record, then the context; empty is null."""
    tries = [F.nullif(F.trim(F.col(m)[tag]), F.lit("")) for tag in FIELDS[name] for m in ("record", "context")]
    return F.coalesce(*tries)


def prices(parsed: DataFrame) -> DataFrame:
    """Typed prices; `problem` tells why a row is no valid price."""
    price = values.decimal_of(field("item_price"))
    rows = parsed.select(
        "source_file_id", "record_index", field("chain_id").alias("chain_id"), field("subchain_id").alias("subchain_id"), field("store_id").alias("source_store_id"), text.normalized_identifier(field("item_code")).alias("source_item_code"),
        values.int_of(field("item_type")).alias("item_type"), field("item_name").alias("item_name"), field("manufacturer_name").alias("manufacturer_name"), field("unit_quantity").alias("unit_quantity"),
        values.decimal_of(field("quantity"), 6).alias("quantity"), field("unit_of_measure").alias("unit_of_measure"), price.alias("item_price"), values.decimal_of(field("unit_of_measure_price")).alias("unit_of_measure_price"),
        values.flag_of(field("allow_discount")).alias("allow_discount"), values.int_of(field("item_status")).alias("item_status"), values.instant_of_parts(field("update_date"), field("update_time")).alias("price_updated_at"),
        field("audit_number").alias("audit_number"), field("item_price").alias("_price"), "problem",
    )
    problem = F.coalesce("problem", F.when(F.col("source_item_code").isNull(), "missing_item_code").when(F.col("source_store_id").isNull(), "missing_store").when(F.col("_price").isNull(), "missing_price").when(F.col("item_price").isNull(), "invalid_price"))
    gtin = F.when(text.is_gtin(F.col("source_item_code")), F.col("source_item_code"))
    return rows.withColumn("problem", problem).withColumn("gtin", gtin).drop("_price")


def discount_kind() -> Column:
    given = lambda name: field(name).isNotNull()
    second = F.lower(F.coalesce(field("description"), F.lit(""))).contains("second item")
    named = F.when(given("discounted_price"), "fixed_price").when(given("discount_rate"), "percentage").when(given("discount_amount"), "amount").when(second, "second_item")
    single = named.when(given("minimum_purchase"), "conditional").when(given("minimum_quantity"), "quantity").otherwise("unknown")
    return F.when((F.size(F.coalesce("items", F.array())) > 1) & given("discounted_price"), "mix_and_match").otherwise(single)


def promotions(parsed: DataFrame) -> DataFrame:
    """Typed promotions with their items, stores (the file's own store among them) and clubs; a fingerprint tells versions apart."""
    stores = F.array_distinct(F.array_compact(F.concat(F.coalesce("stores", F.array().cast("array<string>")), F.array(field("store_id")))))
    rows = parsed.select(
        "source_file_id", "record_index", field("chain_id").alias("chain_id"), field("subchain_id").alias("subchain_id"), field("store_id").alias("source_scope_store_code"), field("promotion_id").alias("source_promotion_id"),
        field("description").alias("description"), discount_kind().alias("discount_kind"), values.instant_of_parts(field("start_date"), field("start_time")).alias("starts_at"), values.instant_of_parts(field("end_date"), field("end_time")).alias("ends_at"),
        values.decimal_of(field("discounted_price")).alias("discounted_price"), values.decimal_of(field("discount_rate"), 6).alias("discount_rate"), values.decimal_of(field("minimum_quantity"), 6).alias("minimum_quantity"),
        values.decimal_of(field("minimum_purchase")).alias("minimum_purchase"), F.array_distinct(F.coalesce("items", F.array().cast("array<string>"))).alias("items"), stores.alias("stores"), F.coalesce("clubs", F.array().cast("array<string>")).alias("clubs"), "problem",
    )
    problem = F.coalesce("problem", F.when(F.col("source_promotion_id").isNull(), "missing_promotion_id").when(F.size("items") == 0, "missing_items").when(F.col("ends_at") < F.col("starts_at"), "invalid_period"))
    told = [F.col(c) for c in ("description", "discount_kind", "starts_at", "ends_at", "discounted_price", "discount_rate", "minimum_quantity", "minimum_purchase")]
    return rows.withColumn("problem", problem).withColumn("fingerprint_sha256", text.fingerprint(*told, F.array_sort("items"), F.array_sort("stores"), F.array_sort("clubs")))


def stores(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("source_file_id", "record_index", *[field(c).alias(c) for c in ("chain_id", "subchain_id", "store_id", "audit_number", "chain_name", "subchain_name", "store_name", "address", "city")], "problem")
    return rows.withColumn("problem", F.coalesce("problem", F.when(F.col("store_id").isNull(), "missing_store")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their content digest as id, name, detected type and compression, and content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.sha2("content", 256).alias("source_file_id"), "path", text.document_type(F.col("path")).alias("document_type"), text.compression(F.col("path")).alias("compression"), "length", "content")
