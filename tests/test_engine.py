import gzip
import io
import random
import zipfile
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tagwell.operators import apply, history, identity
from tagwell.sources import export, html_links, publisher_files as pf
from tagwell.streaming import ingest

PRICES = """<?xml version="1.0" encoding="{0}"?><Root><ChainID>7290</ChainID><SubChainID>1</SubChainID><StoreID>42</StoreID><BikoretNo>5</BikoretNo><Items>
<Item><ItemCode>4006381333931</ItemCode><ItemType>1</ItemType><ItemName>חלב</ItemName><Quantity>1,5</Quantity><ItemPrice>19.90</ItemPrice><AllowDiscount>1</AllowDiscount><PriceUpdateDate>2026-08-11</PriceUpdateDate><PriceUpdateTime>02:01:02</PriceUpdateTime></Item>
<iTeM><ItemCode>77</ItemCode><ItemPrice>-1</ItemPrice></iTeM></Items></Root>"""
PROMOS = """<Root><ChainID>7290</ChainID><StoreID>042</StoreID><Promotions><Promotion><PromotionID>9</PromotionID><PromotionStartDate>2000-01-01</PromotionStartDate><PromotionStartHour>10:00:00</PromotionStartHour>
<PromotionEndDate>2099-12-31</PromotionEndDate><PromotionEndHour>10:00:00</PromotionEndHour><MinQty>2</MinQty><DiscountedPrice>10</DiscountedPrice><PromotionItems><Item><ItemCode>a</ItemCode></Item><Item><ItemCode>b</ItemCode></Item></PromotionItems>
<Clubs><Club><ClubID>MEMBERS</ClubID></Club></Clubs></Promotion><Promotion><PromotionID>10</PromotionID><PromotionItems><Item><Other>1</Other></Item></PromotionItems></Promotion></Promotions></Root>"""
STORES = "<Root><Chain><ChainID>7290</ChainID><SubChains><SubChain><SubChainID>3</SubChainID><Stores><Store><StoreID>1</StoreID><StoreName>A</StoreName></Store><Store><StoreID>2</StoreID></Store></Stores></SubChain></SubChains></Chain></Root>"


def zipped(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, m in enumerate(members):
            z.writestr(f"m{i}.xml", m)
    return out.getvalue()


def parsed(spark, kind, **files):
    return pf.parse(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "source_file_id string, content binary"), kind)


def test_prices_in_all_wrappings(spark):
    plain = PRICES.format("utf-8").encode()
    hebrew, wide = PRICES.format("windows-1255").encode("cp1255"), PRICES.format("utf-16").encode("utf-16")
    got = pf.prices(parsed(spark, "price", a=plain, b=gzip.compress(hebrew), c=zipped(wide), d=b"\xef\xbb\xbf" + plain)).collect()
    assert len(got) == 8
    for r in got:
        if r.record_index == 0:
            assert (r.source_item_code, r.gtin, r.item_name, r.item_price, r.quantity, r.allow_discount, r.source_store_id, r.price_updated_at, r.problem) == ("4006381333931", "4006381333931", "חלב", Decimal("19.9000"), Decimal("1.5"), True, "42", datetime(2026, 8, 10, 23, 1, 2), None)
        else:
            assert r.problem == "invalid_price" and r.gtin is None


def test_refused_files_are_told_one_by_one(spark):
    got = parsed(spark, "price", two=zipped(b"<a/>", b"<b/>"), cut=gzip.compress(b"x" * 999)[:20], bomb=gzip.compress(b"0" * 9_000_000), xml=b"<Root><Items>", dtd=b"<!DOCTYPE a><Root/>", wide=b"\xff\xfe\0\0abcd", ok=PRICES.format("utf-8").encode()).collect()
    assert {r.source_file_id: r.problem for r in got if r.record is None} == {"two": "archive_members", "cut": "damaged_archive", "bomb": "output_too_large", "xml": "malformed_xml", "dtd": "document_type_declaration", "wide": "unsupported_encoding"}
    assert sum(r.source_file_id == "ok" for r in got) == 2


def test_promotions_and_stores(spark):
    good, bad = pf.promotions(parsed(spark, "promotion", a=PROMOS.encode())).orderBy("record_index").collect()
    assert (good.discount_kind, good.items, good.stores, good.clubs, good.problem) == ("mix_and_match", ["a", "b"], ["042"], ["MEMBERS"], None) and bad.problem == "malformed_relation"
    got = pf.stores(parsed(spark, "store", a=STORES.encode())).orderBy("record_index").collect()
    assert [(r.chain_id, r.subchain_id, r.store_id, r.store_name) for r in got] == [("7290", "3", "1", "A"), ("7290", "3", "2", None)]


@pytest.mark.parametrize(("tags", "kind"), [("<DiscountedPrice>1</DiscountedPrice>", "fixed_price"), ("<DiscountRate>5</DiscountRate>", "percentage"), ("<DiscountAmount>5</DiscountAmount>", "amount"), ("<MinQty>2</MinQty>", "quantity"), ("<MinPurchaseAmount>9</MinPurchaseAmount>", "conditional"), ("<PromotionDescription>Second item free</PromotionDescription>", "second_item"), ("", "unknown")])
def test_discount_kinds(spark, tags, kind):
    doc = f"<Root><Promotions><Promotion><PromotionID>1</PromotionID>{tags}<PromotionItems><Item><ItemCode>a</ItemCode></Item></PromotionItems></Promotion></Promotions></Root>"
    assert pf.promotions(parsed(spark, "promotion", a=doc.encode())).first().discount_kind == kind


def at(day):
    return datetime(2026, 1, day)


def staged(spark, file, day, rows, scope="s", full=False, rejected=0):
    return spark.createDataFrame([(file, scope, at(day), full, rejected, store, item, price, price, sale, status) for store, item, price, sale, status in rows], ingest.INCOMING)


def test_stream_keeps_history_quarantines_bad_files_and_is_idempotent(spark, tmp_path):
    one, two = Decimal("1.0000"), Decimal("2.0000")
    files = [
        ("a", 1, [("1", "x", one, False, 1), ("1", "y", one, False, None)], True, 0), ("b", 3, [("1", "x", two, False, 1), ("1", "z", one, False, 0)], True, 0), ("late", 2, [("1", "x", Decimal("9.0000"), False, 1)], False, 0),
        ("broken", 4, [("1", "x", one, False, 1)], False, 3), ("d", 5, [("1", "x", two, None, 1), ("2", "x", one, False, 1)], False, 0),
    ]
    for part in (files[:2], files[2:]):
        for name, day, rows, full, rejected in part:
            staged(spark, name, day, rows, full=full, rejected=rejected).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state = ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "checkpoint"), files_per_trigger=10, least=1)
    got = sorted(map(tuple, state.read("price_history").select("store", "item", "valid_from", "valid_to", "price", "allow_discount").collect()), key=str)
    assert got == sorted([("1", "x", at(1), at(3), one, False), ("1", "x", at(3), at(5), two, False), ("1", "x", at(5), None, two, None), ("1", "y", at(1), None, one, False), ("1", "z", at(3), None, one, False), ("2", "x", at(5), None, one, False)], key=str)
    assert {(r.item, r.is_available, r.valid_to is None) for r in state.read("availability_history").where("store = '1'").collect()} == {("x", True, True), ("y", True, False), ("y", False, True), ("z", False, True)}
    assert sorted((r.file, r.verdict) for r in state.read("quarantine").collect()) == [("broken", "too_many_rejected_records"), ("late", "source_timestamp_regression")]
    first = state.pointers()["s"]
    state.apply(staged(spark, "z", 9, [("9", "z", one, True, 1)]), first.batch)
    assert state.pointers()["s"] == first
    state.apply(staged(spark, "t", 1, [("7", "z", one, True, 1)], scope="t").unionByName(staged(spark, "u", 9, [("1", "q", one, True, 1)], full=True)), first.batch + 1)
    assert state.pointers()["t"].version == 1 and state.pointers()["s"].version == first.version + 1 and state.pointers()["s"].source_time == at(9)
    state.apply(staged(spark, "v", 2, [("7", "other", one, True, 1)], scope="t", full=True).where("false").unionByName(staged(spark, "v", 2, [("8", "n", one, True, 1)], scope="t", full=True)), first.batch + 2)
    assert state.pointers()["t"].version == 2 and {r.item for r in state.read("prices", "t").collect()} == {"z", "n"}


def test_a_full_file_that_drops_too_much_is_refused(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    items = [("1", f"i{k}", Decimal(1), Decimal(1), False, 1) for k in range(10)]
    columns = "store string, item string, price decimal(14,4), unit_price decimal(14,4), allow_discount boolean, item_status int"
    empty = apply.Prices(*(make([], ingest.EMPTY[n]) for n in ("prices", "price_history", "availability", "availability_history")))
    state, counts = apply.apply_prices(empty, make(items, columns), F.lit(at(1)), True, least=5)
    assert tuple(counts.first()) == (10, 0, 0, 0, 20)
    with pytest.raises(apply.Refused):
        apply.apply_prices(state, make(items[:4], columns), F.lit(at(2)), True, least=1)
    with pytest.raises(apply.Refused):
        apply.apply_prices(empty, make(items[:4], columns), F.lit(at(2)), True, least=5)
    state, counts = apply.apply_prices(state, make(items[:6], columns), F.lit(at(2)), True, least=1)
    assert tuple(counts.first()) == (0, 0, 6, 4, 4) and state.prices.count() == 10 and state.availability.where("is_available").count() == 6
    bare = spark.createDataFrame([("2",)], "store string")
    _, counts = apply.apply_prices(state, make(items[:6], columns), F.lit(at(3)), True, least=1, scopes=bare)
    assert tuple(counts.first()) == (0, 0, 6, 0, 0)


def test_guards_and_order(spark):
    assert history.accepted_file(90, 10) and not history.accepted_file(89, 11) and not history.accepted_file(0, 1) and history.accepted_file(0, 0) and not history.accepted_file(5, 0, True)
    files = spark.createDataFrame([(1, "s", 5, "a"), (2, "s", 4, "b"), (3, "s", 5, "c"), (4, "s", 5, "a"), (5, "t", 1, "d")], "n int, scope string, t int, digest string")
    got = {r.n: r.verdict for r in history.regressions(files, ["scope"], ["n"], "t", "digest").collect()}
    assert got == {1: "accepted", 2: "source_timestamp_regression", 3: "source_timestamp_conflict", 4: "source_timestamp_conflict" if got[4] != "accepted" else "accepted", 5: "accepted"}


def test_identity(spark):
    evidence = spark.createDataFrame([("g1", "r1", "p1"), ("g1", "r1", "p2"), ("g2", "r1", "p1"), ("g2", "r2", "p3")], "gtin string, retailer string, portal string")
    assert {r.gtin: r.validated for r in identity.validated(evidence).collect()} == {"g1": False, "g2": True}
    schema = "id long, gtin string, name string, brand string, manufacturer string, quantity struct<value: int, unit: string>, packaging string"
    items = spark.createDataFrame([(1, "g", "dark chocolate", "B", "M", (100, "g"), "box"), (2, None, "dark chocolate bar", "B", "M", (100, "g"), "box"), (3, None, "olive oil", None, None, None, None)], schema)
    products = spark.createDataFrame([(10, "g", "something else", None, None, None, None), (11, None, "dark chocolate bar", "B", "M", (100, "g"), "box"), (12, None, "dark chocolate bar", "B", "M", (200, "g"), "box")], schema)
    got = {(r.item, r.product): (str(r.score), r.reason) for r in identity.proposals(items, products).collect()}
    assert got == {(1, 10): ("1.000", "gtin"), (1, 11): ("0.867", "structured"), (2, 11): ("0.990", "structured")}
    pending = identity.reviewed(spark.createDataFrame([], "item long, product long, score decimal(5,3), reason string, status string"), identity.proposals(items, products))
    done = identity.accept(pending, 1, 10)
    assert {(r.item, r.product): r.status for r in identity.reviewed(done, identity.proposals(items, products)).collect()} == {(1, 10): "accepted", (1, 11): "superseded", (2, 11): "pending"}


def test_export_and_archive(spark, tmp_path):
    rows = spark.createDataFrame([("r1", at(1), 5), ("r1", at(2), 6), ("r 2", at(1), 7)], "retailer string, at timestamp, price int")
    got = export.export(rows, "current_prices", str(tmp_path / "out"), "retailer").collect()
    assert sorted((r.retailer_id, r.date, r.n_rows, len(r.digests)) for r in got) == [("r 2", "2026-01-01", 1, 1), ("r1", "2026-01-01", 1, 1), ("r1", "2026-01-02", 1, 1)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    files = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary")
    first = export.archive(files.limit(2))
    kept = export.archive(files, first).collect()
    assert first.count() == 1 and len(kept) == 1 and kept[0].key.startswith("sha256/3e/23/3e23")


def test_links_skip_scripts():
    page = "<p><a href='/x.gz'>one <b>file</b></a><script>var a='<a href=\"no\">';</script><a name=n>t</a><A HREF=y>two</A>"
    assert html_links.links(page) == [("/x.gz", "one file"), ("y", "two")] and html_links.links(None) == []


def test_candidates_of_common_trigrams_against_all_pairs(spark):
    rng = random.Random(4)
    kinds = ["milk", "milky", "silk milk", "dairy milk", "low fat milk", "milk shake", "goat milk", "oat"]
    names = [" ".join([rng.choice(kinds), *([rng.choice(["one", "two", "blue", "red", f"q{i}z"])] * rng.randint(0, 1))]) for i in range(400)]
    products = [(1000 + i, n, None) for i, n in enumerate(names)] + [(5000, "milk", "g7"), (5001, None, None), (5002, "--", None)]
    items = [(1, "milk", None), (2, "goat milk", None), (3, "milk blue", "g7"), (4, "oat red q17z", None), (5, "xyzzy", None), (6, None, None), (7, "Milk", None)]
    grams = lambda name: {f"  {w} "[i : i + 3] for w in (name or "").lower().replace("-", " ").split() for i in range(len(w) + 1)}
    want = set()
    for item, name, gtin in items:
        found = []
        for product, other, code in products:
            both, either = len(grams(name) & grams(other)), len(grams(name) | grams(other))
            if (same := gtin is not None and gtin == code) or both:
                found.append((not same, -both / either, product))
        want |= {(item, product) for *_, product in sorted(found)[:3]}
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string, gtin string")
    got = {(r.item, r.product) for r in identity.candidates(frame(items), frame(products), k=3).collect()}
    assert got == want and any(item == 1 for item, _ in got)


def test_late_document_type_declaration():
    late = f"<!--{'x' * 9000}--><!DOCTYPE Root [<!ENTITY a 'b'>]><Root/>"
    with pytest.raises(pf.Refused, match="document_type_declaration"):
        list(pf.records(late, "price"))
