import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tagwell.operators import promotions as pr
from tagwell.plans import api
from tagwell.sources import listings


def day(n):
    return datetime(2026, 1, n)


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "retailers": make([("r1", "Shop"), ("r2", "Mart")], "id string, name string"), "portals": make([("p1", "r1"), ("p2", "r2")], "id string, retailer string"),
        "stores": make([("s1", "r1", "p1", "Main Street", "Haifa", "main street"), ("s2", "r2", "p2", "Harbour", "Tel-Aviv", "harbour"), ("s3", "r1", "p1", "Main Square", "Haifa", "main square")], "id string, retailer string, portal string, name string, city string, search_name string"),
        "products": make([("a", "Dark chocolate", "B", "dark chocolate", "active"), ("b", "Dark chocolate bar", "B", "dark chocolate bar", "active"), ("c", "Milk", None, "milk", "active"), ("d", "Dark chocolate", None, "dark chocolate", "retired")], "id string, name string, brand string, search_name string, status string"),
        "identifiers": make([("a", "gtin", "1", True), ("b", "gtin", "1", False), ("c", "gtin", "77", False)], "product string, kind string, value string, validated boolean"),
        "matches": make([("i1", "c")], "item string, product string"), "items": make([("i1", "r1", "77", None, "fresh milk")], "id string, retailer string, code string, gtin string, search_name string"),
        "prices": make([(f"q{i}", "a", f"s{i % 3 + 1}", Decimal(9 - i % 3), day(1)) for i in range(6)], "id string, product string, store string, price decimal(14,4), observed_at timestamp"),
        "history": make([("h1", "a", "s1", Decimal(1), day(1), day(5)), ("h2", "a", "s1", Decimal(2), day(5), None), ("h3", "a", "s2", Decimal(3), day(2), None)], "id string, product string, store string, price decimal(14,4), valid_from timestamp, valid_to timestamp"),
        "availability": make([("v1", "a", "s1", True, day(3)), ("v2", "b", "s1", True, day(4)), ("v3", "a", "s2", False, day(1))], "id string, product string, store string, is_available boolean, observed_at timestamp"),
        "files": make([("f1", "p1", "completed", day(1), day(2)), ("f2", "p1", "quarantined", day(3), None), ("f3", "p1", "parsing", day(1), None), ("f4", "p1", "failed_retryable", day(2), None)], "id string, portal string, status string, downloaded_at timestamp, finished_at timestamp"),
        "issues": make([("x1", "f2", 4, "bad"), ("x2", "f2", 1, "bad")], "id string, file string, record_index long, code string"),
    }


def ids(rows, column="id"):
    return [r[column] for r in rows.collect()]


def test_pages_and_searches(tables):
    assert ids(api.retailers(tables)) == ["r1", "r2"] and ids(api.retailers(tables, ["r1"])) == ["r2"]
    assert ids(api.stores(tables, name="main")) == ["s1", "s3"] and ids(api.stores(tables, city="tel aviv")) == ["s2"] and ids(api.stores(tables, retailer="r1", cursor=["s1"])) == ["s3"]
    assert ids(api.search_products(tables, "Dark Chocolate")) == ["a", "b"] and ids(api.search_products(tables, "milk")) == ["c"]
    assert [(r.id, r["rank"]) for r in api.search_products(tables, "1").collect()] == [("a", 100.0), ("b", 90.0)] and [(r.id, r["rank"]) for r in api.search_products(tables, "77").collect()] == [("c", 90.0)]
    assert [(r.id, r["rank"]) for r in api.search_products(tables, "fresh milk").collect()] == [("c", 11.0)]
    with pytest.raises(ValueError):
        api.search_products(tables, "dark", most=1)
    near, after = api.store_window(tables, "main", scanned=2)
    assert ids(near) == ["s1"] and after == ["s2"] and api.store_window(tables, "main", after, scanned=2)[1] is None
    first = api.search_products(tables, "dark chocolate", size=1).collect()
    assert len(first) == 2 and ids(api.search_products(tables, "dark chocolate", [first[0]["rank"], first[0].id])) == ["b"]
    assert [(r.id, r.validated) for r in api.by_barcode(tables, "1").collect()] == [("a", True), ("b", False)]
    assert ids(api.by_item_code(tables, "r1", " 7 7")) == ["c"] and [tuple(x) for x in api.product(tables, "a").first().identifiers] == [("gtin", "1", True)]


def test_prices_and_history(tables):
    rows = api.prices(tables, "a", size=3).collect()
    assert [(r.price, r.id) for r in rows] == [(7, "q2"), (7, "q5"), (8, "q1"), (8, "q4")] and rows[0].retailer_name == "Shop"
    assert ids(api.prices(tables, "a", cursor=[rows[2].price, rows[2].id])) == ["q4", "q0", "q3"] and ids(api.prices(tables, "a", retailer="r2")) == ["q1", "q4"]
    span = (F.lit(day(3)), F.lit(day(5)))
    assert ids(api.price_history(tables, "a", *span)) == ["h3", "h1"] and ids(api.price_history(tables, "a", *span, store="s1")) == ["h1"]
    assert ids(api.availability(tables, "a")) == ["v1", "v3"]


def test_status(tables):
    assert [(r.id, r.available, r.truncated) for r in api.freshness(tables, 1).collect()] == [("s1", 1, True), ("s2", 0, False), ("s3", 0, False)]
    assert [(r.id, r.latest_file, r.good_file, r.healthy) for r in api.source_status(tables).collect()] == [("p1", "f2", "f1", False), ("p2", None, None, False)]
    assert ids(api.failures(tables)) == ["f4"] and [(r.id, r.issues) for r in api.quarantine(tables).collect()] == [("f2", 2)] and ids(api.issues(tables, "f2")) == ["x2", "x1"]
    assert ids(api.replay_range(tables, F.lit(day(1)), F.lit(day(3)), [day(1), "f1"])) == ["f3", "f4"]
    assert ids(api.stale_jobs(tables, F.lit(day(2)))) == ["f3"] and ids(api.sequence(tables).orderBy("sequence")) == ["f3", "f1", "f4", "f2"]


def test_cursors_are_bound_to_their_query():
    cursor = api.encode_cursor("prices", {"product": "a"}, ["7.0", "q2"])
    assert api.decode_cursor(cursor, "prices", {"product": "a"}) == ["7.0", "q2"]
    for bad, route, filters in ((cursor, "stores", {"product": "a"}), (cursor, "prices", {"product": "b"}), ("x" + cursor, "prices", {"product": "a"})):
        with pytest.raises(ValueError):
            api.decode_cursor(bad, route, filters)


def test_promotions(spark):
    kept = "subchain string, scope_store string, promotion string, fingerprint string, items array<string>, stores array<string>, valid_from timestamp, valid_to timestamp"
    new = "subchain string, scope_store string, promotion string, fingerprint string, items array<string>, stores array<string>"
    before = spark.createDataFrame([("1", "s1", "same", "f", ["i"], [], day(1), None), ("1", "s1", "changed", "f", ["i"], [], day(1), None), ("1", "s1", "gone", "f", ["j"], ["s1"], day(1), None), ("1", "s2", "elsewhere", "f", ["i"], [], day(1), None), ("1", "s1", "old", "e", [], [], day(1), day(2))], kept)
    file = spark.createDataFrame([("1", "s1", "same", "f", ["i"], []), ("1", "s1", "changed", "g", ["i"], []), ("1", "s1", "new", "f", [], ["s9"])], new)
    for full, gone in ((True, day(3)), (False, None)):
        done = pr.apply_promotions(before, file, F.lit(day(3)), full)
        assert sorted((r.promotion, r.fingerprint, r.valid_to) for r in done.history.collect() if r.valid_from < day(3)) == sorted([("same", "f", None), ("changed", "f", day(3)), ("gone", "f", gone), ("elsewhere", "f", None), ("old", "e", day(2))])
        assert sorted((r.promotion, r.fingerprint) for r in done.history.where(F.col("valid_from") == day(3)).collect()) == [("changed", "g"), ("new", "f")]
    assert sorted(ids(pr.applies_in(done.current, "s1"), "promotion")) == ["changed", "elsewhere", "gone", "same"]
    assert sorted(ids(pr.of_product(done.current, spark.createDataFrame([("i", "p"), ("j", "q")], "item string, product string"), "p"), "promotion")) == ["changed", "elsewhere", "same"]
    timed = done.current.withColumns({"starts_at": F.lit(day(1)), "ends_at": F.lit(day(9)), "is_active": F.lit(None).cast("boolean")})
    assert pr.active(timed, F.lit(day(9))).count() == 5 and pr.active(timed, F.lit(day(10))).count() == 0


def test_listings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"d": [{"FileNm": "PriceFull1-202601020930.gz", "FileSize": 12}, {"FileNm": "Stores1-202601010930.xml", "FileSize": "321.40 KB", "SPath": "https://X.org/f/Stores1.xml?sig=1"}, {"FileNm": "", "FileSize": "1"}]}))
    rows = listings.json_catalogue(spark, str(tmp_path / "a.json"), "p", "d")
    got = {r.name: (r.document_type, r.compression, r.published, r.size, r.remote_id) for r in rows.collect()}
    assert got == {"PriceFull1-202601020930.gz": ("price_full", "gzip", "202601020930", 12, "PriceFull1-202601020930.gz"), "Stores1-202601010930.xml": ("stores", "none", "202601010930", None, "x.org/f/Stores1.xml")}
    assert ids(listings.latest_day(rows), "name") == ["PriceFull1-202601020930.gz"]
    pages = spark.createDataFrame([(1, "<a href='/d/Price7-202601010101.gz?x=1'>f</a><a href='/about'>n</a><a href='/d/Price7-202601010101.gz?x=1'>again</a>")], "page_id long, html string")
    assert [(r.name, r.document_type) for r in listings.distinct_files(listings.html_listing(pages, "p")).collect()] == [("Price7-202601010101.gz", "price_delta")]
    assert ids(listings.page(rows, "PriceFull1-202601020930.gz", 5), "remote_id") == ["x.org/f/Stores1.xml"]
