from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tagwell.functions import text, values


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [
    ("2026-08-11T20:00:00+02:00", datetime(2026, 8, 11, 18)), ("2026-03-27T02:30:00", None), ("2026-10-25T01:30:00", None), ("2026-10-25T01:30:00+03:00", datetime(2026, 10, 24, 22, 30)),
    ("2026-10-25T01:30:00+02:00", datetime(2026, 10, 24, 23, 30)), ("11/08/2026 02:01", datetime(2026, 8, 10, 23, 1)), ("nonsense", None), (None, None),
])
def test_instants(spark, given, want):
    assert one(spark, values.instant_of, given) == want


def test_instant_of_parts(spark):
    rows = spark.createDataFrame([("2026-08-11", "02:01:02"), (None, "02:01:02"), (None, "2026-08-10T23:58:00.000")], "d string, t string")
    got = [r.x for r in rows.select(values.instant_of_parts(F.col("d"), F.col("t")).alias("x")).collect()]
    assert got == [datetime(2026, 8, 10, 23, 1, 2), None, datetime(2026, 8, 10, 20, 58)]


@pytest.mark.parametrize(("given", "want"), [("1 ליטר", (Decimal(1000), "ml")), ('2 ק"ג', (Decimal(2000), "g")), ("6 יחידות", (Decimal(6), "each")), ("30 מטרים", (Decimal(30), "m")), ("milk 1,5 l x", (Decimal(1500), "ml")), ("plain", None), (None, None)])
def test_quantities(spark, given, want):
    got = one(spark, text.quantity, given)
    assert got == want if want is None else (got.value, got.unit) == want


@pytest.mark.parametrize(("given", "want"), [("4006381333931", True), ("4006381333932", False), ("96385074", True), ("123", False), ("400638133393x", False), ("", False)])
def test_gtin(spark, given, want):
    assert one(spark, text.is_gtin, given) is want


@pytest.mark.parametrize(("given", "want"), [("19.90", Decimal("19.9000")), ("1,234.5", Decimal("1234.5000")), ("1,234", Decimal("1.2340")), ("1,234,567", Decimal("1234567.0000")), ("1\u00a0234.5", Decimal("1234.5000")), ("3,5", Decimal("3.5000")), ("-1", None), ("x", None), ("99999999999", None), (" 7 ", Decimal("7.0000"))])
def test_decimals(spark, given, want):
    assert one(spark, values.decimal_of, given) == want


def test_names_and_search_text(spark):
    names = ["PriceFull729-001-202401020930.gz", "Price729.xml", "PromoFull1.zip", "stores7.xml", "StoresFull.gz", "promotions.xml", "other.xml"]
    got = spark.createDataFrame([(n,) for n in names], "v string").select(text.document_type(F.col("v")).alias("t"), text.compression(F.col("v")).alias("c"), text.file_timestamp(F.col("v")).alias("s")).collect()
    assert [r.t for r in got] == ["price_full", "price_delta", "promotion_full", "stores", "stores", "promotion_delta", None]
    assert [r.c for r in got] == ["gzip", "none", "zip", "none", "gzip", "none", "none"] and got[0].s == "202401020930"
    assert one(spark, text.search_text, "Ｃafé́-X  שָׁלוֹם!") == "café x שלום"
    assert one(spark, text.clean_text, " a‏ b\x00 ") == "a b" and one(spark, text.clean_text, " \x01") is None
    assert one(spark, lambda c: text.trigram_similarity(c, F.lit("two words")), "word") == pytest.approx(4 / 11)
    assert one(spark, values.flag_of, "כן") is True and one(spark, values.flag_of, "0") is False and one(spark, values.flag_of, "?") is None


def test_integers_and_listing_times(spark):
    assert [one(spark, values.int_of, v) for v in (" 7 ", "-3", "1.0", "x", "")] == [7, -3, None, None, None]
    assert one(spark, values.listing_instant, "1/2/2026 4:05:06 PM") == datetime(2026, 1, 2, 14, 5, 6) and one(spark, values.listing_instant, "2026-01-02 16:05") is None
    assert one(spark, values.instant_of, "01/02/2026 04:05:06 PM") == datetime(2026, 1, 2, 14, 5, 6)
