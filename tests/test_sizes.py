"""What larger tables than the test ones bring about: ties, many candidates, shuffles."""

import os

import duckdb
import pytest

from tagwell.plans import registry

SF = "/root/testdata/sf0.001"


def linked(folder, *own):
    """The test tables but these, under another folder."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    for name in os.listdir(SF):
        if name.split(".")[0] not in own:
            os.symlink(f"{SF}/{name}", f"{folder}/{name}")
    return str(folder)


def test_events_that_arrive_at_once_stand_by_id(spark, tmp_path):
    rows = [(1_000_004, "a"), (1, "a"), (2_000_007, "a"), (5, "b")]  # the first three arrive at once
    spark.createDataFrame(rows, "event_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.watermark, r.verdict) for r in registry.QUERIES["watermark_regressions"](spark, str(tmp_path)).collect()}
    assert got == {1: (None, "accepted"), 1_000_004: (1, "accepted"), 2_000_007: (1_000_004, "accepted"), 5: (None, "accepted")}


def test_a_barcode_of_more_than_ten_thousand_products_is_searched(spark, tmp_path):
    sf = linked(tmp_path, "part")
    spark.range(10_001).selectExpr("id * 700 + 12 AS p_partkey", "'part ' || id AS p_name", "'b' AS p_brand", "'t' AS p_type", "cast(id % 7 AS int) AS p_size", "1D AS p_retailprice").coalesce(1).write.parquet(f"{sf}/part.parquet")
    con = duckdb.connect()
    for t in ("nation", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet/*.parquet'")
    got = registry.QUERIES["product_search_by_barcode"](spark, sf).select("id", "name", "brand", "rank").collect()
    assert [tuple(r) for r in got] == con.sql(registry.ORACLES["product_search_by_barcode"]).fetchall() and len(got) == 21


@pytest.mark.parametrize("name", ["state_after_full_price_file", "availability_events_of_full_file", "apply_full_price_file"])
def test_a_full_file_meets_its_state_once(spark, name):
    """Each shuffle file takes disk until the query ends: both halves of the observations for the state's two tables and for the file, and one more for all."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 0 and plan.count("Relation [l_") <= 4
