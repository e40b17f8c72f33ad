"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "current_price_latest", "compare_prices_product", "keyset_page_two", "price_history_intervals", "price_history_overlap", "price_as_of_instant", "change_counts", "absent_after_full_snapshot", "snapshot_drop_guard",
    "availability_transitions", "corroboration_count", "promo_active_at", "bounded_children_json", "freshness_per_store", "trigram_similarity_search", "search_rank", "blocked_topk_candidates", "rolling_24h_budget",
    "watermark_regressions", "export_partition_plan", "fingerprint_dedup", "html_links", "product_search_page", "product_by_barcode", "current_prices_page", "price_history_page", "apply_full_price_file",
)


XML_FILES, XML_RECORDS = 8, 2_500


def parsed(spark: SparkSession) -> float:
    """Seconds to parse price documents of 20,000 records into typed rows."""
    from tagwell.sources import publisher_files

    item = "<Item><PriceUpdateDate>2026-01-0{d} 07:30</PriceUpdateDate><ItemCode>{c:013d}</ItemCode><ItemType>1</ItemType><ItemName>Plain item {c} of some brand</ItemName><ManufacturerName>Maker {m}</ManufacturerName><UnitQty>g</UnitQty><Quantity>250.00</Quantity><UnitOfMeasure>100 g</UnitOfMeasure><bIsWeighted>0</bIsWeighted><ItemPrice>{p}.90</ItemPrice><UnitOfMeasurePrice>3.96</UnitOfMeasurePrice><AllowDiscount>1</AllowDiscount><ItemStatus>1</ItemStatus></Item>"
    rows = []
    for k in range(XML_FILES):
        items = "".join(item.format(c=k * XML_RECORDS + i, d=i % 9 + 1, m=i % 70, p=i % 90) for i in range(XML_RECORDS))
        rows.append((f"file {k}", bytearray(f"<Root><ChainId>729</ChainId><SubChainId>1</SubChainId><StoreId>{k}</StoreId><Items>{items}</Items></Root>".encode())))
    files = spark.createDataFrame(rows, "source_file_id string, content binary").repartition(XML_FILES, "source_file_id").cache()
    files.count()
    typed = publisher_files.prices(publisher_files.parse(files, "price"))
    began = time.perf_counter()
    typed.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def written(spark: SparkSession) -> float:
    """Seconds to apply a full file (the second half of the observations) to the state after the first, and to write all four tables of the new state."""
    from tagwell.plans import applying

    with tempfile.TemporaryDirectory() as folder:
        began = time.perf_counter()
        state, _ = applying.applied(spark, SF_DIR)
        for name in ("prices", "price_history", "availability", "availability_history"):
            getattr(state, name).write.parquet(f"{folder}/{name}")
        return round(time.perf_counter() - began, 3)


def main() -> None:
    os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tagwell.plans import registry

    run = lambda name: registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    run(HEADLINES[0])  # starts the JVM's compilers
    times = {}
    for name in HEADLINES:
        began = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - began, 3)
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    times |= {"xml_parse": parsed(spark), "apply_written": written(spark)}
    rates = {"xml_rows_per_s": round(XML_FILES * XML_RECORDS / times["xml_parse"]), "applied_rows_per_s": round(lines / times["apply_written"]), "change_rows_per_s": round(lines / times["change_counts"]), "history_rows_per_s": round(lines / times["price_history_intervals"])}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times[name] for name in HEADLINES), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rpartition("sf")[2], **rates}))


if __name__ == "__main__":
    sys.exit(main())
