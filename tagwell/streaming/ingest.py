"""Micro-batches of staged price files onto versioned state, in source order, each batch once.

The state of a scope (a retailer's feed) is Parquet in a folder for each version; a row of `pointers` names the current one. A batch writes new versions of the scopes that it
touches, and of no others, and then their pointers, so readers see whole versions only and a repeated batch finds itself done. Files that come late, conflict, hold too many rejected records or drop
too much go to quarantine.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwell.operators import apply, history

KEY, CHANGE = apply.PRICE_KEY, apply.PRICE_CHANGE
INCOMING = "file string, scope string, source_time timestamp, full boolean, rejected long, store string, item string, price decimal(14,4), unit_price decimal(14,4), allow_discount boolean, item_status int"
POINTERS = "scope string, version long, batch long, source_time timestamp"
EMPTY = {
    "prices": "store string, item string, price decimal(14,4), unit_price decimal(14,4), allow_discount boolean", "price_history": "store string, item string, valid_from timestamp, valid_to timestamp, price decimal(14,4), unit_price decimal(14,4), allow_discount boolean",
    "availability": "store string, item string, is_available boolean, item_status int", "availability_history": "store string, item string, valid_from timestamp, valid_to timestamp, is_available boolean, item_status int",
    "quarantine": "file string, scope string, source_time timestamp, verdict string",
}


class PriceState:
    """Tables of the current versions under a path."""

    def __init__(self, spark: SparkSession, path: str, least: int = history.LEAST_RECORDS, most: float = history.MOST_DROPPED):
        self.spark, self.path, self.least, self.most = spark, path.rstrip("/"), least, most

    def pointers(self) -> dict:
        """The current pointer of each scope; there is a row for each feed."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):  # any other failure to read is one
            return {}
        rows = self.spark.read.schema(POINTERS).parquet(f"{self.path}/pointers").groupBy("scope").agg(F.max(F.struct("version", "batch", "source_time")).alias("last"))
        return {r.scope: r["last"] for r in rows.collect()}

    def folder(self, scope: str, version: int) -> str:
        return f"{self.path}/{hashlib.sha256(scope.encode()).hexdigest()[:16]}/v{version}"

    def read(self, name: str, scope: str | None = None) -> DataFrame:
        """A table of one scope, or of all."""
        found = [self.folder(k, p.version) for k, p in self.pointers().items() if scope in (None, k)]
        return self.spark.read.schema(EMPTY[name]).parquet(*[f"{f}/{name}" for f in found]) if found else self.spark.createDataFrame([], EMPTY[name])

    def apply(self, batch: DataFrame, number: int) -> None:
        """Apply a batch's files, each scope's in order of their source time."""
        facts = batch.groupBy("scope", "source_time", "file").agg(F.coalesce(F.bool_or("full"), F.lit(False)).alias("full"), F.coalesce(F.max("rejected"), F.lit(0)).alias("rejected"), F.count("item").alias("accepted"))
        files, known, moved = sorted(facts.collect()), self.pointers(), []  # a trigger's few files
        for scope, own in groupby(files, key=lambda f: f.scope):
            last = known.get(scope)
            if last is not None and last.batch >= number:
                continue
            version, mark, bad = last.version + 1 if last else 1, last.source_time if last else None, []
            state = apply.Prices(*(self.read(name, scope) for name in ("prices", "price_history", "availability", "availability_history")))
            for f in own:
                if mark is not None and f.source_time <= mark:
                    bad.append((f.file, scope, f.source_time, "source_timestamp_regression" if f.source_time < mark else "source_timestamp_conflict"))
                elif not history.accepted_file(f.accepted, f.rejected):
                    bad.append((f.file, scope, f.source_time, "too_many_rejected_records"))
                else:
                    rows = batch.where((F.col("scope") == scope) & (F.col("file") == f.file) & F.col("item").isNotNull()).select(*KEY, *CHANGE, "item_status")
                    try:
                        state, _ = apply.apply_prices(state, rows, F.lit(f.source_time), f.full, self.most, self.least)
                        mark = f.source_time
                    except apply.Refused:
                        bad.append((f.file, scope, f.source_time, "unsafe_snapshot_drop"))
            tables = {"prices": state.prices, "price_history": state.price_history, "availability": state.availability, "availability_history": state.availability_history}
            tables["quarantine"] = self.read("quarantine", scope).unionByName(self.spark.createDataFrame(bad, EMPTY["quarantine"]))
            for name, rows in tables.items():
                rows.write.mode("overwrite").parquet(f"{self.folder(scope, version)}/{name}")
            moved.append((scope, version, number, mark))
        if moved:
            self.spark.createDataFrame(moved, POINTERS).write.mode("append").parquet(f"{self.path}/pointers")


def ingest(spark: SparkSession, folder: str, state: str, checkpoint: str, files_per_trigger: int = 1, least: int = history.LEAST_RECORDS):
    """A stream of staged Parquet files into the state; run until all files that are there are done."""
    store = PriceState(spark, state, least)
    rows = spark.readStream.schema(INCOMING).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    query = rows.writeStream.foreachBatch(lambda batch, number: store.apply(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return store


def event_buckets(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Five-minute counts and sums of a stream of events, final once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
