"""Event streams: windowed counts with late data, sessions, deduplication, and decisions that follow the last event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curatrix.operators.decisions import SCOPE, latest
from curatrix.sources.shared import drop_path, exists

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of tumbling or sliding windows; on a stream, state of closed windows is dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once, within the time that late data is waited for."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


BUCKETS = 64


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """What keep_latest holds: of each bucket its newest version (older than batch `before`)."""
    rows = spark.read.parquet(table)
    if before is not None:
        rows = rows.filter(F.col("v") < before)
    newest = rows.groupBy("bucket").agg(F.max("v").alias("v"))  # of partition columns alone
    return rows.join(F.broadcast(newest), ["bucket", "v"])


def keep_latest(log: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the last decision of each scope at `table` (read it with `current`), and processes what is there.

    Items are dealt to buckets by their hash, and a batch rewrites those that it touches, as a version of its own; versions
    that it replaces are deleted once it is whole, but for the last, which a batch that is run again starts from.
    """
    names = [*SCOPE, "decision", "ts", "event_id"]

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*names, F.pmod(F.hash("item_id"), F.lit(buckets)).alias("bucket")).persist()
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # `buckets` at most
        if touched:
            both = rows
            if exists(spark, table):
                both = rows.unionByName(current(spark, table, number).filter(F.col("bucket").isin(touched)).select(*names, "bucket"))
            last = latest(both.select(*names)).select(*names).withColumn("bucket", F.pmod(F.hash("item_id"), F.lit(buckets)))
            last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v={number}")
            old = spark.read.parquet(table).filter(F.col("bucket").isin(touched) & (F.col("v") < number)).select("bucket", "v").distinct().collect()
            newest = {b: max(r.v for r in old if r.bucket == b) for b in {r.bucket for r in old}}
            for r in old:
                if r.v < newest[r.bucket]:
                    drop_path(spark, f"{table}/v={r.v}/bucket={r.bucket}")
        rows.unpersist()

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
