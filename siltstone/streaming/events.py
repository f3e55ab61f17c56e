"""The append-only event log as a stream: windows with late data, sessions, and the latest state by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import state


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files that are added to a folder; event times become instants, which watermarks need."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by kind in tumbling windows; rows later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_state(read_table: Callable[[], DataFrame | None], write_table: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps each user's last event; a batch that comes again changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        new = batch.select("user_id", "event_id", "event_type", "value")
        old = read_table()
        rows = new if old is None else old.unionByName(new)
        write_table(state.latest(rows, ["user_id"], F.col("event_id"), ["event_id", "event_type", "value"]), epoch)

    return merge
