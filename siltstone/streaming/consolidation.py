"""Consolidation of closed scrolls as a stream: each is taken once, however often it arrives or a batch is repeated.

A folder holds two tables, `facts` and `processed`, with a part for each batch. A batch takes what no earlier batch has
processed, the oldest first, and overwrites its own parts: first the facts, then the ids. If a run is stopped between the
two, the batch comes again from the checkpoint and writes the same parts anew. Ids are read from the parts of earlier
batches alone, so a repeated batch sees what it saw before. Both tables are plain Parquet beside the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import ranking

IDS = "scroll string, batch long"


def earlier(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """Ids that earlier batches have processed; none before the first batch has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/processed")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], IDS)
    return spark.read.schema(IDS).option("basePath", f"{folder}/processed").parquet(f"{folder}/processed").where(F.col("batch") < batch)


def number(scroll: str = "scroll") -> Column:
    """The number at the end of an id, by which scrolls are ordered."""
    return F.regexp_extract(scroll, r"(\d+)$", 1).try_cast("long")


def consolidator(folder: str, score: Column, threshold: float | None = None, most: int | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for rows (scroll, text): facts (scroll, text, score, promoted) of each new scroll.

    Scrolls below the threshold are kept as not promoted. With `most`, a batch takes the scrolls of the lowest numbers only;
    the others are taken when they arrive again.
    """

    def take(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.where("scroll IS NOT NULL").groupBy("scroll").agg(F.max("text").alias("text")).join(earlier(spark, folder, n), "scroll", "left_anti")
        if most is not None:
            new = ranking.positions(new.withColumn("_all", F.lit(0)).withColumn("_n", number()), ["_all"], ["_n", "scroll"])[0].where(F.col("place") < most)
        promoted = F.lit(True) if threshold is None else F.coalesce(F.col("score") >= threshold, F.lit(False))
        facts = new.select("scroll", "text", F.round(score, 6).alias("score")).withColumn("promoted", promoted)
        path = f"{folder}/facts/batch={n}"
        facts.write.mode("overwrite").parquet(path)
        spark.read.parquet(path).select("scroll").write.mode("overwrite").parquet(f"{folder}/processed/batch={n}")

    return take


def start(scrolls: DataFrame, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], timeout_s: float | None = None) -> StreamingQuery:
    """Runs over what is there now; with a timeout it waits so long for the end, and stops the query if that is not met."""
    query = scrolls.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if timeout_s is not None and not query.awaitTermination(timeout_s):
        query.stop()
    return query
