"""Streams that end when all there is has been read, or keep running if told to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window_start, kind and n: counts per tumbling window; runs on streams and tables."""
    timed = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    counted = timed.groupBy(F.window("__time", window).alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n")


def drain(spark: SparkSession, folder: str, pattern: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], sink: str, mode: str = "complete") -> None:
    """Read what is new among the Parquet files of `folder` through `transform` into the
    Parquet table `sink`, batch by batch, and stop; `checkpoint` remembers what was read.

    In complete mode a batch replaces the table, and state is kept for all windows. In
    append mode a window is given out once the watermark has passed it, its state goes, and
    each batch has a folder of its own, which a batch that is tried again replaces."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(sink if mode == "complete" else f"{sink}/batch={number}")

    query = transform(stream).writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
