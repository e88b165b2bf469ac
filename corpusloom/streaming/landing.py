"""Documents and call metrics as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_arrivals(spark: SparkSession, landing: str, schema, out: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame]):
    """Each micro-batch of new Parquet files in landing through clean(), appended to out; ends when all is read."""
    arrivals = spark.readStream.schema(schema).parquet(landing)

    def write(batch: DataFrame, number: int) -> None:
        clean(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_arrivals(arrivals: DataFrame, time_col: str, text_col: str = "text", delay: str = "1 hour") -> DataFrame:
    """Documents whose content hasn't arrived within the watermark's delay."""
    keyed = arrivals.withColumn("content_hash", F.sha2(F.col(text_col).cast("binary"), 256))
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(events: DataFrame, time_col: str, key_col: str, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events by key and tumbling window, late ones dropped after the delay."""
    grouped = events.withWatermark(time_col, delay).groupBy(F.window(time_col, width), key_col)
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key_col, "n")
