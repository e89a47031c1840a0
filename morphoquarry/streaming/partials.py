"""Results per example appended as its files arrive: stateless, resumable, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_partials(spark: SparkSession, source: str, schema, target: str, checkpoint: str, summarise: Callable[[DataFrame], DataFrame], once: bool = True):
    """Reads new Parquet files of a folder in micro-batches and writes each batch's summary under its number.

    A batch that is repeated after a failure replaces its own output, so results come out once. ``once`` takes what is
    there and stops; else the query goes on.
    """

    def write(batch: DataFrame, number: int) -> None:
        summarise(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    started = (query.trigger(availableNow=True) if once else query).start()
    if once:
        started.awaitTermination()
    return started


def late_counts(stream: DataFrame, time: str, keys: list[str], window: str, delay: str) -> DataFrame:
    """Counts per event-time window that close once the watermark has passed; rows later than the delay are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
