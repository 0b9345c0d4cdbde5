"""Streaming forms, beyond the batch operators: deduplication, event statistics, quarantine on arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_url
from ..operators import quality as Q


def dedup_urls(stream: DataFrame, url: str, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each URL within the watermark."""
    return stream.withColumn("norm_url", normalize_url(F.col(url))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["norm_url"])


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", value: str | None = None, delay: str | None = None) -> DataFrame:
    """Event counts of sessions: batch or stream alike."""
    df = events.withColumn(time, F.col(time).cast("timestamp"))
    df = df.withWatermark(time, delay) if delay else df
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    grouped = df.groupBy(key, F.session_window(time, gap).alias("w")).agg(*aggs)
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *(["n", "total"] if value else ["n"]))


def tumbling(events: DataFrame, time: str, every: str, *keys: str, delay: str | None = None) -> DataFrame:
    df = events.withColumn(time, F.col(time).cast("timestamp"))
    df = df.withWatermark(time, delay) if delay else df
    return df.groupBy(F.window(time, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def quarantine_sink(kept: str, held: str, checkpoint: str):
    """A function that starts a stream of texts, scores each batch and writes clean and quarantined rows apart."""

    def batch(df: DataFrame, number: int) -> None:
        scored = Q.quality(df).persist()
        for path, test in ((kept, ~F.col("quarantine_candidate")), (held, F.col("quarantine_candidate"))):
            scored.filter(test).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)
        scored.unpersist()

    return lambda stream: stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
