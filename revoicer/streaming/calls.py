"""An extension that the reference does not have: call logs as streams.

The same aggregates as in batch, over event time, with a watermark that bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_costs(calls: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls (ts, stage, cache_hit, cost) by tumbling window and stage."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window).alias("w"), "stage").agg(F.count(F.lit(1)).alias("n"), F.count_if("cache_hit").alias("hits"), F.sum(F.when(~F.col("cache_hit"), F.col("cost")).otherwise(0.0)).alias("cost_inr"))
    return out.select(F.col("w.start").alias("start"), "stage", "n", "hits", "cost_inr")


def sessions(calls: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of calls of one user without a longer pause."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def run_available(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Work off what is there, then stop; the result as a table in memory."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
