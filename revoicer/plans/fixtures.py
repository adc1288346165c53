"""The driver's tables seen as media, segments, calls, fits and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters spoken in a second.
SPEED = 15.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as segments that tile their medium by construction."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.char_length("text")
    stop = F.sum(n).over(w)
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("m"), F.col("turn").cast("int").alias("id"), ((stop - n) / SPEED).alias("start"), (stop / SPEED).alias("end"), "text", F.col("role").alias("speaker"), n.alias("n"), stop.alias("stop"),
    )


def media(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("m")).agg((F.sum(F.char_length("text")) / SPEED).alias("duration_s"))


def silences(spark: SparkSession, d: str) -> DataFrame:
    """A pause that ends at each segment's end, longer for every third."""
    s = segments(spark, d)
    k = F.when(F.col("id") % 3 == 0, 12).otherwise(5)
    return s.where(F.col("n") > 12).select("m", ((F.col("stop") * 2 - k) / 30.0).alias("start_s"), (F.col("stop") * 2 / 30.0).alias("end_s"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Events as points on the media."""
    e = table(spark, d, "events")
    return e.select((F.col("event_id") % 97).alias("m"), (F.col("event_id") * 7919 % 12000 / 100.0).alias("t")).distinct()


def fits(spark: SparkSession, d: str) -> DataFrame:
    base = F.col("l_extendedprice") / 1000
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("m"), F.col("l_linenumber").alias("segment_id"), F.col("l_quantity").alias("target"), (base * (1 - F.col("l_discount"))).alias("achieved"), base.alias("baseline"),
        (1 + F.col("l_tax")).alias("final_pace"), (F.col("l_linenumber") % 3 + 1).alias("attempts"), (F.col("l_linenumber") == 1).alias("clamped"), (F.col("l_linenumber") > 3).alias("converged"), "l_returnflag", "l_linestatus",
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("stage"), "user_id", F.col("value").alias("latency_s"), (F.col("event_id") % 3 == 0).alias("cache_hit"), (F.ceil("value") * 20.0 / 10000).alias("cost_if_billed_inr"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as reference beside the next as hypothesis, cleaned to ASCII words."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    ascii_ = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    both = table(spark, d, "conversations").select(F.col("conv_id").alias("m"), F.col("turn").cast("int").alias("segment_id"), ascii_(F.col("text")).alias("reference"), ascii_(F.lead("text").over(w)).alias("hypothesis"))
    return both.where("hypothesis is not null and reference != ''")


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as int16 signals of 64 samples at 1 kHz."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("m"), F.col("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 20000).cast("int")).alias("samples"), F.lit(1000).alias("rate"))


def placements(spark: SparkSession, d: str) -> DataFrame:
    """Clips placed at their segments; some are longer than their windows."""
    s = segments(spark, d)
    length = F.col("n") * F.when(F.col("id") % 4 == 1, 5).otherwise(3) / 60.0
    return s.select(
        "m", F.col("id").alias("segment_id"), F.col("start").alias("window_start_s"), F.col("end").alias("window_end_s"), F.col("start").alias("placed_start_s"), length.alias("duration_s"),
        F.lit(0).cast("long").alias("clipped_samples"), F.lit(0).cast("long").alias("truncated_frames"), F.lit(0).cast("long").alias("overlapped_frames"),
    )
