"""Memoised calls: keys, hits and misses, provenance; and external backends behind them."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revoicer.config import CacheMissError, EngineError


def canonical_params(**params: Column) -> Column:
    """Compact JSON of the parameters that are not null, in the order of their names."""
    return F.to_json(F.struct(*[params[k].alias(k) for k in sorted(params)]))


def cache_key(stage: Column, model: Column, params_json: Column, input_hash: Column) -> Column:
    return F.sha2(F.concat_ws("\0", stage, model, params_json, input_hash), 256)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def decode_audio(audios: Column) -> Column:
    """The first base64 item of an array; a missing or damaged one raises."""
    raw = F.try_to_binary(audios[0], F.lit("base64"))
    return F.when(raw.isNull(), F.raise_error(F.lit("no audio, or damaged audio, in the reply")).cast("binary")).otherwise(raw)


def lookup(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """Calls with cache_hit and what the cache holds; an entry of damaged JSON is a miss."""
    good = cache.where(F.try_parse_json("payload").isNotNull()).dropDuplicates(["key"])
    return calls.join(good.withColumn("__hit", F.lit(True)), "key", "left").withColumn("cache_hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def misses(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct calls to make: one for each key that the cache lacks."""
    good = cache.where(F.try_parse_json("payload").isNotNull()).select("key")
    return calls.dropDuplicates(["key"]).join(good, "key", "left_anti")


def stats(looked_up: DataFrame, writes: DataFrame) -> DataFrame:
    hits = looked_up.agg(F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses"))
    out = hits.crossJoin(writes.agg(F.count(F.lit(1)).alias("writes"))) if writes is not None else hits
    return out.withColumn("total", F.col("hits") + F.col("misses")).withColumn("hit_rate", F.try_divide(F.col("hits").cast("double"), F.col("total")))


def clear(spark, path: str) -> int:
    """Empty a cache table; the count of entries removed."""
    from pyspark.errors import AnalysisException

    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        return 0
    n = old.count()
    old.limit(0).write.mode("overwrite").parquet(path + ".empty")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(path + ".empty"), hadoop)
    return n


@dataclass(frozen=True)
class Retry:
    """Full jitter: a wait up to min(base * 2^(n-1), cap), or what the server asks for."""

    attempts: int = 4
    base_s: float = 1.0
    cap_s: float = 30.0
    statuses: tuple[int, ...] = (429, 500, 502, 503, 504)

    def delay(self, attempt: int, retry_after: float | None = None, rng: Callable[[float, float], float] = random.uniform) -> float:
        return retry_after if retry_after is not None else rng(0.0, min(self.base_s * 2 ** (attempt - 1), self.cap_s))


@dataclass
class Reply:
    status: int
    payload: dict
    retry_after: float | None = None


def call_with_retries(backend: Callable[[dict], Reply], request: dict, retry: Retry, sleep: Callable[[float], None] = time.sleep) -> tuple[Reply, int]:
    for attempt in range(1, retry.attempts + 1):
        reply = backend(request)
        if reply.status < 400:
            return reply, attempt
        if reply.status not in retry.statuses or attempt == retry.attempts:
            raise EngineError(f"call failed with status {reply.status} after {attempt} attempts")
        sleep(retry.delay(attempt, reply.retry_after))
    raise AssertionError


def stub_backend(request: dict) -> Reply:
    """Deterministic and offline: echoes what it was asked."""
    return Reply(200, {"request_id": f"stub-{request['key'][:8]}", "text": request["input"][::-1]})


def cached_calls(calls: DataFrame, cache_path: str, backend: Callable[[dict], Reply] = stub_backend, dry_run: bool = False, retry: Retry = Retry()) -> tuple[DataFrame, DataFrame]:
    """Answer calls (key, stage, model, input) from the cache table, and the rest by the backend.

    Fresh replies are appended, one row per key, before anything reads them, so a repeated
    task or a second run asks nothing twice that has been written; failed calls are never
    written. A dry run raises on any miss. Returns the replies and the log of calls.
    """
    from pyspark.errors import AnalysisException

    spark = calls.sparkSession
    schema = "key string, stage string, payload string, latency_s double, attempts int"
    try:
        cache = spark.read.schema(schema).parquet(cache_path)
    except AnalysisException:
        cache = spark.createDataFrame([], schema)
    need = misses(calls, cache)
    before = lookup(calls, cache.select("key", "payload"))
    if not need.isEmpty():
        if dry_run:
            raise CacheMissError(f"{need.count()} calls are not in the cache")

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for r in frame.to_dict("records"):
                    began = time.perf_counter()
                    reply, n = call_with_retries(backend, r, retry)
                    out.append((r["key"], r["stage"], json.dumps(reply.payload), time.perf_counter() - began, n))
                yield pd.DataFrame(out, columns=["key", "stage", "payload", "latency_s", "attempts"])

        known = cache.select("key").distinct()
        need.select("key", "stage", "model", "input").mapInPandas(work, schema).write.mode("append").parquet(cache_path)
        # The earlier table's plan holds its file list, so hits stay those of before.
        before = calls.join(known.withColumn("__old", F.lit(True)), "key", "left").withColumn("cache_hit", F.coalesce("__old", F.lit(False))).drop("__old")
        cache = spark.read.schema(schema).parquet(cache_path)
    answers = calls.join(cache.select("key", "payload").dropDuplicates(["key"]), "key")
    log = before.select("stage", "key", "model", "cache_hit")
    return answers, log


def stale(media: DataFrame, provenance: DataFrame, tolerance_s: float = 0.01) -> DataFrame:
    """Why earlier work can't be reused, null where it can."""
    p = provenance.select("m", F.col("path").alias("old_path"), F.col("size_bytes").alias("old_size"), F.col("duration_s").alias("old_duration"))
    reason = (
        F.when(F.col("old_path").isNull(), F.lit("no earlier run")).when(F.col("path") != F.col("old_path"), F.lit("another source"))
        .when(F.col("size_bytes") != F.col("old_size"), F.lit("the size differs")).when(F.abs(F.col("duration_s") - F.col("old_duration")) > tolerance_s, F.lit("the duration differs"))
    )
    return media.join(p, "m", "left").select("m", reason.alias("reason"))
