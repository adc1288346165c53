"""Aggregations: drift blocks, paired statistics, calls and costs, coverage."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revoicer.config import CALL_STAGES, STAGES
from revoicer.functions import scalar as S


def percentile(value: str, p: float) -> Column:
    """Exact percentile with linear interpolation; null on no rows. Its buffer holds the
    group's values: ``grouped`` is for groups that grow."""
    return F.expr(f"percentile({value}, {p / 100}D)")


class Percentile(NamedTuple):
    """An exact percentile, among the aggregates of ``grouped``."""

    name: str
    value: str
    p: float


#: Groups of more rows have their percentiles by counting in ever narrower ranges; the ranges
#: to a doubling in the first count, and to a range in the second.
LARGE, FIRST, SECOND = 1 << 16, 256, 1 << 20


def log_range(x: Column) -> Column:
    """A number that never falls as x rises: its logarithm's range, NaN above all."""
    size = lambda v: (F.floor(F.log2(v) * FIRST) + (1 << 21)).cast("long")
    far = 1 << 40
    return F.when(F.isnan(x), far + 1).when(x == float("inf"), far).when(x == float("-inf"), -far).when(x > 0, size(x)).when(x < 0, -size(-x)).otherwise(0)


def percentiles(rows: DataFrame, keys: list[str], wanted: list[Percentile]) -> DataFrame:
    """Exact percentiles with linear interpolation: __k0 ... for the keys, and the names.

    Small groups keep their values in a buffer each. In large groups no row moves and no
    buffer grows: rows are counted by ranges, the ranges that hold the wanted ranks are
    counted again in finer ones, then by value. Rows are read once for each count.
    """
    values = list(dict.fromkeys(w.value for w in wanted))
    ks, vs = [f"__k{i}" for i in range(len(keys))], [f"__v{j}" for j in range(len(values))]
    own = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)], *[F.col(v).cast("double").alias(n) for v, n in zip(values, vs, strict=True)])
    same = lambda left, right: reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])
    bs, ts = [f"__b{i}" for i in range(len(keys))], [f"__t{i}" for i in range(len(keys))]
    large = F.broadcast(own.groupBy(*ks).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select(*[F.col(k).alias(b) for k, b in zip(ks, bs, strict=True)]))
    small = own.join(large, same(ks, bs), "left_anti").groupBy(*ks).agg(*[percentile(vs[values.index(w.value)], w.p).alias(w.name) for w in wanted])

    x = own.join(large, same(ks, bs)).select(*ks, F.posexplode(F.array(*vs)).alias("j", "x")).where("x is not null")
    counted = x.groupBy(*ks, "j", log_range(F.col("x")).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    whole = Window.partitionBy(*ks, "j")
    counted = counted.withColumn("total", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(whole.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    place = lambda p: (F.col("total") - 1) * (p / 100)
    ranks = F.array(*[F.array(*[f(place(w.p)).cast("long") for w in wanted if w.value == v for f in (F.floor, F.ceil)]) for v in values])[F.col("j")]
    found = counted.withColumn("r", F.explode(F.array_distinct(ranks))).where((F.col("r") >= F.col("upto") - F.col("n")) & (F.col("r") < F.col("upto"))).withColumn("below", F.col("upto") - F.col("n"))
    for finer in (lambda: F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * SECOND), F.lit(SECOND - 1))).otherwise(0), lambda: F.col("x")):
        ranges = F.broadcast(found.select(*[F.col(k).alias(b) for k, b in zip(ks, ts, strict=True)], F.col("j").alias("__j"), "r", "total", "below", "low", "high"))
        inside = x.join(ranges, same([*ks, "j"], [*ts, "__j"]) & (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
        counted = inside.groupBy(*ks, "j", "r", "total", "below", finer().alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy(*ks, "j", "r").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        found = counted.withColumn("upto", upto).where((F.col("r") >= F.col("upto") - F.col("n")) & (F.col("r") < F.col("upto"))).withColumn("below", F.col("upto") - F.col("n"))

    ends = []
    for w in wanted:
        of, at = F.col("j") == values.index(w.value), place(w.p)
        ends += [F.max(F.when(of, at)).alias(f"{w.name}_at"), *[F.max(F.when(of & (F.col("r") == f(at).cast("long")), F.col("low"))).alias(f"{w.name}_{n}") for n, f in (("a", F.floor), ("z", F.ceil))]]
    met = found.groupBy(*ks).agg(*ends)

    def between(w: Percentile) -> Column:
        at, a, z = (F.col(f"{w.name}_{n}") for n in ("at", "a", "z"))
        return F.when(a == z, a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * z).alias(w.name)

    return small.unionByName(met.select(*ks, *[between(w) for w in wanted]))


def grouped(rows: DataFrame, keys: list[str], *aggregates: Column | Percentile) -> DataFrame:
    """``rows.groupBy(keys).agg(aggregates)``, among which percentiles may be."""
    wanted = [a for a in aggregates if isinstance(a, Percentile)]
    held = rows.groupBy(*keys).agg(*[F.max(F.lit(None).cast("double")).alias(a.name) if isinstance(a, Percentile) else a for a in aggregates])
    order, names = held.columns, [w.name for w in wanted]
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return held.drop(*names).join(percentiles(rows, keys, wanted), on, "left").select(*order)


def drift_aggregates(value: str, prefix: str, threshold: float = 5.0) -> list[Column | Percentile]:
    return [
        F.avg(value).alias(f"{prefix}_mean"), Percentile(f"{prefix}_p50", value, 50), Percentile(f"{prefix}_p95", value, 95),
        F.max(value).alias(f"{prefix}_max"), F.count_if(F.col(value) > threshold).alias(f"{prefix}_over"),
    ]


def drift_block(fits: DataFrame, keys: list[str], threshold: float = 5.0) -> DataFrame:
    """Mean, median, 95th percentile, maximum and count over the threshold of absolute drift."""
    own = fits.select(*keys, S.drift_pct(F.col("achieved"), F.col("target")).alias("drift"))
    return grouped(own, keys, F.count(F.lit(1)).alias("n"), *drift_aggregates("drift", "drift", threshold))


def duration_fit_stats(fits: DataFrame, keys: list[str], small: int = 20) -> DataFrame:
    """Before (baseline) against after (achieved), paired by construction in one aggregation."""
    t = F.col("target")
    own = fits.select(
        *keys, S.drift_pct(F.col("baseline"), t).alias("before"), S.drift_pct(F.col("achieved"), t).alias("after"), S.signed_drift_pct(F.col("achieved"), t).alias("signed"),
        S.overrun_pct(F.col("baseline"), t).alias("over_before"), S.overrun_pct(F.col("achieved"), t).alias("over_after"), "attempts", "final_pace", "clamped", "converged",
    )
    out = grouped(
        own, keys,
        F.count(F.lit(1)).alias("n"), *drift_aggregates("before", "before"), *drift_aggregates("after", "after"),
        F.avg(F.when(F.col("over_before") > 0, F.col("over_before"))).alias("overrun_before_mean"), F.avg(F.when(F.col("over_after") > 0, F.col("over_after"))).alias("overrun_after_mean"),
        F.count_if(F.col("over_before") > 0).alias("overrun_before"), F.count_if(F.col("over_after") > 0).alias("overrun_after"),
        F.count_if(F.col("signed") > 0).alias("running_over"), F.count_if(F.col("signed") < 0).alias("running_under"), F.avg("signed").alias("signed_mean"),
        F.count_if(F.col("after") < F.col("before")).alias("improved"), F.count_if(F.col("after") > F.col("before")).alias("worsened"),
        F.avg("attempts").alias("attempts_mean"), F.avg("final_pace").alias("pace_mean"), F.count_if("clamped").alias("clamped"), F.count_if("converged").alias("converged"),
    )
    before, after, n = F.col("before_mean"), F.col("after_mean"), F.col("n")
    return out.withColumns({"delta": before - after, "reduction_pct": F.when(before != 0, (before - after) / before * 100), "clamped_pct": F.col("clamped") / n * 100, "converged_pct": F.col("converged") / n * 100, "small_sample": n < small})


def calls_by_stage(calls: DataFrame, stages: tuple[str, ...] = CALL_STAGES) -> DataFrame:
    """Network calls of each stage; a stage without one has 0."""
    dim = calls.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    return dim.join(calls.where(~F.col("cache_hit")).groupBy("stage").agg(F.count(F.lit(1)).alias("n")), "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


def cost_summary(calls: DataFrame, keys: list[str]) -> DataFrame:
    hit = F.col("cache_hit")
    out = calls.groupBy(*keys).agg(
        F.sum(F.when(~hit, F.col("cost_if_billed_inr")).otherwise(0.0)).alias("cost_inr"), F.sum(F.when(hit, F.col("cost_if_billed_inr")).otherwise(0.0)).alias("cost_avoided_inr"),
        F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"),
    )
    return out.withColumn("hit_rate", F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("misses")))


def stage_latency(calls: DataFrame, keys: list[str], stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Summed latency by stage, one column each; null where a stage never ran."""
    return calls.groupBy(*keys).agg(*[F.sum(F.when(F.col("stage") == s, F.col("latency_s"))).alias(f"{s}_s") for s in stages])


def expansion_summary(rows: DataFrame, keys: list[str], over: float = 1.25) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.sum("target_chars") / F.greatest(F.lit(1), F.sum("source_chars"))).alias("corpus_char_ratio"),
        *[f.alias(f"{c}_{n}") for c in ("char_ratio", "syllable_ratio") for n, f in (("mean", F.avg(c)), ("min", F.min(c)), ("max", F.max(c)), ("p95", percentile(c, 95)))],
        F.count_if(F.col("syllable_ratio") > over).alias("over"),
    )


def timing_block(scores: DataFrame, keys: list[str], threshold: float = 5.0, small: int = 20) -> DataFrame:
    out = scores.withColumn("abs_drift", F.abs("signed_drift"))
    return grouped(out, keys, F.count(F.lit(1)).alias("n"), *drift_aggregates("abs_drift", "drift", threshold), F.count_if(F.col("signed_drift") > threshold).alias("overruns"), F.count_if(F.col("signed_drift") < -threshold).alias("underruns"), (F.count(F.lit(1)) < small).alias("small_sample"))


def timeline_totals(placements: DataFrame, media: DataFrame) -> DataFrame:
    """Speech, silence, overflow and mixing totals of each medium; media: m, duration_s."""
    ends = placements.groupBy("m").agg(F.sum("duration_s").alias("speech_s"), F.max(F.col("placed_start_s") + F.col("duration_s")).alias("end_s"), F.sum("clipped_samples").alias("clipped_samples"), F.sum("truncated_frames").alias("truncated_frames"), F.sum("overlapped_frames").alias("overlapped_frames"))
    d, speech = F.col("duration_s"), F.coalesce("speech_s", F.lit(0.0))
    return media.join(ends, "m", "left").select("m", "duration_s", speech.alias("speech_s"), F.greatest(F.lit(0.0), d - speech).alias("silence_s"), F.when(d > 0, speech / d * 100).alias("speech_pct"), F.greatest(F.lit(0.0), F.coalesce("end_s", F.lit(0.0)) - d).alias("overflow_s"), "clipped_samples", "truncated_frames", "overlapped_frames")


def final_attempts(attempts: DataFrame) -> DataFrame:
    """Of each segment the attempt nearest to its target, the first of equals; and the first."""
    ratio = F.when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.col("duration_s") / F.col("target"))
    chosen = F.min_by(F.struct("attempt", "pace", "duration_s"), F.struct(F.abs(ratio - 1), "attempt"))
    out = attempts.groupBy("m", "segment_id").agg(chosen.alias("best"), F.min_by("duration_s", "attempt").alias("baseline"), F.max("attempt").alias("attempts"))
    return out.select("m", "segment_id", "baseline", "attempts", F.col("best.attempt").alias("shipped"), F.col("best.pace").alias("pace"), F.col("best.duration_s").alias("achieved"))


def format_groups(clips: DataFrame) -> DataFrame:
    """Clips by audio format, and whether their medium mixes formats."""
    own = clips.groupBy("m", "rate", "channels").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return own.withColumn("mixed", F.count(F.lit(1)).over(Window.partitionBy("m")) > 1)


def variance_probe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), (F.max(value) - F.min(value)).alias("spread"), ((F.max(value) - F.min(value)) / F.avg(value) * 100).alias("spread_pct"), (F.count_distinct(value) == 1).alias("identical"))


def elasticity(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """Of consecutive paces: d log duration / d log pace, and whether duration falls."""
    w = Window.partitionBy(*keys).orderBy("pace")
    before_d, before_p = F.lag("duration_s").over(w), F.lag("pace").over(w)
    return sweep.select(*keys, "pace", "duration_s", (F.ln(F.col("duration_s") / before_d) / F.ln(F.col("pace") / before_p)).alias("elasticity"), (F.col("duration_s") < before_d).alias("falls"), (F.col("duration_s") * F.col("pace")).alias("product"))


def shares(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A value's share of its group's total and of its maximum, and whether it strays by more than 5 %."""
    w = Window.partitionBy(*keys)
    mean = F.avg(value).over(w)
    return rows.withColumns({"share_pct": F.try_divide(F.col(value), F.sum(value).over(w)) * 100, "bar": F.try_divide(F.col(value), F.max(value).over(w)), "strays": F.try_divide(F.abs(F.col(value) - mean), mean) > 0.05})
