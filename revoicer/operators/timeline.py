"""Timelines: contiguity, overlaps, seams, silences, all partitioned by the medium ``m``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revoicer.config import MAPPING_EPS, TIMELINE_EPS


def by_m():
    return Window.partitionBy("m")



def violations(segments: DataFrame, media: DataFrame, eps: float = TIMELINE_EPS) -> DataFrame:
    """Segments that break the tiling of [0, D]: (m, id, problem), one row per problem."""
    w = by_m().orderBy("start", "id")
    rows = segments.join(media.select("m", "duration_s"), "m").select(
        "m", "id", "start", "end", "duration_s", F.lead("start").over(w).alias("next"), F.row_number().over(w).alias("n"),
    )
    gap = F.col("next") - F.col("end")
    found = F.filter(
        F.array(
            F.when(F.col("end") - F.col("start") <= 0, F.lit("not positive")), F.when((F.col("n") == 1) & (F.abs("start") > eps), F.lit("does not start at 0")),
            F.when(F.abs(gap) > eps, F.when(gap > 0, F.lit("gap")).otherwise(F.lit("overlap"))), F.when(F.col("next").isNull() & (F.abs(F.col("end") - F.col("duration_s")) > eps), F.lit("does not end with the medium")),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("m", "id", F.explode(found).alias("problem"))


def overlaps(placements: DataFrame, eps: float = TIMELINE_EPS) -> DataFrame:
    """Adjacent clips that overlap, keyed by the left one, with the share of the later clip."""
    w = by_m().orderBy("placed_start_s", "segment_id")
    rows = placements.select("m", "segment_id", (F.col("placed_start_s") + F.col("duration_s")).alias("stop"), F.lead("placed_start_s").over(w).alias("next_start"), F.lead("duration_s").over(w).alias("next_s"), F.lead("segment_id").over(w).alias("right_id"))
    over = F.col("stop") - F.col("next_start")
    return rows.where(over > eps).select("m", F.col("segment_id").alias("left_id"), "right_id", over.alias("overlap_s"), F.when(F.col("next_s") > 0, over / F.col("next_s") * 100).otherwise(0.0).alias("pct_of_right"))


def all_overlaps(placements: DataFrame, eps: float = TIMELINE_EPS, bucket_s: float = 60.0) -> DataFrame:
    """Every overlapping pair, adjacent or not: an equi-join on (m, time bucket) keeps it
    from becoming a nested loop; a pair counts in the bucket where its overlap starts."""
    rows = placements.select("m", "segment_id", F.col("placed_start_s").alias("s"), (F.col("placed_start_s") + F.col("duration_s")).alias("e"))
    spread = rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / bucket_s), F.floor(F.col("e") / bucket_s))))
    a, b = spread.alias("a"), spread.alias("b")
    before = (F.col("a.s") < F.col("b.s")) | ((F.col("a.s") == F.col("b.s")) & (F.col("a.segment_id") < F.col("b.segment_id")))
    over = F.least("a.e", "b.e") - F.col("b.s")
    hit = a.join(b, ["m", "bucket"]).where(before & (over > eps) & (F.col("bucket") == F.floor(F.col("b.s") / bucket_s)))
    return hit.select("m", F.col("a.segment_id").alias("left_id"), F.col("b.segment_id").alias("right_id"), over.alias("overlap_s"))


def renumber(segments: DataFrame) -> DataFrame:
    """Dense ids from 0 in the order of time."""
    return segments.withColumn("id", (F.row_number().over(by_m().orderBy("start", "end", "id")) - 1).cast("int"))


def close_gaps(spans: DataFrame) -> DataFrame:
    """Spans of a chunk stretched to tile it: spans have m, idx, n, start_s, end_s, and
    chunk_start_s, chunk_end_s."""
    w = Window.partitionBy("m", "idx").orderBy("n")
    start = F.when(F.row_number().over(w) == 1, F.col("chunk_start_s")).otherwise(F.col("start_s"))
    return spans.withColumns({"start": start, "end": F.lead("start_s", 1).over(w)}).withColumn("end", F.coalesce("end", "chunk_end_s"))


def start_sources(chunks: DataFrame) -> DataFrame:
    """What made each chunk's start: the last chunk's cut, ``file_start`` for the first."""
    return chunks.withColumn("start_source", F.lag("cut_source", 1, "file_start").over(by_m().orderBy("idx")))


def first_n(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows of each medium, before any paid call."""
    return rows.withColumn("__n", F.row_number().over(by_m().orderBy(order))).where(F.col("__n") <= n).drop("__n")


def with_buckets(rows: DataFrame, start: Column, end: Column, size: float) -> DataFrame:
    return rows.withColumn("bucket", F.explode(F.sequence(F.floor(start / size), F.floor(end / size))))


def enclosing_silence(points: DataFrame, silences: DataFrame, bucket_s: float = 30.0) -> DataFrame:
    """The first silence that holds each point (m, t), null where none does: an equi-join
    on (m, bucket), so a range join never becomes a nested loop."""
    s = with_buckets(silences, F.col("start_s"), F.col("end_s"), bucket_s)
    p = points.withColumn("bucket", F.floor(F.col("t") / bucket_s))
    hit = p.join(s, ["m", "bucket"]).where(F.col("t").between(F.col("start_s"), F.col("end_s")))
    best = hit.groupBy("m", "t").agg(F.min_by(F.struct("start_s", "end_s"), F.struct("start_s", "end_s")).alias("x"))
    return points.join(best, ["m", "t"], "left").select("m", "t", F.col("x.start_s").alias("start_s"), F.col("x.end_s").alias("end_s"))


def nearest_silence(points: DataFrame, silences: DataFrame, snap_s: float = 1.5) -> DataFrame:
    """The silence whose middle is nearest to each point, at most snap_s away; ties to the earlier."""
    mids = silences.select("m", ((F.col("start_s") + F.col("end_s")) / 2).alias("mid"))
    s = with_buckets(mids, F.col("mid") - snap_s, F.col("mid") + snap_s, snap_s)
    p = points.withColumn("bucket", F.floor(F.col("t") / snap_s))
    hit = p.join(s, ["m", "bucket"]).where(F.abs(F.col("mid") - F.col("t")) <= snap_s)
    best = hit.groupBy("m", "t").agg(F.min_by("mid", F.struct(F.abs(F.col("mid") - F.col("t")), "mid")).alias("mid"))
    return points.join(best, ["m", "t"], "left").select("m", "t", "mid")


def asof_neighbours(points: DataFrame, segments: DataFrame, eps: float = TIMELINE_EPS) -> DataFrame:
    """For each point (m, t) the segment that ends last at or before it and the one that
    starts first at or after it. One union and two sorts per medium, no range join: either
    neighbour is the last one seen, going forwards or backwards."""
    p = points.select("m", F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("ends"), F.lit(None).cast("int").alias("starts"))
    e = segments.select("m", (F.col("end") - eps).alias("at"), F.lit(0).alias("kind"), F.col("id").cast("int").alias("ends"), F.lit(None).cast("int").alias("starts"))
    s = segments.select("m", (F.col("start") + eps).alias("at"), F.lit(2).alias("kind"), F.lit(None).cast("int").alias("ends"), F.col("id").cast("int").alias("starts"))
    order = (F.col("at"), F.col("kind"), F.coalesce("ends", "starts"))
    seen = lambda c, by: F.last(c, True).over(by_m().orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    rows = p.unionByName(e).unionByName(s)
    back, ahead = seen("ends", order), seen("starts", [c.desc() for c in order])
    return rows.withColumns({"before_id": back, "after_id": ahead}).where("kind = 1").select("m", F.col("at").alias("t"), "before_id", "after_id")


def seam_texts(segments: DataFrame, n: int = 6) -> DataFrame:
    """The last words before and the first words after each inner boundary."""
    w = by_m().orderBy("start", "id")
    parts = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = segments.select("m", "id", "end", parts.alias("ws"), F.lead(parts).over(w).alias("next"))
    tail = F.slice(F.col("ws"), F.greatest(F.lit(1), F.size("ws") - n + 1), F.lit(n))
    return rows.where(F.col("next").isNotNull()).select("m", "id", F.col("end").alias("boundary_s"), F.array_join(tail, " ").alias("before"), F.array_join(F.slice("next", 1, n), " ").alias("after"))


def gaps_and_islands(samples: DataFrame, threshold: float, min_length: int) -> DataFrame:
    """Runs of at least min_length samples (m, i, x) under the threshold: m, first, last, length."""
    w = by_m().orderBy("i")
    quiet = samples.withColumn("q", F.abs("x") < threshold)
    runs = quiet.withColumn("turn", (F.col("q") != F.lag("q", 1, None).over(w)).cast("int")).withColumn("run", F.sum(F.coalesce("turn", F.lit(0))).over(w))
    out = runs.where("q").groupBy("m", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("length"))
    return out.where(F.col("length") >= min_length).select("m", "first", "last", "length")


def mapping_audit(before: DataFrame, after: DataFrame, eps: float = MAPPING_EPS) -> DataFrame:
    """Where a translated table does not map one to one onto its source: (m, n, problem).

    Rows are paired by place; both have m, id, start, end, text, after also translation.
    """
    number = lambda df: df.withColumn("n", F.row_number().over(by_m().orderBy("start", "id")))
    a, b = number(before).alias("a"), number(after).alias("b")
    pair = a.join(b, (F.col("a.m") == F.col("b.m")) & (F.col("a.n") == F.col("b.n")), "full")
    differs = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > eps
    found = F.array(
        F.when(F.col("a.n").isNull() | F.col("b.n").isNull(), F.lit("count")), F.when(F.col("a.id") != F.col("b.id"), F.lit("id")), F.when(differs("start") | differs("end"), F.lit("time")),
        F.when(F.col("a.text") != F.col("b.text"), F.lit("text")), F.when(F.col("b.n").isNotNull() & (F.trim(F.coalesce("b.translation", F.lit(""))) == ""), F.lit("empty")),
    )
    rows = pair.select(F.coalesce("a.m", "b.m").alias("m"), F.coalesce("a.n", "b.n").alias("n"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))
    twice = after.groupBy("m", "id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("m", F.col("id").cast("int").alias("n"), F.lit("duplicate id").alias("problem"))
    return rows.unionByName(twice)


def require_none(found: DataFrame, error: type[Exception], what: str) -> None:
    """Fail-fast mode of an audit: raise with its first finding."""
    if (row := found.limit(1).collect()) != []:
        raise error(f"{what}: {row[0].asDict()}")
