"""Audits: each returns its findings as rows; a fail-fast mode raises on the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(layers: dict[str, DataFrame]) -> DataFrame:
    """Counts of each layer per medium, and whether each hop keeps them.

    layers: ordered name -> rows with m; the first layer is what is expected."""
    names = list(layers)
    joined = None
    for name, rows in layers.items():
        n = rows.groupBy("m").agg(F.count(F.lit(1)).alias(name))
        joined = n if joined is None else joined.join(n, "m", "full")
    zero = joined.select("m", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    hops = [F.struct(F.lit(f"{a}_to_{b}").alias("hop"), F.col(a).alias("expected"), F.col(b).alias("actual"), (F.col(a) == F.col(b)).alias("passed")) for a, b in zip(names, names[1:], strict=False)]
    return zero.select("m", F.inline(F.array(*hops)))


def mux_checks(source: DataFrame, output: DataFrame, tolerance_s: float = 0.25) -> DataFrame:
    """(m, check, expected, actual, passed) of a muxed file's probe against its source's."""
    fields = ("codec", "width", "height", "pix_fmt")
    pair = source.alias("s").join(output.alias("o"), F.col("s.m") == F.col("o.m"))
    text = lambda c: F.col(c).cast("string")
    rows = [F.struct(F.lit(f).alias("check"), text(f"s.{f}").alias("expected"), text(f"o.{f}").alias("actual"), F.col(f"s.{f}").eqNullSafe(F.col(f"o.{f}")).alias("passed")) for f in fields]
    known = F.col("s.nb_frames").isNotNull() & F.col("o.nb_frames").isNotNull()
    rows += [
        F.struct(F.lit("nb_frames").alias("check"), text("s.nb_frames").alias("expected"), text("o.nb_frames").alias("actual"), F.when(known, F.col("s.nb_frames") == F.col("o.nb_frames")).alias("passed")),
        F.struct(F.lit("audio").alias("check"), F.lit("present").alias("expected"), F.when(F.col("o.has_audio"), F.lit("present")).otherwise(F.lit("absent")).alias("actual"), F.coalesce("o.has_audio", F.lit(False)).alias("passed")),
        F.struct(F.lit("duration").alias("check"), text("s.duration_s").alias("expected"), text("o.duration_s").alias("actual"), (F.abs(F.col("s.duration_s") - F.col("o.duration_s")) <= tolerance_s).alias("passed")),
    ]
    return pair.select(F.col("s.m").alias("m"), F.inline(F.array(*rows))).where("passed is not null")


def chunk_acceptance(chunks: DataFrame, max_s: float = 30.0, eps: float = 1e-3) -> DataFrame:
    """Chunks over the cap, and seams that do not meet: (m, idx, problem)."""
    from revoicer.operators.timeline import by_m

    w = by_m().orderBy("idx")
    rows = chunks.withColumn("next", F.lead("start_s").over(w))
    found = F.array(F.when(F.col("end_s") - F.col("start_s") > max_s + eps, F.lit("over the cap")), F.when(F.abs(F.col("next") - F.col("end_s")) > eps, F.lit("does not meet the next")))
    return rows.select("m", "idx", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def seams(segments: DataFrame, silences: DataFrame) -> DataFrame:
    """Every inner boundary with the silence around it, its neighbours and their words."""
    from revoicer.operators.timeline import asof_neighbours, enclosing_silence, seam_texts

    texts = seam_texts(segments)
    points = texts.select("m", F.col("boundary_s").alias("t")).distinct()
    around = enclosing_silence(points, silences).join(asof_neighbours(points, segments), ["m", "t"])
    return texts.join(around.withColumnRenamed("t", "boundary_s"), ["m", "boundary_s"]).withColumn("in_silence", F.col("start_s").isNotNull())


def parts_match(parts: DataFrame, source: DataFrame) -> DataFrame:
    """(m, passed): whether a medium's parts (m, idx, data), in order, are its source's data."""
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("idx", "data"))), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"]))
    own = parts.groupBy("m").agg(F.sha2(joined, 256).alias("own"))
    return source.join(own, "m", "left").select("m", F.sha2("data", 256).eqNullSafe(F.col("own")).alias("passed"))
