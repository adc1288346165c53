"""PCM signals: arrays of int16 samples as ARRAY<INT>; native higher-order functions, but
for the mix, whose blocks of clips are folded in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revoicer.functions.scalar import amplitude, dbfs

LOW, HIGH = -32768, 32767


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("int")))), F.lit(0))


def peak_dbfs(samples: Column) -> Column:
    return dbfs(peak(samples) / 32768)


def frame_peaks(samples: Column, channels: int = 1) -> Column:
    """The loudest channel of each frame of interleaved samples."""
    if channels == 1:
        return F.transform(samples, lambda x: F.abs(x.cast("int")))
    n = (F.size(samples) / channels).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: peak(F.slice(samples, i * channels + 1, F.lit(channels))))).otherwise(F.expr("cast(array() as array<int>)"))


def trim_bounds(samples: Column, rate: Column, threshold_db: float = -40.0, window_ms: int = 10, margin_ms: int = 20) -> Column:
    """struct<first, stop, all_silent>: frames kept, from the first to the last loud
    window with a margin; an all-silent signal is kept whole."""
    n = F.size(samples)
    win = F.greatest(F.lit(1), (rate * window_ms / 1000).cast("int"))
    margin = (rate * margin_ms / 1000).cast("int")
    count = F.ceil(n / win).cast("int")
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
    loud = F.filter(blocks, lambda b: peak(F.slice(samples, b * win + 1, win)) / 32768 >= amplitude(F.lit(threshold_db)))
    silent = F.size(loud) == 0
    first = F.when(silent, 0).otherwise(F.greatest(F.lit(0), F.array_min(loud) * win - margin))
    stop = F.when(silent, n).otherwise(F.least(n, (F.array_max(loud) + 1) * win + margin))
    return F.struct(first.cast("int").alias("first"), stop.cast("int").alias("stop"), silent.alias("all_silent"))


def trimmed(df: DataFrame, samples: str = "samples", rate: str = "rate", threshold_db: float = -40.0, window_ms: int = 10, margin_ms: int = 20) -> DataFrame:
    """Adds trimmed samples, durations, lead and trail trims, all_silent, peak_dbfs."""
    s, r = F.col(samples), F.col(rate)
    out = df.withColumn("__t", trim_bounds(s, r, threshold_db, window_ms, margin_ms))
    kept = F.slice(s, F.col("__t.first") + 1, F.col("__t.stop") - F.col("__t.first"))
    cols = {"trimmed": kept, "duration_s": (F.col("__t.stop") - F.col("__t.first")) / r, "original_duration_s": F.size(s) / r, "lead_trim_s": F.col("__t.first") / r, "trail_trim_s": (F.size(s) - F.col("__t.stop")) / r, "all_silent": F.col("__t.all_silent"), "peak_dbfs": peak_dbfs(s)}
    return out.withColumns(cols).drop("__t")


def faded(samples: Column, rate: Column, fade_ms: int = 15) -> Column:
    """Linear fades at both ends, truncated to whole samples; the first is exactly 0."""
    n = F.size(samples)
    fade = F.least((rate * fade_ms / 1000).cast("int"), F.floor(n / 2).cast("int"))
    gain = lambda i: F.least(F.lit(1.0), i / F.greatest(fade, F.lit(1)), (n - 1 - i) / F.greatest(fade, F.lit(1)))
    return F.when(fade <= 0, samples).otherwise(F.transform(samples, lambda x, i: (x * gain(i)).cast("int")))


def clamp16(x: Column) -> Column:
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), x))


def pcm_slice(samples: Column, rate: Column, start_s: Column, end_s: Column) -> Column:
    """Samples of [start, end) by nearest frame; an empty range raises, the end is clamped."""
    first, last = F.greatest(F.lit(0), F.bround(start_s * rate)).cast("int"), F.least(F.bround(end_s * rate).cast("int"), F.size(samples))
    return F.when(last <= first, F.raise_error(F.lit("the slice is empty")).cast("array<int>")).otherwise(F.slice(samples, first + 1, last - first))


#: Frames of a tile, and clips of a block: clips are cut to tiles, and the clips of a tile
#: are taken in blocks. Tasks hold one block's parts at a time, however many clips meet.
TILE, BLOCK = 4096, 1024


def parts(clips: DataFrame, canvas: DataFrame) -> DataFrame:
    """(m, tile, block, pos, ord, at, s): of each tile of the canvas the samples s that clips
    have in it, from its frame ``at`` on; pos is the clip's place in its medium."""
    order = clips.select("m", "ord").distinct().withColumn("pos", F.row_number().over(Window.partitionBy("m").orderBy("ord")) - 1).join(canvas, "m")
    order = order.select(F.col("m").alias("__m"), F.col("ord").alias("__ord"), "pos", F.floor(F.col("pos") / BLOCK).cast("int").alias("block"), "frames")
    rows = clips.join(order, (F.col("m") == F.col("__m")) & F.col("ord").eqNullSafe(F.col("__ord")))
    rows = rows.withColumn("stop", F.least(F.col("offset") + F.size("samples"), F.col("frames")).cast("int")).withColumn("from", F.greatest("offset", F.lit(0)).cast("int")).where("from < stop")
    rows = rows.withColumn("tile", F.explode(F.expr(f"sequence(cast(from div {TILE} as int), cast((stop - 1) div {TILE} as int))")))
    a, z = F.greatest("from", F.col("tile") * TILE), F.least("stop", (F.col("tile") + 1) * TILE)
    own = F.slice("samples", (a - F.col("offset") + 1).cast("int"), (z - a).cast("int")).cast("array<int>")
    return rows.select("m", "tile", "block", "pos", F.col("ord").cast("long").alias("ord"), (a - F.col("tile") * TILE).cast("int").alias("at"), own.alias("s"))


def in_order(rows: pd.DataFrame) -> list[tuple]:
    """(ord, frames, samples) of a block's parts in order; equal places by their samples.
    Samples that are null are left out."""
    out = []
    for pos, ord_, at, s in zip(rows["pos"], rows["ord"], rows["at"], rows["s"]):
        x = np.asarray(s, "f8")
        known = ~np.isnan(x)
        w = slice(at, at + len(x)) if known.all() else at + np.flatnonzero(known)
        out.append((pos, -at, ord_, w, x[known].astype("i8")))
    twice = rows["pos"].duplicated().any()
    return [x[2:] for x in sorted(out, key=lambda x: (*x[:2], x[4].tolist()) if twice else x[0])]


def steps(clips_parts: DataFrame) -> DataFrame:
    """Of each block the one step that its clips make: clamped additions in a row are
    x -> least(high, greatest(low, x + added)) at each frame, from ``at`` on."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        added, low, high, hit = np.zeros(TILE, "i8"), np.full(TILE, LOW), np.full(TILE, HIGH), np.zeros(TILE, bool)
        for _, w, s in in_order(rows):
            added[w] += s
            low[w], high[w] = np.clip(low[w] + s, LOW, HIGH), np.clip(high[w] + s, LOW, HIGH)
            hit[w] = True
        a, z = np.flatnonzero(hit)[[0, -1]] + (0, 1) if hit.any() else (0, 0)
        return pd.DataFrame({"m": [key[0]], "tile": [key[1]], "block": [key[2]], "at": [a], "added": [added[a:z]], "low": [low[a:z]], "high": [high[a:z]], "hit": [hit[a:z]]})

    kind = clips_parts.schema["m"].dataType.simpleString()
    return clips_parts.groupBy("m", "tile", "block").applyInPandas(one, f"m {kind}, tile int, block int, at int, added array<bigint>, low array<int>, high array<int>, hit array<boolean>")


def walked(rows: pd.DataFrame) -> Iterator[tuple]:
    """(block, from, to, mix, hit) before each step of a tile; the mix goes on in place."""
    x, hit = np.zeros(TILE, "i8"), np.zeros(TILE, bool)
    for r in rows.sort_values("block").itertuples():
        z = r.at + len(r.added)
        yield r.block, r.at, z, x, hit
        x[r.at : z] = np.clip(x[r.at : z] + r.added, r.low, r.high)
        hit[r.at : z] |= r.hit
    yield None, 0, 0, x, hit


def mix(clips: DataFrame, canvas: DataFrame) -> DataFrame:
    """Mix clips (m, ord, offset, samples) into silence of canvas (m, frames), one by one
    in order with clamping after each: (m, i, x) for every frame that a clip touches; the
    rest are zeros."""

    def last(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *_, (_, _, _, x, hit) = walked(rows)
        i = np.flatnonzero(hit)
        return pd.DataFrame({"m": pd.Series([key[0]] * len(i)), "i": key[1] * TILE + i, "x": x[i]})

    return steps(parts(clips, canvas)).groupBy("m", "tile").applyInPandas(last, f"m {clips.schema['m'].dataType.simpleString()}, i int, x int")


def mix_counts(clips: DataFrame, canvas: DataFrame) -> DataFrame:
    """Of each clip: written, truncated and overlapped frames, and clipped samples."""
    own, kind = parts(clips, canvas), clips.schema["m"].dataType.simpleString()

    def before(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = [(*key, block, a, x[a:z].copy()) for block, a, z, x, _ in walked(rows) if block is not None]
        return pd.DataFrame(found, columns=["m", "tile", "block", "at", "x"])

    def marked(key: tuple, rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        x, out = np.zeros(TILE, "i8"), []
        for at, s in zip(start["at"], start["x"]):
            x[at : at + len(s)] = s
        for ord_, w, s in in_order(rows):
            old, total = x[w], x[w] + s
            out.append((key[0], ord_, len(s), int((old != 0).sum()), int(((total < LOW) | (total > HIGH)).sum())))
            x[w] = np.clip(total, LOW, HIGH)
        return pd.DataFrame(out, columns=["m", "ord", "written", "over", "clip"])

    keys = ("m", "tile", "block")
    starts = steps(own).groupBy("m", "tile").applyInPandas(before, f"m {kind}, tile int, block int, at int, x array<int>")
    marks = own.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(marked, f"m {kind}, ord bigint, written int, over int, clip int")
    marks = marks.groupBy("m", "ord").agg(F.sum("written").alias("written"), F.sum("over").alias("overlapped"), F.sum("clip").alias("clipped"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    every = clips.select("m", "ord", F.size("samples").alias("n"))
    return every.join(marks, ["m", "ord"], "left").select("m", "ord", zero("written"), (F.col("n") - F.coalesce("written", F.lit(0))).cast("long").alias("truncated"), zero("overlapped"), zero("clipped"))


def silent(frames: Column) -> Column:
    return F.array_repeat(F.lit(0), frames.cast("int"))


def assemble(clips: DataFrame, media: DataFrame, fade_ms: int = 15) -> tuple[DataFrame, DataFrame]:
    """Clips (m, segment_id, start_s, lead_trim_s, rate, samples) on media (m, duration_s,
    rate): the mixed frames and the placements. The canvas is the source's length, or the
    last clip's end where that lies beyond."""
    from revoicer.functions.scalar import frames, placed_start
    from revoicer.operators.timeline import by_m

    at = placed_start(F.col("start_s"), F.col("lead_trim_s"))
    own = clips.withColumn("placed_start_s", at).withColumn("offset", frames(at, F.col("rate"))).withColumn("samples", faded(F.col("samples"), F.col("rate"), fade_ms))
    own = own.withColumn("ord", F.row_number().over(by_m().orderBy("placed_start_s", "segment_id"))).withColumn("duration_s", F.size("samples") / F.col("rate"))
    ends = own.groupBy("m").agg(F.max(F.col("offset") + F.size("samples")).alias("stop"))
    canvas = media.join(ends, "m", "left").select("m", F.greatest(frames(F.col("duration_s"), F.col("rate")), F.coalesce("stop", F.lit(0))).alias("frames"))
    counts = mix_counts(own.select("m", "ord", "offset", "samples"), canvas)
    placed = own.drop("samples", "offset").join(counts, ["m", "ord"]).drop("ord")
    return mix(own.select("m", "ord", "offset", "samples"), canvas), placed
