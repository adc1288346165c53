"""Segments from transcripts: spans, stitching, merging of short and splitting of long ones.

Merging and splitting depend on their own earlier results, so they run on one medium at
a time in pandas; everything around them is joins and windows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revoicer import schemas
from revoicer.config import Config, TIMELINE_EPS

#: Boundaries in a text, strongest kind first.
KINDS = (("sentence", re.compile(r"[.!?।]+[\"')\]”’]*\s+")), ("clause", re.compile(r"[,;:—-]+\s+")), ("word", re.compile(r"\s+")))
TIMESTAMPS = "struct<transcript:string,timestamps:struct<words:array<string>,start_time_seconds:array<string>,end_time_seconds:array<string>>,words:array<string>,start_time_seconds:array<string>,end_time_seconds:array<string>>"


def spans_of_payloads(chunks: DataFrame, payload: str = "payload") -> DataFrame:
    """Spans of each chunk (m, idx, start_s, end_s) from its JSON reply; ``source`` is
    api_multi_span, api_single_span (capped, whole transcript) or chunk_fallback."""
    p = F.from_json(payload, TIMESTAMPS)
    part = lambda n: F.coalesce(p["timestamps"][n], p[n])
    number = lambda a: F.transform(a, lambda x: x.try_cast("double"))
    words, starts, ends = part("words"), number(part("start_time_seconds")), number(part("end_time_seconds"))
    n = F.size(words)
    good = F.coalesce((n > 0) & (F.size(starts) == n) & (F.size(ends) == n) & ~F.exists(starts, lambda x: x.isNull()) & ~F.exists(ends, lambda x: x.isNull()), F.lit(False))
    length = F.col("end_s") - F.col("start_s")
    text = F.trim(F.coalesce(p["transcript"], F.lit("")))
    span = lambda a, b, t: F.struct(a.alias("a"), b.alias("b"), t.alias("t"))
    many = F.transform(F.arrays_zip(words.alias("w"), starts.alias("s"), ends.alias("e")), lambda z: span(z["s"], z["e"], F.trim(z["w"])))
    spans = F.when(good & (n > 1), many).when(good & (n == 1), F.array(span(starts[0], F.least(ends[0], length), text))).otherwise(F.array(span(F.lit(0.0), length, text)))
    source = F.when(good & (n > 1), F.lit("api_multi_span")).when(good & (n == 1), F.lit("api_single_span")).otherwise(F.lit("chunk_fallback"))
    return chunks.select("m", "idx", "start_s", "end_s", source.alias("source"), F.posexplode(spans).alias("n", "x")).select("m", "idx", F.col("start_s").alias("chunk_start_s"), F.col("end_s").alias("chunk_end_s"), "source", "n", F.col("x.a").alias("local_start"), F.col("x.b").alias("local_end"), F.col("x.t").alias("text"))


def offset_spans(spans: DataFrame, eps: float = TIMELINE_EPS) -> DataFrame:
    """Local spans on the timeline, clamped to their chunk; order, sign, overlap and
    excess over the chunk are checked and raise."""
    w = Window.partitionBy("m", "idx").orderBy("n")
    length = F.col("chunk_end_s") - F.col("chunk_start_s")
    before = F.lag(F.least("local_end", length)).over(w)
    problem = (
        F.when(F.col("local_start") < -eps, F.lit("a span starts before its chunk")).when(F.col("local_end") < F.col("local_start"), F.lit("a span ends before it starts"))
        .when(F.col("local_end") > length + eps, F.lit("a span ends beyond its chunk")).when(F.col("local_start") < before - eps, F.lit("spans overlap"))
    )
    good = lambda c: F.when(problem.isNotNull(), F.raise_error(problem).cast("double")).otherwise(c)
    inside = lambda c: F.least(F.greatest(c, F.lit(0.0)), length)
    return spans.withColumns({"start_s": good(F.col("chunk_start_s") + inside(F.col("local_start"))), "end_s": good(F.col("chunk_start_s") + inside(F.col("local_end")))})


def stitch(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Segments that tile the timeline from chunks (m, idx, start_s, end_s, cut_source) and
    spans of them: chunk edges pinned, gaps closed, ids dense; a chunk without a span raises."""
    from .timeline import close_gaps, start_sources

    # The chunk table keeps chunks without spans visible, so that they raise.
    sources = start_sources(chunks).select("m", "idx", "start_source")
    rows = sources.join(offset_spans(spans), ["m", "idx"], "left")
    rows = rows.withColumn("n", F.when(F.col("n").isNull(), F.raise_error(F.lit("a chunk has no span")).cast("int")).otherwise(F.col("n")))
    closed = close_gaps(rows)
    first = F.row_number().over(Window.partitionBy("m", "idx").orderBy("n")) == 1
    out = closed.withColumn("boundary_source", F.when(first, F.col("start_source")).otherwise("api_span"))
    ids = F.row_number().over(Window.partitionBy("m").orderBy("idx", "n")) - 1
    return out.select("m", ids.cast("int").alias("id"), "start", "end", "text", F.lit(None).cast("string").alias("speaker"), F.col("idx").alias("chunk_index"), "boundary_source", F.array(ids.cast("int")).alias("origin"))


def text_boundaries(text: str) -> list[tuple[int, int]]:
    """(index, rank) strictly inside the text, the strongest kind at each index."""
    best: dict[int, int] = {}
    for rank, (_, pattern) in enumerate(KINDS):
        for hit in pattern.finditer(text):
            if 0 < hit.end() < len(text):
                best.setdefault(hit.end(), rank)
    return sorted(best.items())


def merged(rows: list[dict], least: float) -> list[dict]:
    """The leftmost short segment joins its only or shorter neighbour (the earlier of
    equals), until none is short or one is left."""
    rows = [dict(r) for r in rows]
    length = lambda r: r["end"] - r["start"]
    while len(rows) > 1 and (short := next((i for i, r in enumerate(rows) if length(r) < least), None)) is not None:
        left = short if short + 1 < len(rows) and (short == 0 or length(rows[short + 1]) < length(rows[short - 1])) else short - 1
        a, b = rows[left], rows[left + 1]
        joined = " ".join(t for t in (a["text"].strip(), b["text"].strip()) if t)
        rows[left : left + 2] = [a | {"end": b["end"], "text": joined, "speaker": a["speaker"] or b["speaker"], "boundary_source": "merged", "origin": sorted({*a["origin"], *b["origin"]})}]
    return rows


def best_split(row: dict, silences: list[float], config: Config) -> tuple[float, int, str] | None:
    """(time, index, label) of the best place to part a segment, or None."""
    text, start, end = row["text"], row["start"], row["end"]
    if len(text) < 2:
        return None
    low, high, middle = start + config.min_segment_s, end - config.min_segment_s, (start + end) / 2
    options = []
    for index, rank in text_boundaries(text):
        time, anchored = start + index / len(text) * (end - start), False
        near = min((s for s in silences if low <= s <= high), key=lambda s: (abs(s - time), s), default=None)
        if near is not None and abs(near - time) <= config.snap_window_s:
            time, anchored = near, True
        if low <= time <= high:
            options.append((rank, not anchored, abs(time - middle), index, time))
    if not options:
        return None
    rank, loose, _, index, time = min(options, key=lambda o: o[:3])
    return time, index, f"{KINDS[rank][0]}+{'estimated' if loose else 'silence'}"


def parted(row: dict, silences: list[float], config: Config, depth: int = 0) -> list[dict]:
    if row["end"] - row["start"] <= config.max_segment_s or depth >= config.split_depth or (cut := best_split(row, silences, config)) is None:
        return [row]
    time, index, label = cut
    left = row | {"end": time, "text": row["text"][:index].strip()}
    right = row | {"start": time, "text": row["text"][index:].strip(), "boundary_source": label}
    return parted(left, silences, config, depth + 1) + parted(right, silences, config, depth + 1)


def post_process(segments: DataFrame, silences: DataFrame, config: Config = Config(), merge: bool = True, split: bool = True) -> DataFrame:
    """Merge short segments, then split long ones at silences (m, start_s, end_s), and
    number them anew. A medium's segments are one group: thousands of rows, not millions."""

    def work(key: tuple, own: pd.DataFrame, quiet: pd.DataFrame) -> pd.DataFrame:
        rows = own.sort_values(["start", "id"]).to_dict("records")
        for r in rows:
            r["origin"] = [int(x) for x in r["origin"]]
        rows = merged(rows, config.min_segment_s) if merge else rows
        mids = sorted(((quiet["start_s"] + quiet["end_s"]) / 2).tolist())
        rows = [p for r in rows for p in parted(r, mids, config)] if split else rows
        for i, r in enumerate(rows):
            r["id"] = i
        return pd.DataFrame(rows, columns=own.columns)

    names = [c.split()[0] for c in schemas.SEGMENT.split(", ")]
    return segments.select(*names).groupBy("m").cogroup(silences.select("m", "start_s", "end_s").groupBy("m")).applyInPandas(work, schemas.SEGMENT).where("id is not null")


def post_process_report(before: DataFrame, after: DataFrame, config: Config = Config()) -> DataFrame:
    length: Column = F.col("end") - F.col("start")
    a = after.groupBy("m").agg(F.count(F.lit(1)).alias("after"), F.count_if(length < config.min_segment_s).alias("still_under"), F.count_if(length > config.max_segment_s).alias("still_over"), F.avg(length).alias("mean_s"))
    return before.groupBy("m").agg(F.count(F.lit(1)).alias("before")).join(a, "m", "full")
