"""The stages of a dub over tables: each reads its inputs, writes Parquet keyed by ``m``,
and can be run alone from what earlier ones wrote; metrics are written even on failure."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revoicer.config import STAGES, Config, EngineError
from revoicer.operators import audit, calls, folds, pcm, qc, segments, stats, timeline


class Workspace:
    """Tables of one run below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            raise EngineError(f"{name} is not there: run the stage that writes it first") from e

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read(name)


def asr(w: Workspace, backend: Callable[[DataFrame], DataFrame], config: Config) -> None:
    """Chunks by the ladder, a call per chunk, stitched and post-processed segments."""
    media = w.read("media")
    plan = w.write(folds.plan_adaptive(media, w.read("silences_at"), config), "plan")
    chunks = plan.select("m", F.inline("chunks"))
    chunks = chunks if config.max_segments is None else timeline.first_n(chunks, config.max_segments, "idx")
    replies = w.write(backend(chunks).select("m", "idx", "start_s", "end_s", "cut_source", "payload"), "asr_replies")
    stitched = segments.stitch(replies.drop("payload"), segments.spans_of_payloads(replies))
    out = w.write(segments.post_process(stitched, w.read("silences"), config), "segments")
    covered = replies.groupBy("m").agg(F.max("end_s").alias("duration_s"))
    timeline.require_none(timeline.violations(out, covered), EngineError, "the timeline is not sound")
    w.write(audit.seams(out, w.read("silences")), "seams")


def translate(w: Workspace, backend: calls.Backend, config: Config) -> None:
    own = calls.translatable(w.read("segments"), config)
    found, counters = calls.translate_segments(own, backend, config)
    w.write(counters, "translate_stats")
    w.write(calls.with_translations(own, w.write(found, "translations")), "translated")
    after = w.read("translated")
    timeline.require_none(timeline.mapping_audit(own, after), calls.MappingError, "the translation does not map onto its segments")


def tts(w: Workspace, backend: calls.Backend, config: Config) -> None:
    rows = calls.synthesisable(w.read("translated")).select("m", F.col("id").alias("segment_id"), F.col("translation").alias("text"), (F.col("end") - F.col("start")).alias("target"))
    attempts = w.write(calls.fit_rounds(rows, backend, config), "attempts")
    ends = attempts.groupBy("m", "segment_id").agg(F.max("clamped").alias("clamped"), F.max_by("stop_reason", "attempt").alias("stop_reason"), F.max("target").alias("target"))
    fits = stats.final_attempts(attempts).join(ends, ["m", "segment_id"]).withColumn("converged", F.col("stop_reason") == "converged").withColumnRenamed("pace", "final_pace")
    w.write(stats.duration_fit_stats(w.write(fits, "fits"), ["m"], config.small_sample), "fit_stats")


def assemble(w: Workspace, config: Config) -> None:
    """Clips (m, segment_id, lead_trim_s, rate, samples) placed at their segments."""
    starts = w.read("segments").select("m", F.col("id").alias("segment_id"), F.col("start").alias("start_s"), F.col("start").alias("window_start_s"), F.col("end").alias("window_end_s"))
    mixed, placed = pcm.assemble(w.read("clips").join(starts, ["m", "segment_id"]), w.read("media"), config.fade_ms)
    w.write(mixed, "mixed")
    placed = w.write(placed.withColumnsRenamed({"clipped": "clipped_samples", "truncated": "truncated_frames", "overlapped": "overlapped_frames"}).drop("rate"), "placements")
    w.write(timeline.overlaps(placed), "overlaps")
    w.write(stats.timeline_totals(placed, w.read("media")), "timeline_totals")


def quality(w: Workspace, backend: Callable[[DataFrame], DataFrame], config: Config) -> None:
    """Scores, rates, coverage; coverage that fails raises after all is written."""
    placed = w.read("placements")
    pieces = backend(qc.back_transcription_windows(placed, config.max_chunk_s))
    scores = w.write(qc.run_qc(placed, w.read("translated"), w.read("fits"), w.write(qc.join_pieces(pieces), "hypotheses"), config), "scores")
    w.write(qc.corpus_rates(scores, ["m"]), "rates")
    w.write(stats.timing_block(scores, ["m"], config.qc_drift_pct, config.small_sample), "timing")
    hops = w.write(audit.coverage({"translated": w.read("translated"), "synthesised": w.read("fits"), "placed": placed, "scored": scores}), "coverage")
    timeline.require_none(hops.where(~F.col("passed")), qc.QcError, "coverage failed")


def run(w: Workspace, work: dict[str, Callable[[], None]], only: str | None = None) -> None:
    """Run the stages of ``work`` in order, or one; latencies are written in any case."""
    took: list[tuple[str, float, bool]] = []
    try:
        for name in STAGES if only is None else (only,):
            if name in work:
                began, ok = time.perf_counter(), False
                try:
                    work[name]()
                    ok = True
                finally:
                    took.append((name, time.perf_counter() - began, ok))
    finally:
        if took:
            w.write(w.spark.createDataFrame(took, "stage string, latency_s double, ok boolean"), "metrics")
