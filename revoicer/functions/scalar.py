"""Scalar expressions: times, levels, costs, drifts. All take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revoicer.config import STT_DIARIZED_PER_HOUR, STT_PER_HOUR, TRANSLATE_PER_10K, TTS_PER_10K


def amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def dbfs(level: Column) -> Column:
    """Level in dBFS; silence is minus infinity."""
    return F.when(level <= 0, F.lit(float("-inf"))).otherwise(20 * F.log10(level))


def frames(seconds: Column, rate: int | Column) -> Column:
    """Nearest frame, halves to even, never negative."""
    return F.greatest(F.lit(0), F.bround(seconds * rate)).cast("long")


def seconds(frame: Column, rate: Column) -> Column:
    return frame / F.when(rate > 0, rate).otherwise(F.raise_error(F.lit("frame rate must be positive")).cast("int"))


def stt_cost(duration_s: Column, diarized: bool = False) -> Column:
    return F.ceil(F.greatest(F.lit(0.0), duration_s)) * (STT_DIARIZED_PER_HOUR if diarized else STT_PER_HOUR) / 3600


def translate_cost(chars: Column) -> Column:
    return F.ceil(F.greatest(F.lit(0.0), chars)) * TRANSLATE_PER_10K / 10000


def tts_cost(chars: Column) -> Column:
    return F.ceil(F.greatest(F.lit(0.0), chars)) * TTS_PER_10K / 10000


def signed_drift_pct(achieved: Column, target: Column) -> Column:
    return F.when(target <= 0, F.lit(0.0)).otherwise((achieved - target) / target * 100)


def drift_pct(achieved: Column, target: Column) -> Column:
    return F.abs(signed_drift_pct(achieved, target))


def overrun_pct(achieved: Column, target: Column) -> Column:
    return F.greatest(F.lit(0.0), signed_drift_pct(achieved, target))


def fit_ratio(achieved: Column, target: Column) -> Column:
    return F.when(target <= 0, F.lit(0.0)).otherwise(achieved / target)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def was_clamped(value: Column, low: float, high: float) -> Column:
    return F.abs(clamp(value, low, high) - value) > 1e-9


def pace_key(pace: Column) -> Column:
    return F.bround(pace, 4)


def fill_pct(duration_s: Column, window_s: Column) -> Column:
    return F.when(window_s <= 0, F.lit(0.0)).otherwise(duration_s / window_s * 100)


def placed_start(start_s: Column, lead_trim_s: Column) -> Column:
    return start_s + F.coalesce(lead_trim_s, F.lit(0.0))


def timestamp(s: Column) -> Column:
    """``mm:ss.mmm``; minutes may pass 59."""
    minutes = F.floor(s / 60)
    return F.format_string("%02d:%06.3f", minutes, s - minutes * 60)


def combined_score(wer: Column, abs_drift_pct: Column, wer_weight: float = 1.0, drift_weight: float = 1.0) -> Column:
    return wer * wer_weight + abs_drift_pct / 100 * drift_weight


def realtime_factor(wall_s: Column, duration_s: Column) -> Column:
    return F.when(duration_s > 0, F.bround(wall_s / duration_s, 4))


def or_sentinel(value: Column, sentinel: str) -> Column:
    """For JSON sinks alone: a missing number becomes the sentinel's text."""
    return F.coalesce(value.cast("string"), F.lit(sentinel))


def reasons(row: dict[str, Column], threshold: float) -> Column:
    """Why a segment was flagged, in order: row has wer, hyp_words, signed_drift,
    clamped, overlap_s, latin (tokens of the reference)."""
    drift = F.abs(row["signed_drift"])
    word = F.when(row["signed_drift"] > 0, F.lit("overruns")).otherwise(F.lit("underruns"))
    found = F.array(
        F.when(row["hyp_words"] == 0, F.lit("no speech was recognised in the window")),
        F.when(row["wer"] >= 0.5, F.format_string("high word error rate (%.3f)", row["wer"])),
        F.when((row["wer"] > 0) & (row["wer"] < 0.5), F.format_string("word error rate %.3f", row["wer"])),
        F.when(drift > threshold, F.format_string("%s its window by %.1f%%", word, drift)),
        F.when(row["clamped"], F.lit("pace was clamped")),
        F.when(row["overlap_s"] > 0, F.format_string("overlaps the next clip by %.3f s", row["overlap_s"])),
        F.when(row["latin"] > 0, F.format_string("%d tokens of the reference are in Latin script", row["latin"])),
    )
    return F.filter(found, lambda x: x.isNotNull())
