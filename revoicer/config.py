"""Parameters of the dubbing pipeline, validated once on the driver."""

from __future__ import annotations

from dataclasses import dataclass

STAGES = ("demux", "asr", "translate", "tts", "assemble", "mux", "qc")
CALL_STAGES = ("asr", "translate", "tts", "qc")
#: Characters that a request of each kind of model may hold.
CHAR_CAPS = {"translate": 1000, "translate-long": 2000, "speech": 2500}
#: Languages that calls accept, modes, and paces.
SPEECH_LANGUAGES = ("bn-IN", "en-IN", "gu-IN", "hi-IN", "kn-IN", "ml-IN", "mr-IN", "od-IN", "pa-IN", "ta-IN", "te-IN")
MORE_LANGUAGES = ("as-IN", "brx-IN", "doi-IN", "kok-IN", "ks-IN", "mai-IN", "mni-IN", "ne-IN", "sa-IN", "sat-IN", "sd-IN", "ur-IN")
LANGUAGES = {"asr": ("unknown", *SPEECH_LANGUAGES, *MORE_LANGUAGES), "translate": SPEECH_LANGUAGES, "translate-long": (*SPEECH_LANGUAGES, *MORE_LANGUAGES), "speech": SPEECH_LANGUAGES}
MODES = {"asr": ("codemix", "transcribe", "translate", "translit", "verbatim"), "translate": ("classic-colloquial", "code-mixed", "formal", "modern-colloquial"), "translate-long": ("formal",)}
PACE_RANGE = (0.5, 2.0)
#: Rupees per hour of speech, and per ten thousand characters.
STT_PER_HOUR, STT_DIARIZED_PER_HOUR, TRANSLATE_PER_10K, TTS_PER_10K = 30.0, 45.0, 20.0, 30.0
TIMELINE_EPS, MAPPING_EPS = 1e-3, 1e-6
NOT_MEASURED = "not yet measured"


class EngineError(Exception):
    """Any failure that the engine reports."""


class ConfigError(EngineError):
    """A parameter outside its range."""


class StitchError(EngineError):
    """Chunks and transcripts that do not fit together."""


class MappingError(EngineError):
    """Translations that do not map onto their segments."""


class CacheMissError(EngineError):
    """A call that a dry run would have to make."""


class AudioError(EngineError):
    """Audio that cannot be read or written."""


class QcError(EngineError):
    """Missing inputs or failed coverage."""


@dataclass(frozen=True)
class Config:
    max_chunk_s: float = 30.0
    min_chunk_s: float = 1.0
    silence_db: float = -40.0
    min_silence_s: float = 0.30
    min_segment_s: float = 1.0
    max_segment_s: float = 15.0
    snap_window_s: float = 1.5
    split_depth: int = 8
    seam_words: int = 6
    char_cap: int = 1000
    batch_fill: float = 0.8
    batch_segments: int = 12
    context_segments: int = 2
    fit_low: float = 0.95
    fit_high: float = 1.05
    fit_attempts: int = 3
    fit_min_step: float = 0.02
    fit_enabled: bool = True
    pace_min: float = 0.85
    pace_max: float = 1.25
    trim_db: float = -40.0
    trim_window_ms: int = 10
    trim_margin_ms: int = 20
    fade_ms: int = 15
    sample_rate: int = 24000
    qc_drift_pct: float = 5.0
    qc_top: int = 5
    wer_weight: float = 1.0
    drift_weight: float = 1.0
    small_sample: int = 20
    mux_tolerance_s: float = 0.25
    source_lang: str = "en-IN"
    target_lang: str = "hi-IN"
    translate_model: str = "translate"
    translate_mode: str = "classic-colloquial"
    translate_batched: bool = True
    max_segments: int | None = None

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ConfigError(what)

        need(0 < self.max_chunk_s <= 30, "max_chunk_s must be in (0, 30]")
        need(0 < self.min_chunk_s <= self.max_chunk_s, "min_chunk_s must be in (0, max_chunk_s]")
        need(self.silence_db < 0 and self.trim_db < 0, "thresholds must be below 0 dB")
        need(self.min_silence_s > 0, "min_silence_s must be positive")
        need(0 < self.min_segment_s < self.max_segment_s, "min_segment_s must be below max_segment_s")
        need(self.char_cap > 0 and 0 < self.batch_fill <= 1, "char_cap and batch_fill must be positive, batch_fill at most 1")
        need(self.batch_segments >= 1 and self.context_segments >= 0, "batch sizes must not be negative")
        need(0 < self.fit_low <= 1 <= self.fit_high, "the fit band must hold 1")
        need(self.fit_attempts >= 1 and self.fit_min_step > 0, "fit_attempts must be 1 or more, fit_min_step positive")
        need(0.5 <= self.pace_min <= 1 <= self.pace_max <= 2.0, "paces must lie in [0.5, 2] around 1")
        need(self.sample_rate > 0 and self.fade_ms >= 0, "sample_rate must be positive, fade_ms not negative")
        need(self.trim_window_ms > 0 and self.trim_margin_ms >= 0, "trim windows must be positive, margins not negative")
        need(self.qc_drift_pct >= 0 and self.qc_top >= 1, "qc_drift_pct must not be negative, qc_top 1 or more")
        need(self.wer_weight >= 0 and self.drift_weight >= 0, "weights must not be negative")
        need(self.mux_tolerance_s > 0, "mux_tolerance_s must be positive")
        need(self.source_lang in LANGUAGES["asr"], "source_lang is not known")
        need(self.translate_model in MODES and self.translate_model != "asr", "translate_model is not known")
        need(self.target_lang in LANGUAGES[self.translate_model], "target_lang is not one that the model knows")
        need(self.translate_mode in MODES[self.translate_model], "translate_mode is not one that the model knows")
        need(self.max_segments is None or self.max_segments >= 1, "max_segments must be 1 or more")


def load_config(env: dict[str, str] | None = None, **given) -> Config:
    """Environment variables ``REVOICER_<FIELD>`` first, then what is given, over the defaults."""
    import os
    from dataclasses import fields

    env = dict(os.environ) if env is None else env
    kinds = {"float": float, "int": int, "str": str, "bool": lambda x: x.lower() in ("1", "true", "yes"), "int | None": int}
    found = {}
    for f in fields(Config):
        if (raw := env.get(f"REVOICER_{f.name.upper()}")) is not None:
            try:
                found[f.name] = kinds[str(f.type)](raw)
            except ValueError as e:
                raise ConfigError(f"REVOICER_{f.name.upper()}: {e}") from e
    return Config(**(found | given))