"""Quality control: scoring of segments, corpus rates, ranking, and the whole stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revoicer.config import Config, QcError
from revoicer.functions import scalar as S
from revoicer.functions import text as X
from revoicer.operators.timeline import overlaps

EMPTY = "qc-empty-hypothesis"


def score_pairs(pairs: DataFrame, composed: bool = False) -> DataFrame:
    """Adds wer, cer, edits, ref_words, hyp_words, latin to pairs with reference and hypothesis.

    An empty hypothesis is all deletions (both rates 1); an empty reference raises."""
    once = lambda df, **c: df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in c.items()]))))  # noqa: E731  not again for every use
    out = once(pairs, r=X.normalised(F.col("reference"), composed), h=X.normalised(F.col("hypothesis"), composed))
    out = out.withColumn("r", F.when(F.col("r") == "", F.raise_error(F.lit("the reference has no words"))).otherwise(F.col("r")))
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    out = once(out, rw=split("r"), hw=split("h"))
    out = once(out, edits=X.word_distance(F.col("rw"), F.col("hw")))
    n = F.size("rw")
    return out.withColumns({"ref_words": n, "hyp_words": F.size("hw"), "wer": F.when(F.size("hw") == 0, F.lit(1.0)).otherwise(F.col("edits") / n), "cer": X.cer(F.col("r"), F.col("h")), "latin": X.latin_tokens(F.col("r"))}).drop("rw", "hw")


def corpus_rates(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Micro-averaged rates: all edits over all reference units. An empty hypothesis counts
    as one wrong token for words and characters, as it does where texts are joined."""
    hyp = F.when(F.col("h") == "", F.lit(EMPTY)).otherwise(F.col("h"))
    edits = F.when(F.col("h") == "", F.greatest(F.col("ref_words"), F.lit(1))).otherwise(F.col("edits"))
    rows = scored.select(*keys, edits.alias("we"), "ref_words", F.levenshtein("r", hyp).alias("ce"), F.char_length("r").alias("rc"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("we").alias("word_edits"), F.sum("ref_words").alias("ref_words"), F.sum("ce").alias("char_edits"), F.sum("rc").alias("ref_chars"), (F.sum("we") / F.sum("ref_words")).alias("wer"), (F.sum("ce") / F.sum("rc")).alias("cer"))


def back_transcription_windows(placements: DataFrame, max_s: float = 30.0) -> DataFrame:
    """Windows to transcribe, cut to equal pieces where longer than the model takes."""
    length = F.col("window_end_s") - F.col("window_start_s")
    pieces = F.when(length > max_s, F.floor(length / max_s) + 1).otherwise(1)
    rows = placements.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces").cast("int") - 1)))
    at = lambda k: F.col("window_start_s") + length * k / F.col("pieces")
    return rows.select("m", "segment_id", "piece", at(F.col("piece")).alias("start_s"), at(F.col("piece") + 1).alias("end_s"))


def join_pieces(replies: DataFrame) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda p: F.trim(p["text"]))
    return replies.groupBy("m", "segment_id").agg(F.array_join(F.filter(parts, lambda t: t != ""), " ").alias("hypothesis"))


def qc_rows(placements: DataFrame, segments: DataFrame, fits: DataFrame, hypotheses: DataFrame, config: Config = Config(), composed: bool = False) -> DataFrame:
    """One scored row per placement: rates, drift, overlap, combined score, reasons, flag."""
    found = placements.join(segments.select("m", F.col("id").alias("segment_id"), F.col("translation").alias("reference")), ["m", "segment_id"])
    f = fits.select("m", "segment_id", *[F.col(c).alias(f"f_{c}") for c in ("target", "achieved", "final_pace", "attempts", "clamped", "converged")])
    over = overlaps(placements).select("m", F.col("left_id").alias("segment_id"), "overlap_s")
    rows = found.join(hypotheses, ["m", "segment_id"]).join(f, ["m", "segment_id"], "left").join(over, ["m", "segment_id"], "left")
    window = F.col("window_end_s") - F.col("window_start_s")
    orelse = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), other)
    rows = rows.withColumns({"target": orelse("f_target", window), "achieved": orelse("f_achieved", F.col("duration_s")), "overlap_s": F.coalesce("overlap_s", F.lit(0.0)), "clamped": F.coalesce("f_clamped", F.lit(False)), "converged": F.coalesce("f_converged", F.lit(False)), "final_pace": orelse("f_final_pace", F.lit(1.0)), "attempts": F.coalesce("f_attempts", F.lit(0))})
    scored = score_pairs(rows, composed=composed).withColumn("signed_drift", S.signed_drift_pct(F.col("achieved"), F.col("target")))
    scored = scored.withColumn("abs_drift", F.abs("signed_drift"))
    why = S.reasons({c: F.col(c) for c in ("wer", "hyp_words", "signed_drift", "clamped", "overlap_s", "latin")}, config.qc_drift_pct)
    flag = (F.col("wer") > 0) | (F.col("abs_drift") > config.qc_drift_pct) | (F.col("overlap_s") > 0)
    return scored.withColumns({"combined": S.combined_score(F.col("wer"), F.col("abs_drift"), config.wer_weight, config.drift_weight), "reasons": why, "flagged": flag, "timestamp": S.timestamp(F.col("window_start_s"))})


def ranked(scores: DataFrame, top: int | None = None) -> DataFrame:
    """Rank of each segment in its medium, worst first, ties by id."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("m").orderBy(F.desc("combined"), "segment_id")))
    return out if top is None else out.where(F.col("rank") <= top)


def audit_inputs(placements: DataFrame, segments: DataFrame) -> DataFrame:
    """Placements without a segment, or whose segment has no translation."""
    s = segments.select("m", F.col("id").alias("segment_id"), F.trim(F.coalesce("translation", F.lit(""))).alias("t"))
    rows = placements.select("m", "segment_id").join(s, ["m", "segment_id"], "left")
    return rows.select("m", "segment_id", F.when(F.col("t").isNull(), F.lit("no segment")).when(F.col("t") == "", F.lit("no translation")).alias("problem")).where("problem is not null")


def run_qc(placements: DataFrame, segments: DataFrame, fits: DataFrame, hypotheses: DataFrame, config: Config = Config()) -> DataFrame:
    from revoicer.operators.timeline import require_none

    require_none(audit_inputs(placements, segments), QcError, "a placement can't be scored")
    return ranked(qc_rows(placements, segments, fits, hypotheses, config))
