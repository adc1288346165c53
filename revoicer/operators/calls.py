"""External calls as DataFrames: checks before any call, translation in batches with a
fallback line by line, and the fit loop against a real synthesiser, round by round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revoicer.config import CHAR_CAPS, LANGUAGES, MODES, PACE_RANGE, Config, EngineError, MappingError
from revoicer.operators import folds
from revoicer.operators.timeline import first_n, require_none

#: A backend takes calls (m, id, text, ...) and returns them with ``reply``.
Backend = Callable[[DataFrame], DataFrame]


def checked(value: Column, ok: Column, what: str) -> Column:
    """The value, or an error before the call is made."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)).cast("string"))


def check_translate(calls: DataFrame, model: str = "translate") -> DataFrame:
    """Length, language and mode of translation calls (text, target, mode)."""
    t = F.col("text")
    for ok, what in (
        (F.trim(t) != "", "a text is blank"), (F.char_length(t) <= CHAR_CAPS[model], "a text is longer than the model takes"),
        (F.col("target").isin(*LANGUAGES[model]), "the model does not know the language"), (F.col("mode").isin(*MODES[model]), "the model does not know the mode"),
    ):
        t = checked(t, ok, what)
    return calls.withColumn("text", t)


def check_speech(calls: DataFrame) -> DataFrame:
    """Length, language and pace of synthesis calls (text, lang, pace)."""
    t = F.col("text")
    for ok, what in ((F.trim(t) != "", "a text is blank"), (F.char_length(t) <= CHAR_CAPS["speech"], "a text is longer than the model takes"), (F.col("lang").isin(*LANGUAGES["speech"]), "the model does not know the language"), (F.col("pace").between(*PACE_RANGE), "the pace is out of range")):
        t = checked(t, ok, what)
    return calls.withColumn("text", t)


def check_audio(calls: DataFrame, max_s: float = 30.0) -> DataFrame:
    """Length, language and mode of transcription calls (duration_s, lang, mode, audio)."""
    a = F.col("audio")
    for ok, what in ((F.col("duration_s") <= max_s, "the audio is longer than the model takes"), (F.col("lang").isin(*LANGUAGES["asr"]), "the model does not know the language"), (F.col("mode").isin(*MODES["asr"]), "the model does not know the mode")):
        a = F.when(ok, a).otherwise(F.raise_error(F.lit(what)).cast("binary"))
    return calls.withColumn("audio", a)


def translatable(segments: DataFrame, config: Config = Config()) -> DataFrame:
    """Segments with a text, the first of each medium where a run is capped."""
    rows = segments.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows if config.max_segments is None else first_n(rows, config.max_segments, "id")


def synthesisable(segments: DataFrame) -> DataFrame:
    """Segments with a translation; none at all is an error."""
    rows = segments.where(F.trim(F.coalesce("translation", F.lit(""))) != "")
    if rows.isEmpty():
        raise EngineError("no segment has a translation")
    return rows


def translate_segments(segments: DataFrame, backend: Backend, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(m, id, translation) of all segments, and the counters of each medium.

    Round one sends batches; those whose reply does not give each line back go again in
    round two, a line each. Only payload lines are taken; context lines were sent for
    their sense. A text longer than the model takes is sent in pieces, whose replies are
    joined. The counters: batches planned, parsed and fallen back, requests, characters.
    """
    cap = CHAR_CAPS[config.translate_model]
    own = segments.select("m", "id", F.trim("text").alias("text"))
    most, context = (config.batch_segments, config.context_segments) if config.translate_batched else (1, 0)
    plan = folds.batches(own, cap, config.batch_fill, most, context)
    lines = plan.select("m", "batch", F.posexplode("line_ids").alias("n", "id")).join(own.withColumn("id", F.col("id").cast("long")), ["m", "id"])
    bodies = lines.groupBy("m", "batch").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("l")).select("m", "batch", folds.render_batch(F.transform("l", lambda x: x["text"])).alias("text"))
    with_args = lambda df: check_translate(df.withColumns({"target": F.lit(config.target_lang), "mode": F.lit(config.translate_mode)}), config.translate_model)

    def asked(df: DataFrame, key: str) -> DataFrame:
        """(m, key, reply, requests, chars) of texts (m, key, text)."""
        cut = df.select("m", F.col(key).alias("id"), F.posexplode(folds.pieces(F.col("text"), cap)).alias("piece", "x")).select("m", "id", "piece", "x.text", "x.gap")
        got = backend(with_args(cut)).groupBy("m", "id").agg(F.array_sort(F.collect_list(F.struct("piece", "gap", "reply"))).alias("l"), F.count(F.lit(1)).alias("requests"), F.sum(F.char_length("text")).alias("chars"))
        whole = F.array_join(F.transform("l", lambda x: F.concat(F.trim(x["reply"]), x["gap"])), "")
        reply = F.when(F.size("l") == 1, F.col("l")[0]["reply"]).when(~F.exists("l", lambda x: x["reply"].isNull()), whole)
        return got.select("m", F.col("id").alias(key), reply.alias("reply"), "requests", "chars")

    first = asked(bodies, "batch")
    parsed = plan.join(first, ["m", "batch"]).withColumn("lines", folds.parse_batch(F.coalesce("reply", F.lit("")), F.size("line_ids")))
    good = parsed.where("lines is not null").select("m", F.col("payload_ids").alias("p"), F.explode(F.arrays_zip("line_ids", "lines")).alias("x")).where(F.array_contains("p", F.col("x.line_ids"))).select("m", F.col("x.line_ids").cast("int").alias("id"), F.col("x.lines").alias("translation"))
    lost = parsed.where("lines is null").select("m", F.explode("payload_ids").alias("id")).join(own.withColumn("id", F.col("id").cast("long")), ["m", "id"])
    second = asked(lost, "id").select("m", F.col("id").cast("int").alias("id"), F.trim(F.coalesce("reply", F.lit(""))).alias("translation"), "requests", "chars")
    counts = parsed.groupBy("m").agg(
        F.count(F.lit(1)).alias("batches_planned"), F.count_if(F.col("lines").isNotNull()).alias("batches_parsed"), F.count_if(F.col("lines").isNull()).alias("batches_fell_back"),
        F.sum(F.size("context_ids")).alias("context_lines"), F.sum("chars").alias("chars1"), F.sum("requests").alias("n1"), F.sum(F.when(F.size("line_ids") == 1, F.col("requests")).otherwise(0)).alias("single1"),
    )
    again = second.groupBy("m").agg(F.sum("requests").alias("n2"), F.sum("chars").alias("chars2"))
    payload = own.groupBy("m").agg(F.sum(F.char_length("text")).alias("payload_chars"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    stats = counts.join(again, "m", "left").join(payload, "m").select(
        "m", "batches_planned", "batches_parsed", "batches_fell_back", "context_lines", (F.col("n1") + zero("n2")).alias("requests"), (F.col("single1") + zero("n2")).alias("single_line_requests"),
        (F.col("chars1") + zero("chars2")).alias("request_chars"), "payload_chars", (F.col("chars1") + zero("chars2") - F.col("payload_chars")).alias("overhead_chars"),
    )
    return good.unionByName(second.select("m", "id", "translation")), stats


def with_translations(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments with their translation; a segment without one raises."""
    require_none(segments.select("m", "id").join(translations, ["m", "id"], "left_anti"), MappingError, "a segment has no translation")
    return segments.drop("translation").join(translations, ["m", "id"])


def fit_rounds(rows: DataFrame, backend: Backend, config: Config = Config()) -> DataFrame:
    """The fit loop with a backend that returns ``duration_s`` for (m, segment_id, text,
    pace): one round of calls per attempt, over the segments that are not done. Returns
    the attempts: m, segment_id, target, attempt, pace, duration_s, clamped, stop_reason."""
    active = rows.select("m", "segment_id", "text", "target").withColumns({"pace": F.lit(1.0), "clamped": F.lit(False)})
    done = None
    attempts = config.fit_attempts if config.fit_enabled else 1
    for n in range(1, attempts + 1):
        # The call has the pace to four places, as its key does; the loop goes on with the exact one.
        got = backend(active.withColumns({"exact": F.col("pace"), "pace": F.bround("pace", 4)})).withColumn("pace", F.col("exact")).drop("exact")
        ratio = F.when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.col("duration_s") / F.col("target"))
        wanted = F.col("pace") * ratio
        step = F.least(F.greatest(wanted, F.lit(config.pace_min)), F.lit(config.pace_max))
        within, last = ratio.between(config.fit_low, config.fit_high), F.lit(n == attempts)
        hit = F.abs(wanted - step) > 1e-9
        small = F.abs(step - F.col("pace")) < config.fit_min_step
        reason = F.when(within, F.lit("converged")).when(F.lit(not config.fit_enabled), F.lit("fit_disabled")).when(last, F.lit("max_attempts")).when(small & hit, F.lit("pinned_at_clamp")).when(small, F.lit("pace_step_below_threshold"))
        out = got.withColumns({"attempt": F.lit(n), "stop_reason": reason, "following": step, "clamped": F.col("clamped") | (~within & ~last & hit)})
        own = out.select("m", "segment_id", "target", "attempt", "pace", "duration_s", "clamped", "stop_reason")
        done = own if done is None else done.unionByName(own)
        active = out.where("stop_reason is null").select("m", "segment_id", "text", "target", F.col("following").alias("pace"), "clamped")
    return done


def chosen_path(files: DataFrame, fitted: bool = True) -> DataFrame:
    """Which clip of a segment is placed."""
    path = F.col("fitted_path") if fitted else F.col("baseline_path")
    return files.withColumn("source_path", F.when(path.isNull(), F.raise_error(F.lit("a clip is missing")).cast("string")).otherwise(path)).withColumn("fitted", F.lit(fitted))


def timeline_durations(media: DataFrame, demuxed: DataFrame, inputs: DataFrame) -> DataFrame:
    """The length that a dub must have: the demuxed audio's, else the input's, else an error."""
    d, i = demuxed.select("m", F.col("duration_s").alias("d")), inputs.select("m", F.col("duration_s").alias("i"))
    rows = media.select("m").join(d, "m", "left").join(i, "m", "left")
    length = F.coalesce("d", "i", F.raise_error(F.lit("the length of a timeline is not known")).cast("double"))
    return rows.select("m", length.alias("duration_s"), F.when(F.col("d").isNotNull(), F.lit("demuxed")).otherwise(F.lit("input")).alias("source"))


def monotonic(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """Whether duration strictly falls, strictly rises, or neither, as the pace rises."""
    from pyspark.sql import Window

    nxt = F.lead("duration_s").over(Window.partitionBy(*keys).orderBy("pace"))
    rows = sweep.withColumns({"down": nxt < F.col("duration_s"), "up": nxt > F.col("duration_s")})
    out = rows.groupBy(*keys).agg(F.bool_and("down").alias("d"), F.bool_and("up").alias("u"))
    return out.select(*keys, F.when(F.col("d"), F.lit("falls")).when(F.col("u"), F.lit("rises")).otherwise(F.lit("neither")).alias("direction"))
