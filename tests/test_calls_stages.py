"""Calls with fallbacks, and a whole dub from chunks to scores with stub backends."""

import json

import pytest
from pyspark.sql import functions as F

from revoicer.config import Config, ConfigError, EngineError, load_config
from revoicer.operators import calls, pcm
from revoicer.plans import stages


def test_translation_falls_back_line_by_line(spark):
    rows = spark.createDataFrame([(1, i, float(i), i + 1.0, f"text {i}") for i in range(4)] + [(2, 0, 0.0, 1.0, "lone")], "m long, id int, start double, end double, text string")

    def backend(df):  # medium 1: a marker goes missing where several lines are sent
        return df.withColumn("reply", F.when((F.col("m") == 1) & F.col("text").startswith("["), F.regexp_replace("text", r"\[2\]", "")).otherwise(F.upper("text")))

    found, counters = calls.translate_segments(rows, backend, Config(batch_segments=2))
    got = sorted((r.m, r.id, r.translation) for r in found.collect())
    assert got == [(1, i, f"TEXT {i}") for i in range(4)] + [(2, 0, "LONE")]
    c = {r.m: r for r in counters.collect()}
    assert (c[1].batches_planned, c[1].batches_fell_back, c[1].requests) == (2, 2, 6) and (c[2].batches_parsed, c[2].requests, c[2].overhead_chars) == (1, 1, 0)
    ok, _ = calls.translate_segments(rows, lambda df: df.withColumn("reply", F.col("text")), Config(batch_segments=2))
    assert calls.with_translations(rows, ok).count() == 5
    with pytest.raises(Exception, match="no translation"):
        calls.with_translations(rows, ok.where("id > 0"))


def test_checks_come_before_calls(spark):
    one = lambda **k: spark.range(1).select(*[F.lit(v).alias(n) for n, v in k.items()])
    for bad in ({"text": " "}, {"text": "x" * 1001}, {"target": "xx"}, {"mode": "loud"}):
        with pytest.raises(Exception):
            calls.check_translate(one(**({"text": "a", "target": "hi-IN", "mode": "formal"} | bad))).collect()
    assert calls.check_speech(one(text="a", lang="hi-IN", pace=1.0)).count() == 1
    with pytest.raises(Exception, match="pace"):
        calls.check_speech(one(text="a", lang="hi-IN", pace=2.5)).collect()
    with pytest.raises(Exception, match="longer"):
        calls.check_audio(one(audio=bytearray(b"x"), duration_s=31.0, lang="en-IN", mode="transcribe")).collect()


def test_fit_rounds_equal_the_fold(spark):
    from revoicer.operators import folds

    rows = spark.createDataFrame([(1, 0, "a", 2.0, 2.4), (1, 1, "b", 2.0, 4.0), (1, 2, "c", 5.0, 1.0), (1, 3, "d", 2.0, 2.05)], "m long, segment_id int, text string, target double, base double")
    base = rows.select("m", "segment_id", "base")
    out = calls.fit_rounds(rows, lambda df: df.join(base, ["m", "segment_id"]).withColumn("duration_s", F.col("base") / F.col("pace")).drop("base"))
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.attempt):
        got.setdefault(r.segment_id, []).append((round(r.pace, 4), r.stop_reason))
    want = {r.segment_id: r.f for r in rows.select("segment_id", folds.fit_loop(F.col("target"), F.col("base"), F.lit(1.0)).alias("f")).collect()}
    assert {k: [p for p, _ in v] for k, v in got.items()} == {k: [round(p, 4) for p in f.paces] for k, f in want.items()}
    assert all(got[k][-1][1] == f.stop_reason for k, f in want.items())


def test_choices(spark):
    m = spark.createDataFrame([(1,), (2,)], "m long")
    d, i = spark.createDataFrame([(1, 5.0)], "m long, duration_s double"), spark.createDataFrame([(1, 6.0), (2, 7.0)], "m long, duration_s double")
    assert sorted(map(tuple, calls.timeline_durations(m, d, i).collect())) == [(1, 5.0, "demuxed"), (2, 7.0, "input")]
    with pytest.raises(Exception, match="not known"):
        calls.timeline_durations(m, d, d).collect()
    sweep = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0)], "k string, pace double, duration_s double")
    assert sorted(map(tuple, calls.monotonic(sweep, ["k"]).collect())) == [("a", "falls"), ("b", "neither"), ("c", "rises")]
    files = spark.createDataFrame([("f", "b")], "fitted_path string, baseline_path string")
    assert [calls.chosen_path(files, x).first().source_path for x in (True, False)] == ["f", "b"]


def test_config_from_the_environment():
    assert load_config({"REVOICER_MAX_CHUNK_S": "20", "REVOICER_FIT_ENABLED": "no"}, batch_segments=3) == Config(max_chunk_s=20.0, fit_enabled=False, batch_segments=3)
    for bad in ({"REVOICER_MAX_CHUNK_S": "x"}, {"REVOICER_TARGET_LANG": "xx"}, {"REVOICER_MAX_SEGMENTS": "0"}):
        with pytest.raises(ConfigError):
            load_config(bad)


def test_a_whole_dub(spark, tmp_path):
    w = stages.Workspace(spark, str(tmp_path))
    config = Config()
    w.write(spark.createDataFrame([(1, 40.0, 1000), (2, 12.0, 1000)], "m long, duration_s double, rate int"), "media")
    w.write(spark.createDataFrame([(m, level, [20.0] if m == 1 else []) for m in (1, 2) for level in range(5)], "m long, level int, cuts array<double>"), "silences_at")
    w.write(spark.createDataFrame([(1, 19.5, 20.5), (1, 9.8, 10.2)], "m long, start_s double, end_s double"), "silences")

    def transcribe(chunks):
        words = F.lit(json.dumps({"transcript": "One two three four. Five six seven eight."}))
        return chunks.withColumn("payload", words)

    def speak(df):
        return df.withColumn("duration_s", F.char_length("text") / 5.0 / F.col("pace"))

    def assemble():
        fits = w.read("fits")
        clips = fits.select("m", "segment_id", F.lit(0.05).alias("lead_trim_s"), F.lit(1000).alias("rate"), F.array_repeat(F.lit(900), (F.col("achieved") * 1000).cast("int")).alias("samples"))
        w.write(clips, "clips")
        stages.assemble(w, config)

    def hear(windows):
        texts = w.read("translated").select("m", F.col("id").alias("segment_id"), F.col("translation").alias("text"))
        return windows.join(texts, ["m", "segment_id"]).withColumn("text", F.when(F.col("piece") == 0, F.col("text")).otherwise(F.lit("")))

    work = {
        "asr": lambda: stages.asr(w, transcribe, config), "translate": lambda: stages.translate(w, lambda df: df.withColumn("reply", F.upper("text")), config),
        "tts": lambda: stages.tts(w, speak, config), "assemble": assemble, "qc": lambda: stages.quality(w, hear, config),
    }
    with pytest.raises(EngineError, match="run the stage"):
        stages.run(w, work, only="qc")
    assert not w.read("metrics").first().ok
    stages.run(w, work)
    scores = w.read("scores").collect()
    assert scores and all(r.wer == 0 for r in scores) and {r.m for r in scores} == {1, 2}
    assert w.read("coverage").where("not passed").count() == 0 and w.read("metrics").count() == 5
    assert w.read("mixed").where(F.col("x") > pcm.HIGH).count() == 0 and w.read("rates").where("wer > 0").count() == 0
