"""Signals, caching, audits, sources and sinks on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from revoicer.config import CacheMissError, EngineError
from revoicer.operators import audit, cache, pcm, qc, stats, timeline
from revoicer.sources import reports, silences, wav


def test_mix_clamps_in_order(spark):
    clips = spark.createDataFrame([(1, 1, 0, [30000] * 4), (1, 2, 2, [10000] * 4), (1, 3, 3, [-5000] * 3)], "m long, ord int, offset int, samples array<int>")
    canvas = spark.createDataFrame([(1, 5)], "m long, frames int")
    got = {r.i: r.x for r in pcm.mix(clips, canvas).collect()}
    assert got == {0: 30000, 1: 30000, 2: 32767, 3: 27767, 4: 5000}
    counts = {r.ord: (r.written, r.truncated, r.overlapped, r.clipped) for r in pcm.mix_counts(clips, canvas).collect()}
    assert counts == {1: (4, 0, 0, 0), 2: (3, 1, 2, 2), 3: (2, 1, 2, 0)}


def test_fade_and_trim(spark):
    df = spark.createDataFrame([(1, [1000] * 100, 1000)], "m long, samples array<int>, rate int")
    faded = df.select(pcm.faded(F.col("samples"), F.col("rate"), 10).alias("f")).first().f
    assert faded[0] == 0 and faded[5] == 500 and faded[50] == 1000 and faded[-1] == 0
    quiet = spark.createDataFrame([(1, [0] * 300 + [20000] * 1000 + [0] * 500, 1000), (2, [0] * 500, 1000)], "m long, samples array<int>, rate int")
    a, b = pcm.trimmed(quiet).orderBy("m").collect()
    assert (a.duration_s, a.lead_trim_s, a.trail_trim_s, a.all_silent) == (1.04, 0.28, 0.48, False)
    assert b.all_silent and len(b.trimmed) == 500


def test_wav_round_trip(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.wav_bytes([1, -2, 3], 8000))
    (tmp_path / "b.wav").write_bytes(b"nothing")
    rows = wav.read_media(spark, str(tmp_path)).withColumn("s", F.when(F.col("info.error").isNull(), wav.wav_samples("content"))).orderBy("path")
    a = rows.where("info.error is null").select("info.*", wav.wav_samples("content").alias("s")).first()
    assert (a.channels, a.frame_rate, a.frames, a.s) == (1, 8000, 3, [1, -2, 3])
    bad = wav.read_media(spark, str(tmp_path)).where("info.error is not null")
    assert bad.count() == 1
    with pytest.raises(Exception, match="not a WAV"):
        bad.select(wav.checked(F.col("info")).alias("x")).collect()
    back = spark.createDataFrame([([5, 6], 16000)], "s array<int>, r int").select(wav.wav_info(wav.to_wav("s", "r")).alias("i")).first().i
    assert (back.frames, back.duration_s) == (2, 2 / 16000)


def test_silence_logs(spark):
    log = "x silence_start: -0.1\nsilence_end: 1.5 | d\nsilence_start: 3\nsilence_start: 4\nsilence_end: 5\nsilence_start: 9.5"
    out = silences.parse_silences(spark.createDataFrame([(1, log, 10.0)], "m long, log string, duration_s double")).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s) for r in out] == [(0.0, 1.5), (4.0, 5.0), (9.5, 10.0)]


def test_cache_keys_match_hashlib(spark):
    import hashlib

    params = cache.canonical_params(b=F.lit(2), a=F.lit("x"), c=F.lit(None).cast("string"))
    r = spark.range(1).select(params.alias("p"), cache.cache_key(F.lit("s"), F.lit("m"), params, F.lit("h")).alias("k")).first()
    assert r.p == '{"a":"x","b":2}' and r.k == hashlib.sha256(b's\0m\0{"a":"x","b":2}\0h').hexdigest()


def test_cached_calls_ask_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    calls = spark.createDataFrame([("k1", "asr", "m", "ab"), ("k2", "asr", "m", "cd"), ("k1", "asr", "m", "ab")], "key string, stage string, model string, input string")
    with pytest.raises(CacheMissError):
        cache.cached_calls(calls, path, dry_run=True)
    answers, log = cache.cached_calls(calls, path)
    assert sorted(json.loads(r.payload)["text"] for r in answers.collect()) == ["ba", "ba", "dc"] and log.where("cache_hit").count() == 0
    _, again = cache.cached_calls(calls, path, dry_run=True)
    assert again.where("cache_hit").count() == 3 and spark.read.parquet(path).count() == 2
    assert cache.clear(spark, path) == 2 and spark.read.parquet(path).count() == 0


def test_retries():
    seen = []
    replies = iter([cache.Reply(503, {}), cache.Reply(429, {}, retry_after=7.0), cache.Reply(200, {"ok": 1})])
    reply, n = cache.call_with_retries(lambda r: next(replies), {}, cache.Retry(), seen.append)
    assert n == 3 and reply.status == 200 and seen[1] == 7.0 and 0 <= seen[0] <= 1
    with pytest.raises(EngineError):
        cache.call_with_retries(lambda r: cache.Reply(400, {}), {}, cache.Retry(), seen.append)


def test_audio_payloads(spark):
    ok = spark.createDataFrame([(["AAEC"],)], "a array<string>").select(cache.decode_audio(F.col("a")).alias("x")).first().x
    assert bytes(ok) == b"\0\1\2"
    with pytest.raises(Exception, match="no audio"):
        spark.createDataFrame([(["!"],)], "a array<string>").select(cache.decode_audio(F.col("a"))).collect()


def dub(spark):
    placements = spark.createDataFrame([(1, 0, 0.0, 5.0, 0.0, 8.0), (1, 1, 5.0, 10.0, 5.0, 5.1)], "m long, segment_id int, window_start_s double, window_end_s double, placed_start_s double, duration_s double")
    segs = spark.createDataFrame([(1, 0, "one two three"), (1, 1, "four five six")], "m long, id int, translation string")
    fits = spark.createDataFrame([(1, 0, 5.0, 8.0, 1.25, 2, True, False), (1, 1, 0.0, 0.0, 1.0, 1, False, True)], "m long, segment_id int, target double, achieved double, final_pace double, attempts int, clamped boolean, converged boolean")
    hyps = spark.createDataFrame([(1, 0, "one two tree"), (1, 1, "")], "m long, segment_id int, hypothesis string")
    return placements, segs, fits, hyps


def test_quality_stage(spark):
    out = qc.run_qc(*dub(spark))
    rows = {r.segment_id: r for r in out.collect()}
    assert rows[0].wer == pytest.approx(1 / 3) and rows[0].signed_drift == pytest.approx(60) and rows[0].overlap_s == pytest.approx(3) and rows[0].rank == 2
    assert rows[1].wer == 1.0 and rows[1].signed_drift == pytest.approx(2) and rows[1].target == 5.0 and rows[1].rank == 1
    assert rows[1].reasons == ["no speech was recognised in the window", "high word error rate (1.000)", "3 tokens of the reference are in Latin script"] and "pace was clamped" in rows[0].reasons
    rates = qc.corpus_rates(out, ["m"]).first()
    assert rates.word_edits == 4 and rates.wer == pytest.approx(4 / 6)
    hops = audit.coverage({"segments": dub(spark)[1], "scored": out})
    text = reports.qc_markdown(out, qc.corpus_rates(out, ["m"]), hops).first().markdown
    assert "2 of 2 segments flagged" in text and "segments_to_scored: 2 of 2, ok" in text
    with pytest.raises(Exception, match="can't be scored"):
        p, s, f, h = dub(spark)
        qc.run_qc(p, s.where("id = 0"), f, h)


def test_windows_longer_than_the_model_takes(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 65.0), (1, 1, 65.0, 95.0)], "m long, segment_id int, window_start_s double, window_end_s double")
    out = qc.back_transcription_windows(p).orderBy("segment_id", "piece").collect()
    assert len(out) == 4 and out[0].end_s == pytest.approx(65 / 3) and (out[3].start_s, out[3].end_s) == (65.0, 95.0)


def test_statistics(spark):
    fits = spark.createDataFrame([(2.0, 2.4, 3.0), (2.0, 2.0, 1.0)], "target double, achieved double, baseline double").selectExpr("1 as m", "*", "2 as attempts", "1.0D as final_pace", "false as clamped", "true as converged")
    r = stats.duration_fit_stats(fits, ["m"]).first()
    assert (r.before_mean, r.after_mean, r.improved, r.worsened, r.small_sample) == (50.0, pytest.approx(10.0), 2, 0, True)
    assert r.reduction_pct == pytest.approx(80)
    assert stats.drift_block(fits.limit(0), ["m"]).count() == 0


def test_overlaps_see_neighbours_alone_or_all(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 2.0, 1.0), (1, 2, 5.0, 2.0)], "m long, segment_id int, placed_start_s double, duration_s double")
    assert [(r.left_id, r.right_id) for r in timeline.overlaps(p).collect()] == [(0, 1)]
    assert sorted((r.left_id, r.right_id) for r in timeline.all_overlaps(p, bucket_s=3.0).collect()) == [(0, 1), (0, 2)]


def test_segment_json(spark):
    s = spark.createDataFrame([(1, 1, 2.00049, 3.0, "b", None), (1, 0, 0.0, 2.0005, "a", "x")], "m long, id int, start double, end double, text string, speaker string")
    rows = json.loads(reports.segments_json(s).first().json)
    assert [r["id"] for r in rows] == [0, 1] and rows[0]["end"] in (2.0, 2.001) and rows[1]["speaker"] is None


def test_files_of_parts(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1, 2], 8000), ("b", [3], 8000)], "name string, samples array<int>, rate int")
    wav.write_wavs(rows, str(tmp_path / "out"))
    assert wav.samples_of((tmp_path / "out" / "b.wav").read_bytes()) == [3] and len(list((tmp_path / "out").iterdir())) == 2
    parts = spark.createDataFrame([(1, 1, bytearray(b"cd")), (1, 0, bytearray(b"ab")), (2, 0, bytearray(b"x"))], "m long, idx int, data binary")
    whole = spark.createDataFrame([(1, bytearray(b"abcd")), (2, bytearray(b"y"))], "m long, data binary")
    assert sorted(map(tuple, audit.parts_match(parts, whole).collect())) == [(1, True), (2, False)]
