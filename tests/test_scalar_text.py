"""Scalar and text expressions on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from revoicer.config import Config, ConfigError
from revoicer.functions import scalar as S
from revoicer.functions import text as X


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_levels_frames_and_costs(spark):
    r = one(spark, S.amplitude(F.lit(-20.0)), S.dbfs(F.lit(0.1)), S.dbfs(F.lit(0.0)), S.frames(F.lit(0.5), 3), S.frames(F.lit(-1.0), 16000), S.frames(F.lit(1.5), 1))
    assert r.c0 == pytest.approx(0.1) and r.c1 == pytest.approx(-20) and r.c2 == -math.inf
    assert (r.c3, r.c4, r.c5) == (2, 0, 2)  # halves to even, floor at 0
    r = one(spark, S.stt_cost(F.lit(9.2)), S.stt_cost(F.lit(3600.0), True), S.translate_cost(F.lit(186.0)), S.tts_cost(F.lit(-3.0)))
    assert (r.c0, r.c1, r.c2, r.c3) == (pytest.approx(0.083333, abs=1e-6), 45.0, pytest.approx(0.372), 0.0)


def test_drift_and_pace(spark):
    r = one(spark, S.drift_pct(F.lit(2.4), F.lit(2.0)), S.signed_drift_pct(F.lit(1.0), F.lit(2.0)), S.drift_pct(F.lit(1.0), F.lit(0.0)), S.overrun_pct(F.lit(1.0), F.lit(2.0)), S.clamp(F.lit(2.0), 0.85, 1.25), S.was_clamped(F.lit(1.0), 0.85, 1.25))
    assert r.c0 == pytest.approx(20) and (r.c1, r.c2, r.c3, r.c4, r.c5) == (-50.0, 0.0, 0.0, 1.25, False)
    r = one(spark, S.timestamp(F.lit(125.5)), S.timestamp(F.lit(3725.25)), S.pace_key(F.lit(1.00005)), S.or_sentinel(F.lit(None).cast("double"), "not yet measured"))
    assert (r.c0, r.c1, r.c3) == ("02:05.500", "62:05.250", "not yet measured")


@pytest.mark.parametrize("word,n", [("hello", 2), ("make", 1), ("table", 2), ("walked", 1), ("wanted", 2), ("see", 1), ("rhythm", 1), ("b", 1)])
def test_english_syllables(spark, word, n):
    assert one(spark, X.english_syllables(F.lit(word))).c0 == n


@pytest.mark.parametrize("text,n", [("राम", 1), ("जय", 1), ("ठीक", 1), ("एक", 1), ("कमल", 2), ("कार्ड", 1), ("पत्तों", 2), ("तुम्हारा", 3), ("शीर्ष", 1), ("अद्भुत", 2), ("तुमने", 2), ("आपका", 2), ("सबसे", 2), ("रखना", 2), ("ऊपर", 2), ("रखिए", 3), ("ठीक है, जय, एक कार्ड चुनो।", 7), ("तुमने यह कैसे किया? मैं हैरान हूँ।", 11), ("Jay, आपका card top card है", 7), ("Okay, Jay, pick a card.", 6), ("Remember it. Right, Jay, shuffle the cards.", 10), ("", 0), ("これは日本語です", None)])
def test_syllables_by_script(spark, text, n):
    assert one(spark, X.syllables(F.lit(text))).c0 == n


def test_words_and_normal_form(spark):
    r = one(spark, X.words(F.lit("'Don't stop' — कार्ड, 12 x")), X.normalised(F.lit("Á b—C।  d!")), X.latin_tokens(F.lit("ab क c")))
    assert r.c0 == ["Don't", "stop", "कार्ड", "x"] and r.c1 == "á b c d" and r.c2 == 2


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edits_by_fold_and_by_rows(spark):
    cases = [("a b c", "a x c"), ("a", ""), ("a b", "b a c d"), ("x", "x"), ("a b c d e", "c d")]
    df = spark.createDataFrame(cases, "r string, h string")
    parts = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    rows = df.select("r", "h", X.edits(parts("r"), parts("h")).alias("e"), X.word_distance(parts("r"), parts("h")).alias("w")).collect()
    for r in rows:
        want = brute(r.r.split(), r.h.split())
        assert r.e.c == want == r.w and r.e.s + r.e.d + r.e.i == r.e.c and r.e.d - r.e.i == len(r.r.split()) - len(r.h.split())


def test_config_checks():
    assert Config().fit_attempts == 3
    for bad in ({"max_chunk_s": 31.0}, {"pace_min": 0.4}, {"fit_low": 1.1}, {"min_segment_s": 20.0}, {"char_cap": 0}, {"batch_fill": 1.5}):
        with pytest.raises(ConfigError):
            Config(**bad)
