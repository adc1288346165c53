"""Chunk plans, batches, fit loops, stitching, merging and splitting on literal rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revoicer.config import Config
from revoicer.operators import folds, segments, timeline


def plan(spark, duration, cuts):
    cuts_col = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.expr("cast(array() as array<double>)")
    row = spark.range(1).select(folds.plan_chunks(F.lit(float(duration)), cuts_col).alias("c")).first()
    return [(c.start_s, c.end_s, c.cut_source) for c in row.c]


def test_chunk_plans(spark):
    assert plan(spark, 12, []) == [(0.0, 12.0, "eof")]
    assert plan(spark, 36.107, [25.27]) == [(0.0, 25.27, "silence"), (25.27, 36.107, "eof")]
    assert plan(spark, 40, [10.0, 20.0, 29.0]) == [(0.0, 20.0, "silence"), (20.0, 40.0, "eof")]
    assert plan(spark, 50, []) == [(0.0, 30.0, "hard"), (30.0, 50.0, "eof")]
    assert [x[2] for x in plan(spark, 70, [40.0])] == ["hard", "silence", "eof"]


@settings(max_examples=10, deadline=None)
@given(st.floats(1, 200), st.lists(st.floats(0.1, 199), max_size=12))
def test_chunks_tile(spark, duration, cuts):
    chunks = plan(spark, duration, sorted(cuts))
    assert chunks[0][0] == 0 and chunks[-1][1] == pytest.approx(duration) and all(a[1] == b[0] for a, b in zip(chunks, chunks[1:])) and all(0 < e - s <= 30 + 1e-9 for s, e, _ in chunks)


def test_fit_loops(spark):
    rows = spark.createDataFrame([(2.0, 2.4, 1.0), (2.0, 4.0, 1.0), (5.0, 1.0, 1.0), (2.0, 2.12, 0.0)], "target double, base double, e double")
    f = [r.f for r in rows.select(folds.fit_loop(F.col("target"), F.col("base"), F.col("e")).alias("f")).collect()]
    assert f[0].paces == [1.0, pytest.approx(1.2)] and f[0].stop_reason == "converged" and f[0].converged
    assert f[1].paces == [1.0, 1.25] and f[1].stop_reason == "pinned_at_clamp" and f[1].clamped
    assert f[2].paces == [1.0, 0.85] and f[2].stop_reason == "pinned_at_clamp"
    assert f[3].stop_reason == "max_attempts" and len(f[3].paces) == 3 and f[3].shipped == 1


def test_batches_and_replies(spark):
    rows = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([300, 300, 300, 100])], "m long, id int, text string")
    out = sorted(folds.batches(rows, cap=1000).collect(), key=lambda r: r.batch)
    assert [r.payload_ids for r in out] == [[0, 1], [2, 3]]
    assert out[0].context_ids == [2] and out[1].context_ids == [0, 1] or out[1].context_ids == [1]
    parse = lambda t, n: spark.createDataFrame([(t, n)], "t string, n int").select(folds.parse_batch(F.col("t"), F.col("n")).alias("p")).first().p
    assert parse("[१] क  ख [२] ग", 2) == ["क ख", "ग"]
    assert parse("[1] a [3] b", 2) is None and parse("[1] a [2] ", 2) is None and parse("  a ", 1) == ["a"] and parse(" ", 1) is None
    assert parse("(1) a\n(2) b", 2) == ["a", "b"]


def test_a_line_over_the_cap_raises(spark):
    with pytest.raises(Exception, match="longer than the cap"):
        spark.range(1).select(folds.plan_batches(F.array(F.lit(2000)))).collect()


def rows_of(*parts):
    out, t = [], 0.0
    for i, (length, text) in enumerate(parts):
        out.append({"m": 1, "id": i, "start": t, "end": t + length, "text": text, "speaker": None, "chunk_index": 0, "boundary_source": "api_span", "origin": [i]})
        t += length
    return out


def test_merge_short():
    out = segments.merged(rows_of((0.5, "a"), (3.0, "b"), (0.4, "c"), (0.6, " "), (2.0, "d")), 1.0)
    assert [(r["start"], r["end"], r["text"]) for r in out] == [(0.0, 3.5, "a b"), (3.5, 4.5, "c"), (4.5, 6.5, "d")]
    assert len(segments.merged(rows_of((0.2, "a"), (0.2, "b")), 1.0)) == 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0.1, 40), st.text("ab .,", min_size=1, max_size=60)), min_size=1, max_size=12))
def test_post_processing_keeps_time_and_words(parts):
    config = Config()
    rows = segments.merged(rows_of(*parts), config.min_segment_s)
    out = [p for r in rows for p in segments.parted(r, [5.0, 12.5], config)]
    assert out[0]["start"] == 0 and all(abs(a["end"] - b["start"]) < 1e-9 for a, b in zip(out, out[1:]))
    assert "".join("".join(p["text"].split()) for p in out) == "".join("".join(t.split()) for _, t in parts)


def test_split_snaps_to_silence():
    row = rows_of((20.0, "One two three. Four five six."))[0]
    time, index, label = segments.best_split(row, [10.5], Config())
    assert (time, label) == (10.5, "sentence+silence") and row["text"][:index] == "One two three. "


def test_stitch(spark):
    chunks = spark.createDataFrame([(1, 0, 0.0, 10.0, "silence"), (1, 1, 10.0, 16.0, "eof")], "m long, idx int, start_s double, end_s double, cut_source string")
    many = '{"transcript":"a b","timestamps":{"words":["a","b"],"start_time_seconds":[0.5,4],"end_time_seconds":[3,9.5]}}'
    spans = segments.spans_of_payloads(chunks.withColumn("payload", F.when(F.col("idx") == 0, F.lit(many)).otherwise(F.lit('{"transcript":" c "}'))))
    out = segments.stitch(chunks, spans).orderBy("id").collect()
    assert [(r.start, r.end, r.text, r.boundary_source) for r in out] == [(0.0, 4.0, "a", "file_start"), (4.0, 10.0, "b", "api_span"), (10.0, 16.0, "c", "silence")]
    media = spark.createDataFrame([(1, 16.0)], "m long, duration_s double")
    assert timeline.violations(spark.createDataFrame([tuple(r) for r in out], segments.stitch(chunks, spans).schema), media).count() == 0


def test_bad_spans_raise(spark):
    base = spark.createDataFrame([(1, 0, 0.0, 10.0, 0, 2.0, 5.0, "a"), (1, 0, 0.0, 10.0, 1, 4.0, 6.0, "b")], "m long, idx int, chunk_start_s double, chunk_end_s double, n int, local_start double, local_end double, text string")
    with pytest.raises(Exception, match="overlap"):
        segments.offset_spans(base).collect()
    with pytest.raises(Exception, match="beyond"):
        segments.offset_spans(base.withColumn("local_end", F.lit(11.0))).collect()
