"""Steps whose tasks stay small however many rows share a key, against plain loops."""

import random

from pyspark.sql import functions as F

from revoicer.config import Config
from revoicer.operators import calls, folds, pcm, stats


def test_many_clips_of_a_tile_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(pcm, "BLOCK", 3)
    draw = random.Random(7)
    rows = [(m, o, draw.randrange(-5, 30), [draw.choice((-30000, -9000, 0, 500, 20000, 32767)) for _ in range(draw.randrange(1, 25))]) for m in (1, 2) for o in range(20)]
    rows.append((1, 99, 4090, [7] * 10))
    frames, counts = {}, {}
    for m, o, at, samples in rows:
        seen = [0, len(samples), 0, 0]
        for i, x in enumerate(samples, at):
            if 0 <= i < 4098 and (m == 1 or i < 40):
                old, total = frames.get((m, i), 0), frames.get((m, i), 0) + x
                frames[m, i] = max(-32768, min(32767, total))
                seen = [seen[0] + 1, seen[1] - 1, seen[2] + (old != 0), seen[3] + (total != frames[m, i])]
        counts[m, o] = tuple(seen)
    clips = spark.createDataFrame(rows, "m long, ord int, offset int, samples array<int>")
    canvas = spark.createDataFrame([(1, 4098), (2, 40)], "m long, frames int")
    held = pcm.parts(clips, canvas).groupBy("m", "tile", "block").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("s")).alias("most")).collect()
    assert max(r.n for r in held) == 3 and max(r.most for r in held) < 25
    assert {(r.m, r.i): r.x for r in pcm.mix(clips, canvas).collect()} == frames
    assert {(r.m, r.ord): (r.written, r.truncated, r.overlapped, r.clipped) for r in pcm.mix_counts(clips, canvas).collect()} == counts


def test_a_text_longer_than_the_model_takes_goes_in_pieces(spark):
    long = " ".join(f"w{i}" for i in range(700)) + "  " + "z" * 2300 + "\te"
    texts = ["short", long, "x" * 1999, "end", "more"]
    rows = spark.createDataFrame([(m, i, t) for m in (1, 3) for i, t in enumerate(texts)], "m long, id int, text string")
    cut = rows.where("m = 1 and id = 1").select(folds.pieces(F.col("text"), 2000).alias("p")).first().p
    assert "".join(x.text + x.gap for x in cut) == long and len(cut) > 2 and max(len(x.text) for x in cut) == 2000 and all(x.text == x.text.strip() for x in cut)
    plan = {r.batch: r for r in folds.batches(rows.where("m = 1"), cap=2000, most=4).collect()}
    assert {b: (r.payload_ids, r.context_ids) for b, r in plan.items()} == {0: ([0], []), 1: ([1], []), 2: ([2], []), 3: ([3, 4], [])}

    def backend(df):  # medium 3 loses a marker where several lines are sent
        return df.withColumn("reply", F.upper(F.when((F.col("m") == 3) & F.col("text").startswith("[1]"), F.regexp_replace("text", r"\[2\]", "")).otherwise(F.col("text"))))

    found, counters = calls.translate_segments(rows, backend, Config(translate_model="translate-long", translate_mode="formal"))
    assert {(r.m, r.id): r.translation for r in found.collect()} == {(m, i): t.upper() for m in (1, 3) for i, t in enumerate(texts)}
    assert {r.m: (r.batches_planned, r.requests) for r in counters.collect()} == {1: (4, 3 + len(cut)), 3: (4, 3 + len(cut) + 2)}


def test_percentiles_of_large_groups_are_exact(spark, monkeypatch):
    monkeypatch.setattr(stats, "LARGE", 20)
    monkeypatch.setattr(stats, "SECOND", 4)
    draw = random.Random(3)
    kinds = {
        "wide": lambda: draw.choice((-1, 1)) * 10 ** draw.uniform(-300, 300), "ties": lambda: float(draw.randrange(3)), "near": lambda: 1 + draw.randrange(60) * 2.0**-52,
        "one": lambda: 7.5, "odd": lambda: draw.choice((float("inf"), float("-inf"), float("nan"), -0.0, 1.0, None)), "none": lambda: None, None: lambda: draw.gauss(0, 9),
    }
    rows = [(k, f(), draw.random()) for k, f in kinds.items() for _ in range(301)] + [("few", float(i), 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(3)
    wanted = [("v50", "v", 50), ("v95", "v", 95), ("v0", "v", 0), ("w99", "w", 99)]
    out = stats.grouped(df, ["k"], F.count(F.lit(1)).alias("n"), *[stats.Percentile(*w) for w in wanted])
    assert out.columns == ["k", "n", "v50", "v95", "v0", "w99"]
    plain = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[stats.percentile(v, p).alias(n) for n, v, p in wanted])
    shown = lambda x: {r.k: tuple(map(str, r)) for r in x.collect()}
    assert shown(out) == shown(plain) and len(shown(out)) == 8
    fits = df.where("k = 'ties'").select("k", F.lit(1.0).alias("target"), F.col("v").alias("achieved"))
    assert stats.drift_block(fits, ["k"]).first().drift_p50 in (0.0, 100.0)
