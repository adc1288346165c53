"""Queries take whole inputs: against plain loops on small fixtures."""

import __spark_entry__ as entry


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_errors_after_word_forty_count(spark, tmp_path):
    own = [f"w{i}" for i in range(70)]
    turns = [own, [*own[:50], "other", *own[51:60]], own[5:], own[:8], ["new", *own[:39]]]
    rows = [(1, i, "user", " ".join(t)) for i, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {i: plain_edits(a, b) for i, (a, b) in enumerate(zip(turns, turns[1:]))}
    q = entry.queries()
    pairs = q["wer_pairs"](spark, str(tmp_path)).collect()
    assert {r.segment_id: r.edits for r in pairs} == want and want[0] == 11
    assert all(r.wer == round(want[r.segment_id] / len(turns[r.segment_id]), 6) for r in pairs)
    (total,) = q["corpus_wer"](spark, str(tmp_path)).collect()
    assert (total.word_edits, total.ref_words) == (sum(want.values()), sum(map(len, turns[:-1])))
    ranked = {r.segment_id: r for r in q["qc_rank_worst"](spark, str(tmp_path)).collect()}
    assert {i: r.wer for i, r in ranked.items()} == {r.segment_id: r.wer for r in pairs}
    assert sorted(r.rank for r in ranked.values()) == [1, 2, 3, 4]


def test_every_clip_is_mixed(spark, tmp_path):
    rows = [(i, [0.1 + i / 1e4] * 64, i % 3) for i in (0, 1, 39, 399, 400, 439, 700, 1205)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    import numpy as np

    frames, counts = {}, {}
    for i, v, label in rows:
        sample, seen = int(np.floor(float(np.float32(v[0])) * 20000)) * 3, [0, 0, 0, 0]
        for k in range(64):
            at = (label, i % 40 + k)
            if at[1] >= 90:
                seen[1] += 1
                continue
            old, total = frames.get(at, 0), frames.get(at, 0) + sample
            frames[at] = max(-32768, min(32767, total))
            seen[0] += 1
            seen[2] += old != 0
            seen[3] += total != frames[at]
        counts[label, i] = tuple(seen)
    q = entry.queries()
    assert {(r.m, r.i): r.x for r in q["mixed_signals"](spark, str(tmp_path)).collect()} == frames
    got = {(r.m, r.ord): (r.written, r.truncated, r.overlapped, r.clipped) for r in q["mix_counts"](spark, str(tmp_path)).collect()}
    assert got == counts and len(got) == len(rows)
