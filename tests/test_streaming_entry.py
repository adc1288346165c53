"""The streaming extension against batch, and the driver's contract."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from revoicer.streaming import calls

TINY = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 10}:15:00", i % 4, "tts" if i % 2 else "asr", i % 3 == 0, 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "ts string, user_id int, stage string, cache_hit boolean, cost double").withColumn("ts", F.to_timestamp("ts"))
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    stream = calls.windowed_costs(spark.readStream.schema(df.schema).parquet(path))
    got = calls.run_available(stream, "costs", str(tmp_path / "ck"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, calls.windowed_costs(df).collect()))
    assert calls.sessions(df).count() > 0


def test_entry_and_names(spark):
    assert len(entry.queries()) >= 50 and set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(TINY):
        assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(TINY), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["qc_rank_worst", "drift_block", "planned_chunks", "fit_loops", "nearest_silence", "mixed_signals", "wer_pairs", "planned_batches", "mapping_audit"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{TINY}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, rel = entry.queries()[name](spark, TINY), con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    own = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    other = sorted(str(tuple(dict(zip(rel.columns, r, strict=True))[c] for c in names)) for r in rel.fetchall())
    assert len(own) == len(other)
    near = lambda a, b: a == b or all(x == y or abs(float(x) - float(y)) < 1e-5 for x, y in zip(a.strip("()").split(", "), b.strip("()").split(", ")))
    assert all(near(a, b) for a, b in zip(own, other, strict=True))
