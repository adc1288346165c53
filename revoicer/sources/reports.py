"""Stage reports as JSON: fixed schemas in, nulls kept and times rounded on the way out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revoicer.config import NOT_MEASURED


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path, multiLine=True)


def segments_json(segments: DataFrame) -> DataFrame:
    """(m, json): each medium's segments as one JSON array in order, times to 3 places."""
    item = F.struct("id", F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"), "text", "speaker")
    own = segments.groupBy("m").agg(F.array_sort(F.collect_list(item)).alias("a"))
    return own.select("m", F.to_json("a", {"ignoreNullFields": "false"}).alias("json"))


def report_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): every other column in one object, nulls kept."""
    return rows.select(*keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys]), {"ignoreNullFields": "false"}).alias("json"))


def expansion_json(rows: DataFrame) -> DataFrame:
    """Expansion as reports give it: a number that is not known is said to be so."""
    show = lambda c: F.coalesce(F.bround(c, 4).cast("string"), F.lit(NOT_MEASURED)).alias(c)
    return rows.select("m", "id", F.to_json(F.struct("source_chars", "target_chars", show("char_ratio"), show("syllable_ratio"))).alias("json"))


def qc_markdown(scores: DataFrame, rates: DataFrame, coverage: DataFrame, top: int = 5) -> DataFrame:
    """(m, markdown): headline, coverage, the worst segments, and the full table."""
    line = F.format_string("| %d | %s | %.3f | %.3f | %.1f%% | %s |", "segment_id", "timestamp", "wer", "cer", "signed_drift", F.coalesce(F.nullif(F.array_join("reasons", "; "), F.lit("")), F.lit("-")))
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda x: x["v"]), "\n")
    worst = F.when(F.col("rank") <= top, F.col("rank"))
    head = "| segment | at | WER | CER | drift | reasons |\n|-|-|-|-|-|-|\n"
    tables = scores.withColumn("line", line).groupBy("m").agg(
        ordered(F.col("segment_id"), F.col("line")).alias("full"), ordered(F.col("rank"), F.when(worst.isNotNull(), F.col("line"))).alias("worst"), F.count_if("flagged").alias("flagged"), F.count(F.lit(1)).alias("n"),
    )
    hops = coverage.groupBy("m").agg(ordered(F.col("hop"), F.format_string("- %s: %d of %d, %s", "hop", "actual", "expected", F.when(F.col("passed"), "ok").otherwise("FAILED"))).alias("hops"))
    joined = tables.join(rates.select("m", F.col("wer").alias("cw"), F.col("cer").alias("cc")), "m").join(hops, "m", "left")
    text = F.concat(
        F.format_string("# Quality report of %d\n\nCorpus WER %.4f, CER %.4f; %d of %d segments flagged.\n\n## Coverage\n", "m", "cw", "cc", "flagged", "n"), F.coalesce("hops", F.lit("-")),
        F.lit(f"\n\n## Worst segments\n{head}"), F.col("worst"), F.lit(f"\n\n## All segments\n{head}"), F.col("full"), F.lit("\n"),
    )
    return joined.select("m", text.alias("markdown"))
