"""A corpus pipeline over ``documents``: drop toxic documents, drop those that the
quality rules reject, keep one document of each near-duplicate class, pack the rest.

Each stage takes (spark, docs, sf_dir), works on all of docs, and returns a DataFrame;
all but the last return the columns of ``documents``. Between stages the rows are
written as Parquet and read again, so a stage never recomputes its predecessors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revoicer.llm import neardup, packing, quality, toxicity
from revoicer.llm.queries import vocabulary
from revoicer.llm.shared import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.without_rejected(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: SQL has no way to say the trained network, the signatures or the plan of the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
