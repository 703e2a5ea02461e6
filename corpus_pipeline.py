"""The corpus pipeline: from raw documents to token ids, in stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` writes every
stage's result as Parquet to the shared folder and reads it again for the next one, so a
lost executor costs no more than the stage it was lost in. Once a stage is written, its own
scratch tables and its predecessor's result are deleted; the last result stays.

A stage works on all rows that its predecessor kept. All but the last return the columns
of ``documents``. Rows with a null or empty text leave in the first stage; repeated rows
are judged one by one; an empty table gives an empty result; further columns are carried
along unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellcast.llm import bpe, chunk_dedup, decontaminate, near_dup, quality
from cellcast.llm.queries import table, vocabulary_path
from cellcast.session import delete_path, scratch_dir, scratch_scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are anomalous go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return near_dup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out of the texts; all rows stay."""
    return chunk_dedup.remove_repeats(docs).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every remaining document."""
    return bpe.round_trip_digests(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("bpe", bpe_round_trip),
]

#: Several stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete_path(spark, before)
        before = path
    return docs
