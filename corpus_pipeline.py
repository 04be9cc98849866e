"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wagelens.llm import decontaminate, line_dedup, near_dedup, tokenize, toxicity
from wagelens.llm.tables import table
from wagelens.session import staging_path


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repetitions of passages go, and documents of which nothing else is left."""
    return line_dedup.unrepeated_documents(docs)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more.

    A near copy has lost the passages it shares by now, so whole texts are compared as well.
    """
    return near_dedup.without_near_duplicates(docs, width=5, percent=80, before=table(spark, sf_dir, "documents"))


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token ids, in checksums of ids and decoded text."""
    from wagelens.llm.queries import vocabulary_path

    return tokenize.digests(docs, vocabulary_path())


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", repeated_lines_out),
    ("near dedup", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("bpe", tokenized),
]

# Compression lengths and MinHash have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared staging folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = staging_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
