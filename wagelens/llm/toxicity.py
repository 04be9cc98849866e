"""Toxicity by compression distance.

Two zstandard dictionaries, one of toxic and one of ordinary text, compress every window of
a text; the bytes that the toxic one saves, calibrated on labelled rows, give the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wagelens.llm import compression
from wagelens.llm.tables import free_name, held_out

# Bounds of the labelled sample that a model is fitted on: rows of each label, and the
# bytes of a text. Scoring has no such bounds.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_TEXT_BYTES = 1_000, 3_000, 65_536


def fit(
    docs: DataFrame,
    labels: DataFrame,
    toxic_rows: int = TOXIC_ROWS,
    ordinary_rows: int = ORDINARY_ROWS,
    text_bytes: int = SAMPLE_TEXT_BYTES,
) -> compression.Model:
    """A model of the labelled rows that are not held out.

    At most ``toxic_rows`` and ``ordinary_rows`` texts of up to ``text_bytes`` come to the
    driver, chosen by a hash of their id. Rows with a null id, label or text teach nothing;
    an id with both labels counts as toxic. Too few rows of a label: all texts score low.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("label"))
        .where(~held_out(F.col("doc_id")))
    )
    usable = docs.where(F.octet_length("text") <= text_bytes).select("doc_id").distinct()
    usable = known.join(usable, "doc_id")
    wanted = None
    for label, most in ((1, toxic_rows), (0, ordinary_rows)):
        part = usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        wanted = part if wanted is None else wanted.union(part)
    # At most toxic_rows + ordinary_rows ids, so broadcasting them has a bound.
    texts = (
        docs.select("doc_id", "text").where(F.octet_length("text") <= text_bytes)
        .join(F.broadcast(wanted), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
    )
    return compression.fit([(r.text, r.label) for r in texts.collect()])


def with_score(docs: DataFrame, model: compression.Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: 0 to 1, higher where label 1 is likelier.

    The whole text is scored; a null text as an empty one. A column of that name is replaced.
    """

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = compression.Scorer(model)
        for batch in texts:
            yield pd.Series([scorer.score(t) for t in batch], dtype="float64")

    return docs.withColumn(name, score(F.col("text")))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their columns as they are."""
    name = free_name(docs.columns, "toxicity_score")
    scored = with_score(docs, fit(docs, labels), name)
    return scored.where(F.col(name) < threshold).drop(name)


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    rows = docs.select("doc_id", "text")
    return with_score(rows, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
