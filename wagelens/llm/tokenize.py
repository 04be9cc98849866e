"""Documents to token ids and back, by forced-boundary splitting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wagelens.llm import bpe


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    with bpe.task_encoder(bpe.BoundaryEncoder, path) as encoder:
        for batch in batches:
            ids = list(encoder.encode(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(encoder.known, i)).hexdigest() for i in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    with bpe.task_encoder(bpe.BoundaryEncoder, path) as encoder:
        for batch in batches:
            ids = list(encoder.encode(batch.column(1).to_pylist()))
            lists = [memoryview(i).cast("I").tolist() for i in ids]
            decoded = [bpe.decode(encoder.known, i).decode("utf-8") for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lists, pa.list_(pa.int64())), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` for every row: the ids of the whole text and their decoding.

    A null text counts as an empty one: no ids and an empty decoding. No special tokens are
    added; their strings in a text become their ids, as in the library.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(partial(_round_trip, path=path), "doc_id bigint, ids array<bigint>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: what ``encoded`` holds, as checksums."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(
        partial(_digest, path=path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
