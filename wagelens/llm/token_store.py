"""Token ids in a binary store of bit-plane shuffled chunks.

The format. A store is a Parquet table ``chunks``, written by Spark's own committers, so that a
lost or repeated task leaves no half file:

* One row per chunk of a shard: ``shard, chunk, n_ids, planes, pieces``. The ids of
  a shard, in document order, are cut into blocks of ``BLOCK`` ids. A block's ids, as
  little-endian 32-bit integers, are transposed into four byte planes (all lowest bytes, then
  the next ...); plane 0 is transposed further into its eight bit planes if that compresses
  better. Every plane is compressed by zstandard alone; an empty plane stands for zeros.
* ``pieces`` is the chunk index: for every document with ids in the block its id and length,
  how many of its ids lie in earlier blocks, and which of the block's are its.

Shards are ranges of ascending doc_id, numbered in that order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wagelens.llm import bpe
from wagelens.session import staging_path

BLOCK = 65_536
LEVEL = 3
END = 2  # the id that ends every document
_PIECE = pa.struct([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
    ("skipped", pa.int64()), ("start", pa.int32()), ("n", pa.int32()),
])
_CHUNK = pa.schema([
    ("shard", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int32()),
    ("layout", pa.string()), ("planes", pa.list_(pa.binary())), ("pieces", pa.list_(_PIECE)),
])
_CHUNK_SQL = (
    "shard int, chunk int, n_ids int, layout string, planes array<binary>, pieces array<struct<"
    "doc_id: bigint, n_tokens: bigint, skipped: bigint, start: int, n: int>>"
)


def to_planes(ids: np.ndarray) -> tuple[str, list[bytes]]:
    """A block's compressed planes and their layout, ``bytes`` or ``bits``."""
    pack = zstd.ZstdCompressor(level=LEVEL, write_checksum=True).compress
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    whole = [pack(p.tobytes()) if p.any() else b"" for p in planes]
    bits = np.unpackbits(planes[0].reshape(-1, 1), axis=1).T
    split = [pack(np.packbits(b).tobytes()) if b.any() else b"" for b in bits]
    if sum(map(len, split)) < len(whole[0]):
        return "bits", split + whole[1:]
    return "bytes", whole


def from_planes(layout: str, planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block, as they went into ``to_planes``."""
    unpack = zstd.ZstdDecompressor().decompress
    out = np.zeros((n, 4), dtype=np.uint8)
    if layout == "bits":
        bits = np.zeros((n, 8), dtype=np.uint8)
        for i, plane in enumerate(planes[:8]):
            if plane:
                bits[:, i] = np.unpackbits(np.frombuffer(unpack(plane), np.uint8))[:n]
        out[:, 0] = np.packbits(bits, axis=1)[:, 0]
    for i, plane in enumerate(planes[8:] if layout == "bits" else planes, 1 if layout == "bits" else 0):
        if plane:
            out[:, i] = np.frombuffer(unpack(plane), np.uint8)
    return out.reshape(-1).view("<u4")


def _chunk_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The chunks of one shard; its documents come in order. Holds one block of ids at most
    besides a batch of documents."""
    end = np.array([END], dtype="<u4").tobytes()
    shard, chunk = TaskContext.get().partitionId(), 0
    held, size, pieces = [], 0, []

    def block() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(held), "<u4")
        layout, planes = to_planes(ids)
        values = (shard, chunk, len(ids), layout, planes, pieces)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _CHUNK)], schema=_CHUNK)

    with bpe.task_encoder(bpe.LibraryEncoder, path) as encoder:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for doc_id, ids in zip(names, encoder.encode(batch.column(1).to_pylist())):
                ids = memoryview(ids + end)
                n, done = len(ids) // 4, 0
                while done < n:
                    take = min(n - done, BLOCK - size)
                    pieces.append({
                        "doc_id": doc_id, "n_tokens": n, "skipped": done, "start": size, "n": take,
                    })
                    held.append(ids[4 * done : 4 * (done + take)])
                    done, size = done + take, size + take
                    if size == BLOCK:
                        yield block()
                        held, size, pieces, chunk = [], 0, [], chunk + 1
        if size:
            yield block()


def write_store(docs: DataFrame, folder: str, path: str, shard_rows: int = 8_192) -> None:
    """Encodes ``docs (doc_id, text)`` whole, ends each document with id 2, and writes a store.

    Documents lie in ascending order of doc_id, null first, equal ids by their text. A null
    text is an empty one. ``shard_rows`` is about how many documents a shard holds.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shards = max(1, -(-rows.count() // shard_rows))
    # Rows of one id, or of none, are dealt out by how their texts begin, in the order of whole texts.
    begins = F.substring("text", 1, 64).asc_nulls_first()
    ordered = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), begins).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    ordered.mapInArrow(partial(_chunk_rows, path=path), _CHUNK_SQL).write.option("compression", "none").parquet(
        f"{folder}/chunks"
    )


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "begin", "doc_id", "n_tokens", "skipped", "ids", "crc"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    for batch in batches:
        for chunk in batch.to_pylist():
            ids = memoryview(from_planes(chunk["layout"], chunk["planes"], chunk["n_ids"]).tobytes())
            columns: list[list] = [[] for _ in names]
            for p in chunk["pieces"]:
                own = ids[4 * p["start"] : 4 * (p["start"] + p["n"])]
                whole = p["n"] == p["n_tokens"]
                begin = chunk["chunk"] * BLOCK + p["start"] - p["skipped"]
                values = (
                    chunk["shard"], begin, p["doc_id"], p["n_tokens"], p["skipped"],
                    None if whole else bytes(own), zlib.crc32(own) if whole else None,
                )
                for column, value in zip(columns, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` for every document of a store, from its files.

    Chunks are decoded where they are read. Only documents that a chunk's end cuts through
    are put together again, each for itself.
    """
    chunks = spark.read.schema(_CHUNK_SQL).parquet(f"{folder}/chunks")
    found = chunks.mapInArrow(
        _pieces_of, "shard int, begin bigint, doc_id bigint, n_tokens bigint, skipped bigint, ids binary, crc bigint"
    )
    # Joined as text, in one step: adding up binaries would copy a long document's start each time.
    parts = F.transform(F.sort_array(F.collect_list(F.struct("skipped", "ids"))), lambda p: F.hex(p["ids"]))
    cut = found.where(F.col("crc").isNull()).groupBy("shard", "begin", "doc_id", "n_tokens").agg(
        F.crc32(F.unhex(F.array_join(parts, ""))).alias("crc")
    )
    whole = found.where(F.col("crc").isNotNull()).select("shard", "begin", "doc_id", "n_tokens", "crc")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    # One row per shard.
    offsets = chunks.groupBy("shard").agg(F.sum(F.col("n_ids").cast("bigint")).alias("size")).select(
        "shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")
    )
    return whole.union(cut).join(offsets, "shard").select(
        "doc_id", (F.col("offset") + F.col("begin")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32")
    )


def stored_documents(docs: DataFrame, path: str) -> DataFrame:
    """Writes a store to the shared staging folder and reads it back."""
    folder = staging_path(docs.sparkSession, "token-store")
    write_store(docs, folder, path)
    return read_store(docs.sparkSession, folder)
