"""Token ids in Parquet: one list column, delta-encoded metadata, small row groups and page indexes.

Layout of a token file set (a folder):
  tokens/    part files in ascending doc_id order: doc_id, part, offset, n_tokens (DELTA_BINARY_PACKED, so that a reader
             of metadata touches some bytes a document) and ids array<int> (dictionary-encoded: the vocabulary bounds the
             dictionary, so an id costs as many bits as the row group's vocabulary needs).
  manifest/  part, base: how many ids stand before each part.
Row groups of ROW_GROUP bytes with column and offset indexes let a reader skip to a range of doc_id, and column pruning
lets it read metadata without the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import fresh_path, tidy
from .tokens import TOKENIZER, codec

ROW_GROUP, PAGE = 16 << 20, 128 << 10
_META = ("doc_id", "part", "offset", "n_tokens")


def write_tokens(docs: DataFrame, path: str | None = None, *, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = 2) -> str:
    """Encodes every whole text, appends end_id and writes the file set; returns its folder.

    Null texts are empty (only end_id). Rows with the same key stay apart, ordered by text. Null keys come first. An empty
    table gives an empty file set. Other columns of docs, whatever their names, are not read.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, offset = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, flat, size in codec(tokenizer).slices(batch.column(1), end_id):
                before = offset + np.cumsum(size) - size
                offset += len(flat)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(size)), pa.array(np.full(len(size), part, np.int32)), pa.array(before), pa.array(size), lists], names=[*_META, "ids"])

    # Texts are dealt out before they are encoded, so that sampling the range bounds encodes nothing.
    ordered = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kind = ordered.schema["doc_id"].dataType.simpleString()
    encoded = ordered.mapInArrow(encode, f"doc_id {kind}, part int, offset bigint, n_tokens bigint, ids array<int>")
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.page.row.count.limit": 2000, "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true"}
    encoded.write.options(**options).parquet(f"{path}/tokens")
    # One row for each part file; the window runs over these alone.
    parts = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    base = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts.select("part", base.alias("base")).write.parquet(f"{path}/manifest")
    return path


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, *, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if asked for, ids. `where` (on doc_id or n_tokens) reaches the scan, which skips row
    groups and pages; without ids only metadata is read."""
    rows = spark.read.parquet(f"{path}/tokens")
    rows = rows.where(where) if where is not None else rows
    manifest = spark.read.parquet(f"{path}/manifest")  # as many rows as there are part files
    return rows.join(F.broadcast(manifest), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", *["ids"] * ids)


def with_crc(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = tokens.select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(digest, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint")
