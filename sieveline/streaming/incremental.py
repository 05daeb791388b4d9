"""Incremental indexing: a folder of chunk files as a stream, postings appended and vectors upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens
from ..operators.lexical import postings
from ..operators.vectors import hash_embedding, upsert
from ..sources.store import ChunkStore

CHUNKS = "chunk_id bigint, content string, type string, ts timestamp"


def chunk_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CHUNKS).parquet(folder)


def latest(chunks: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The stream without repeats of a chunk within the watermark."""
    return chunks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["chunk_id"])


def index_stream(chunks: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Each batch is one folder of postings (written whole or not at all, so a batch that runs twice changes nothing) and one
    new version of the vectors, which ChunkStore reads."""
    spark, tables = chunks.sparkSession, ChunkStore(chunks.sparkSession, store)

    def take(batch: DataFrame, number: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{store}/postings/batch={number}")
        new = batch.select("chunk_id", hash_embedding(tokens(F.col("content"))).cast("array<float>").alias("embedding"), "ts")
        if number:
            new = upsert(spark.read.parquet(tables.version_path("vectors", number - 1)), new)
        new.write.mode("overwrite").parquet(tables.version_path("vectors", number))

    return chunks.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def type_counts(chunks: DataFrame, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Chunks of each type in tumbling windows; late ones count until the watermark."""
    return chunks.withWatermark("ts", lateness).groupBy(F.window("ts", window), "type").count()
