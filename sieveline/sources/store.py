"""Where an index lives: Parquet (or JSON) folders under one path.

Chunks and vectors have numbered versions, `chunks/v0`, `chunks/v1` ...; the newest that is complete (has its _SUCCESS) counts.
Replacing a table writes the next version, so that readers keep what they opened and a writer that dies leaves the old one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import upsert

VECTORS = "chunk_id bigint, embedding array<float>, ts timestamp"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may do without."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: driver and executors share no other folder")
    return tempfile.mkdtemp(prefix="sieveline-")


class ChunkStore:
    """chunks/ (partitioned by type), postings/, vectors/ and graph/ under a path; by default a new one in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def versions(self, name: str) -> list[int]:
        """The complete versions of a table, oldest first."""
        path, fs = self._path(name)
        found = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(v[1:]) for v in found if v[:1] == "v" and v[1:].isdigit() and self._exists(f"{name}/{v}/_SUCCESS"))

    def version_path(self, name: str, version: int) -> str:
        return f"{self.path}/{name}/v{version}"

    def _newest(self, name: str) -> str | None:
        found = self.versions(name)
        return self.version_path(name, found[-1]) if found else None

    def _next(self, name: str) -> str:
        return self.version_path(name, max(self.versions(name), default=-1) + 1)

    def append_chunks(self, chunks: DataFrame) -> None:
        chunks.write.mode("append").partitionBy("type").parquet(self._newest("chunks") or self._next("chunks"))

    def overwrite_chunks(self, chunks: DataFrame) -> None:
        """A new version; it may be made from the one before."""
        chunks.write.mode("overwrite").partitionBy("type").parquet(self._next("chunks"))

    def chunks(self) -> DataFrame | None:
        """The table as it is now: a snapshot that later versions don't change. Ask again to see them."""
        path = self._newest("chunks")
        return self.spark.read.parquet(path) if path else None

    def save_vectors(self, vectors: DataFrame, fmt: str = "parquet") -> None:
        rows = vectors if "ts" in vectors.columns else vectors.withColumn("ts", F.current_timestamp())
        rows = rows.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"), "ts")
        rows.write.mode("overwrite").format(fmt).save(self._next("vectors"))

    def vectors(self, fmt: str = "parquet") -> DataFrame:
        """An empty table if nothing was saved."""
        path = self._newest("vectors")
        return self.spark.read.schema(VECTORS).format(fmt).load(path) if path else self.spark.createDataFrame([], VECTORS)

    def upsert_vectors(self, vectors: DataFrame, fmt: str = "parquet") -> None:
        """Vectors of new chunks, and newer ones of known chunks, as a new version."""
        new = vectors if "ts" in vectors.columns else vectors.withColumn("ts", F.current_timestamp())
        self.save_vectors(upsert(self.vectors(fmt), new.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"), "ts")), fmt)

    def get_vectors(self, ids: DataFrame, fmt: str = "parquet") -> DataFrame:
        """The stored rows of ids (chunk_id)."""
        return self.vectors(fmt).join(ids.select("chunk_id"), "chunk_id", "left_semi")

    def contains_vectors(self, ids: DataFrame, fmt: str = "parquet") -> DataFrame:
        """ids (chunk_id) with `stored`."""
        known = self.vectors(fmt).select("chunk_id").distinct().withColumn("stored", F.lit(True))
        return ids.join(known, "chunk_id", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))

    def remove_vectors(self, ids: DataFrame, fmt: str = "parquet") -> None:
        """A new version without ids (chunk_id); unknown ids change nothing."""
        self.save_vectors(self.vectors(fmt).join(ids.select("chunk_id"), "chunk_id", "left_anti"), fmt)

    def vacuum(self) -> None:
        """Deletes all versions but the newest of each table; readers of older ones must be done."""
        for name in ("chunks", "vectors"):
            for version in self.versions(name)[:-1]:
                path, fs = self._path(f"{name}/v{version}")
                fs.delete(path, True)

    def clear(self) -> None:
        for name in ("chunks", "vectors", "postings", "graph"):
            path, fs = self._path(name)
            fs.delete(path, True)

    def status(self) -> dict[str, bool]:
        return {name: self._exists(name) for name in ("chunks", "postings", "vectors", "graph")}
