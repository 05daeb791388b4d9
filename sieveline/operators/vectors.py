"""Exact vector search: cosine similarity in double precision."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .lexical import top


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0; vectors of different sizes are an error."""
    length = norm(a) * norm(b)
    alike = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different sizes")).cast("double"))
    return alike.when(length == 0, 0.0).otherwise(dot(a, b) / length)


def knn_by_vector(vectors: DataFrame, query: list[float], k: int, min_similarity: float | None = None) -> DataFrame:
    """(chunk_id, similarity) of the k nearest to one vector. The query is a literal: no join, and only k rows a task leave."""
    near = vectors.select("chunk_id", F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), 6).alias("similarity"))
    near = near if min_similarity is None else near.where(F.col("similarity") >= min_similarity)
    return near.orderBy(F.desc("similarity"), "chunk_id").limit(k)


#: Bytes of query vectors that one pass over the store searches for, and similarities that a task holds at once.
QUERY_BYTES, CELLS = 16 << 20, 8 << 20


class _Best:
    """The k best (query, key, similarity) that a task has met, for a block of `size` queries."""

    def __init__(self, k: int, size: int, least: float):
        self.k, self.least, self.found = k, np.full(size, max(least, -2.0)), None

    def take(self, near: np.ndarray, key: pa.Array) -> None:
        """near: queries by keys."""
        some = near >= self.least[:, None]
        if self.k < len(key) and some.sum() > self.k * len(near):
            some &= near >= np.partition(near, -self.k, axis=1)[:, [-self.k]]  # ties of the k-th stay
        row, col = np.nonzero(some)
        key, near = key.take(pa.array(col)), near[row, col]
        if self.found is not None:
            row, near = np.concatenate([self.found[0], row]), np.concatenate([self.found[2], near])
            key = pa.concat_arrays([self.found[1], key])
        order = np.lexsort((pc.rank(key, tiebreaker="dense").to_numpy(), -near, row))
        order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < self.k]
        row, near = row[order], near[order]
        self.found = row, key.take(pa.array(order)), near
        ends = np.searchsorted(row, np.arange(len(self.least)), "right")
        full = np.flatnonzero(np.diff(ends, prepend=0) == self.k)
        self.least[full] = near[ends[full] - 1]


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, *, min_similarity: float = -2.0, exclude_self: bool = False, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, chunk_id, similarity, rank) for queries (query_id, embedding) against all vectors (chunk_id, embedding).

    Ids keep their types (with exclude_self, both have the same). Rows without a vector neither search nor are found; vectors
    of different sizes are an error. Queries go to the tasks in blocks of at most query_bytes; each task multiplies its vectors
    with the block and hands on its own k best of each query, so at most k rows a task and query are shuffled.
    """
    spark = vectors.sparkSession
    rows = queries.select("query_id", "embedding").where("embedding IS NOT NULL")
    store = vectors.select("chunk_id", "embedding").where("embedding IS NOT NULL")
    types = [d.schema[0].dataType for d in (rows, store)]
    out = f"query_id {types[0].simpleString()}, chunk_id {types[1].simpleString()}, similarity double"
    arrow = to_arrow_type(types[0])

    def search(block: list) -> DataFrame:
        q = np.array([r[1] for r in block], float)
        size = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast(([r[0] for r in block], np.divide(q, size, out=np.zeros_like(q), where=size > 0)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, unit = shared.value
            ids, best = pa.array(ids, arrow), _Best(k, len(unit), min_similarity)
            step = max(1, CELLS // len(unit))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    key, lists = batch.column(0).slice(at, step), batch.column(1).slice(at, step)
                    if pc.any(pc.not_equal(pc.list_value_length(lists), unit.shape[1])).as_py():
                        raise ValueError("vectors of different sizes")
                    v = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
                    length = np.linalg.norm(v, axis=1, keepdims=True)
                    near = np.round(unit @ np.divide(v, length, out=np.zeros_like(v), where=length > 0).T, 6)
                    if exclude_self:
                        number = pa.concat_arrays([ids, key]).dictionary_encode().indices.to_numpy()
                        near[number[: len(ids), None] == number[None, len(ids) :]] = -np.inf
                    best.take(near, key)
            if best.found is not None:
                row, key, near = best.found
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), key, pa.array(near)], names=["query_id", "chunk_id", "similarity"])

        return store.mapInArrow(run, out)

    found, held = [], []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) * 8 * max(1, len(row[1])) >= query_bytes:
            found.append(search(held))
            held = []
    if held:
        found.append(search(held))
    return top(reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], out), k, score="similarity")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row (by ts) of each chunk_id; rows of `new` win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("chunk_id").orderBy(F.desc("ts"), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def hash_embedding(tokens: Column, size: int = 64) -> Column:
    """A deterministic embedding: signed counts of hashed tokens. A stand-in for a model, which is pluggable."""
    slot = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(size)).cast("int").alias("i"), F.when(F.pmod(F.hash(t), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    zero = F.array_repeat(F.lit(0.0), size)
    return F.aggregate(slot, zero, lambda v, x: F.transform(v, lambda y, i: F.when(i == x["i"], y + x["s"]).otherwise(y)))
