"""Packing documents into sequences: Martello-Toth reduction, then best fit, on counts of lengths.

Pieces are at most `capacity` tokens long, so the whole instance is one count for each length: at most `capacity` rows,
however many documents there are. The driver solves that instance exactly as it would the list of pieces; its plan is a
list of bin patterns with multiplicities. Each piece then learns its rank among the pieces of its length, and the rank
picks its place in the plan. Ranks need no sorting: a task numbers the pieces of each length as it makes them, and only
the counts of tasks and lengths are summed up.

Reduction (Martello and Toth, 1990): a set F of items that fits a bin dominates a set G if the items of G can be grouped
so that each group fits under a different item of F. If F holds the largest item and dominates every set that holds it,
some best packing has F as a bin; F is fixed and leaves the instance. Sets of up to three items are tried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .runtime import stored, tidy
from .tokens import TOKENIZER, codec

Pattern = tuple[tuple[int, int], ...]


def _available(counts: dict[int, int], lengths: list[int], most: int, used: tuple[int, ...]) -> int:
    """The largest length up to `most` of which a piece is left beside those used; 0 if none."""
    at = bisect_right(lengths, most)
    while at:
        at -= 1
        if counts[lengths[at]] > used.count(lengths[at]):
            return lengths[at]
    return 0


def _smallest(counts: dict[int, int], lengths: list[int], used: int, n: int) -> list[int]:
    """The n smallest pieces left beside one of length `used`."""
    out: list[int] = []
    for size in lengths:
        out += [size] * min(n - len(out), counts[size] - (size == used))
        if len(out) == n:
            break
    return out


def _dominant(counts: dict[int, int], lengths: list[int], j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with j that dominates every set that fits and holds j, or None if none is found."""
    rest = capacity - j
    if not (best := _available(counts, lengths, rest, (j,))):
        return (j,)
    low = _smallest(counts, lengths, j, 3)
    if best == rest or len(low) < 2 or low[0] + low[1] > rest:
        return (j, best)  # any other company of j goes into best's place
    if len(low) == 3 and sum(low) <= rest:
        return None
    # Two more at most. All pairs p >= q that fit: p <= first, q <= second.
    first = _available(counts, lengths, rest - low[0], (j,))
    pairs = 0
    for q in lengths[: bisect_right(lengths, rest // 2)]:
        if counts[q] > (q == j) and (p := _available(counts, lengths, rest - q, (j, q))):
            pairs = max(pairs, p + q)
    if best >= pairs:
        return (j, best)
    if first == low[0] and counts[first] - (first == j) < 2:
        return None
    second = _available(counts, lengths, rest - first, (j, first))
    widest = _available(counts, lengths, rest // 2, (j,))
    return (j, first, second) if second and second >= widest and first >= best else None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, Pattern]], dict[int, int]]:
    """Bins that some best packing has, as (how many, pattern), and the counts that remain."""
    counts = {k: v for k, v in counts.items() if v > 0}
    fixed: list[tuple[int, Pattern]] = []
    lengths = sorted(counts)
    for j in reversed(sorted(counts)):
        while counts.get(j):
            if not (chosen := _dominant(counts, lengths, j, capacity)):
                break
            need = Counter(chosen)
            n = min(counts[k] // m for k, m in need.items())  # what dominates once does so while its pieces last
            fixed.append((n, tuple(sorted(need.items(), reverse=True))))
            for k, m in need.items():
                counts[k] -= n * m
                if not counts[k]:
                    del counts[k]
                    lengths.remove(k)
    return fixed, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best fit over lengths in descending order; bins that look alike are one group."""
    groups: dict[int, list[tuple[int, Pattern]]] = defaultdict(list)
    open_: list[int] = []  # residual capacities that occur, ascending

    def put(residual: int, n: int, pattern: Pattern) -> None:
        if n:
            if not groups[residual]:
                insort(open_, residual)
            groups[residual].append((n, pattern))

    for size in sorted((k for k, v in counts.items() if v > 0), reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(open_, size)
            if at < len(open_):
                residual = open_[at]
                n, pattern = groups[residual].pop()
                if not groups[residual]:
                    del open_[at]
            else:
                residual, n, pattern = capacity, -(-left // (capacity // size)), ()
            each = residual // size
            full = min(n, left // each)
            put(residual - each * size, full, (*pattern, (size, each)))
            left -= full * each
            if full < n and left and left < each:
                put(residual - left * size, 1, (*pattern, (size, left)))
                full, left = full + 1, 0
            if pattern:
                put(residual, n - full, pattern)
    return [group for of in groups.values() for group in of]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _segments(bins: list[tuple[int, Pattern]]) -> dict[str, np.ndarray]:
    """For runs of ranks within a length: the first sequence, the place in it and how many each sequence takes."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for n, pattern in bins:
        offset = 0
        for size, each in pattern:
            rows.append((size, rank[size], sequence, offset, each))
            rank[size] += n * each
            offset += size * each
        sequence += n
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("size", "rank", "sequence", "offset", "each"))}


def pieces(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document's ids (end_id appended); part, the task that
    made it, and nth, the piece's number among that task's pieces of its length."""

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, flat, size in codec(tokenizer).slices(batch.column(1), end_id):
                many = -(-size // capacity)
                of = np.repeat(np.arange(len(size)), many)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(size[of] - start, capacity)
                raw, ends = memoryview(flat.astype("<u4", copy=False)).cast("B"), [0, *(4 * np.cumsum(length)).tolist()]
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])]
                # Pieces of one length are numbered in order.
                order = np.argsort(length, kind="stable")
                lengths, at, n = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty_like(length)
                nth[order] = np.arange(len(order)) - np.repeat(at - made[lengths], n)
                made[lengths] += n
                cols = (pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(of), part, np.int32)), pa.array(nth))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + of)), *cols], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32, sequence_id
    and offset.

    Null texts are empty (a piece of end_id alone). Rows with the same key are packed each. An empty table gives no rows.
    Pieces of equal length go by their place in the input. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, key=key, text=text, tokenizer=tokenizer, end_id=end_id, capacity=capacity), "pieces")
    out = rows.drop("part", "nth")
    # Pieces were numbered as they were made; a task's first rank of a length is what the tasks before it made of that length.
    made = stored(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r[0]: r[1] for r in made.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    placed = StructType([*out.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    if not counts:
        return spark.createDataFrame([], placed)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = stored(made.select("part", "length", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    ranked = rows.join(bases, ["part", "length"]).select(*out.columns, (F.col("base") + F.col("nth")).alias("rank"))

    seg = _segments(plan(counts, capacity))
    first = (seg["size"] << 44) | seg["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(first, (length << 44) | rank, "right") - 1
            nth = rank - seg["rank"][at]
            sequence = seg["sequence"][at] + nth // seg["each"][at]
            offset = seg["offset"][at] + nth % seg["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=placed.names)

    return ranked.mapInArrow(place, placed)
