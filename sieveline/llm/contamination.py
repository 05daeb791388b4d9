"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Containment of a short item in a long document says nothing about their Jaccard similarity, so documents get no
signature. Items do: the smallest hashes of an item's shingles (a bottom-m MinHash sketch). Items are partitioned by size,
and in each partition m is the least number that no match evades: if a document holds a share t of an item's q shingles, it
lacks at most q - ceil(t q) of them, so it holds one of any q - ceil(t q) + 1. A document probes the sketches with all of
its shingles; items that it hits are verified on the words themselves. The search is thus exact, and neither documents nor
their shingles are moved. Items are searched in blocks of a bounded number of shingles, whatever their number.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, THRESHOLD = 5, 0.8
#: Shingles of the items that are searched in one pass (their words are broadcast, some 100 MB at most).
BLOCK = 1_000_000
#: Words whose hashes one worker keeps before it starts afresh.
CACHE = 300_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(of: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of k words; a shorter text is one run of all its words."""
    return {tuple(of[i : i + k]) for i in range(max(1, len(of) - k + 1))} if of else set()


class Hasher:
    """64-bit hashes of words, and of runs of words, for whole texts."""

    def __init__(self) -> None:
        self.kept: dict[str, tuple[int, ...]] = {}

    def _word(self, raw: str) -> tuple[int, ...]:
        own = tuple(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in _WORD.findall(raw))
        if len(raw) <= 64:
            if len(self.kept) >= CACHE:
                self.kept.clear()
            self.kept[raw] = own
        return own

    def words(self, text: str | None) -> np.ndarray:
        get, out = self.kept.get, []
        for raw in (text or "").lower().split():
            own = get(raw)
            out += self._word(raw) if own is None else own
        return np.array(out, np.uint64)

    @staticmethod
    def runs(h: np.ndarray, k: int) -> np.ndarray:
        if len(h) < k:
            return h[:0]
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX
            out ^= out >> np.uint64(29)
        return out


class Items:
    """A block of items, ready to be searched for. rows: (number, text)."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float = THRESHOLD, shingle: int = SHINGLE):
        self.threshold = threshold
        hasher = Hasher()
        self.own: dict[int, set[tuple[str, ...]]] = {}
        partitions: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for number, text in rows:
            of = words(text)
            if not of:
                continue
            k = min(shingle, len(of))
            self.own[number] = shingles(of, k)
            hashes = np.unique(hasher.runs(hasher.words(text), k))
            partitions[k, len(self.own[number]).bit_length()].append((number, hashes))
        sketches: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for (k, _), members in partitions.items():
            largest = max(len(self.own[n]) for n, _ in members)
            m = largest - math.ceil(threshold * largest - 1e-9) + 1
            for number, hashes in members:
                for h in hashes[:m].tolist():  # ascending: the smallest
                    sketches[k][h].append(number)
        self.sketches = {k: (np.array(sorted(s), np.uint64), [s[h] for h in sorted(s)]) for k, s in sketches.items()}

    def search(self, text: str | None, hasher: Hasher) -> list[tuple[int, int]]:
        """(number, shingles shared) of each item that the text contains to the threshold."""
        h = hasher.words(text)
        hit: set[int] = set()
        for k, (sketch, numbers) in self.sketches.items():
            runs = hasher.runs(h, k)
            at = np.minimum(np.searchsorted(sketch, runs), len(sketch) - 1)
            for i in set(at[sketch[at] == runs].tolist()):
                hit.update(numbers[i])
        if not hit:
            return []
        of, out = words(text), []
        held = {k: shingles(of, k) for k in {len(next(iter(self.own[n]))) for n in hit} if len(of) >= k}
        for number in sorted(hit):
            own = self.own[number]
            shared = len(own & held.get(len(next(iter(own))), set()))
            if shared >= self.threshold * len(own) - 1e-9:
                out.append((number, shared))
        return out


def _blocks(items: DataFrame, key: str, text: str, block: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of about `block` words; one block at a time is on the driver."""
    held: list[tuple[object, str]] = []
    size = 0
    for row in items.where(F.col(text).isNotNull()).select(F.col(key), F.col(text)).toLocalIterator():
        n = len(row[1]) // 4 + 1
        if held and size + n > block:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    if held:
        yield held


def find(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared and containment for each document and item that it contains.

    An item of fewer than `shingle` words is one shingle of all its words. Items and documents without words match
    nothing. Repeated rows, of either table, match each. Empty tables give no rows.
    """
    spark = docs.sparkSession
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shingles int, n_shared int, containment double"
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = None
    for some in _blocks(items, item_key, item_text, block):
        shared = spark.sparkContext.broadcast(([k for k, _ in some], Items([(n, t) for n, (_, t) in enumerate(some)], threshold, shingle)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, index = shared.value
            hasher = Hasher()
            for batch in batches:
                hits = [(i, n, s) for i, t in enumerate(batch.column(1).to_pylist()) for n, s in index.search(t, hasher)]
                sizes = [len(index.own[n]) for _, n, _ in hits]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _, _ in hits], pa.int64())), pa.array([keys[n] for _, n, _ in hits], item_type), pa.array(sizes, pa.int32()), pa.array([s for *_, s in hits], pa.int32()), pa.array([s / q for (*_, s), q in zip(hits, sizes)], pa.float64())], names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        item_type = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, that contain no item; see find() for what counts."""
    spark = docs.sparkSession
    for some in _blocks(items, item_text, item_text, block):
        shared = spark.sparkContext.broadcast(Items([(n, t) for n, (_, t) in enumerate(some)], threshold, shingle))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hasher = shared.value, Hasher()
            for batch in batches:
                keep = [not index.search(t, hasher) for t in batch.column(text_at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        text_at = docs.columns.index(text)
        docs = docs.mapInArrow(run, docs.schema)
    return docs
