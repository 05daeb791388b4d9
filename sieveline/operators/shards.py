"""Exact top-k BM25 of many queries at once: shards of documents, scored by matrix products and posting lists.

A shard is a part of the documents (of one task's input). Its documents are grouped by the frequent terms they share, and queries
come in blocks of alike ones. For a block and a group, terms that many queries and many documents have are multiplied as
matrices (32 bits), the lists of all others are summed. That score is off by a known share at most: documents that can reach
the query's k-th best score by it are scored again, in 64 bits and whole. No list is cut and no document left out.

A sixteenth of the documents is searched first. The k-th best score there is a floor: the other shards hand on nothing below it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Queries of a block; share of a block's (query, document) pairs from which a term is multiplied; query terms of a broadcast.
BLOCK, LONG, TERMS = 256, 0.004, 1_000_000
#: Groups of a shard, frequent terms by which they are made, documents of a shard that are searched first, and their share.
GROUPS, MARKS, LEAD, FIRST = 8, 256, 4000, 16
#: Postings of a shard: a task with more makes several shards, one after the other.
POSTINGS = 4_000_000
#: Queries whose lists are summed at once; an entry of a list.
FEW, PAIR = 8, np.dtype([("doc", "i4"), ("impact", "f4")])


def _expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + size[i] - 1, for each i."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _centres(rows: np.ndarray, most: int) -> np.ndarray:
    """Means of at most `most` groups of alike rows (of length 1): each starts where the others are far."""
    some = rows[:: max(1, len(rows) // 2000)]
    found, near = [some[0]], some @ some[0]
    while len(found) < most and near.min() < 0.5:
        found.append(some[near.argmin()])
        near = np.maximum(near, some @ found[-1])
    centres = np.array(found)
    for _ in range(4):
        label = (some @ centres.T).argmax(axis=1)
        centres = np.array([some[label == i].mean(axis=0) for i in range(len(centres)) if (label == i).any()])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


class Shard:
    """A part of the documents: rank (of their ids, for ties), ends, terms, tf (all lists one after the other) and dl."""

    def __init__(self, rank: np.ndarray, ends: np.ndarray, terms: np.ndarray, tf: np.ndarray, dl: np.ndarray, mean: float, long: float = LONG):
        self.n, self.rank, self.long = len(rank), rank, long
        self.terms, term = np.unique(terms, return_inverse=True)
        self.term, self.tf = term.astype(np.int32), tf.astype(np.int32)
        del term
        self.size, self.start = np.diff(ends), ends[:-1] - ends[0]
        self.norm = K1 * (1 - B + B * dl / max(mean, 1e-9))
        df = np.bincount(self.term, minlength=len(self.terms))
        marks = np.argsort(-df, kind="stable")[:MARKS]
        self.mark = np.full(len(self.terms), -1, np.int32)
        self.mark[marks] = np.arange(len(marks))
        # Words that nearly all documents have say little of what a document is like.
        self.say = np.log(1 + self.n / np.maximum(df[marks], 1)).astype(np.float32)
        rows = self._marked(np.repeat(np.arange(self.n, dtype=np.int32), self.size), self.term, self.n)
        self.centres = _centres(rows, GROUPS)
        label = (rows @ self.centres.T).argmax(axis=1)
        del rows
        self.groups = [self._group(np.flatnonzero(label == g)) for g in range(len(self.centres)) if (label == g).any()]

    def _marked(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        column = self.mark[term]
        some = column >= 0
        out = np.zeros((n, len(self.say)), np.float32)
        out[row[some], column[some]] = self.say[column[some]]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def _impact(self, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the postings at, which are all those of docs one after the other."""
        tf = self.tf[at]
        return tf / (tf + np.repeat(self.norm[docs], self.size[docs]))

    def _group(self, docs: np.ndarray) -> tuple:
        """Documents; their lists by term: first place, size, documents (numbers in the group), impacts; rows of long lists."""
        at = _expand(self.start[docs], self.size[docs])
        term, doc = self.term[at], np.repeat(np.arange(len(docs), dtype=np.int32), self.size[docs])
        by = np.argsort(term, kind="stable")
        size = np.bincount(term, minlength=len(self.terms)).astype(np.int32)
        first = np.cumsum(size, dtype=np.int32) - size
        pairs = np.empty(len(at), PAIR)
        pairs["doc"], pairs["impact"] = doc[by], self._impact(docs, at)[by]
        long = np.flatnonzero(size > max(8, 8 * self.long * len(docs)))
        row = np.full(len(self.terms), -1, np.int32)
        row[long] = np.arange(len(long))
        dense = np.zeros((len(long), len(docs)), np.float32)
        where = _expand(first[long], size[long])
        dense[np.repeat(np.arange(len(long)), size[long]), pairs["doc"][where]] = pairs["impact"][where]
        return docs, first, size, pairs.view(np.int64), row, dense

    def top(self, starts: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, floor: np.ndarray | None = None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, documents, scores) with the k best of each query that reach its floor. starts: where each query's
        entries of term (numbers; -1: not held) and weight begin. Scores are rounded to six places."""
        query = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(starts, append=len(term)))
        held = term >= 0
        query, term, weight = query[held], term[held], weight[held]
        label = np.zeros(len(starts), int)
        for a in range(0, len(starts), 4096):
            of = slice(*np.searchsorted(query, [a, a + 4096]))
            label[a : a + 4096] = (self._marked(query[of] - a, term[of], min(4096, len(starts) - a)) @ self.centres.T).argmax(axis=1)
        bounds = np.searchsorted(query, np.arange(len(starts) + 1))
        known, floor = floor is not None, np.zeros(len(starts)) if floor is None else floor.copy()
        found, full, number = [], np.zeros(len(self.terms)), np.zeros(len(self.terms), np.int64)
        order = np.argsort(label, kind="stable")
        for a in range(0, len(order), block):
            some = order[a : a + block]
            size = bounds[some + 1] - bounds[some]
            where = _expand(bounds[some], size)
            t, w, q = term[where], weight[where], np.repeat(np.arange(len(some)), size)
            ends = np.append(0, np.cumsum(size))
            many = np.bincount(t, minlength=len(self.terms))
            seen = np.flatnonzero(many)
            number[seen] = np.arange(len(seen))
            at = number[t]
            for docs, *lists in self.groups if len(t) else ():
                near, share = self._near(q, at, w, seen, many[seen], len(some), len(docs), lists)
                least = floor[some]
                if not known and len(docs) >= k:
                    # k documents of this group reach this, so the k-th best does.
                    least = np.maximum(least, np.partition(near, len(docs) - k, axis=1)[:, len(docs) - k] * (1 - share))
                hit = near >= np.maximum((least - 2e-6) * (1 - share), 1e-30)[:, None].astype(np.float32)
                row, col = np.nonzero(hit)
                cuts = np.searchsorted(row, np.arange(len(some) + 1))
                for i in np.unique(row).tolist():
                    own = docs[col[cuts[i] : cuts[i + 1]]]
                    mine = slice(ends[i], ends[i + 1])
                    full[t[mine]] = w[mine]
                    long = self.size[own]
                    places = _expand(self.start[own], long)
                    score = np.round(np.add.reduceat(full[self.term[places]] * self._impact(own, places), np.cumsum(long) - long), 6)
                    full[t[mine]] = 0
                    keep = (score >= floor[some[i]]) & (score > 0)
                    own, score = own[keep], score[keep]
                    if len(own) > k:
                        best = np.lexsort((self.rank[own], -score))[:k]
                        own, score = own[best], score[best]
                    if len(own) == k:
                        floor[some[i]] = max(floor[some[i]], score.min())
                    found.append((np.full(len(own), some[i]), own, score))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        query, docs, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((self.rank[docs], -score, query))
        query, docs, score = query[order], docs[order], score[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[best], docs[best], score[best]

    def _near(self, q, t, w, seen, many, rows: int, n: int, lists) -> tuple[np.ndarray, float]:
        """Scores of a block's queries and a group's documents, and the share by which they may be off. Entries: queries, places
        in seen, weights; seen: the block's terms, of which so `many` queries have each."""
        first, size, pairs, row, dense = lists
        size, row = size[seen], row[seen]
        long = (row >= 0) & (many * size > self.long * rows * n)
        near = np.empty((rows, n), np.float32)
        size = np.where(long, 0, size)[t]
        short = np.flatnonzero(size)
        size, first, query, weight = size[short], first[seen][t[short]].astype(np.int64), q[short] % FEW * n, w[short]
        cuts = np.searchsorted(q[short], np.arange(0, rows + FEW, FEW))
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            got = pairs.take(_expand(first[a:b], size[a:b]), mode="clip").view(PAIR)
            place, value = np.repeat(query[a:b], size[a:b]), np.repeat(weight[a:b], size[a:b])
            place += got["doc"]
            value *= got["impact"]
            few = near[i * FEW : i * FEW + FEW]
            few[:] = np.bincount(place, value, minlength=few.size).reshape(few.shape)
        columns = np.count_nonzero(long)
        if columns:
            of = np.flatnonzero(long[t])
            weights = np.zeros((rows, columns), np.float32)
            weights[q[of], (np.cumsum(long) - 1)[t[of]]] = w[of]
            near += weights @ dense[row[long]]
        return near, (columns + 16) * 2.0**-23


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of at most so many postings, or 500 texts: what a shard holds in memory."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            more = len(some.column("terms").flatten())
            if held and size + more > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(some)
            size += more
    if held:
        yield pa.Table.from_batches(held)


def search(index: DataFrame, entries: DataFrame, k: int, n: int, mean: float, stored: Callable[[DataFrame, str], DataFrame], *, block: int = BLOCK, long: float = LONG, terms: int = TERMS, lead: int = LEAD, postings: int = POSTINGS) -> DataFrame:
    """query_id, chunk_id, score and rank: the k best documents of each query, scores to six places, ties to the smaller id.

    index: chunk_id, terms (distinct 64-bit hashes), tf, dl; n rows of that mean length. entries: query_id, term, qtf and idf, once a
    query and term. Both are read more than once. Ids may be of any types that compare. stored(table, label) writes a table to the
    folder that driver and executors share, and reads it.
    """
    spark = index.sparkSession
    kinds = [d.schema[0].dataType for d in (entries, index)]
    schema = f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double"
    parts = -(-entries.count() // terms)
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    names, shared = [], []
    for part in range(parts):
        rows = entries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        coded = pc.dictionary_encode(rows["query_id"]).combine_chunks()
        query = coded.indices.to_numpy()
        term, at, number = np.unique(rows["term"].to_numpy(), return_index=True, return_inverse=True)
        order = np.argsort(query, kind="stable")
        starts = np.searchsorted(query[order], np.arange(len(coded.dictionary)))
        qtf, idf = rows["qtf"].to_numpy()[order].astype(np.int32), rows["idf"].to_numpy()[at]
        names.append(coded.dictionary)
        shared.append(spark.sparkContext.broadcast((coded.dictionary, starts, number[order].astype(np.int32), qtf, term, idf)))

    def found(docs: DataFrame, floors) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _pieces(batches, postings):
                yield from searched(table)

        def searched(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            lists, tf, ids = (table[c].chunk(0) for c in ("terms", "tf", "chunk_id"))
            if not len(lists.flatten()):
                return
            rank = pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
            shard = Shard(rank, lists.offsets.to_numpy(), lists.flatten().to_numpy(), tf.flatten().to_numpy(), table["dl"].to_numpy(), mean, long)
            del table, lists, tf
            pa.default_memory_pool().release_unused()
            for part, value in enumerate(shared):
                names, starts, number, qtf, term, idf = value.value
                vars(value).pop("_value", None)  # one part in memory at a time
                place = np.minimum(np.searchsorted(shard.terms, term), len(shard.terms) - 1)
                place = np.where(shard.terms[place] == term, place, -1).astype(np.int32)
                weight = qtf * idf[number]
                del term, qtf, idf
                query, own, score = shard.top(starts, place[number], weight, k, floors and floors.value[part], block)
                for a in range(0, len(query), 20_000):
                    of = slice(a, a + 20_000)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(query[of])), ids.take(pa.array(own[of])), pa.array(score[of])], names=["query_id", "chunk_id", "score"])

        return docs.mapInArrow(run, schema)

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if n <= lead:
        return stored(best(found(index, None)), "found")
    early = F.pmod(F.xxhash64("chunk_id"), F.lit(FIRST)) == 0
    first = stored(best(found(index.where(early).repartition(-(-n // (FIRST * lead))), None)), "found-first")
    last = first.where(F.col("rank") == k).select("query_id", "score").toArrow().combine_chunks()
    floors = []
    for own in names:
        at = pc.index_in(own, last["query_id"]) if last.num_rows else pa.nulls(len(own), pa.int32())
        floors.append(last["score"].take(at).fill_null(0.0).to_numpy() if last.num_rows else np.zeros(len(own)))
    rest = found(index.where(~early), spark.sparkContext.broadcast(floors))
    return stored(best(first.drop("rank").unionByName(rest)), "found")
