"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into `radius // 2 + 1` segments (three for a radius of 4), fewer than an exact-match index
would need: of two fingerprints within the radius, one segment differs by one bit at most. Each fingerprint is indexed
under every segment with each of its bits wiped (64 signatures), so that such a pair meets under an equal signature; the
pairs that meet are verified on all 64 bits. Exact copies are one node of the index, whatever their number.

Fingerprints that meet are searched breadth first: a found node leaves the rest of its bucket, so a bucket yields at most
one link fewer than it has members (a spanning forest of all its links), never all pairs. A bucket above CELL members is
handed on and dealt out as pairs of blocks, each a task of its own.

For a similarity of shingle sets instead of a radius (`similar_documents`), fingerprints are candidates' index only. They
have WIDTH words and hold the shingles of INDEX_SHINGLE words: an edited word changes fewer of these than of longer ones, so
that fewer bits move. At a similarity of 0.8 (five words, edits here and there) a bit differs with a probability of 0.09, one
of nine segments of 21 bits then differs by one bit at most with a probability of 0.99. Fingerprints within the radius form
groups, and inside a group texts are compared on their shingle sets themselves, so that what is linked is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import stored

SEED = 42
#: Members of a bucket that one task searches; larger ones are dealt out as pairs of blocks of half as many.
CELL = 20_000
#: Bytes of text that are hashed at once.
SLICE = 1_000_000
#: Of the index for a similarity: words of a shingle, words of 64 bits of a fingerprint.
INDEX_SHINGLE, WIDTH = 2, 3
#: Hashes of shingles that one task compares with each other; larger groups are dealt out as pairs of blocks of half as many.
COMPARED = 4_000_000
# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _stir(lane: np.ndarray, into: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
    return _turn(into + lane * P2, 31) * P1


def xxh64_spans(buffer: bytes, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of a buffer, a group of equal lengths at a time."""
    raw = np.frombuffer(buffer + bytes(8), np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))).view("<u8")[:, 0]
    out = np.empty(len(start), np.uint64)
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    seed = np.uint64(seed)
    with np.errstate(over="ignore"):
        for length, where in zip(lengths.tolist(), np.split(order, first[1:])):
            at = start[where]
            if length > 400:  # a lone long word: nothing to gain here
                out[where] = [xxhash.xxh64_intdigest(buffer[a : a + length], int(seed)) for a in at.tolist()]
                continue
            done = 0
            if length >= 32:
                v = [np.full(len(at), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
                for done in range(0, length - 31, 32):
                    v = [_stir(words[at + (done + 8 * k)], v[k]) for k in range(4)]
                done += 32
                h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
                for x in v:
                    h = (h ^ _stir(x)) * P1 + P4
            else:
                h = np.full(len(at), seed + P5, np.uint64)
            h = h + np.uint64(length)
            while done + 8 <= length:
                h = _turn(h ^ _stir(words[at + done]), 27) * P1 + P4
                done += 8
            if done + 4 <= length:
                h = _turn(h ^ ((words[at + done] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
                done += 4
            while done < length:
                h = _turn(h ^ (raw[at + done].astype(np.uint64) * P5), 11) * P1
                done += 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[where] = h ^ (h >> np.uint64(32))
    return out


def _majorities(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes; `of` has their sizes, all above zero."""
    # Eight counters of a byte each are summed as one word, over runs of 255 hashes at most.
    runs = -(-of // 255)
    ends = np.cumsum(of)
    run_at = np.repeat(ends - of, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    group_at = np.cumsum(runs) - runs
    out = np.zeros(len(of), np.uint64)
    for bit in range(8):
        sums = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), run_at)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), group_at)
        for byte in range(8):
            out |= (2 * counts[:, byte] > of).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def normal_words(text: bytes | None) -> bytes:
    """A text's words in lower case, a blank between them: on bytes, A-Z and the six ASCII blanks only."""
    return b" ".join((text or b"").lower().split())


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of normal_words that aren't empty, one text after the other, and how many each text has."""
    buffer = b" ".join(texts)
    cut = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
    begin, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(buffer)]])
    n = np.array([x.count(b" ") + 1 for x in texts])
    first = np.cumsum(n) - n
    many = np.maximum(n - shingle + 1, 1)
    i = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    last = i + np.repeat(np.minimum(n, shingle) - 1, many)
    return xxh64_spans(buffer, begin[i], end[last] - begin[i]), many


def simhash(texts: list[bytes | None], shingle: int = 4, width: int = 1) -> np.ndarray:
    """Fingerprints of UTF-8 texts, a column for each of `width` words of 64 bits; zero where a text has no word."""
    out = np.zeros((len(texts), width), np.uint64)
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        if not held:
            return
        h, many = shingle_hashes([x for _, x in held], shingle)
        for word in range(width):
            out[[k for k, _ in held], word] = _majorities(h, many)
            h = (h ^ (h >> np.uint64(31))) * P1  # another hash of the same shingle
            h ^= h >> np.uint64(29)
        held.clear()

    size = 0
    for k, text in enumerate(texts):
        if words := normal_words(text):
            held.append((k, words))
            size += len(words)
            if size >= SLICE:
                flush()
                size = 0
    flush()
    return out


def words_of(width: int) -> list[str]:
    return [f"fp{w}" for w in range(width)]


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4, width: int = 1) -> DataFrame:
    """doc_id and fp0, fp1, ... (the fingerprint's bits as longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                fp = simhash(some.column(1).to_pylist(), shingle, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(fp[:, w]) for w in range(width))], names=["doc_id", *words_of(width)])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in words_of(width))}")


def node_id(fps: np.ndarray) -> np.ndarray:
    """One long for a fingerprint: itself if it is one word. Only fingerprints that differ by two bits or so can share one."""
    out = fps[:, 0]
    for w in range(1, fps.shape[1]):
        out = out ^ _turn(fps[:, w], 7 * w)
    return out.view(np.int64)


def node_column(width: int) -> Column:
    """The same in Spark."""
    out = F.col("fp0")
    for w in range(1, width):
        out = out.bitwiseXOR(F.shiftleft(f"fp{w}", 7 * w).bitwiseOR(F.shiftrightunsigned(f"fp{w}", 64 - 7 * w)))
    return out


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among these fingerprints (rows of uint64, distinct), found breadth first."""
    left, out = fps, []
    while len(left) > 1:
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x).sum(axis=1) <= radius
            if near.any():
                found = left[near]
                out += [(int(node_id(x)[0]), y) for y in node_id(found).tolist()]
                queue += [found[i : i + 1] for i in range(len(found))]
                left = left[~near]
    return out


def _signatures(radius: int, bits: int = 64) -> list[int]:
    """For each bit, the mask of its segment without it."""
    parts = radius // 2 + 1
    ends = [round(bits * i / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in range(lo, hi) if b != k) for lo, hi in zip(ends, ends[1:]) for k in range(lo, hi)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _search(radius: int, cell: int | None, width: int):
    """Over rows (bucket columns..., fingerprint words) sorted by bucket: yields (a, b, fp0..., hot). Links have hot false;
    members of a bucket that is larger than `cell` come out as the signature's number, their words and hot true."""

    def close(fps: list[np.ndarray], number: int, links: list, hot: list) -> None:
        members = np.unique(np.concatenate(fps), axis=0) if len(fps) > 1 or len(fps[0]) > 1 else fps[0]
        if cell and len(members) > cell:
            hot.append((np.full(len(members), number, np.int64), members.view(np.int64)))
        elif len(members) > 1:
            links += forest(members, radius)

    def batch_of(links: list, hot: list) -> pa.RecordBatch:
        a, b = (np.array(x, np.int64) for x in (zip(*links) if links else ((), ())))
        numbers = np.concatenate([a, *(n for n, _ in hot)])
        words = np.concatenate([np.zeros((len(a), width), np.int64), *(m for _, m in hot)])
        other = np.concatenate([b, np.zeros(len(numbers) - len(b), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(other), *(pa.array(np.ascontiguousarray(words[:, w])) for w in range(width)), pa.array(np.arange(len(numbers)) >= len(a))], names=["a", "b", *words_of(width), "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        bucket, links, hot = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [c.to_numpy() for c in batch.columns[:-width]]
            fp = np.stack([c.to_numpy() for c in batch.columns[-width:]], axis=1).view(np.uint64)
            change = np.zeros(len(fp) - 1, bool)
            for c in keys:
                change |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            ends = np.append(starts[1:], len(fp))
            # Most buckets have one member or two; all pairs of the batch are verified at once, and only larger buckets and
            # those at the batch's ends are looked at one by one.
            look = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(fp)))
            pairs = look[(ends - starts)[look] == 2]
            inner = pairs[(starts[pairs] > 0) & (ends[pairs] < len(fp))]
            a, b = fp[starts[inner]], fp[starts[inner] + 1]
            apart = np.bitwise_count(a ^ b).sum(axis=1)
            near = (apart <= radius) & (apart > 0)
            links += zip(node_id(a[near]).tolist(), node_id(b[near]).tolist())
            for g in np.setdiff1d(look, inner, assume_unique=True).tolist():
                this = tuple(c[starts[g]] for c in keys)
                if this != bucket and held:
                    close(held, int(bucket[0]), links, hot)
                    held = []
                bucket = this
                held.append(fp[starts[g] : ends[g]])
            if len(links) > 20_000 or hot:
                yield batch_of(links, hot)
                links, hot = [], []
        if held:
            close(held, int(bucket[0]), links, hot)
        yield batch_of(links, hot)

    return run


def links(nodes: DataFrame, radius: int = 4, cell: int = CELL, width: int = 1, segments_for: int = 4) -> DataFrame:
    """nodes: (fp0, ...), distinct. Returns (a, b) of node ids: links within the radius, enough of them to connect all that
    are linked and meet under a signature."""
    masks = F.array(*[F.lit(_signed(m)) for m in _signatures(segments_for)])
    words = words_of(width)
    out_schema = f"a bigint, b bigint, {', '.join(f'{c} bigint' for c in words)}, hot boolean"
    # A signature follows from its number and the words: rows are dealt by it, but don't carry it.
    signature = F.element_at(F.array(*words), F.floor(F.col("k") / 64).cast("int") + 1).bitwiseAND(F.element_at(masks, F.col("k") % 64 + 1))
    keyed = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(64 * width - 1))).alias("k"), *words)
    dealt = keyed.repartition("k", signature).select("k", signature.alias("signature"), *words).sortWithinPartitions("k", "signature")
    found = stored(dealt.mapInArrow(_search(radius, cell, width), out_schema), "links")
    out = found.where("not hot").select("a", "b")
    if found.where("hot").limit(1).count():
        hot = found.where("hot").select(F.col("a").cast("int").alias("k"), *words).withColumn("signature", signature)
        sizes = hot.groupBy("k", "signature").count().select("k", "signature", F.ceil(F.col("count") * 2 / cell).cast("int").alias("blocks"))
        own = hot.join(sizes, ["k", "signature"]).withColumn("block", F.pmod(F.xxhash64(*words), F.col("blocks")).cast("int"))
        other = own.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))))
        cells = other.select("k", "signature", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *words)
        cells = cells.repartition("k", "signature", "i", "j").sortWithinPartitions("k", "signature", "i", "j")
        out = out.unionByName(cells.mapInArrow(_search(radius, None, width), out_schema).select("a", "b"))
    return out


def radius_for(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of texts with this Jaccard similarity differ at most, but for one pair in a hundred."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + 2.4 * math.sqrt(bits * share * (1 - share)))


def noted(docs: DataFrame, *, key: str, text: str, shingle: int, width: int) -> DataFrame:
    """doc_id, h (of the text as it is), node (of its words in lower case; zero without any), n_words, fp0, fp1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                words = [normal_words(x) for x in some.column(2).to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(x, SEED) if x else 0 for x in words], np.uint64).view(np.int64)
                n = pa.array([x.count(b" ") + bool(x) for x in words], pa.int64())
                fp = simhash(words, shingle, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(node), n, *(pa.array(fp[:, w]) for w in range(width))], names=["doc_id", "h", "node", "n_words", *words_of(width)])

    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h bigint, node bigint, n_words bigint, {', '.join(f'{c} bigint' for c in words_of(width))}")


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest, breadth first, of the links among these sets (sorted arrays): pairs of their numbers."""
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    sets = np.split(flat, np.cumsum(size)[:-1])
    own = np.zeros(len(vocabulary), bool)
    left, out = np.argsort(size, kind="stable"), []
    held = np.concatenate([sets[i] for i in left])
    while len(left) > 1:
        queue = [left[0]]
        left, held = left[1:], held[size[left[0]] :]
        while queue and len(left):
            x = queue.pop()
            own[sets[x]] = True
            n = size[left]
            both = np.add.reduceat(own[held], np.cumsum(n) - n, dtype=np.int64)
            own[sets[x]] = False
            near = both >= similarity * (n + size[x] - both) - 1e-9
            if near.any():
                out += [(x, y) for y in left[near].tolist()]
                queue += left[near].tolist()
                held = held[np.repeat(~near, n)]
                left = left[~near]
    return out


def _verified(similarity: float):
    """Over rows (bucket columns..., node, shingles) sorted by bucket: yields the links (a, b) of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, nodes, sets = None, [], []

        def close() -> pa.RecordBatch:
            pairs = similar_forest(sets, similarity) if len(sets) > 1 else []
            a, b = (pa.array([nodes[p[k]] for p in pairs], pa.int64()) for k in (0, 1))
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, this in enumerate(zip(*(c.to_pylist() for c in batch.columns[:-1]))):
                if this[:-1] != bucket and sets:
                    yield close()
                    nodes, sets = [], []
                bucket = this[:-1]
                nodes.append(this[-1])
                sets.append(flat[ends[i] : ends[i + 1]].copy())
        if sets:
            yield close()

    return run


def similar_links(members: DataFrame, docs: DataFrame, *, text: str, shingle: int, similarity: float, compared: int = COMPARED) -> DataFrame:
    """members: (root, node, h, n_words), one row a distinct text. Returns (a, b): links of the texts of each root, enough of
    them to connect all that are linked."""
    sizes = members.groupBy("root").agg(F.sum("n_words").alias("n"), F.count(F.lit(1)).alias("members")).where("members > 1")
    # In blocks of half of what a task compares; a group that fits is one block.
    sizes = sizes.select("root", F.when(F.col("n") <= compared, 1).otherwise(F.ceil(2 * F.col("n") / compared)).cast("int").alias("blocks"))
    sizes = stored(sizes, "sizes")  # a table of its own, so that the join can split a root with very many members
    wanted = stored(members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")
    texts = docs.select(F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("text"))
    texts = texts.join(wanted.select("h", "node", "root", "blocks", "block"), "h").dropDuplicates(["node"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                h, many = shingle_hashes([normal_words(x) for x in some.column(4).to_pylist()], shingle)
                sets = [np.unique(x) for x in np.split(h, np.cumsum(many)[:-1])] if len(many) else []
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*some.columns[:4], lists], names=["node", "root", "blocks", "block", "shingles"])

    sets = texts.select("node", "root", "blocks", "block", "text").mapInArrow(hashed, "node bigint, root bigint, blocks int, block int, shingles array<bigint>")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("block")) | (F.col("blocks") == 1))
    cells = sets.withColumn("other", F.explode(others))
    cells = cells.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "shingles")
    cells = cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return cells.mapInArrow(_verified(similarity), "a bigint, b bigint")


def _placed(rows: DataFrame, roots: DataFrame, node: str = "node") -> DataFrame:
    """rows and the root of each one's node: itself, if no link has it."""
    return rows.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))


def _labelled(prints: DataFrame, placed: DataFrame) -> DataFrame:
    """prints and component_id: the smallest key of what has the same root. placed: (node, root, least_id)."""
    placed = stored(placed.groupBy("node", "root").agg(F.min("least_id").alias("least_id")), "rooted")
    least = stored(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    return prints.join(placed.select("node", "root").join(least, "root").drop("root"), "node")


def similar_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, width: int = WIDTH, index_shingle: int = INDEX_SHINGLE) -> DataFrame:
    """doc_id and component_id: the smallest key of the documents that links reach, itself included. Links join texts whose
    sets of shingles (a shorter text is one) have at least this Jaccard similarity, if fingerprints bring them together.

    Null and blank texts are equal to each other. Very long texts are hashed whole. Rows with the same key are rows of the
    result each. A null key is never a component's smallest unless all its keys are null. An empty table gives no rows. Other
    columns of docs aren't read.
    """
    words = words_of(width)
    prints = stored(noted(docs, key=key, text=text, shingle=index_shingle, width=width), "fingerprints")
    nodes = stored(prints.groupBy("node", "n_words", *words).agg(F.min("doc_id").alias("least_id"), F.min("h").alias("h")).withColumn("fp", node_column(width)), "nodes")
    near = links(nodes.select(*words).distinct(), radius_for(similarity, 64 * width), width=width, segments_for=4)
    groups = _placed(nodes.select("fp", "node", "h", "n_words"), components(near), "fp")
    found = similar_links(groups, docs, text=text, shingle=shingle, similarity=similarity)
    roots = components(stored(found, "links"))
    return _labelled(prints, _placed(nodes.select("node", "least_id"), roots)).select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, similarity: float | None = None, width: int = 1) -> DataFrame:
    """doc_id, fp0 (fp1, ... up to width) and component_id: the smallest key of the documents that links reach, itself
    included. Links join fingerprints that differ in at most `radius` bits; if a similarity is given, see similar_documents.

    Null and blank texts have fingerprint zero and link like any other. Very long texts are hashed whole. Rows with the same
    key are rows of the result each. A null key is never a component's smallest unless all its keys are null. An empty table
    gives no rows. Other columns of docs aren't read.
    """
    if similarity is not None:
        return similar_documents(docs, key=key, text=text, shingle=shingle, similarity=similarity, width=max(width, WIDTH))
    words = words_of(width)
    prints = stored(fingerprints(docs, key=key, text=text, shingle=shingle, width=width).withColumn("node", node_column(width)), "fingerprints")
    nodes = stored(prints.groupBy("node", *words).agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = components(links(nodes.select(*words), radius, width=width, segments_for=radius))
    return _labelled(prints, _placed(nodes.select("node", "least_id"), roots)).select("doc_id", *words, "component_id")
