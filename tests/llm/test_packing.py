import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import packing
from sieveline.llm.tokens import codec


def fewest(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in seen:
                seen.add(bins[k])
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.integers(8, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=9))))
def test_reduction_keeps_the_optimum_and_the_plan_every_piece(case):
    capacity, items = case
    counts = Counter(items)
    fixed, rest = packing.reduce_instance(counts, capacity)
    left = [k for k, v in rest.items() for _ in range(v)]
    assert sum(n for n, _ in fixed) + (fewest(left, capacity) if left else 0) == fewest(items, capacity)
    placed = Counter()
    for n, pattern in packing.plan(counts, capacity):
        assert sum(size * each for size, each in pattern) <= capacity
        for size, each in pattern:
            placed[size] += n * each
    assert placed == counts


def test_patterns_stay_few_for_many_lengths():
    bins = packing.plan({k: 10**7 + k for k in range(1, 4097)}, 4096)
    assert len(bins) < 3 * 4096


def rows(spark):
    texts = [None, "", "a b c", "a b c", "word " * 9000, "x", "Don't stop — déjà vu 123"]
    return spark.createDataFrame([(i, t, 1, "r") for i, t in enumerate(texts)] + [(None, "lost", 0, ""), (3, "again", 0, "")], "doc_id long, text string, length int, rank string")


def test_pack_places_every_piece_once_without_gaps(spark):
    docs = rows(spark)
    got = packing.pack(docs, capacity=64).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.concatenate([next(codec().encode([r.text])), [1]]).astype("<u4")
        for n, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want[r.doc_id, n, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(r.length for r in got) // 64) + 1


def test_hot_length_is_ranked_in_parts(spark):
    for parts in (1, 7):
        docs = spark.range(100).selectExpr("id AS doc_id", "'same words here' AS text").repartition(parts)
        got = packing.pack(docs, capacity=16).collect()
        assert len(got) == 100 and len({(r.sequence_id, r.offset) for r in got}) == 100


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
