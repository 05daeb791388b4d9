"""Searches with many whole texts: tasks hand on the best of their chunks, no query is joined with all of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import graph, lexical, shards
from sieveline.plans import search_queries


def rows(found):
    return sorted(map(tuple, found.select("query_id", "rank", "chunk_id", F.round("score", 5)).collect()))


@pytest.fixture(scope="module")
def chunks(spark):
    draw = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in draw.exponential(30, draw.integers(0, 60))) for _ in range(300)]
    table = [(f"c{i}", t, "en" if i % 3 else "de") for i, t in enumerate([*texts, *texts[:40], None, "", "solo"])]  # copies tie
    return spark.createDataFrame(table, "chunk_id string, content string, type string").repartition(4)


def test_best_is_the_top_of_all_scores(spark, chunks, monkeypatch):
    queries = chunks.where("content IS NOT NULL").select((F.hash("chunk_id") % 100).alias("query_id"), F.col("content").alias("query_text"))
    terms, index = lexical.query_terms(queries), lexical.Index.of(chunks)
    want = rows(lexical.top(lexical.bm25_scores(index, terms), 7))
    typed = rows(lexical.top(lexical.bm25_scores(index, terms, among=chunks.where("type = 'de'")), 7))
    plain = shards.search
    for lead, block, postings in ((4000, 256, 4_000_000), (30, 16, 200)):  # in one pass; with a first one, in many shards
        monkeypatch.setattr(shards, "search", lambda *a, more=dict(lead=lead, block=block, postings=postings): plain(*a, **more))
        own = lexical.Documents.of(chunks)
        assert rows(lexical.best(own, terms, 7)) == rows(lexical.best(lexical.Documents.from_index(index), terms, 7)) == want
        assert rows(lexical.best(own, terms, 7, F.col("type") == "de")) == typed
    assert lexical.best(lexical.Documents.of(chunks.where("false")), terms, 7).count() == 0
    assert lexical.best(own, terms.where("false"), 7).count() == 0


def test_hint_words_give_the_hints_of_the_text(spark):
    texts = spark.createDataFrame([("The WEB login of a webservice",), ("daoaction",), (None,), ("none",)], "t string")
    for table in (graph.API_HINTS, graph.PACKAGE_HINTS, graph.MVC_HINTS):
        got = texts.select(graph.hints(F.col("t"), table).alias("a"), graph.hints(graph.hint_words(F.col("t")), table).alias("b")).collect()
        assert all(r.a == r.b for r in got)


@pytest.mark.parametrize("name", ["hybrid_search", "hybrid_search_defaults", "vector_recall", "pattern_search"])
def test_no_query_is_joined_with_all_chunks(spark, sf, monkeypatch, name):
    def joined(*args, **kwargs):
        raise AssertionError("scores of all pairs of queries and chunks")

    monkeypatch.setattr(lexical, "bm25_scores", joined)
    assert getattr(search_queries, name)(spark, sf).count() >= 0
