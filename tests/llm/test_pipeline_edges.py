import pytest

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
LONG = " ".join(f"long{i}" for i in range(40_000))
#: Nulls in any column, empty and very long texts, a row twice, and a second text under one id.
ODD = [(None, None, None, None, None), (10**9, None, "en", None, None), (10**9 + 1, "", None, "s", 0), (10**9 + 2, LONG, "en", "s", len(LONG)), (10**9 + 3, "one row twice", "en", "s", 13), (10**9 + 3, "one row twice", "en", "s", 13), (10**9 + 3, "its id again", "en", "s", 12)]
#: Names that operators use for their own columns.
CLASHING = ("__row", "key", "row", "score", "label", "length", "part", "nth", "component_id", "fingerprint", "line", "item_id", "rank")


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet")
    return own.unionByName(spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").select(own.columns))


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, docs, name):
    out = STAGES[name](spark, docs.limit(0), SF)
    assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows_and_clashing_columns(spark, docs, name):
    plain = STAGES[name](spark, docs, SF)
    named = docs.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING])
    extra = STAGES[name](spark, named, SF)
    if name == "packing":
        pieces = {(r.doc_id, r.piece): r.length for r in plain.collect()}
        assert extra.columns == plain.columns and extra.count() == plain.count()
        assert pieces[(None, 0)] == 1 and pieces[(10**9 + 1, 0)] == 1 and pieces[(10**9 + 2, 1)] == 4096
        assert plain.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n <> end OR n > 4096").count() == 0
        return
    assert plain.columns == docs.columns and extra.columns == named.columns
    got = rows(plain)
    assert rows(extra) == got
    odd = [(i, t) for i, t in got if i is None or i >= 10**9]
    want = [(r[0], r[1]) for r in ODD]
    if name == "near_duplicates":  # of rows without words one stays, of equal rows too
        assert len(odd) == len(want) - 3 and {t for _, t in odd if t} == {t for _, t in want if t}
    else:
        assert [(i, t or "") for i, t in odd] == sorted([(i, t or "") for i, t in want], key=str)
