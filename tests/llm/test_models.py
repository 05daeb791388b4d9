import math
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import language, linear, quality, toxicity
from sieveline.llm.queries import QUERIES
from sieveline.llm.runtime import crc_mod

SF = "/root/testdata/sf0.1"
AT = "/root/testdata/sf0.01"


def held(i, n, k):
    return crc32(str(i).encode()) % n == k


@pytest.mark.parametrize("name,label,n,k,least", [("op2_toxicity", "toxic", 3, 1, 0.93), ("op4_quality", "quality", 4, 2, 0.97)])
def test_held_out_accuracy(spark, name, label, n, k, least):
    rows = QUERIES[name](spark, AT).join(spark.read.parquet(f"{AT}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id, n, k) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r[label] for r in out]) >= least


def test_languages_held_out(spark):
    rows = QUERIES["op7_language"](spark, AT).join(spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.96
    assert all(0 <= r.score <= 1 for r in rows)


ODD = [(1, None), (2, ""), (3, "12 34 --"), (4, "the of and thing"), (4, "the of and thing"), (None, "no id"), (6, "the erhea of " * 30_000)]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", None, 0.5, 7) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, score double, label int")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (4, 0, 1), (4, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_odd_rows_are_scored(spark):
    tox = toxicity.score_documents(odd(spark), labels(spark), F.lit(True))
    assert tox.columns == [*odd(spark).columns, "_score"]
    good = quality.score_documents(odd(spark), labels(spark), F.lit(True))
    for rows, c in ((tox.collect(), "_score"), (good.collect(), "score")):
        assert len(rows) == len(ODD) and all(0 <= r[c] <= 1 for r in rows)
    lang = language.identify(odd(spark), F.lit(True)).collect()
    assert [r.lang_pred for r in lang] == ["und", "und", "und", "en", "en", "en", "en"]
    assert [r.rejected for r in lang[:3]] == [True] * 3


def test_without_labels_or_rows(spark):
    none = labels(spark).where("false")
    assert {r._score for r in toxicity.score_documents(odd(spark), none, F.lit(True)).collect()} == {0.5}
    assert {r.score for r in quality.score_documents(odd(spark), none, F.lit(True)).collect()} == {0.5}
    assert {r.lang_pred for r in language.identify(odd(spark), F.lit(False)).collect()} == {"und"}
    empty = odd(spark).where("false")
    assert toxicity.score_documents(empty, labels(spark), F.lit(True)).count() == 0
    assert quality.score_documents(empty, labels(spark), F.lit(True)).count() == 0
    assert language.identify(empty, F.lit(True)).count() == 0


def test_the_identity_gives_the_sum_over_pairs():
    draw = np.random.default_rng(1)
    m = quality.Machine(0.3, draw.normal(size=50), draw.normal(size=(50, 4)))
    at, x = np.array([3, 7, 20, 41]), draw.normal(size=4)
    pairs = sum(m.factor[at[i]] @ m.factor[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert math.isclose(m.raw(at, x), 0.3 + m.weight[at] @ x + pairs)


def test_log_ratios_follow_the_counts():
    ratio = toxicity.log_ratios(np.array([[90.0, 5.0, 50.0], [1.0, 60.0, 51.0]]), np.array([100.0, 100.0]))
    assert ratio[0] < -1 and ratio[1] > 1 and ratio[2] == 0


def test_logistic_fit_finds_the_minimum():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(200, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.5 + draw.normal(size=200) > 0).astype(float)
    of, at = np.repeat(np.arange(200), 3), np.tile(np.arange(3), 200)
    bias, w = linear.fit_logistic(of, at, x.ravel(), y, 3, ridge=1.0)
    error = linear.sigmoid(x @ w + bias) - y
    assert abs(error.sum()) < 0.1 and np.abs(x.T @ error + w).max() < 0.1


def test_ids_split_as_crc32(spark):
    got = spark.range(50).withColumn("m", crc_mod("id", 3)).collect()
    assert all(r.m == crc32(str(r.id).encode()) % 3 for r in got)
