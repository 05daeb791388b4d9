"""Scores recomputed plainly, one feature, pair or compressor at a time."""

import math
import random
import re
from zlib import crc32

import pytest
import zstandard
from pyspark.sql import functions as F

from sieveline.llm import language, quality, toxicity
from sieveline.llm.runtime import crc_mod
from sieveline.llm.sampling import labelled_sample

AT = "/root/testdata/sf0.01"
ODD = [None, "", "  ", "12 34 --", "é", "Don't STOP, you worthless moron!", "the of and thing " * 5000, "ß x\x00y", "a" * 5000, "nicht und der"]


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "text", "n_chars", "lang")
    odd = spark.createDataFrame([(-1 - i, t, None, None) for i, t in enumerate(ODD)], docs.schema)
    return docs.where("doc_id % 10 = 3").unionByName(odd), docs, spark.read.parquet(f"{AT}/labels.parquet")


def test_toxicity(spark, tables):
    some, docs, labels = tables
    learn = crc_mod("doc_id", 3) != 1
    model = toxicity.learned(labelled_sample(docs, labels, learn, "doc_id", "text", "toxic", toxicity.SAMPLE))
    weight = dict(zip(model.index.tolist(), model.weight.tolist()))
    assert len(weight) > 50
    score = model.scorer()
    for r in some.collect():
        found = set()
        for run in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            padded = f" {run} "
            for n in (3, 4, 5):
                for i in range(len(padded) - n + 1):
                    found.add(crc32(padded[i : i + n].encode()) % 2**18)
        assert score(r.text) == pytest.approx(sigmoid(model.bias + sum(weight.get(x, 0) for x in found)), abs=1e-9), r.doc_id


def test_quality_sums_over_all_pairs(spark, tables):
    some, docs, labels = tables
    rows = labelled_sample(docs, labels, crc_mod("doc_id", 4) != 2, "doc_id", "text", "quality", 300, also=("n_chars",)).collect()
    machine = quality.fit([(*quality.features(r.text, r.n_chars), r.label) for r in rows], rounds=2)
    for r in some.where("length(coalesce(text, '')) < 2000").collect():
        at, value = quality.features(r.text, r.n_chars)
        raw = machine.bias
        for i in range(len(at)):
            raw += machine.weight[at[i]] * value[i]
            for j in range(i):
                raw += float(machine.factor[at[i]] @ machine.factor[at[j]]) * value[i] * value[j]
        assert machine.raw(at, value) == pytest.approx(raw, abs=1e-8), r.doc_id


def test_language_is_the_least_compressed_size():
    draw = random.Random(6)
    words = {k: ["".join(draw.choice(x) for _ in range(draw.randint(2, 7))) for _ in range(300)] for k, x in (("aa", "etaoin"), ("bb", "shrdlu"), ("cc", "etashr"))}
    text = lambda k, n: " ".join(draw.choice(words[k]) for _ in range(n))
    # Of equal sizes, so that the least compressed size alone decides.
    samples = {k: [text(k, 6000)[:19_999].rstrip().ljust(20_000, "q")] for k in words}
    judge = language.Languages(samples)
    assert len(set(judge.room)) == 1
    for t in [text(k, n) for k in words for n in (1, 3, 20, 2000)] + [text("aa", 30) + " " + text("bb", 30), "é", "x1"]:
        data = " ".join(t.lower().split()).encode()
        sizes = {}
        for k, (sample,) in samples.items():
            own = zstandard.ZstdCompressionDict(sample.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=own, write_content_size=False, write_dict_id=False)
            sizes[k] = sum(len(c.compress(data[i : i + language.PIECE])) for i in range(0, len(data), language.PIECE))
        best = min(sorted(sizes), key=sizes.get)
        lost = sorted((sizes[k] - sizes[best]) * 100 / len(data) for k in sizes if k != best)
        name, score, rejected = judge.predict(t)
        assert (name, rejected) == (best, lost[0] < language.MARGIN)
        assert score == pytest.approx(1 / (1 + sum(2 ** -min(8 * x, 200) for x in lost)))


def test_training_texts_are_bounded_and_different(spark):
    rows = [(i, f"text number {i % 50} of this language " * 20, "l0") for i in range(400)] + [(1000, "single", "l1"), (1001, None, "l1"), (1002, "x" * 30_000, "l1"), (1003, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = language.training_texts(docs, F.lit(True), text="text", lang="lang", texts=30)
    assert len(got["l0"]) == len(set(got["l0"])) == 30 and got["l1"] == ["single"] and set(got) == {"l0", "l1"}
    few = language.training_texts(docs, F.lit(True), text="text", lang="lang", dictionary=1000)
    assert sum(map(len, few["l0"][:-1])) < 2000 <= sum(map(len, few["l0"]))
    assert language.training_texts(docs.where("false"), F.lit(True), text="text", lang="lang") == {}
