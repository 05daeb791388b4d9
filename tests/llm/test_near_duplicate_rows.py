import random

import corpus_pipeline


def test_rows_without_ids_and_repeated_ids_stay_apart(spark):
    draw = random.Random(4)
    text = lambda: " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(80))
    a, b, c, d, e, f = (text() for _ in range(6))
    # No id: c, d and a copy of a. Id 5: two different texts, one of them twice. Id 7 copies the second, id 2 is a alone.
    rows = [(None, c), (None, d), (None, d), (None, a), (2, a), (5, b), (5, e), (5, e), (7, e), (9, f), (None, f)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(None, c), (None, d), (2, a), (5, b), (5, e), (9, f)], key=str)
