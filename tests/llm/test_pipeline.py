from sieveline.llm import contamination
from sieveline.llm.runtime import stored
from tests.llm.test_lines import brute

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    items = [contamination.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stored(stage(spark, docs, sf), "t")
        rows = out.collect()
        after = {r.doc_id: r for r in rows}
        assert set(after) <= set(before)
        if name != "packing":
            assert out.columns == columns and len(rows) == len(after)
        if name == "toxicity":
            bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()} & ids
            assert len(set(after) & bad) < 0.7 * len(bad) and len(after) > 0.85 * len(before)
        elif name == "line_dedup":
            assert sorted((i, r.text) for i, r in after.items()) == [(i, t) for i, _, _, t in brute(sorted(before.items()))]
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_duplicates":
            # Every exact copy goes, and what goes has a similar text among what stays.
            assert len({r.text for r in rows}) == len(rows)
            kept = {r.text for r in rows}
            sets = {i: contamination.shingles((t or "").lower().split()) for i, t in before.items()}
            for i in set(before) - set(after):
                if before[i] not in kept:
                    assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in before if j != i) > 0.5
        elif name == "decontamination":
            hit = set()
            for i, t in before.items():
                have = contamination.shingles(contamination.words(t))
                hit |= {i for w in items if len(contamination.shingles(w) & have) >= 0.8 * len(contamination.shingles(w))}
            assert set(after) == set(before) - hit
        docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(after)
