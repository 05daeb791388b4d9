import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import simhash
from sieveline.llm.components import components


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=600), st.data())
def test_xxh64_of_spans(buffer, data):
    spans = data.draw(st.lists(st.tuples(st.integers(0, len(buffer)), st.integers(0, len(buffer))).map(sorted), min_size=1, max_size=20))
    got = simhash.xxh64_spans(buffer, np.array([a for a, _ in spans]), np.array([b - a for a, b in spans]))
    assert got.tolist() == [xxhash.xxh64_intdigest(buffer[a:b], 42) for a, b in spans]


def plain(text, n=4):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, linked):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    word = lambda: draw.choice(["the", "Of", "thing", "Élan", "erhea", "ou"]) + str(draw.randint(0, 30))
    out = [None, "", " \t\n", "one", "two words", "one"]
    for _ in range(40):
        base = [word() for _ in range(draw.randint(3, 400))]
        out.append(" ".join(base))
        for _ in range(draw.randint(0, 3)):
            near = list(base)
            near[draw.randrange(len(near))] = word()
            out.append(" ".join(near))
    return out


@pytest.mark.parametrize("cell", [20_000, 3])
def test_components_are_those_of_all_pairs(spark, texts, cell, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash.links, "__defaults__", (4, cell, 1, 4))
    docs = spark.createDataFrame([(i * 3 + 1, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp0 long, node string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {i * 3 + 1: plain(t) for i, t in enumerate(texts)}
    assert {k: r.fp0 & (1 << 64) - 1 for k, r in got.items()} == fp
    linked = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    assert {k: r.component_id for k, r in got.items()} == roots(fp, linked)


def test_long_fingerprints_catch_similar_texts(spark):
    draw = random.Random(3)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(400)]
    near = list(base)
    for i in (20, 130, 260, 380):
        near[i] = "changed"
    other = [f"w{draw.randint(0, 10**6)}" for _ in range(400)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(base))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, similarity=0.8, width=3).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_rows_without_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "quite another text of words")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_random_graphs(spark):
    draw = random.Random(1)
    linked = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(50)]
    want = {k: v for k, v in roots({x for e in linked for x in e}, linked).items() if k != v}
    assert {r.node: r.root for r in components(spark.createDataFrame(linked, "a long, b long")).collect()} == want


def shingle_set(text, n=5):
    w = simhash.normal_words((text or "").encode()).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(draw):
    """Texts in groups of edited copies, some of which are too far from each other, and odd ones."""
    texts = [None, " ", "few words", "Few  words", "few words more", "long " * 30_000 + "tail"]
    for _ in range(120):
        base = [f"w{draw.randint(0, 10**6)}" for _ in range(draw.randint(60, 200))]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6):
            near = list(base)
            for _ in range(edits):
                near[draw.randrange(len(near))] = f"x{draw.randint(0, 10**6)}"
            texts.append(" ".join(near))
        texts.append(" ".join(base[: int(0.9 * len(base))]))
    return texts


@pytest.mark.parametrize("compared", [simhash.COMPARED, 300])
def test_similar_documents_against_all_pairs(spark, compared, monkeypatch):
    monkeypatch.setitem(simhash.similar_links.__kwdefaults__, "compared", compared)
    texts = edited(random.Random(8))
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    linked = [(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.8]
    assert sum(jaccard(sets[i], sets[j]) < 0.85 for i, j in linked) > 50 and len(linked) > 500
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, node int, h string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    want = roots(sets, linked)
    assert set(got) == set(want)
    met = sum(got[i] == got[j] for i, j in linked)
    assert met >= 0.99 * len(linked)
    # What is linked is linked by similar texts alone: no component reaches beyond a true one.
    assert all(want[i] == want[got[i]] for i in got)
    assert simhash.similar_documents(docs.where("false")).count() == 0


def test_forest_of_similar_sets():
    draw = random.Random(2)
    sets = [np.array(sorted(draw.sample(range(40), draw.randint(1, 30)))) for _ in range(60)]
    sets += [np.array(sorted({*draw.choice(sets).tolist(), draw.randint(0, 60)})) for _ in range(60)]
    linked = [(i, j) for i in range(120) for j in range(i) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
    found = simhash.similar_forest(sets, 0.8)
    assert roots(range(120), found) == roots(range(120), linked)
    assert len(found) == 120 - len(set(roots(range(120), linked).values()))


def test_a_chain_of_near_copies_is_one_component(spark):
    # Neighbours are similar, the ends are not: a star around one member would not find them all.
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[k * 8 : k * 8 + 200]) for k in range(20)]
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 20


def test_recall_on_the_documents(spark):
    """All pairs of the table with a similarity of 0.8 and more, found by their least shingles: such a pair shares one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    of = {}
    for r in docs.collect():
        of.setdefault(simhash.normal_words((r.text or "").encode()), r.doc_id)
    texts = [t for t in of if t]
    h, many = simhash.shingle_hashes(texts, 5)
    sets = [np.unique(x) for x in np.split(h, np.cumsum(many)[:-1])]
    holders = {}
    for i, s in enumerate(sets):
        for x in s[: len(s) - int(np.ceil(0.8 * len(s) - 1e-9)) + 1].tolist():
            holders.setdefault(x, []).append(i)
    close = {(i, j) for v in holders.values() for i in v for j in v if i < j}
    sets = [frozenset(s.tolist()) for s in sets]
    alike = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and jaccard(a, b) >= 0.8
    linked = [(of[texts[i]], of[texts[j]]) for i, j in close if alike(sets[i], sets[j])]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert len(linked) >= 40 and sum(got[a] == got[b] for a, b in linked) >= 0.95 * len(linked)
