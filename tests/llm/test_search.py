import math
import random
import re
from collections import Counter

import pytest

from sieveline.llm import contamination, search, wrappers


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def brute_bm25(docs, queries, k):
    tf = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n, mean = len(tf), sum(x[2] for x in tf) / max(1, len(tf))
    df = Counter(w for _, c, _ in tf for w in c)
    out = []
    for q, t in queries:
        score = [(round(sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + 1.2 * (0.25 + 0.75 * dl / mean)) for w, m in Counter(words(t)).items() if c[w]), 6), i) for i, c, dl in tf]
        out += [(q, i, s, r + 1) for r, (s, i) in enumerate(sorted((x for x in score if x[0] > 0), key=lambda x: (-x[0], x[1]))[:k])]
    return out


@pytest.mark.parametrize("block,long", [(64, 0.25), (4, 0.05), (8, 2.0)])
def test_bm25_is_exact(spark, monkeypatch, block, long):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "LONG", long)
    monkeypatch.setattr(search, "TERMS", 150)
    draw = random.Random(block)
    docs = [(i, " ".join(draw.choice(["the", "of", "and"] * 6 + [f"w{draw.randint(0, 80)}"]) for _ in range(draw.randint(0, 60)))) for i in range(150)]
    docs += [(200, docs[3][1]), (201, docs[3][1]), (202, None), (203, ""), (204, "solo")]
    queries = [(i, t) for i, t in docs if i % 20 == 0] + [(7, "nothing_here"), (8, None), (9, "solo the")]
    d = spark.createDataFrame([(i, t, 0, 1.0) for i, t in docs], "doc_id long, text string, rank int, score double").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, text string")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in search.search(d, q, 5).collect())
    want = sorted((a, r, i, s) for a, i, s, r in brute_bm25(docs, queries, 5))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(got, want))
    assert search.search(d.where("false"), q, 5).count() == 0 and search.search(d, q.where("false"), 5).count() == 0


def test_a_very_long_text_and_rows_without_ids(spark):
    docs = [(1, "alpha " * 50_000 + "omega"), (None, "alpha omega"), (2, "alpha"), (2, "omega omega")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(5, "omega"), (None, "alpha"), (6, "alpha alpha omega"), (6, "omega")], "query_id long, text string")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in search.search(d, q, 5).collect())
    want = brute_bm25([(2**63 - 1 if i is None else i, t) for i, t in docs], [(5, "omega"), (6, "alpha alpha omega omega")], 5)
    assert [x[:3] for x in got] == sorted((q, r, i) for q, i, _, r in want)


ITEM = " ".join(f"Word{i}," for i in range(30))


def test_contamination_against_brute_force(spark):
    draw = random.Random(4)
    noise = lambda n: " ".join(f"n{draw.randint(0, 999)}" for _ in range(n))
    part = ITEM.split()
    docs = [(1, f"{noise(500)} {ITEM.upper()} {noise(500)}"), (2, noise(900)), (3, " ".join(part[:26])), (4, " ".join(part[:24])), (5, None), (6, ""), (7, "so it is short"), (1, f"{ITEM} twice")]
    docs += [(8, " ".join(part[:15] + ["x"] + part[15:])), (None, ITEM), (9, f"{noise(20_000)} {ITEM}")]
    items = [(1, ITEM), (2, "it is short"), (3, None), (4, "!!"), (5, ITEM), (6, noise(40))]
    d = spark.createDataFrame([(i, t, 0.0, "z") for i, t in docs], "doc_id long, text string, containment double, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in docs:
        for j, u in items:
            of = contamination.words(u)
            own = contamination.shingles(of, min(5, len(of)))
            have = contamination.shingles(contamination.words(t), min(5, len(of))) if len(contamination.words(t)) >= min(5, len(of)) else set()
            if own and len(own & have) >= 0.8 * len(own):
                want.append((str(i), j, len(own), len(own & have)))
    for block in (1_000_000, 10):
        got = contamination.find(d, b, block=block).collect()
        assert sorted((str(r.doc_id), r.item_id, r.n_shingles, r.n_shared) for r in got) == sorted(want)
    dirty = {i for i, *_ in want}
    clean = contamination.clean(d, b)
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == [2, 4, 5, 6] and "2" not in dirty
    assert contamination.find(d, b.where("false")).count() == 0 and contamination.clean(d, b.where("false")).count() == len(docs)
    assert contamination.find(d.where("false"), b).count() == 0


PAGE = '<html><head><title>t</title><style>p{{}}</style><script>var x="</p>";</script></head><body><header class="site">Head</header><nav><ul><li>m</li></ul></nav><div id="cookie-notice">c</div><div class="layout"><div class="sidebar"><p>side</p></div><div class="post-body"><h1>{0} &amp; x</h1>{1}<form><input>f</form><div class="comments"><p>nope</p></div></div></div><footer>&copy; f</footer>'


def page(n):
    return PAGE.format(f"Title {n}", "".join(f"<p>Text {n}.{i} with <b>bo</b>ld<br>and\n more</p>" for i in range(n % 4 + 1)) + ("<ul><li>one<li>two</ul>" if n % 2 else ""))


def want(n):
    return "\n\n".join([f"Title {n} & x", *[f"Text {n}.{i} with bold and more" for i in range(n % 4 + 1)], *(["one", "two"] if n % 2 else [])])


def test_main_text_without_an_article_element(spark):
    rows = [(n, f"https://host{n % 3}.example/p/{n}", page(n), "x") for n in range(30)] + [(100, None, None, "x"), (101, "http://h/", "", "x"), (102, "no url", "just text", "x"), (103, "http://host0.example/odd", "<p>odd one</p>", "x"), (1, "https://host1.example/p/1", page(1), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = wrappers.extract(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[n] == want(n) for n in range(30))
    assert (text[100], text[101], text[102], text[103]) == ("", "", "just text", "odd one")
    assert all(r.n_chars == len(r.text) for r in got)
    assert wrappers.extract(pages.where("false")).count() == 0


def test_wrapper_of_a_host_is_union_free(spark):
    a, b = (wrappers.wrapper(wrappers.parse(x)) for x in ("<ul><li>a<li>b</ul><p>same</p>", "<ul><li>c</ul><h2>t</h2><p>same</p>"))
    assert wrappers.expression(wrappers.merge(a, b)) == "<ul>(<li>#TEXT</li>)+</ul>(<h2>#FIXED</h2>)?<p>#FIXED</p>"


def test_registered_pages_keep_their_articles(spark, sf):
    from sieveline.llm.queries import QUERIES

    docs = {"\n\n".join(" ".join(x.split()) for x in r.text.split("\n") if x.strip()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op9_main_text"](spark, sf).collect()
    assert got and all(r.text.split("\n\n", 1)[1] in docs for r in got if "\n\n" in r.text)


def test_bm25_with_floors_of_a_first_pass_and_groups_of_alike_texts(spark, monkeypatch):
    monkeypatch.setattr(search, "LEAD", 40)
    monkeypatch.setattr(search, "TERMS", 2000)
    draw = random.Random(5)
    docs = [(i, " ".join(draw.choice(["the", "of"] if i % 3 else ["der", "und"]) if draw.random() < 0.4 else f"{'en' if i % 3 else 'de'}{int(draw.expovariate(0.05))}" for _ in range(draw.randint(1, 60)))) for i in range(700)]
    docs += [(i, docs[33][1]) for i in range(800, 840)]  # ties beyond k, in several shards
    queries = [(i, t) for i, t in docs if i % 20 == 0] + [(33, docs[33][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in search.search(d, spark.createDataFrame(queries, "query_id long, text string"), 5).collect())
    want = sorted((a, r, i, s) for a, i, s, r in brute_bm25(docs, queries, 5))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(got, want))


def test_shards_are_indexed_once_however_many_the_query_terms(spark, monkeypatch):
    monkeypatch.setattr(search, "TERMS", 10)
    written, plain = [], search.stored
    monkeypatch.setattr(search, "stored", lambda df, label: written.append(label) or plain(df, label))
    docs = [(i, f"a{i % 7} b{i % 5} c") for i in range(100)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = search.search(d, d.withColumnRenamed("doc_id", "query_id"), 3)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got.collect()) == sorted((q, r, i) for q, i, _, r in brute_bm25(docs, docs, 3))
    assert written.count("found") == 1  # one pass over the index, not one for each ten query terms
