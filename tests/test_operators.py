import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import chunks, diff, graph, hybrid, lexical, rerank, vectors
from sieveline.plans import corpora


def test_bm25_ranks_by_the_formula_and_ties_by_id(spark):
    c = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, "gamma"), (4, "alpha beta"), (5, None)], "chunk_id long, content string")
    got = lexical.bm25_search(lexical.Index.of(c), spark.createDataFrame([(0, "Alpha")], "query_id int, query_text string"), 10).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 1, 4]
    idf, mean = np.log(1 + (4 - 3 + 0.5) / 3.5), 7 / 4
    assert got[0].score == pytest.approx(idf * 2 / (2 + 1.2 * (0.25 + 0.75 * 2 / mean)), abs=1e-6)


def test_cosine_is_symmetric_zero_safe_and_strict(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = rows.select(vectors.cosine(F.col("a"), F.col("b")).alias("x"), vectors.cosine(F.col("b"), F.col("a")).alias("y")).collect()
    assert got[0].x == got[0].y and got[1].x == 0.0
    with pytest.raises(Exception, match="different sizes"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b"))).collect()


def test_batches_agree_with_single_queries(spark):
    draw = np.random.default_rng(0)
    v = spark.createDataFrame([(i, draw.normal(size=8).tolist()) for i in range(40)], "chunk_id long, embedding array<float>")
    batch = vectors.knn_batch(v, v.where("chunk_id < 8").withColumnRenamed("chunk_id", "query_id"), 5, query_bytes=1).collect()
    for q in v.where("chunk_id < 8").collect():
        want = [(r.chunk_id, r.similarity) for r in vectors.knn_by_vector(v, q.embedding, 5).collect()]
        assert [(r.chunk_id, r.similarity) for r in sorted((r for r in batch if r.query_id == q.chunk_id), key=lambda r: r["rank"])] == want


@pytest.mark.parametrize("n,kept", [(1, 0), (2, 1), (5, 4), (10, 8)])
def test_graph_filter_keeps_four_fifths(spark, n, kept):
    rows = spark.range(n).selectExpr("0 AS query_id", "id AS chunk_id", "cast(id AS double) AS score", "0.0D AS graph", "id + 1 AS rank")
    assert graph.graph_filter(rows).count() == kept


@pytest.mark.parametrize("n,kept", [(2, 2), (5, 5), (9, 5), (20, 10)])
def test_pattern_filter_keeps_half_or_five(spark, n, kept):
    rows = spark.range(n).selectExpr("0 AS query_id", "id AS chunk_id", "0.5D AS pattern", "id + 1 AS rank")
    assert [r.chunk_id for r in graph.pattern_filter(rows).orderBy("place").collect()] == list(range(kept))


def test_graph_score_adds_its_terms(spark):
    rows = spark.createDataFrame([(0, i, f"web.C{i}", ["Service", "x"], ["a"], {"actionPath": "login"}, "the web login service") for i in range(4)], "query_id int, chunk_id int, fqn string, calls array<string>, imports array<string>, mvc map<string,string>, query_text string")
    got = {r.graph for r in graph.graph_score(rows, ["query_id"]).collect()}
    assert got == {1.0}
    bare = rows.withColumn("fqn", F.lit(None).cast("string")).withColumn("calls", F.lit(None).cast("array<string>")).withColumn("mvc", F.lit(None).cast("map<string,string>"))
    assert {r.graph for r in graph.graph_score(bare, ["query_id"]).collect()} == {round(0.1 * float(np.log(3)), 6)}


def test_unranked_candidates_keep_their_similarity(spark):
    c = spark.createDataFrame([(0, "a", 0.5, 1), (0, "b", 0.4, 2)], "query_id int, chunk_id string, similarity double, rank int")
    got = {r.chunk_id: (r.llm, r.combined, r.place) for r in rerank.merge(c, spark.createDataFrame([(0, "b", 12)], "query_id int, chunk_id string, score int"), "m").collect()}
    assert got == {"a": (0.5, 0.5, 2), "b": (1.0, 0.76, 1)}


def test_rankings_are_all_or_nothing(spark):
    assert {r.reply_id for r in rerank.parse_rankings(corpora.replies(spark)).collect()} == {1, 2}


def test_diff_tables(spark):
    d = corpora.diffs(spark)
    assert [r.effective_path for r in diff.file_changes(d).orderBy("file_no").collect()] == ["src/web/LoginAction.java", "web.xml", "WEB-INF/new.jsp", "img/logo.png", "conf/struts-config.xml"]
    kinds = {(r.file_no, r.kind): r.n for r in diff.diff_lines(d).groupBy("file_no", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    files = {r.file_no: (r.added_lines, r.deleted_lines) for r in diff.file_changes(d).collect()}
    assert all(files[f] == (kinds.get((f, "added"), 0), kinds.get((f, "deleted"), 0)) for f in files)
    assert diff.file_changes(d.where("false")).count() == 0


def test_overlap_join_is_the_theta_join(spark):
    a = spark.range(200).selectExpr("id % 3 AS k", "id", "(id * 37) % 500 AS start", "(id * 37) % 500 + (id * 7) % 90 AS end")
    b = spark.range(150).selectExpr("id % 3 AS k", "id", "(id * 53) % 500 AS start", "(id * 53) % 500 + (id * 11) % 40 AS end")
    want = a.alias("a").join(b.alias("b"), F.expr("a.k = b.k AND a.start <= b.end AND b.start <= a.end")).count()
    for width in (10, 100, 1000):
        assert diff.overlap_join(a, b, ["k"], width).count() == want


def test_java_chunks():
    found = chunks.parse_java("x.java", corpora.JAVA)
    assert [(c.type, c.fqn) for c in found] == [("CLASS", "com.acme.web.LoginAction"), ("METHOD", "com.acme.web.LoginAction.execute"), ("FIELD", "com.acme.web.LoginAction.NAME"), ("CLASS", "com.acme.web.Inner"), ("METHOD", "com.acme.web.Inner.size")]
    method = found[1]
    assert method.mvc == {"actionPath": "/login", "actionMethod": "execute"} and method.api_calls == ["service.find", "check", "audit.log"]
    assert method.metadata["complexity"] == 3 and method.class_context == "class LoginAction extends BaseAction implements Audited"
    parts = [c for c in chunks.parse_java("l.java", corpora.LONG) if c.type == "METHOD"]
    assert [(c.start_line, c.end_line) for c in parts] == [(2, 101), (77, 153)] and parts[0].metadata["totalWindows"] == 2


def test_bad_files_are_reported_not_fatal(spark):
    got = chunks.chunks(corpora.files(spark), chunks.parse_any).where("error IS NOT NULL").collect()
    assert {r.file_path for r in got} == {"src/Broken.java", "conf/bad/web.xml"}


JAVA = """package a.b;
import x.Y;
public class C extends D {
  @Inject(value = @Named("q")) private final Map<String, List<Integer>> m = f(1), n;
  public C(@A("x") int x, int y) { int z = 1; }
  C() {}
  @RequestMapping(value = {"/a"}, method = M.GET)
  public String show(@PathVariable("id") int id, @Valid(groups = {G.class}) Model m) { if (a) { b(); } return c.d(); }
  private static <T> List<T> of(T a, Map<K, V> b) throws E, F { return null; }
}
"""


def test_java_methods_with_annotated_parameters_and_constructors():
    found = [(c.type, c.fqn, c.start_line, c.end_line, c.annotations) for c in chunks.parse_java("C.java", JAVA)]
    assert found == [
        ("CLASS", "a.b.C", 3, 10, []),
        ("METHOD", "a.b.C.show", 7, 8, ['@RequestMapping(value = {"/a"}, method = M.GET)']),
        ("METHOD", "a.b.C.of", 9, 9, []),
        ("FIELD", "a.b.C.m", 4, 4, ['@Inject(value = @Named("q"))']),
    ]
    show = chunks.parse_java("C.java", JAVA)[1]
    assert show.metadata["parameterCount"] == 2 and show.mvc == {"actionPath": "/a"} and show.api_calls == ["b", "c.d"]


def test_a_stored_index_gives_the_same_scores(spark, tmp_path):
    c = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(i % 7 + 1))) for i in range(40)] + [(50, None), (51, "")], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "t0 t6"), (2, "t3 t3 nothing"), (3, None)], "query_id int, query_text string")
    fresh = lexical.Index.of(c)
    stored = fresh.save(str(tmp_path / "index"))
    rows = lambda index: sorted(map(tuple, lexical.bm25_search(index, q, 5).collect()))
    assert rows(fresh) == rows(stored) == rows(lexical.Index.load(spark, str(tmp_path / "index"))) and len(rows(fresh)) == 10


def test_replies_without_rankings_fall_back(spark):
    rows = [(q, c, "T", f"f{c}", f"text {c}", round(0.5 - c / 100, 6), c, f"query {q}") for q in (1, 2, 3) for c in range(1, 26)]
    cand = spark.createDataFrame(rows, "query_id int, chunk_id long, type string, fqn string, content string, similarity double, rank int, query_text string")
    reply = '{"rankings": [{"chunk_id": "7", "score": 10, "reasoning": "it"}, {"chunk_id": "99", "score": 3, "reasoning": "made up"}]}'
    model = lambda p: F.when(p.contains("query 1"), reply).when(p.contains("query 2"), '{"rankings": [{"chunk_id": "7"}]}')
    got = {}
    for r in rerank.by_model(cand, model).collect():
        got.setdefault(r.query_id, []).append((r.place, r.chunk_id, r.method))
    assert sorted(got[1])[0] == (1, 7, "llm_rerank") and len(got[1]) == 20
    for q in (2, 3):
        assert sorted(got[q]) == [(c, c, "vector_fallback") for c in range(1, 26)]


def test_searchable_text_and_segments(spark):
    rows = [("k", "body", "METHOD", "a/C.java", "C.m", 3, 9, "p", ["i.J"], ["@X"], "class C", '{"complexity": 2}'), ("n", "alone", "JSP_FRAGMENT", "a.jsp", None, 1, 1, None, [], None, None, None)]
    c = spark.createDataFrame(rows, "chunk_id string, content string, type string, file_path string, fqn string, start_line int, end_line int, package_context string, imports array<string>, annotations array<string>, class_context string, metadata_json string")
    texts = {r[0]: r[1] for r in c.select("chunk_id", chunks.searchable(c)).collect()}
    assert texts == {"k": "package p;\nimport i.J;\n\nclass C\n@X\nbody", "n": "alone"}
    found = spark.createDataFrame([(1, "k", 0.5, 0.7, "llm_rerank", 1), (1, "n", 0.4, 0.4, "llm_rerank", 2)], "query_id int, chunk_id string, vector_similarity double, llm_score double, ranking_method string, rank int")
    got = {r["rank"]: (r.text, r.metadata) for r in hybrid.segments(found, c).collect()}
    assert got[1] == ("body", {"complexity": "2", "chunk_id": "k", "chunk_type": "METHOD", "file_path": "a/C.java", "fqn": "C.m", "start_line": "3", "end_line": "9", "vector_similarity": "0.5", "llm_score": "0.7", "ranking_method": "llm_rerank"})
    assert got[2][0] == "alone" and "fqn" not in got[2][1]


def test_batched_search_agrees_with_brute_force_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties and some zero vectors
    rows = spark.createDataFrame([(f"c{i:03}", x.tolist()) for i, x in enumerate(v)] + [("null", None)], "chunk_id string, embedding array<double>").repartition(3)
    monkeypatch.setattr(vectors, "CELLS", 500)
    got = vectors.knn_batch(rows, rows.withColumnRenamed("chunk_id", "query_id"), 5, min_similarity=0.2, exclude_self=True, query_bytes=70 * 32).collect()
    unit = np.divide(v, np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=v.any(axis=1, keepdims=True))
    near = np.round(unit @ unit.T, 6)
    want = {(f"c{i:03}", f"c{j:03}", n + 1) for i in range(300) for n, j in enumerate([j for j in np.lexsort((np.arange(300), -near[i])) if j != i and near[i, j] >= 0.2][:5])}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == want and len(got) == len(want)


def test_graph_score_counts_exact_flows_and_imports_by_share(spark):
    rows = spark.createDataFrame([(0, 1, None, [], ["a.B", "c.D"], {"formName": "login", "actionPath": "/user"}, "login of a user")], "query_id int, chunk_id int, fqn string, calls array<string>, imports array<string>, mvc map<string,string>, query_text string")
    assert graph.graph_score(rows, ["query_id"]).first().graph == 0.15
    assert graph.graph_score(rows, ["query_id"], import_hints=F.array(F.lit("a.B"), F.lit("x"))).first().graph == 0.25


def test_inheritance_takes_plain_names(spark):
    rows = spark.createDataFrame([(1, "class A<T> extends Base<T> implements I, J<T> {")], "chunk_id int, class_context string")
    assert [r.value for r in graph.inheritance(rows).collect()] == ["Base", "I", "J"]
