"""Queries on lexical and vector search, graph, cascades and reranking, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import KEYWORDS, attribute, code_tokens, package_of, tokens, truncated
from ..operators import graph, hybrid, lexical, rerank, vectors
from .corpora import document_chunks, replies, stored_vectors, table
from ..sources.store import ChunkStore
from .registry import query

WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
RAW = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')"

def _ordered(expr: str) -> str:
    return f"list_filter({expr}, lambda w, i: list_position({expr}, w) = i)"


#: Distinct capitalised identifiers in order of first occurrence.
CALLS = _ordered(rf"list_filter({RAW}, lambda w: regexp_matches(w, '^[A-Z][A-Za-z0-9_]{{2,}}$'))")
INDEX = f"""
toks AS (SELECT doc_id AS chunk_id, unnest({WORDS}) AS term FROM documents WHERE text IS NOT NULL),
post AS (SELECT term, chunk_id, count(*) AS tf FROM toks GROUP BY 1, 2),
docs AS (SELECT doc_id AS chunk_id, len({WORDS}) AS dl FROM documents WHERE text IS NOT NULL),
fs AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM docs),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"""
SCORES = """
sc AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN docs USING (chunk_id), fs GROUP BY 1, 2)"""
BENCH = f"""
qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY 1, 2)"""
SEARCH = "thing of worthless nonsense and the identity of them"
FQN = "source || '.' || lang || '.d' || doc_id"


_INDEXES: dict[tuple[str, str], lexical.Index] = {}
_DOCUMENTS: dict[tuple[str, str], lexical.Documents] = {}


def _index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The stored index of the documents, built once a session; every search reads it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = lexical.Index.of(document_chunks(spark, sf_dir)).save(f"{ChunkStore(spark).path}/index")
    return _INDEXES[key]


def _documents(spark: SparkSession, sf_dir: str) -> lexical.Documents:
    """The same by document, for searches with many whole texts; built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DOCUMENTS:
        _DOCUMENTS[key] = lexical.Documents.of(document_chunks(spark, sf_dir))
    return _DOCUMENTS[key]


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS pos, t[i] AS token FROM (SELECT doc_id, {WORDS} AS t FROM documents), unnest(range(1, len(t) + 1)) AS u(i)")
def tokenize(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    return d.select("doc_id", (F.col("pos") + 1).alias("pos"), "token")


@query(r"SELECT conv_id, turn, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+(?:[.\x27:][\p{L}_]+)*')) AS INTEGER) AS n_tokens FROM conversations")
def tokenize_code(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(code_tokens(F.col("text"))).alias("n_tokens"))


@query(f"WITH {INDEX} SELECT term, df, sum_tf, n_docs, round(avgdl, 6) AS avgdl FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS sum_tf FROM post GROUP BY 1), fs")
def postings_stats(spark, sf_dir):
    index = _index(spark, sf_dir)
    terms = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("sum_tf"))
    return terms.crossJoin(F.broadcast(index.stats)).select("term", "df", "sum_tf", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {INDEX}, qt AS (SELECT 0 AS query_id, term, count(*) AS qtf FROM (SELECT unnest(string_split('{SEARCH}', ' ')) AS term) GROUP BY 1, 2), {SCORES} SELECT chunk_id, score, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc ORDER BY score DESC, chunk_id LIMIT 100")
def bm25_topk(spark, sf_dir):
    one = spark.createDataFrame([(0, SEARCH)], "query_id int, query_text string")
    return lexical.bm25_search(_index(spark, sf_dir), one, 100).select("chunk_id", "score", "rank")


@query(f"WITH {INDEX}, qt AS (SELECT 0 AS query_id, term, count(*) AS qtf FROM (SELECT unnest(string_split('{SEARCH} die eine', ' ')) AS term) GROUP BY 1, 2), {SCORES} SELECT chunk_id, score FROM sc JOIN documents ON doc_id = chunk_id WHERE lang = 'de' ORDER BY score DESC, chunk_id LIMIT 100")
def bm25_type_filter(spark, sf_dir):
    one = lexical.query_terms(spark.createDataFrame([(0, SEARCH + " die eine")], "query_id int, query_text string"))
    return lexical.top(lexical.bm25_scores(_index(spark, sf_dir), one, among=document_chunks(spark, sf_dir).where("type = 'de'")), 100).select("chunk_id", "score")


BATCH_SQL = f"WITH {INDEX}, {BENCH}, {SCORES}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc) SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10"


@query(BATCH_SQL)
def bm25_batch(spark, sf_dir):
    return lexical.bm25_search(_index(spark, sf_dir), _bench(spark, sf_dir), 10)


@query(f"SELECT chunk_id, fqn, CAST(1.0 AS DOUBLE) AS score FROM (SELECT doc_id AS chunk_id, {FQN} AS fqn FROM documents) WHERE lower(fqn) LIKE 'src1_.en.%' ORDER BY fqn, chunk_id LIMIT 50")
def fqn_search(spark, sf_dir):
    return lexical.fqn_search(document_chunks(spark, sf_dir), "SRC1?.en.*", 50)


@query("SELECT chunk_id, file_path, CAST(1.0 AS DOUBLE) AS score FROM (SELECT doc_id AS chunk_id, source || '/' || doc_id AS file_path FROM documents) WHERE file_path LIKE 'src2/%' ORDER BY file_path, chunk_id LIMIT 50")
def path_search(spark, sf_dir):
    return lexical.path_search(document_chunks(spark, sf_dir), "src2/*", 50)


@query(f"SELECT doc_id AS chunk_id FROM documents WHERE NOT list_has_any({WORDS}, ['worthless', 'moron', 'nicht'])")
def delete_by_query(spark, sf_dir):
    return lexical.delete_by_query(document_chunks(spark, sf_dir), "worthless moron nicht").select("chunk_id")


@query(f"SELECT doc_id AS chunk_id, {FQN} AS fqn, array_to_string({CALLS}, ' ') AS api_calls, source || ' ' || lang AS mvc_mapping FROM documents")
def lucene_fields(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("chunk_id", "fqn", F.array_join("calls", " ").alias("api_calls"), F.array_join(F.map_values("mvc"), " ").alias("mvc_mapping"))


@query("SELECT lang AS type, count(*) AS chunks, (SELECT count(*) FROM embeddings) AS vectors FROM documents GROUP BY 1")
def index_status(spark, sf_dir):
    n = stored_vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("vectors"))
    return document_chunks(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("chunks")).crossJoin(F.broadcast(n))


# --- vectors -----------------------------------------------------------------------------------------------------------

VECTOR = [((i * 37) % 11 - 5) / 5 for i in range(64)]
COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], {}::DOUBLE[]), 6)"


@query(f"SELECT e.vec_id AS chunk_id, {COS.format('n.embedding')} AS similarity FROM embeddings e JOIN embeddings n ON n.vec_id = e.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    a = stored_vectors(spark, sf_dir)
    b = a.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("embedding").alias("next"))
    return a.join(b, "chunk_id").select("chunk_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@query(f"SELECT vec_id AS chunk_id, {COS.format(VECTOR)} AS similarity FROM embeddings e ORDER BY similarity DESC, chunk_id LIMIT 50")
def knn_by_vector(spark, sf_dir):
    return vectors.knn_by_vector(stored_vectors(spark, sf_dir), VECTOR, 50)


@query(f"SELECT * FROM (SELECT vec_id AS chunk_id, {COS.format(VECTOR)} AS similarity FROM embeddings e) WHERE similarity >= 0.1 ORDER BY similarity DESC, chunk_id LIMIT 50")
def knn_threshold(spark, sf_dir):
    return vectors.knn_by_vector(stored_vectors(spark, sf_dir), VECTOR, 50, 0.1)


NEAR = f"WITH near AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {COS.format('q.embedding')} AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank FROM near) SELECT * FROM r WHERE rank <= 10"


@query(NEAR)
def knn_by_id(spark, sf_dir):
    """Stored vectors as queries: every id that is divisible by 20, against all."""
    v = stored_vectors(spark, sf_dir)
    return vectors.knn_batch(v, v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), 10, exclude_self=True)


@query(NEAR.replace("WHERE q.vec_id % 20 = 0 AND", "WHERE"))
def knn_all_pairs(spark, sf_dir):
    v = stored_vectors(spark, sf_dir)
    return vectors.knn_batch(v, v.withColumnRenamed("chunk_id", "query_id"), 10, exclude_self=True)


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")
def vector_upsert(spark, sf_dir):
    old = stored_vectors(spark, sf_dir).withColumn("ts", F.lit(1)).withColumn("version", F.lit(1))
    new = old.where("chunk_id % 3 = 0").withColumn("ts", F.lit(2)).withColumn("version", F.lit(2))
    return vectors.upsert(old, new).select("chunk_id", "version", F.size("embedding").alias("dims"))


@query("SELECT doc_id AS chunk_id, doc_id IN (SELECT vec_id FROM embeddings) AS stored, (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 1) AS left_after_removal FROM documents")
def vector_point_ops(spark, sf_dir):
    store, ids = ChunkStore(spark), document_chunks(spark, sf_dir).select("chunk_id")
    store.save_vectors(stored_vectors(spark, sf_dir))
    known = store.contains_vectors(ids)
    store.remove_vectors(stored_vectors(spark, sf_dir).where("chunk_id % 2 = 0"))
    return known.crossJoin(F.broadcast(store.vectors().agg(F.count(F.lit(1)).alias("left_after_removal"))))


@query("SELECT vec_id AS chunk_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ")
def vector_get(spark, sf_dir):
    store = ChunkStore(spark)
    store.save_vectors(stored_vectors(spark, sf_dir))
    return store.get_vectors(document_chunks(spark, sf_dir)).select("chunk_id", F.size("embedding").alias("dims"))


@query()
def hash_embed(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", vectors.hash_embedding(tokens(F.col("text"))).alias("embedding"))


# --- graph -------------------------------------------------------------------------------------------------------------

EDGES = f"""SELECT DISTINCT 'call' AS kind, CAST(doc_id AS VARCHAR) AS src, unnest({CALLS}) AS dst FROM documents
UNION SELECT 'import', CAST(doc_id AS VARCHAR), source FROM documents UNION SELECT 'package', source || '.' || lang, CAST(doc_id AS VARCHAR) FROM documents
UNION SELECT 'mvc', CAST(doc_id AS VARCHAR), source FROM documents UNION SELECT 'inherit', CAST(doc_id AS VARCHAR), lang FROM documents UNION SELECT 'inherit', CAST(doc_id AS VARCHAR), source FROM documents"""


@query(EDGES)
def graph_edges(spark, sf_dir):
    return graph.edges(document_chunks(spark, sf_dir))


@query("SELECT doc_id AS chunk_id, source AS value FROM documents")
def graph_mvc(spark, sf_dir):
    return graph.mvc_edges(document_chunks(spark, sf_dir))


@query("SELECT doc_id AS chunk_id, lang AS value FROM documents UNION ALL SELECT doc_id, source FROM documents")
def graph_inherit(spark, sf_dir):
    return graph.inheritance(document_chunks(spark, sf_dir))


@query("SELECT doc_id AS chunk_id, source || '.' || lang AS package FROM documents")
def extract_package(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("chunk_id", package_of(F.col("fqn")).alias("package"))


@query("SELECT doc_id AS chunk_id, count(*) OVER (PARTITION BY source, lang) - 1 AS co FROM documents")
def co_occurrence(spark, sf_dir):
    return graph.co_occurrence(document_chunks(spark, sf_dir), []).select("chunk_id", "co")


HINTS = {k: "list_filter([" + ", ".join(f"CASE WHEN contains(q, '{w}') THEN '{h}' END" for w, h in t.items()) + "], lambda x: x IS NOT NULL)" for k, t in (("api", graph.API_HINTS), ("pack", graph.PACKAGE_HINTS), ("flow", graph.MVC_HINTS))}
#: From hits (query_id, chunk_id, score, rank) and qs (query_id, query_text): scored, with the graph score.
GRAPH = f"""
named AS (SELECT h.*, source || '.' || lang AS package, source, {CALLS} AS calls, lower(query_text) AS q FROM hits h JOIN documents ON doc_id = chunk_id JOIN qs USING (query_id)),
hinted AS (SELECT *, {HINTS['api']} AS api, {HINTS['pack']} AS pack, {HINTS['flow']} AS flow, count(*) OVER (PARTITION BY query_id, package) - 1 AS co FROM named),
scored AS (SELECT *, round(least(1.0, CASE WHEN list_contains(pack, package) THEN 0.3 ELSE 0.0 END + 0.4 * len(list_intersect(calls, api)) / greatest(len(api), 1)
  + 0.3 * len(list_intersect([source], flow)) / greatest(len(flow), 1) + CASE WHEN co > 1 THEN 0.1 * ln(greatest(co, 1)) ELSE 0.0 END), 6) AS graph FROM hinted)"""
FILTERED = """
combined AS (SELECT *, round(0.7 * score + 0.3 * graph, 7) AS combined FROM scored),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, rank) AS INTEGER) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM combined),
kept AS (SELECT * FROM placed WHERE place <= floor(n * 4 / 5))"""
BENCH_HITS = f"WITH {INDEX}, {BENCH}, {SCORES}, hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 100), qs AS (SELECT item_id AS query_id, text AS query_text FROM benchmark), {GRAPH}"


def _graph_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = document_chunks(spark, sf_dir), _bench(spark, sf_dir)
    hits = lexical.bm25_search(_index(spark, sf_dir), q, 100)
    return graph.graph_score(hits.join(c.drop("content"), "chunk_id").join(q, "query_id"), ["query_id"])


@query(BENCH_HITS + " SELECT query_id, chunk_id, rank, graph FROM scored")
def graph_score(spark, sf_dir):
    return _graph_scored(spark, sf_dir).select("query_id", "chunk_id", "rank", "graph")


@query(BENCH_HITS + f", {FILTERED} SELECT query_id, chunk_id, combined, place FROM kept")
def graph_filter(spark, sf_dir):
    return graph.graph_filter(_graph_scored(spark, sf_dir)).select("query_id", "chunk_id", "combined", "place")


APIS = _ordered(r"list_filter(regexp_extract_all(text, '([A-Za-z0-9_]+)\s*\(', 1), lambda w: length(w) > 2)")
FRAMES = "list_filter([" + ", ".join(f"CASE WHEN contains(text, '{f}') THEN '{f}' END" for f in graph.FRAMEWORKS) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({APIS}, ' ') AS apis, array_to_string({CALLS}, ' ') AS signatures, array_to_string({FRAMES}, ' ') AS frameworks FROM documents")
def pattern_context(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", graph.pattern_context(F.col("text")).alias("c"))
    return c.select("doc_id", *[F.array_join(f"c.{k}", " ").alias(k) for k in ("apis", "signatures", "frameworks")])


PATTERN = f"""WITH {INDEX}, {BENCH}, {SCORES}, hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 100),
ctx AS (SELECT item_id AS query_id, {APIS} AS apis, {CALLS} AS sigs, {FRAMES} AS frames FROM benchmark),
named AS (SELECT h.*, lang, source, {FQN} AS fqn, {CALLS} AS calls, apis, sigs, frames FROM hits h JOIN documents ON doc_id = chunk_id JOIN ctx USING (query_id)),
pat AS (SELECT *, round(least(1.0, CASE WHEN lang = 'en' THEN 0.4 ELSE 0.0 END + 0.3 * len(list_filter(apis, lambda p: len(list_filter(calls, lambda c: contains(c, p))) > 0)) / greatest(len(apis), 1)
  + CASE WHEN len(list_filter(sigs, lambda s: contains(fqn, s))) > 0 THEN 0.2 ELSE 0.0 END + CASE WHEN len(list_filter(frames, lambda f: contains(source, f))) > 0 THEN 0.1 ELSE 0.0 END), 6) AS pattern FROM named)"""


def _pattern_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = document_chunks(spark, sf_dir), _bench(spark, sf_dir)
    contexts = q.select("query_id", graph.pattern_context(F.col("query_text")).alias("context"))
    return graph.pattern_score(lexical.bm25_search(_index(spark, sf_dir), q, 100).join(c.drop("content"), "chunk_id").join(contexts, "query_id"), F.lit("en"))


@query(PATTERN + " SELECT query_id, chunk_id, pattern FROM pat")
def pattern_score(spark, sf_dir):
    return _pattern_scored(spark, sf_dir).select("query_id", "chunk_id", "pattern")


@query(PATTERN + ", placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pattern DESC, rank) AS INTEGER) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM pat) SELECT query_id, chunk_id, pattern, place FROM placed WHERE place <= greatest(5, floor(n / 2))")
def pattern_filter(spark, sf_dir):
    return graph.pattern_filter(_pattern_scored(spark, sf_dir)).select("query_id", "chunk_id", "pattern", "place")


# --- cascades ----------------------------------------------------------------------------------------------------------

#: A stored document as a query: its whole text, and its vector.
OWN = f"""WITH {INDEX},
q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0 AND vec_id IN (SELECT doc_id FROM documents)),
qt AS (SELECT chunk_id AS query_id, term, tf AS qtf FROM post WHERE chunk_id IN (SELECT query_id FROM q)), qs AS (SELECT doc_id AS query_id, text AS query_text FROM documents WHERE doc_id IN (SELECT query_id FROM q)), {SCORES},
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 100), {GRAPH}, {FILTERED},
near AS (SELECT query_id, e.vec_id AS chunk_id, {COS.format('q.embedding')} AS similarity FROM q, embeddings e),
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS near_rank FROM near WHERE similarity >= THRESHOLD) WHERE near_rank <= 50),
recalled AS (SELECT query_id, chunk_id, similarity, score, graph FROM nearest JOIN kept USING (query_id, chunk_id)),
final AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank FROM recalled)"""


def own_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries (query_id, query_text, embedding): every stored vector whose id is divisible by 20, with its document's text."""
    v = stored_vectors(spark, sf_dir).where("chunk_id % 20 = 0")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("query_text"))
    return v.join(texts, "chunk_id").withColumnRenamed("chunk_id", "query_id")


COLUMNS = ("query_id", "chunk_id", "bm25", "graph", "vector_similarity", "llm_score", "ranking_method", "rank")


@query(OWN.replace("THRESHOLD", "0.0") + " SELECT query_id, chunk_id, score AS bm25, graph, similarity AS vector_similarity, similarity AS llm_score, 'vector_only' AS ranking_method, rank FROM final WHERE rank <= 10")
def hybrid_search(spark, sf_dir):
    found = hybrid.search(document_chunks(spark, sf_dir), stored_vectors(spark, sf_dir), own_queries(spark, sf_dir), hybrid.RetrievalConfig(threshold=0.0), index=_documents(spark, sf_dir))
    return found.select(*COLUMNS)


@query(OWN.replace("THRESHOLD", "0.3") + " SELECT query_id, chunk_id, similarity, rank FROM final WHERE rank <= 10")
def hybrid_search_defaults(spark, sf_dir):
    found = hybrid.search(document_chunks(spark, sf_dir), stored_vectors(spark, sf_dir), own_queries(spark, sf_dir), index=_documents(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.col("vector_similarity").alias("similarity"), "rank")


@query(OWN.replace("THRESHOLD", "0.0") + " SELECT query_id, chunk_id, similarity FROM recalled")
def vector_recall(spark, sf_dir):
    q = own_queries(spark, sf_dir)
    c, v = document_chunks(spark, sf_dir), stored_vectors(spark, sf_dir)
    kept = hybrid.candidates(c, q, 100, index=_documents(spark, sf_dir))
    return hybrid.vector_recall(kept, vectors.knn_batch(v, q, 50, min_similarity=0.0)).select("query_id", "chunk_id", "similarity")


@query()
def pattern_search(spark, sf_dir):
    v = stored_vectors(spark, sf_dir)
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("source"), F.lit("Service").alias("hint"))
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id").join(source, "query_id")
    return hybrid.pattern_search(document_chunks(spark, sf_dir), v, q, "en", config=hybrid.RetrievalConfig(threshold=0.0), index=_documents(spark, sf_dir))


KEYS = "('" + "', '".join(KEYWORDS) + "')"
#: (doc_id, word, n): the distinct words of a pattern, numbered in order of first occurrence.
FIRST = f"WITH w AS (SELECT doc_id, lang, unnest({RAW}) AS word, generate_subscripts({RAW}, 1) AS i FROM documents), f AS (SELECT doc_id, word, min(i) AS i FROM w WHERE PATTERN GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)"
IDENTS = FIRST.replace("PATTERN", f"regexp_matches(word, '^[A-Za-z_][A-Za-z0-9_]{{2,}}$') AND lower(word) NOT IN {KEYS}")
NAMES = FIRST.replace("PATTERN", "regexp_matches(word, '^[A-Z][A-Za-z0-9_]{2,}$')")


@query(IDENTS + " SELECT doc_id, concat_ws(' ', string_agg(word, ' ' ORDER BY n) FILTER (WHERE n <= 20), 'hint') AS query_text FROM documents LEFT JOIN n USING (doc_id) GROUP BY doc_id")
def enhanced_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(hybrid.enhanced_query(F.col("text"), F.lit("hint"))).alias("query_text"))


@query(NAMES + " SELECT doc_id, concat_ws(' ', any_value(lang), string_agg(word, ' ' ORDER BY n) FILTER (WHERE n <= 10), 'hint') AS query_text FROM documents LEFT JOIN n USING (doc_id) GROUP BY doc_id")
def pattern_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(rerank.pattern_query(F.col("text"), F.col("lang"), F.lit("hint")), "  ", " ").alias("query_text"))


# --- rerank ------------------------------------------------------------------------------------------------------------

JACCARD = "CAST(floor(10 * len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1)) AS INTEGER)"
RERANK = f"""WITH {INDEX}, {BENCH}, {SCORES}, hits AS (SELECT *, round(score / 128, 6) AS similarity FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 20),
pairs AS (SELECT h.*, list_distinct({WORDS.replace('text', 'b0.text')}) AS a, list_distinct({WORDS.replace('text', 'd.text')}) AS b FROM hits h JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b0 ON b0.item_id = query_id),
merged AS (SELECT *, {JACCARD} / 10.0 AS llm, round(0.4 * similarity + 0.6 * {JACCARD} / 10.0, 7) AS combined FROM pairs)
SELECT query_id, chunk_id, CAST(llm AS DOUBLE) AS llm, CAST(combined AS DOUBLE) AS combined, 'METHOD' AS method, CAST(row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, rank) AS INTEGER) AS place FROM merged"""


def _candidates(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    c, q = document_chunks(spark, sf_dir), _bench(spark, sf_dir)
    return lexical.bm25_search(_index(spark, sf_dir), q, n).withColumn("similarity", F.round(F.col("score") / 128, 6)).join(c.select("chunk_id", "content", "type", "fqn"), "chunk_id").join(q, "query_id")


@query(RERANK.replace("METHOD", "llm_rerank"))
def rerank_general(spark, sf_dir):
    return rerank.rerank(_candidates(spark, sf_dir), "llm_rerank").select("query_id", "chunk_id", "llm", "combined", "method", "place")


@query(RERANK.replace("METHOD", "pattern_rerank"))
def rerank_pattern(spark, sf_dir):
    return rerank.rerank(_candidates(spark, sf_dir), "pattern_rerank").select("query_id", "chunk_id", "llm", "combined", "method", "place")


FALLBACK = RERANK.split("pairs AS")[0].rstrip().rstrip(",").replace("rank <= 20", "rank <= 30")


@query(FALLBACK + " SELECT query_id, chunk_id, similarity AS llm, round(0.4 * similarity + 0.6 * similarity, 7) AS combined, 'vector_fallback' AS method, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(0.4 * similarity + 0.6 * similarity, 7) DESC, rank) AS INTEGER) AS place FROM hits")
def rerank_fallback(spark, sf_dir):
    """A model that answers without rankings: all candidates stay, by similarity."""
    found = rerank.by_model(_candidates(spark, sf_dir, 30), lambda prompt: F.when(prompt.contains("Search:"), "I can't tell."))
    return found.select("query_id", "chunk_id", "llm", "combined", "method", "place")


def _first_named(prompt):
    """A model that gives nine points to the first chunk of its prompt."""
    return F.format_string('{"rankings": [{"chunk_id": "%s", "score": 9, "reasoning": "first"}]}', F.regexp_extract(prompt, r'"chunk_id":(\d+)', 1))


@query(FALLBACK + """, told AS (SELECT *, CASE WHEN rank = 1 THEN 0.9::DOUBLE ELSE similarity END AS llm FROM hits WHERE rank <= 20)
SELECT query_id, chunk_id, llm, round(0.4 * similarity + 0.6 * llm, 7) AS combined, 'pattern_rerank' AS method, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(0.4 * similarity + 0.6 * llm, 7) DESC, rank) AS INTEGER) AS place FROM told""")
def rerank_model(spark, sf_dir):
    """A model that ranks, asked for the place of a change."""
    rows = _candidates(spark, sf_dir, 30).withColumn("source", F.col("query_text")).withColumn("hint", F.lit("Service"))
    return rerank.by_model(rows, _first_named, preferred=F.lit("en")).select("query_id", "chunk_id", "llm", "combined", "method", "place")


@query(FALLBACK + " SELECT query_id, string_agg(chunk_id, ' ' ORDER BY rank) AS chunk_ids, count(*) FILTER (WHERE lang = 'en') AS of_type FROM hits JOIN documents ON doc_id = chunk_id WHERE rank <= 20 GROUP BY query_id")
def pattern_payload(spark, sf_dir):
    """What a model is asked about a change's place, read again."""
    found = rerank.pattern_payload(_candidates(spark, sf_dir, 30), "query_id", F.lit("en"))
    read = F.from_json("payload", "array<struct<chunk_id: string, type_match: boolean>>")
    return found.select("query_id", F.array_join(F.transform(read, lambda x: x["chunk_id"]), " ").alias("chunk_ids"), F.size(F.filter(read, lambda x: x["type_match"])).cast("bigint").alias("of_type"))


@query(f"SELECT text, source || '/' || doc_id AS file_path, lang AS chunk_type, CAST(similarity AS VARCHAR) AS similarity, 'vector_only' AS method FROM (SELECT vec_id, {COS.format(VECTOR)} AS similarity FROM embeddings e) JOIN documents ON doc_id = vec_id WHERE similarity >= 0.1")
def result_segments(spark, sf_dir):
    """Results as texts with metadata."""
    near = stored_vectors(spark, sf_dir).select("chunk_id", F.round(vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in VECTOR])), 6).alias("vector_similarity")).where("vector_similarity >= 0.1")
    found = near.select(F.lit(0).alias("query_id"), "chunk_id", "vector_similarity", F.col("vector_similarity").alias("llm_score"), F.lit("vector_only").alias("ranking_method"), F.lit(1).alias("rank"))
    told = hybrid.segments(found, document_chunks(spark, sf_dir))
    return told.select("text", F.col("metadata.file_path").alias("file_path"), F.col("metadata.chunk_type").alias("chunk_type"), F.col("metadata.vector_similarity").alias("similarity"), F.col("metadata.ranking_method").alias("method"))


@query(RERANK.split("pairs AS")[0].rstrip().rstrip(",") + " SELECT query_id, string_agg(chunk_id, ' ' ORDER BY rank) AS chunk_ids, string_agg(lang, ' ' ORDER BY rank) AS types, sum(length(CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END))::BIGINT AS chars FROM hits JOIN documents ON doc_id = chunk_id GROUP BY query_id")
def rerank_payload(spark, sf_dir):
    """The candidates' JSON, read again."""
    found = rerank.payload(_candidates(spark, sf_dir), "query_id", ["chunk_id", "type", "fqn", "content", "similarity"])
    read = F.from_json("payload", "array<struct<chunk_id: string, type: string, content: string>>")
    of = lambda name: F.array_join(F.transform(read, lambda x: x[name]), " ")
    chars = F.aggregate(F.transform(read, lambda x: F.length(x["content"])), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return found.select("query_id", of("chunk_id").alias("chunk_ids"), of("type").alias("types"), chars.alias("chars"))



@query("""SELECT e.vec_id AS chunk_id, similarity, coalesce(quality / 1.0, similarity) AS llm, round(0.4 * similarity + 0.6 * coalesce(quality / 1.0, similarity), 7) AS combined, 'llm_rerank' AS method,
CAST(row_number() OVER (ORDER BY round(0.4 * similarity + 0.6 * coalesce(quality / 1.0, similarity), 7) DESC, similarity DESC, e.vec_id) AS INTEGER) AS place
FROM (SELECT vec_id, COS AS similarity FROM embeddings e) e LEFT JOIN labels ON doc_id = vec_id""".replace("COS", COS.format(VECTOR)))
def rerank_merge(spark, sf_dir):
    """Labels as a model's scores: quality 1 is ten points."""
    near = stored_vectors(spark, sf_dir).select(F.lit(0).alias("query_id"), "chunk_id", F.round(vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in VECTOR])), 6).alias("similarity"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")))
    scores = table(spark, sf_dir, "labels").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("chunk_id"), (10 * F.col("quality")).alias("score"))
    return rerank.merge(ranked, scores, "llm_rerank").select("chunk_id", "similarity", "llm", "combined", "method", "place")


@query("SELECT * FROM (VALUES (1, 'a', 7, 'r'), (1, 'b', 10, ''), (1, 'c', 0, 'x'), (2, 'a', 4, 'ok')) AS t(reply_id, chunk_id, score, reasoning)")
def llm_parse(spark, sf_dir):
    return rerank.parse_rankings(replies(spark))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS text FROM documents")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", truncated(F.col("text")).alias("text"))


@query(r"""SELECT page_id, regexp_extract(html, 'href\s*=\s*["\x27]([^"\x27]*)["\x27]', 1) AS href, regexp_extract(html, 'class\s*=\s*["\x27]([^"\x27]*)["\x27]', 1) AS class FROM pages""")
def attr_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", attribute(F.col("html"), "href").alias("href"), attribute(F.col("html"), "class").alias("class"))
