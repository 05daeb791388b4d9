"""The registered queries of this package: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, language, line_runs, packing, quality, search, simhash, token_file, toxicity, wrappers
from .runtime import crc_mod, ship, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 3) == 1
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, carry=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", F.round("containment", 6).alias("containment"))


OP3_SQL = """
WITH item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(5, len(w)) AS k FROM item_words WHERE len(w) > 0),
item_shingles AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM items, unnest(range(1, len(w) - k + 2)) AS t(i)),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id),
doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
doc_shingles AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM doc_words, (SELECT DISTINCT k FROM items) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
shared AS (
  SELECT doc_id, item_id, count(*) AS m FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(m AS INTEGER) AS n_shared, round(m / n, 6) AS containment
FROM shared JOIN sizes USING (item_id) WHERE m >= 0.8 * n - 1e-9
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 4) == 2
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_file.write_tokens(table(spark, sf_dir, "documents"))
    return token_file.with_crc(token_file.read_tokens(spark, path))


def op6_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as queries, whole: every one whose id is divisible by 20, against all documents."""
    docs = table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.search(docs, queries)


OP6_SQL = """
WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2),
lens AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS dl FROM documents),
fs AS (SELECT count(*) AS n, avg(dl) AS mean FROM lens),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
sc AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM post q JOIN dfs USING (term) JOIN post d USING (term) JOIN lens ON lens.doc_id = d.doc_id, fs WHERE q.doc_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 4) == 2
    found = language.identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
  FROM documents),
keyed AS (
  SELECT doc_id, line_no, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE r.k IS NOT NULL AND doc_id <> last_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE r.k IS NULL OR doc_id = last_id), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated r ON keyed.k = r.k
GROUP BY doc_id
"""


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _query(f) for f in (op1_best_fit_packing, op2_toxicity, op3_decontamination, op4_quality, op5_token_file, op6_bm25, op7_language, op8_simhash, op9_main_text, op10_line_dedup)}
ORACLES: dict[str, str] = {"op3_decontamination": OP3_SQL, "op6_bm25": OP6_SQL, "op10_line_dedup": OP10_SQL}
