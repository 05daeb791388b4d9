"""Reranking by a scorer (a language model, or any function of texts), payloads and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capitalised, tokens, truncated

CANDIDATES, CONTENT = 20, 500

RELEVANCE_PROMPT = """You judge how well code chunks answer a search.
Search: {{query}}
Chunks (JSON): {{code_chunks}}
Give each chunk a whole number from 0 (unrelated) to 10 (exactly what is asked for): does it do what the search describes, at the
layer it names, with the calls it needs? Reply with JSON only:
{"rankings": [{"chunk_id": "...", "score": 0, "reasoning": "..."}]}"""

PATTERN_PROMPT = """You look for the place where a change belongs.
Source: {{source_code}}
Hint: {{target_hint}}
Preferred type: {{preferred_type}}
Pattern: {{query}}
Chunks (JSON): {{code_chunks}}
Give each chunk a whole number from 0 to 10 for structure, calls and type alike. Reply with JSON only:
{"rankings": [{"chunk_id": "...", "score": 0, "reasoning": "..."}]}"""


def prompt(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return out


def payload(candidates: DataFrame, by: str, fields: list[str], score: str = "similarity") -> DataFrame:
    """(by, payload): the candidates of each query as JSON in rank order, nulls left out, at most CANDIDATES each."""
    entry = F.struct("rank", F.struct(*[truncated(F.col(c), CONTENT).alias(c) if c == "content" else F.col(c) for c in fields]).alias("chunk"))
    rows = candidates.where(F.col("rank") <= CANDIDATES).groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return rows.select(by, F.to_json(F.transform("entries", lambda e: e["chunk"])).alias("payload"))


def jaccard_score(query: Column, content: Column) -> Column:
    """The default scorer, deterministic: token overlap as a whole number from 0 to 10."""
    a, b = F.array_distinct(tokens(query)), F.array_distinct(tokens(content))
    return F.floor(F.lit(10) * F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))).cast("int")


def json_part(reply: Column) -> Column:
    """From the first { to the last }, or all of the reply, trimmed."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(F.trim(reply))


def _rankings(text: Column) -> Column:
    """The rankings of a reply; null if a field is missing, it has another shape, or it names a chunk twice."""
    shape = "struct<rankings: array<struct<chunk_id: string, score: int, reasoning: string>>>"
    r = F.from_json(json_part(text), shape, {"mode": "PERMISSIVE"})["rankings"]
    whole = F.forall(r, lambda x: x["chunk_id"].isNotNull() & x["score"].isNotNull() & x["reasoning"].isNotNull())
    once = F.size(F.array_distinct(F.transform(r, lambda x: x["chunk_id"]))) == F.size(r)
    return F.when(r.isNotNull() & whole & once, F.transform(r, lambda x: F.struct(x["chunk_id"].alias("chunk_id"), F.greatest(F.lit(0), F.least(F.lit(10), x["score"])).alias("score"), x["reasoning"].alias("reasoning"))))


def parse_rankings(replies: DataFrame) -> DataFrame:
    """(reply_id, chunk_id, score, reasoning) of replies (reply_id, text). A reply with a missing field, or of another
    shape, or that names a chunk twice, has no rankings."""
    return replies.select("reply_id", F.explode(_rankings(F.col("text"))).alias("x")).select("reply_id", "x.*")


def merge(candidates: DataFrame, rankings: DataFrame, method: str, by: str = "query_id") -> DataFrame:
    """candidates (by, chunk_id, similarity, rank) with llm, combined (0.4 vector + 0.6 llm), method and place. Without a
    ranking a candidate's similarity stands in for it."""
    rows = candidates.join(rankings.select(by, "chunk_id", F.col("score").alias("_s")), [by, "chunk_id"], "left")
    clamped = F.greatest(F.lit(0), F.least(F.lit(10), F.col("_s"))) / 10.0  # least() and greatest() pass over nulls
    llm = F.when(F.col("_s").isNull(), F.col("similarity")).otherwise(clamped)
    rows = rows.withColumn("llm", llm).withColumn("combined", F.round(0.4 * F.col("similarity") + 0.6 * F.col("llm"), 7))
    order = Window.partitionBy(by).orderBy(F.desc("combined"), F.asc("rank"))
    return rows.drop("_s").withColumn("method", F.lit(method)).withColumn("place", F.row_number().over(order))


def rerank(candidates: DataFrame, method: str, scorer=jaccard_score, by: str = "query_id") -> DataFrame:
    """Scores the first CANDIDATES of each query (columns query_text, content) and merges; the others leave the result."""
    first = candidates.where(F.col("rank") <= CANDIDATES)
    return merge(first, first.select(by, "chunk_id", scorer(F.col("query_text"), F.col("content")).alias("score")), method, by)


def pattern_query(source: Column, kind: Column, hint: Column) -> Column:
    """Type, up to ten capitalised identifiers in order of occurrence, and the hint."""
    return F.concat_ws(" ", kind, F.concat_ws(" ", F.slice(capitalised(source), 1, 10)), F.when(hint != "", hint))


PATTERN_FIELDS = ["chunk_id", "type", "type_match", "fqn", "content", "vector_similarity", "imports", "annotations", "api_calls", "mvc_mapping", "metadata"]


def pattern_payload(candidates: DataFrame, by: str, preferred: Column) -> DataFrame:
    """(by, payload) for a change's place: also whether the type is the preferred one, and what is known of the chunk."""
    rows = candidates.withColumn("type_match", F.col("type").eqNullSafe(preferred)).withColumn("vector_similarity", F.col("similarity"))
    for name, source in (("api_calls", "calls"), ("mvc_mapping", "mvc")):
        rows = rows.withColumn(name, F.col(source)) if source in rows.columns else rows
    return payload(rows, by, [c for c in PATTERN_FIELDS if c in rows.columns])


def by_model(candidates: DataFrame, model, *, preferred: Column | None = None, by: str = "query_id") -> DataFrame:
    """Reranks by a language model: `model` makes a column of replies of a column of prompts (one for each query).

    candidates: by, chunk_id, type, fqn, content, similarity, rank, query_text and, with a preferred type, source and hint.
    The first CANDIDATES of a query whose reply holds rankings are merged with them. A query whose reply holds none keeps all
    its candidates, by similarity, and its method ends in `fallback`.
    """
    kind = "pattern" if preferred is not None else "llm"
    if preferred is None:
        asked = payload(candidates.withColumn("vector_similarity", F.col("similarity")), by, ["chunk_id", "type", "fqn", "content", "vector_similarity"])
        asked = asked.join(candidates.groupBy(by).agg(F.first("query_text").alias("query_text")), by)
        text = prompt(RELEVANCE_PROMPT, query=F.col("query_text"), code_chunks=F.col("payload"))
    else:
        rows = candidates.withColumn("_preferred", preferred)
        asked = pattern_payload(rows, by, F.col("_preferred")).join(rows.groupBy(by).agg(*[F.first(c).alias(c) for c in ("source", "hint", "_preferred")]), by)
        wide = pattern_query(F.col("source"), F.col("_preferred"), F.col("hint"))
        text = prompt(PATTERN_PROMPT, source_code=truncated(F.col("source"), CONTENT), target_hint=F.col("hint"), preferred_type=F.col("_preferred"), query=wide, code_chunks=F.col("payload"))
    replies = asked.select(by, _rankings(model(text)).alias("_rankings"))
    told = candidates.join(replies, by)
    key = candidates.schema["chunk_id"].dataType
    silent = F.col("_rankings").isNull()
    own = F.transform(F.filter("_rankings", lambda x: x["chunk_id"].cast(key) == F.col("chunk_id")), lambda x: x["score"] / 10.0)
    told = told.where(silent | (F.col("rank") <= CANDIDATES)).withColumn("llm", F.coalesce(F.try_element_at(own, F.lit(1)), F.col("similarity")))
    told = told.withColumn("combined", F.round(0.4 * F.col("similarity") + 0.6 * F.col("llm"), 7))
    told = told.withColumn("method", F.when(silent, "vector_fallback" if kind == "llm" else "pattern_fallback").otherwise(f"{kind}_rerank"))
    order = Window.partitionBy(by).orderBy(F.desc("combined"), F.asc("rank"))
    return told.drop("_rankings").withColumn("place", F.row_number().over(order))
