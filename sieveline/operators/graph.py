"""Relationship edges between chunks, and the scores that they give to search results.

chunks: chunk_id, fqn, calls and imports (arrays), mvc (map), class_context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capitalised, package_of

# Substrings of a lower-cased query and the hint that each gives.
API_HINTS = {"service": "Service", "dao": "DAO", "controller": "Controller", "action": "Action"}
PACKAGE_HINTS = {w: w for w in ("util", "service", "dao", "web")}
MVC_HINTS = {w: w for w in ("login", "user", "form")}
FRAMEWORKS = ("struts", "spring", "hibernate", "jsp")


def hints(text: Column, table: dict[str, str]) -> Column:
    return F.filter(F.array(*[F.when(F.lower(text).contains(w), F.lit(h)) for w, h in table.items()]), lambda h: h.isNotNull())


def hint_words(text: Column) -> Column:
    """The words of the tables above that a text holds: as a query it gives the same hints, and is short."""
    words = sorted({*API_HINTS, *PACKAGE_HINTS, *MVC_HINTS})
    return F.concat_ws("\n", hints(text, {w: w for w in words}))


def mvc_edges(chunks: DataFrame) -> DataFrame:
    """(chunk_id, value) of the mapping entries whose key holds action, form or jsp."""
    return chunks.select("chunk_id", F.explode("mvc").alias("key", "value")).where(F.col("key").rlike("action|form|jsp")).select("chunk_id", "value")


def inheritance(chunks: DataFrame) -> DataFrame:
    """(chunk_id, value): the first extended type and the implemented ones of a class context."""
    context = F.coalesce(F.col("class_context"), F.lit(""))
    parent = F.regexp_extract(context, r"extends\s+(\w+)", 1)
    faces = F.transform(F.split(F.regexp_extract(context, r"implements\s+([\w,\s]+)", 1), ","), lambda x: F.trim(x))
    return chunks.select("chunk_id", F.explode(F.filter(F.concat(F.array(parent), faces), lambda x: x != "")).alias("value"))


def edges(chunks: DataFrame) -> DataFrame:
    """Distinct (kind, src, dst)."""
    src = F.col("chunk_id").cast("string")
    kinds = [
        chunks.select(F.lit("call").alias("kind"), src.alias("src"), F.explode("calls").alias("dst")),
        chunks.select(F.lit("import").alias("kind"), src.alias("src"), F.explode("imports").alias("dst")),
        chunks.where(F.col("fqn").isNotNull()).select(F.lit("package").alias("kind"), package_of(F.col("fqn")).alias("src"), src.alias("dst")),
        mvc_edges(chunks).select(F.lit("mvc").alias("kind"), src.alias("src"), F.col("value").alias("dst")),
        inheritance(chunks).select(F.lit("inherit").alias("kind"), src.alias("src"), F.col("value").alias("dst")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.distinct()


def co_occurrence(results: DataFrame, by: list[str]) -> DataFrame:
    """results (chunk_id, fqn, ...) with `co`: how many other results of the same `by` share the package. One window in
    place of comparing all pairs; rows of the same chunk don't count each other."""
    rows = results.withColumn("package", package_of(F.col("fqn")))
    of = Window.partitionBy(*by, "package")
    same = Window.partitionBy(*by, "package", "chunk_id")
    return rows.withColumn("co", F.count(F.lit(1)).over(of) - F.count(F.lit(1)).over(same))


def _share(found: Column, of: Column) -> Column:
    return F.size(found) / F.greatest(F.size(of), F.lit(1))


def graph_score(results: DataFrame, by: list[str], query: str = "query_text", import_hints: Column | None = None) -> DataFrame:
    """Adds `graph`, 0 to 1, to results with chunk_id, fqn, calls, imports, mvc and the query's text. Each kind of hint counts
    by the share of it that the chunk has word for word. A query's text gives no hints of imports; `import_hints` (an array)
    may."""
    rows = co_occurrence(results, by)
    q = F.col(query)
    api, packages, flows = hints(q, API_HINTS), hints(q, PACKAGE_HINTS), hints(q, MVC_HINTS)
    none = F.array().cast("array<string>")
    wanted = none if import_hints is None else F.array_distinct(F.coalesce(import_hints, none))
    values = F.coalesce(F.map_values(F.map_filter("mvc", lambda k, v: k.rlike("action|form|jsp"))), none)
    score = (
        F.when(F.array_contains(packages, F.col("package")), 0.3).otherwise(0.0)
        + 0.4 * _share(F.array_intersect(F.coalesce("calls", none), api), api)
        + 0.2 * _share(F.array_intersect(F.coalesce("imports", none), wanted), wanted)
        + 0.3 * _share(F.array_intersect(values, flows), flows)
        + F.when(F.col("co") > 1, 0.1 * F.log(F.greatest(F.col("co"), F.lit(1)).cast("double"))).otherwise(0.0)
    )
    return rows.withColumn("graph", F.round(F.least(F.lit(1.0), score), 6))


def graph_filter(scored: DataFrame, by: str = "query_id") -> DataFrame:
    """Keeps the best four fifths (rounded down) of each query by 0.7 score + 0.3 graph; a lone result goes."""
    rows = scored.withColumn("combined", F.round(0.7 * F.col("score") + 0.3 * F.col("graph"), 7))
    order = Window.partitionBy(by).orderBy(F.desc("combined"), F.asc("rank"))
    kept = rows.withColumn("place", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    return kept.where(F.col("place") <= F.floor(F.col("_n") * 4 / 5)).drop("_n")


def pattern_context(source: Column) -> Column:
    """struct(apis, signatures, frameworks) of a piece of source code."""
    called = F.transform(F.regexp_extract_all(source, F.lit(r"([A-Za-z0-9_]+)\s*\("), F.lit(1)), lambda x: x)
    apis = F.array_distinct(F.filter(called, lambda x: F.length(x) > 2))
    frameworks = F.filter(F.array(*[F.when(source.contains(f), F.lit(f)) for f in FRAMEWORKS]), lambda x: x.isNotNull())
    return F.struct(apis.alias("apis"), capitalised(source).alias("signatures"), frameworks.alias("frameworks"))


def pattern_score(results: DataFrame, preferred: Column) -> DataFrame:
    """Adds `pattern`, 0 to 1, to results with type, calls, imports, fqn and `context` (of pattern_context). A null name
    matches no signature."""
    none = F.array().cast("array<string>")
    calls, imports, c = F.coalesce("calls", none), F.coalesce("imports", none), F.col("context")
    hit = F.filter(c["apis"], lambda p: F.exists(calls, lambda x: x.contains(p)))
    score = (
        F.when(F.col("type") == preferred, 0.4).otherwise(0.0)
        + 0.3 * _share(hit, c["apis"])
        + F.when(F.exists(c["signatures"], lambda s: F.coalesce(F.col("fqn"), F.lit("")).contains(s)), 0.2).otherwise(0.0)
        + F.when(F.exists(c["frameworks"], lambda f: F.exists(imports, lambda x: x.contains(f))), 0.1).otherwise(0.0)
    )
    return results.withColumn("pattern", F.round(F.least(F.lit(1.0), score), 6))


def pattern_filter(scored: DataFrame, by: str = "query_id") -> DataFrame:
    """Keeps the better half of each query by pattern score (five at least); earlier ranks win ties."""
    order = Window.partitionBy(by).orderBy(F.desc("pattern"), F.asc("rank"))
    rows = scored.withColumn("place", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    return rows.where(F.col("place") <= F.greatest(F.lit(5), F.floor(F.col("_n") / 2))).drop("_n")
