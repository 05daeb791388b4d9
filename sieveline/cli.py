"""python -m sieveline.cli index|search|retrofit|status: the engine from a shell."""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import tokens
from .operators import chunks, diff, graph, hybrid, lexical
from .operators.vectors import hash_embedding
from .sources.files import parser_for, read_diffs, read_files
from .sources.store import ChunkStore


def index(spark: SparkSession, source: str, out: str) -> dict[str, float]:
    began = time.time()
    files = read_files(spark, source).withColumn("parser", parser_for(F.col("path")))
    counts = {r[0]: r[1] for r in files.groupBy("parser").count().collect()}
    store = ChunkStore(spark, out)
    found = chunks.chunks(files.where("parser IS NOT NULL"), chunks.parse_any)
    store.append_chunks(found.where("error IS NULL").drop("error"))
    table = _table(store)
    lexical.Index.of(table, field="searchable").save(f"{out}/postings")
    store.save_vectors(table.select("chunk_id", hash_embedding(tokens(F.col("searchable"))).alias("embedding")))
    graph.edges(table).write.mode("overwrite").parquet(f"{out}/graph")
    n = table.count()
    return {"files": sum(counts.values()), "java": counts.get("java", 0), "jsp": counts.get("jsp", 0), "config": counts.get("config", 0), "chunks": n, "documents": n, "embeddings": store.vectors().count(), "seconds": round(time.time() - began, 1)}


def _table(store: ChunkStore):
    """The chunks once each (a source that is indexed again gives the same ids), with what they are found by."""
    rows = store.chunks().dropDuplicates(["chunk_id"])
    return rows.select(F.xxhash64("chunk_id").alias("chunk_id"), F.col("chunk_id").alias("id"), chunks.searchable(rows).alias("searchable"), "metadata_json", "content", "type", "file_path", "fqn", "start_line", "end_line", F.col("api_calls").alias("calls"), "imports", "mvc", "class_context")


def search(spark: SparkSession, path: str, text: str, limit: int = 10, kind: str | None = None) -> list[dict]:
    table = _table(ChunkStore(spark, path))
    index = lexical.Index.load(spark, f"{path}/postings")
    query = spark.createDataFrame([(0, text)], "query_id int, query_text string")
    hits = lexical.bm25_search(index, query, limit, among=table.where(F.col("type") == kind) if kind else None)
    rows = hits.join(table, "chunk_id").orderBy("rank").collect()
    return [{"score": r.score, "type": r.type, "place": f"{r.file_path}:{r.start_line}-{r.end_line}", "fqn": r.fqn, "content": r.content[:200]} for r in rows]


def retrofit(spark: SparkSession, path: str, diffs: str, kind: str = "METHOD", file: str | None = None) -> list[dict]:
    """For each hunk of the diffs (a file, or a folder of them), or of those of one changed file, the chunks of the index that
    it belongs to. query_id is the hunk's number within its diff: file number * 100,000 + hunk number."""
    raw = read_diffs(spark, diffs)
    lines = diff.diff_lines(raw).join(diff.file_changes(raw).select("diff_id", "file_no", F.col("effective_path").alias("changed")), ["diff_id", "file_no"])
    lines = lines if file is None else lines.where(F.col("changed") == file)
    rows = lines.groupBy("diff_id", "file_no", "hunk_no", "changed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("source"))
    queries = rows.select(F.struct("diff_id", "file_no", "hunk_no").alias("at"), F.concat_ws(":", "diff_id", "file_no", "hunk_no").alias("query_id"), "changed", "source", F.lit("").alias("hint"), hash_embedding(tokens(F.col("source"))).alias("embedding"))
    store = ChunkStore(spark, path)
    table = _table(store)
    found = hybrid.pattern_search(table, store.vectors(), queries, kind, config=hybrid.RetrievalConfig(threshold=0.0), index=lexical.Index.load(spark, f"{path}/postings"))
    found = found.join(queries.select("query_id", "at", "changed"), "query_id").join(table.select("chunk_id", "id", "file_path", "fqn", "start_line", "end_line"), "chunk_id")
    number = (F.col("at.file_no") * 100_000 + F.col("at.hunk_no")).cast("bigint")
    out = found.withColumn("diff", F.col("at.diff_id")).withColumn("query_id", number).withColumn("chunk_id", F.col("id")).drop("at", "id")
    return [r.asDict() for r in out.orderBy("diff", "query_id", "rank").collect()]


def status(spark: SparkSession, path: str) -> dict[str, bool]:
    return ChunkStore(spark, path).status() | {f"env {v}": bool(os.environ.get(v)) for v in ("SPARK_HOME", "PYSPARK_PYTHON")}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sieveline")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index")
    a.add_argument("source")
    a.add_argument("-o", "--output", required=True)
    b = sub.add_parser("search")
    b.add_argument("query")
    b.add_argument("-i", "--index", required=True)
    b.add_argument("-n", "--limit", type=int, default=10)
    b.add_argument("-t", "--type", choices=chunks.TYPES)
    c = sub.add_parser("retrofit")
    c.add_argument("diff", help="a diff, or a folder of them")
    c.add_argument("-f", "--file", help="only this changed file")
    c.add_argument("-i", "--index", required=True)
    d = sub.add_parser("status")
    d.add_argument("-i", "--index", required=True)
    x = p.parse_args(args)
    spark = SparkSession.builder.appName("sieveline").getOrCreate()
    out = {"index": lambda: index(spark, x.source, x.output), "search": lambda: search(spark, x.index, x.query, x.limit, x.type), "retrofit": lambda: retrofit(spark, x.index, x.diff, file=x.file), "status": lambda: status(spark, x.index)}[x.command]()
    print(json.dumps(out, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
