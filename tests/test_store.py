from pyspark.sql import functions as F

from sieveline import cli
from sieveline.plans import corpora
from sieveline.sources.store import ChunkStore
from sieveline.streaming import incremental


def test_index_search_retrofit_and_status(spark, tmp_path):
    for path, text in corpora.FILES:
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(text)
    (tmp_path / "c.diff").write_text(corpora.DIFF)
    out = str(tmp_path / "index")
    stats = cli.index(spark, str(tmp_path / "src"), out)
    assert (stats["files"], stats["java"], stats["jsp"], stats["config"]) == (10, 3, 1, 5) and stats["chunks"] == stats["embeddings"] > 20
    best = cli.search(spark, out, "execute user tries", 3, "METHOD")
    assert best[0]["fqn"] == "com.acme.web.LoginAction.execute"
    assert any(r["query_id"] == 100_001 for r in cli.retrofit(spark, out, str(tmp_path / "c.diff")))
    (tmp_path / "diffs").mkdir()
    for name in ("one", "two"):
        (tmp_path / f"diffs/{name}.diff").write_text(corpora.DIFF)
    found = cli.retrofit(spark, out, str(tmp_path / "diffs"), file="src/web/LoginAction.java")
    assert {(r["diff"][-8:], r["changed"]) for r in found} == {(f"{n}.diff", "src/web/LoginAction.java") for n in ("one", "two")}
    assert {r["chunk_id"] for r in found} <= {r.chunk_id for r in ChunkStore(spark, out).chunks().collect()}
    status = cli.status(spark, out)
    assert all(status[t] for t in ("chunks", "vectors", "postings", "graph"))


def test_store_overwrites_and_clears(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    assert store.chunks() is None and store.vectors().count() == 0
    store.append_chunks(spark.createDataFrame([(1, "a", "METHOD"), (2, "b", "FIELD")], "chunk_id long, content string, type string"))
    store.append_chunks(spark.createDataFrame([(3, "c", "FIELD")], "chunk_id long, content string, type string"))
    assert store.chunks().count() == 3
    store.overwrite_chunks(store.chunks().where("chunk_id <> 2"))
    assert {r.chunk_id for r in store.chunks().collect()} == {1, 3}
    store.clear()
    assert store.chunks() is None


def test_stream_appends_postings_and_upserts_vectors(spark, tmp_path):
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    for n, rows in enumerate([[(1, "alpha beta"), (2, "gamma")], [(2, "delta"), (3, "beta")]]):
        spark.createDataFrame([(i, t, "METHOD", n) for i, t in rows], "chunk_id long, content string, type string, s int").selectExpr("chunk_id", "content", "type", "timestamp_seconds(s) AS ts").write.mode("append").parquet(source)
        incremental.index_stream(incremental.chunk_stream(spark, source), store, f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{store}/postings").count() == 5
    assert {r.chunk_id for r in ChunkStore(spark, store).vectors().collect()} == {1, 2, 3}
    query = incremental.type_counts(incremental.chunk_stream(spark, source))
    query.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("SELECT sum(count) AS n FROM counts").first().n == 4


def test_vectors_are_upserted_found_and_removed(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "v"))
    rows = lambda *ids: spark.createDataFrame([(i, [float(i), 1.0]) for i in ids], "chunk_id long, embedding array<float>")
    store.save_vectors(rows(1, 2))
    before = store.vectors()
    store.upsert_vectors(rows(2, 3).selectExpr("chunk_id", "array(9f, 9f) AS embedding"))
    assert {r.chunk_id: r.embedding for r in store.vectors().collect()} == {1: [1.0, 1.0], 2: [9.0, 9.0], 3: [9.0, 9.0]}
    assert {r.chunk_id: r.stored for r in store.contains_vectors(rows(3, 4)).collect()} == {3: True, 4: False}
    assert [r.chunk_id for r in store.get_vectors(rows(3, 4)).collect()] == [3]
    store.remove_vectors(rows(1, 7))
    assert {r.chunk_id for r in store.vectors().collect()} == {2, 3}
    assert {r.chunk_id for r in before.collect()} == {1, 2}  # a reader keeps what it opened
    store.vacuum()
    assert store.versions("vectors") == [2] and store.vectors().count() == 2


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "u"))
    store.append_chunks(spark.createDataFrame([(1, "METHOD")], "chunk_id long, type string"))
    (tmp_path / "u/chunks/v1/type=METHOD").mkdir(parents=True)
    (tmp_path / "u/chunks/v1/type=METHOD/part-0.parquet").write_text("half")
    assert store.chunks().count() == 1
    store.overwrite_chunks(store.chunks().withColumn("chunk_id", F.col("chunk_id") + 1))
    assert [r.chunk_id for r in store.chunks().collect()] == [2]
