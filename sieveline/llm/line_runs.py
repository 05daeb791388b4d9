"""Line deduplication over levelled sorted runs of line hashes.

The index is a log-structured set of runs: tables of (hi, lo, n_docs, last_id), dealt out into buckets by (hi, lo) and
sorted in them, so that a batch meets them bucket by bucket and only compaction deals them out anew. Each new batch is merged
with the runs by anti-joins, which decide where its keys go: those that no run holds become a run of level 0, so that a key is in one run
alone, and the few that a run holds become an increment (documents and largest document that the batch adds to the key).
When a level has FANOUT runs they are compacted into one run of the next level: a batch meets O(FANOUT log batches) runs,
and a key is rewritten once a level. The documents of a key are its run's count and its increments'.

Keys are two 64-bit hashes of the stripped, lower-cased line: lines are neither stored nor moved. A batch holds whole
documents, and all rows of a doc_id come in one batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import fresh_path, stored

FANOUT, BATCHES = 4, 4
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


class LineRuns:
    """The index; `levels` lists the tables of its runs by level, newest last, `increments` those of the increments."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path or fresh_path(spark, "line-runs"), fanout
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.increments: list[str] = []
        self.made = 0

    def _write(self, keys: DataFrame) -> str:
        table = f"{self.name}_{self.made}"
        self.made += 1
        keys.write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", f"{self.path}/{table}").saveAsTable(table)
        return table

    def _drop(self, tables: list[str]) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE {t}")  # the files stay: who still reads them can

    def _plain(self, tables: list[str]) -> DataFrame:
        """The tables' rows, without their buckets: a union of bucketed tables would be grouped as if it were one."""
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{t}" for t in tables])

    def runs(self) -> list[DataFrame]:
        """Each run; a key is in one alone, with what the batch that brought it had of it."""
        return [self.spark.table(t) for level in self.levels for t in level]

    def close(self) -> None:
        """Forgets the tables' names; frames that read them go on."""
        self._drop([t for level in self.levels for t in level])
        self.levels, self.increments = [], []

    def keys(self) -> DataFrame | None:
        """One row for each key, with all batches' documents."""
        tables = [t for level in self.levels for t in level]
        return merged(self._plain(tables + self.increments)) if tables else None

    def repeated(self, min_docs: int) -> DataFrame | None:
        """Of keys(), those with min_docs documents or more: each run meets the increments in its buckets."""
        added = stored(merged(self._plain(self.increments)), "increments") if self.increments else None
        out = None
        for run in self.runs():
            if added is not None:
                more = added.select("hi", "lo", F.col("n_docs").alias("_n"), F.col("last_id").alias("_last"))
                run = run.join(more, ["hi", "lo"], "left")
                run = run.select("hi", "lo", (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("last_id", "_last").alias("last_id"))
            run = run.where(F.col("n_docs") >= min_docs)
            out = run if out is None else out.unionAll(run)
        return out

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes in a batch of (doc_id, hi, lo); returns its run: (hi, lo, n_docs, last_id) of the keys that are new with it."""
        # Documents first, each on its own key: a line that a third of all documents hold is counted in parts.
        pairs = batch.select("hi", "lo", "doc_id").distinct()
        own = pairs.groupBy("hi", "lo").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last_id"))
        self.schema = own.schema
        if runs := self.runs():
            own = stored(own, "line-batch")
        new = own
        for run in runs:
            new = new.join(run.select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")
        table = self._write(new)
        new = self.spark.table(table)
        if runs:
            held = own.join(new.select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")
            name = f"{self.name}_more_{self.made}"
            held.write.parquet(f"{self.path}/{name}")
            self.increments.append(name)
        self._take(table, 0)
        return new

    def _take(self, table: str, level: int) -> None:
        self.levels += [[]] * (level + 1 - len(self.levels))
        self.levels[level] = [*self.levels[level], table]
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._take(self._write(self._plain(full).repartition(self.buckets, "hi", "lo")), level + 1)
            self._drop(full)


def merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """Drops repeated lines: keys of at least min_chars code points that at least min_docs documents hold go from all
    documents but the one with the largest id. Returns the rows of docs with the text replaced and n_lines (before) and
    n_dropped added under those names, or with a leading underscore where docs has such columns.

    A null text is an empty one (one empty line). Very long texts take time in proportion to their lines. Rows with the same
    id count as one document, and each of them keeps what that document keeps. Rows with a null id are nobody's document:
    they count for no line and keep no repeated one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    row = F.xxhash64(F.col(key), F.col(text))  # rows with the same id and different texts stay apart
    # The row's hash and the keys come before the rows of lines, which else would each carry the whole text.
    keyed = docs.select(F.col(key).alias("doc_id"), row.alias("row"), F.transform(_lines(text), lambda x: F.when(F.length(x) >= min_chars, line_key(x))).alias("lines"))
    at = keyed.select("doc_id", "row", F.posexplode("lines").alias("line_no", "line"))
    at = at.where(F.length("line") >= min_chars).select("doc_id", "row", "line_no", F.xxhash64("line").alias("hi"), F.xxhash64(F.lit(1), "line").alias("lo"))
    at = at.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)))
    path = fresh_path(spark, "lines")
    at.write.partitionBy("batch").parquet(path)
    schema = at.schema
    lines = spark.read.schema(schema).parquet(path)

    runs = LineRuns(spark)
    for n in range(batches):
        runs.add(lines.where(F.col("batch") == n))
    # A table of its own: its size is known, so it is broadcast where small, and else a line with very many holders is split.
    repeated = stored(runs.repeated(min_docs).select("hi", "lo", "last_id"), "repeated-lines")
    runs.close()
    gone = lines.join(repeated, ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    gone = gone.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__of")).agg(F.collect_set("line_no").alias("__gone"))

    # The text is split once, for the count and for what is kept.
    out = docs.withColumn("__row", row).join(gone.hint("shuffle_hash"), (F.col("__row") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__id")), "left")
    out = out.withColumn("__lines", _lines(text))
    n = F.size("__lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("__gone")), lambda i: F.get(F.col("__lines"), i))
    name = lambda c: f"_{c}" if c in docs.columns else c
    return out.select(
        *[F.when(F.col("__gone").isNull(), F.coalesce(F.col(c), F.lit(""))).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(c) for c in docs.columns],
        n.cast("bigint").alias(name("n_lines")), F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias(name("n_dropped")),
    )
