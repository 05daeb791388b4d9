"""The corpus pipeline: what of `documents` goes into training sequences.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Every stage takes nulls in any column (a null text counts as empty), empty and very long texts, repeated rows and an empty table
(which gives no rows). Extra columns of docs, whatever their names, are passed on by all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm import contamination, line_runs, packing, simhash, toxicity
from sieveline.llm.runtime import crc_mod, ship, stored, table

#: Documents that score this much go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; empty texts stay."""
    ship(spark)
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return scored.where(F.col(scored.columns[-1]) < TOXIC).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat elsewhere; n_chars is that of the text that is left."""
    ship(spark)
    return line_runs.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id (then the smallest hash of its row). Rows
    without an id are documents of their own, behind those with one; of rows that are equal in id and text one can stay, and
    so of rows without words."""
    ship(spark)
    row = F.xxhash64("doc_id", "text")
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row.alias("row")).alias("key"), "text")
    found = simhash.near_duplicates(keyed, key="key", shingle=5, similarity=0.8)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id.row").alias("__row")).distinct()
    kept = docs.withColumn("__row", row).join(keep, "__row", "left_semi")
    first = F.row_number().over(Window.partitionBy("__row").orderBy(*docs.columns))
    return kept.withColumn("__n", first).where("__n = 1").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; texts too short to hold one stay."""
    ship(spark)
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL has neither the classifier nor XXH64 nor the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
