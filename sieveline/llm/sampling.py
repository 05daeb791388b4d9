"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, key: str, text: str, label: str, sample: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(text, label, also...) of at most `sample` labelled rows for which `learn` holds: those with the least hash of their
    key. The key only picks rows; it is not among the columns.
    """
    marked = labels.where(learn & F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label"))
    marked = marked.orderBy(F.xxhash64("_key"), "_key", "label").limit(sample)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"), *also)
    return texts.join(F.broadcast(marked), "_key").select("text", "label", *also)  # at most `sample` rows of two numbers
