"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams inside words (lower case, with a blank at either end of a run of letters), hashed, as
present or absent in the whole text. The log-count ratio of a feature is the log of how much likelier it is in toxic than
in other documents; features carry their ratio as value and a logistic regression learns their weights (Wang and Manning,
2012). Weights too small to matter are set to nought when the model is fitted, so most words of a text score nothing and
need one look-up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import fit_logistic, sigmoid
from .runtime import stored, tidy
from .sampling import labelled_sample

BITS, ORDERS = 18, (3, 4, 5)
#: Labelled rows that the fit uses at most; the rows with the smallest hash of their id.
SAMPLE = 12_000
#: Words whose features one worker keeps before it starts afresh.
CACHE = 400_000
_RUNS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    """Hashed n-grams of the runs of letters in a lower-cased word."""
    out = set()
    for run in _RUNS.findall(word):
        padded = f" {run} "
        for n in ORDERS:
            out.update(crc32(padded[i : i + n].encode()) & ((1 << BITS) - 1) for i in range(len(padded) - n + 1))
    return tuple(out)


def _words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


@dataclass
class Model:
    bias: float
    index: np.ndarray  # features with a weight, ascending
    weight: np.ndarray

    def scorer(self):
        """A function of a text: the probability that it is toxic."""
        weight = dict(zip(self.index.tolist(), self.weight.tolist()))
        kept: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            found: set[int] = set()
            for word in _words(text):
                own = kept.get(word)
                if own is None:
                    if len(kept) >= CACHE:
                        kept.clear()
                    own = tuple(x for x in word_features(word) if x in weight)
                    if len(word) <= 64:
                        kept[word] = own
                if own:
                    found.update(own)
            return float(sigmoid(self.bias + sum(map(weight.__getitem__, sorted(found)))))

        return score


def log_ratios(counts: np.ndarray, n: np.ndarray, *, smooth: float = 1.0, certain: float = 3.0) -> np.ndarray:
    """Log-count ratios from counts (2 x features: of other and of toxic rows that have each) and numbers of rows. Within
    `certain` standard errors of nought they are nought: such features, the most, say nothing about the label."""
    counts = counts + smooth
    ratio = np.log(counts[1] / (n[1] + 2 * smooth)) - np.log(counts[0] / (n[0] + 2 * smooth))
    ratio[np.abs(ratio) < certain * np.sqrt(1 / counts[0] + 1 / counts[1])] = 0.0
    return ratio


def fit(rows: list[np.ndarray], labels: np.ndarray, used: np.ndarray, ratio: np.ndarray, *, ridge: float = 1.0, least: float = 0.02) -> Model:
    """rows: for each, which of the features `used` (ascending) it has; ratio: theirs."""
    n = float(len(labels)), float(labels.sum())
    if not n[1] or n[0] == n[1]:  # nothing to tell apart
        return Model(float(np.log((n[1] + 0.5) / (n[0] - n[1] + 0.5))), used[:0], ratio[:0])
    flat = np.concatenate(rows).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    at = np.searchsorted(used, flat)
    bias, weight = fit_logistic(of, at, ratio[at], labels.astype(float), len(used), ridge=ridge)
    kept = np.abs(weight * ratio) >= least
    return Model(bias, used[kept], (weight * ratio)[kept])


def _present(texts: list[str | None], kept: dict[str, tuple[int, ...]]) -> list[list[int]]:
    out = []
    for text in texts:
        found: set[int] = set()
        for word in _words(text):
            if (own := kept.get(word)) is None:
                if len(kept) >= CACHE // 8:
                    kept.clear()
                own = kept[word] = word_features(word)
            found.update(own)
        out.append(sorted(found))
    return out


def learned(sample: DataFrame) -> Model:
    """Fits to (text, label) rows. Features are extracted and counted by the tasks; the driver gets the counts of those
    that some label prefers, and which of them each row has."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([pa.array(_present(some.column(0).to_pylist(), kept), pa.list_(pa.int32())), some.column(1)], names=["features", "label"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            lists, label = batch.column(0), batch.column(1).to_numpy()
            of = np.repeat(label != 0, np.diff(lists.offsets.to_numpy()))
            flat = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            for k in (0, 1):
                sums[k] += np.bincount(flat[of == bool(k)], minlength=1 << BITS)
        at = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["feature", "other", "toxic"])

    rows = stored(sample.mapInArrow(features, "features array<int>, label int"), "features")
    n = {bool(r[0]): r[1] for r in rows.groupBy(F.col("label") != 0).count().collect()}
    sums = rows.mapInArrow(count, "feature bigint, other bigint, toxic bigint").groupBy("feature").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()  # at most 2^BITS rows
    feature, counts = sums["feature"].to_numpy().astype(np.int64), np.stack([sums["other"].to_numpy(), sums["toxic"].to_numpy()]).astype(float).reshape(2, -1)
    ratio = log_ratios(counts, np.array([n.get(False, 0), n.get(True, 0)], float))
    order = np.argsort(feature)
    order = order[ratio[order] != 0]
    used, ratio = feature[order], ratio[order]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.intersect1d(x, used).astype(np.int32) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(1)], names=["features", "label"])

    chosen = rows.mapInArrow(select, "features array<int>, label int").toArrow()
    lists = chosen["features"].to_pylist()
    return fit([np.array(x, np.int64) for x in lists], chosen["label"].to_numpy() != 0, used, ratio)


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", label: str = "toxic", carry: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The columns `carry` of docs (all, if not given) and `score`, or `_score` where a carried column has that name. Fits on
    the labelled rows for which `learn` (over the key) holds.

    Null and empty texts score the bias alone. Rows that repeat an id are scored each; labels that repeat an id count
    each; null labels don't count. Without labels every score is one half. An empty table gives no rows.
    """

    model = learned(labelled_sample(docs, labels, learn, key, text, label, sample))
    carry = docs.columns if carry is None else carry
    out = "_score" if "score" in carry else "score"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = pa.array(map(score, batch.column(batch.num_columns - 1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*carry, out])

    schema = docs.select(*carry, F.lit(None).cast("double").alias(out)).schema
    return docs.select(*carry, F.col(text).alias("_whole_text")).mapInArrow(run, schema)
