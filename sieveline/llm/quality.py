"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairs are never visited: for each factor f,
sum_{i<j} v_if v_jf x_i x_j = ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2 (Rendle, 2010), so a text costs time linear in
its distinct words.

Features: each distinct word of the text (hashed, as written) with its count, the words together of length one; each
structure statistic and the metadata (n_chars) in bins, one feature a bin.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import sigmoid
from .sampling import labelled_sample

BITS, FACTORS = 16, 8
BINS = 12
#: Labelled rows that the fit uses at most; the rows with the smallest hash of their id.
SAMPLE = 8_000
STATISTICS = ("words", "upper", "digits", "marks", "symbols", "word_length", "distinct", "commonest", "marked_words", "line_words", "equal_lines", "stops", "n_chars")
SIZE = (1 << BITS) + BINS * len(STATISTICS)


def _bin(x: float) -> int:
    """Of a share: nought and one have bins of their own, those between on a scale that is finer near nought."""
    return 0 if x <= 0 else BINS - 1 if x >= 1 else 1 + min(BINS - 3, int((BINS - 2) * x**0.5))


def _size_bin(x: float) -> int:
    return min(BINS - 1, int(np.log2(1 + max(0.0, x)) * 0.8))


def _byte_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_UPPER = _byte_table(bytes(range(65, 91)))
_DIGIT = _byte_table(b"0123456789")
_MARK = _byte_table(b".,;:!?'\"-()")
_SYMBOL = _byte_table(b"#$%&*+/<=>@[\\]^_`{|}~")


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, ascending, and their values."""
    text = text or ""
    counts = Counter(text.split())
    n = sum(counts.values())
    held: dict[int, float] = {}
    marked = 0
    for word, m in counts.items():
        h = crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        held[h] = held.get(h, 0.0) + m
        marked += m * (not word[-1].isalnum())
    norm = sum(x * x for x in held.values()) ** 0.5 or 1.0
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, len(text))
    lines = [x for x in text.split("\n") if x]
    words = max(1, n)
    bins = (
        _size_bin(n), _bin(byte @ _UPPER / size), _bin(byte @ _DIGIT / size), _bin(byte @ _MARK / size), _bin(byte @ _SYMBOL / size),
        min(BINS - 1, int((len(text) - n + 1) / words)), _bin(len(counts) / words), _bin(max(counts.values(), default=0) / words),
        _bin(marked / words), _size_bin(n / max(1, len(lines))), _bin(1 - len(set(lines)) / max(1, len(lines))), _bin(text.count(".") / words),
        _size_bin(len(text) if n_chars is None else n_chars) if n_chars != 0 else 0,
    )
    at = np.array([*held, *((1 << BITS) + BINS * i + b for i, b in enumerate(bins))], np.int64)
    value = np.array([*(x / norm for x in held.values()), *[1.0] * len(bins)])
    order = np.argsort(at)
    return at[order], value[order]


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray  # SIZE x FACTORS

    def raw(self, at: np.ndarray, value: np.ndarray) -> float:
        scaled = self.factor[at] * value[:, None]
        total = scaled.sum(axis=0)
        return self.bias + float(self.weight[at] @ value) + 0.5 * float(total @ total - (scaled * scaled).sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], *, rounds: int = 8, batch: int = 64, rate: float = 0.05, ridge: float = 2e-4, seed: int = 7) -> Machine:
    """rows: (features, values, label). Adagrad on the log loss in batches, in an order that `seed` fixes."""
    y = np.array([r[2] for r in rows], float)
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    draw = np.random.default_rng(seed)
    w, v = np.zeros(SIZE), draw.normal(0, 0.05, (SIZE, FACTORS))
    if len(set(y.tolist())) < 2:
        return Machine(bias, w, np.zeros_like(v))
    gw, gv, gb = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6), 1e-6
    for _ in range(rounds):
        order = draw.permutation(len(rows))
        for lo in range(0, len(order), batch):
            part = [rows[i] for i in order[lo : lo + batch]]
            size = np.array([len(p[0]) for p in part])
            at, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            starts, of = np.cumsum(size) - size, np.repeat(np.arange(len(part)), size)
            scaled = v[at] * x[:, None]
            total = np.add.reduceat(scaled, starts)
            z = bias + np.add.reduceat(w[at] * x, starts) + 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((scaled * scaled).sum(axis=1), starts))
            error = (sigmoid(z) - y[order[lo : lo + batch]]) / len(part)
            used, inverse = np.unique(at, return_inverse=True)
            dw = np.bincount(inverse, weights=error[of] * x) + ridge * w[used]
            each = (error[of] * x)[:, None] * (total[of] - scaled)
            dv = np.stack([np.bincount(inverse, weights=each[:, f]) for f in range(FACTORS)], axis=1) + ridge * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += error.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            bias -= rate * error.sum() / gb**0.5
    return Machine(bias, w, v)


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs. Fits on the labelled rows for which `learn` (over the key) holds.

    Null and empty texts are scored by their structure. A null n_chars counts as the text's length. Rows that repeat an id
    are scored each; null labels don't count; without labels every score is one half. An empty table gives no rows.
    """
    chosen = labelled_sample(docs, labels, learn, key, text, label, sample, also=(n_chars,))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = zip(*map(features, batch.column(0).to_pylist(), batch.column(2).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for x in value], pa.list_(pa.float32())), batch.column(1)], names=["at", "value", "label"])

    found = chosen.mapInArrow(extract, "at array<int>, value array<float>, label int").toArrow()
    at, value = found["at"].combine_chunks(), found["value"].combine_chunks()
    a, x, ends = at.values.to_numpy().astype(np.int64), value.values.to_numpy().astype(float), at.offsets.to_numpy()
    machine = fit([(a[i:j], x[i:j], y) for i, j, y in zip(ends, ends[1:], found["label"].to_pylist())])
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weight.astype(np.float32), machine.factor.astype(np.float32)))  # SIZE rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*shared.value)
        for batch in batches:
            raw = [machine.raw(*features(t, n)) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(raw) if raw else [], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(n_chars).cast("bigint").alias("n_chars"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
