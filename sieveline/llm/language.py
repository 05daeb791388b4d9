"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content dictionary for zstandard, cut from whole training texts. All of a text,
lower-cased and with white space joined, is compressed with every dictionary, piece by piece, and the least size wins. Where dictionaries
differ in size, the smaller one has to beat the mean of what the larger gives whole and cut to the smaller's size: on equal terms a
text of a rare language is told, and a common language keeps what its size is worth. When the runner-up comes within
`margin` bytes a hundred bytes of text, the decision is rejected: `rejected` says so, `lang_pred` still names the winner.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of what is learned, all parameters of identify(): bytes of a dictionary; training texts of a language at most (and
#: no more than it takes for two dictionaries); characters of the longest text that can be one of them.
DICTIONARY, TEXTS, LONGEST = 112 << 10, 400, 20_000
#: Parts in which the training texts of a language are picked.
PARTS = 64
LEVEL, MARGIN = 6, 0.4
#: Bytes that are compressed at once: beyond them a text would be its own dictionary.
PIECE = 2048
#: Cut dictionaries that a worker keeps (speed only).
CUTS = 256
#: Words that are kept or left out together when training texts are cleaned.
WINDOW = 12


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Languages:
    """Dictionaries by language; scores texts."""

    def __init__(self, samples: dict[str, list[str]], level: int = LEVEL, margin: float = MARGIN, dictionary: int = DICTIONARY):
        self.names = sorted(samples)
        self.margin = margin
        self.level = level
        share = {k: b"\n".join(normal(t).encode() for t in samples[k])[-dictionary:] for k in self.names}
        self.names.sort(key=lambda k: -len(share[k]))  # stable: of equal sizes, the language that sorts first
        self.share = [share[k] for k in self.names]
        self.room = [len(x) for x in self.share]
        self.compressors = [self._compressor(x) for x in self.share]
        self.cut = lru_cache(CUTS)(lambda i, room: self._compressor(self.share[i][len(self.share[i]) - room :]))

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=self.level)
        return zstandard.ZstdCompressor(level=self.level, dict_data=data, write_content_size=False, write_dict_id=False)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1) and whether the margin is too narrow; ("und", 0, True) without a letter or languages."""
        if not text or not self.names or not has_letter(text):
            return "und", 0.0, True
        data = normal(text).encode()
        parts = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        size_with = lambda c: sum(map(len, map(c.compress, parts)))
        sizes = np.array(list(map(size_with, self.compressors)), float)
        cuts: dict[tuple[int, int], float] = {}

        def beside(i: int, room: int) -> float:
            """What a dictionary has to beat that has only `room` bytes: half way between i's whole one and i's cut to that."""
            if room >= self.room[i]:
                return sizes[i]
            if (i, room) not in cuts:
                cuts[i, room] = (sizes[i] + size_with(self.cut(i, room))) / 2
            return cuts[i, room]

        best = 0
        for i in range(1, len(sizes)):
            against = beside(best, self.room[i])
            if sizes[i] < against or (sizes[i] == against and self.room[i] == self.room[best] and self.names[i] < self.names[best]):
                best = i
        # What each other language lost by: sizes are told apart at the smaller one's room.
        lost = np.array([sizes[i] - beside(best, self.room[i]) if self.room[i] <= self.room[best] else beside(i, self.room[best]) - sizes[best] for i in range(len(sizes))])
        # Odds fall by half with each eighth of a byte a hundred bytes that a dictionary needs more.
        lost = np.maximum(lost, 0) * 100 / len(data)
        odds = np.exp2(-np.minimum(8 * lost, 200))
        narrow = len(lost) > 1 and np.delete(lost, best).min() < self.margin
        return self.names[best], float(odds[best] / odds.sum()), bool(narrow)


def windows(text: str) -> list[str]:
    words = text.split()
    return [" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]


def cleaned(samples: dict[str, list[str]], level: int = LEVEL, dictionary: int = DICTIONARY) -> dict[str, list[str]]:
    """The samples without the runs of WINDOW words that another language's texts explain better: passages in a foreign language would
    make a dictionary match their other copies. Each half of the texts is judged by dictionaries of the other half; a
    language with a single text stays as it is and judges both."""
    single = {k: v for k, v in samples.items() if len(v) < 2}
    halves = [{k: v[i::2] for k, v in samples.items() if k not in single} for i in (0, 1)]
    if len(samples) < 2 or not halves[0]:
        return samples
    judge = Languages(halves[0] | single, level, dictionary=dictionary)
    for i in (1, 0):  # the second half's lines first; then dictionaries of what is left of it judge the first
        own = {k: [" ".join(x for x in windows(t) if judge.predict(x)[0] in (k, "und")) for t in v] for k, v in halves[i].items()}
        halves[i] = {k: [t for t in v if t.strip()] or halves[i][k] for k, v in own.items()}
        judge = Languages(halves[i] | single, level, dictionary=dictionary)
    return single | {k: [t for pair in zip_longest(halves[0][k], halves[1][k]) for t in pair if t] for k in halves[0]}


def training_texts(docs: DataFrame, learn: Column, *, text: str, lang: str, texts: int = TEXTS, longest: int = LONGEST, dictionary: int = DICTIONARY) -> dict[str, list[str]]:
    """At most `texts` different whole texts a language, those with the least hash (of the rows for which learn holds), and no
    more of them than it takes for two dictionaries."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.length(text).between(1, longest)).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    # Hashes are picked first, in parts of a language and then of the whole, and only the texts of those are fetched.
    hashes = rows.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("size"))
    for part in (F.pmod(F.xxhash64("h"), F.lit(PARTS)), F.lit(0)):
        least = Window.partitionBy("lang", "part").orderBy("h")
        hashes = hashes.withColumn("part", part).withColumn("n", F.row_number().over(least)).where(F.col("n") <= texts).select("lang", "h", "size")
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    chosen = hashes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 2 * dictionary).select("lang", "h")
    out: dict[str, list[str]] = {}
    for r in rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).orderBy("lang", "h").select("lang", "text").collect():
        out.setdefault(r[0], []).append(r[1])
    return out


def identify(docs: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang", level: int = LEVEL, margin: float = MARGIN, texts: int = TEXTS, longest: int = LONGEST, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row. Learns from the rows of docs for which `learn` holds and whose
    language isn't null, within the bounds `texts`, `longest` and `dictionary`.

    Null texts and texts without a letter get `und`, score 0, rejected. Without a training text all rows do. Equal sizes go
    to the language that sorts first. Very long texts are compressed whole, piece by piece. Repeated rows are scored each. An
    empty table gives no rows. Other columns of docs are not read.
    """
    samples = cleaned(training_texts(docs, learn, text=text, lang=lang, texts=texts, longest=longest, dictionary=dictionary), level, dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(samples, level, margin, dictionary)
        for batch in batches:
            name, score, rejected = zip(*map(languages.predict, batch.column(1).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
