import zlib

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sieveline.llm import token_file, tokens

ODD = ["", " a\tb\n\nc ", "x\x1cy \x85 z w", "<|endoftext|> hi<|startoftext|>there", "ΑΣ ΣΑΣ. it's DON'T", "é ́a", "Ⅷ 12345 !!!???", "a" * 3000, "ÀÖß÷ Ñandú, ÿ\xadx àß. éé!!$$", "the&&& stupid$$$ | x"]


def same(texts):
    codec = tokens.codec()
    got = list(codec.encode(texts))
    want = codec.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [a.tolist() for a in got] == [e.ids for e in want]


def test_ids_are_the_librarys():
    assert same([*ODD, None])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=40), max_size=5))
def test_ids_are_the_librarys_on_any_text(texts):
    assert same(texts)


def test_a_full_cache_starts_afresh(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "CACHE_CORES", 3)
    monkeypatch.setattr(tokens, "SLICE_CHARS", 10)
    monkeypatch.setattr(tokens, "STEP", 2)
    monkeypatch.setattr(tokens, "_codecs", {})
    assert same(["one two three four", "five six, one", "two!", *ODD])


def test_token_file_round_trip(spark, tmp_path):
    texts = ["b c", None, "", "long " * 5000, "a", "a"]
    docs = spark.createDataFrame([(9 - i, t, i, 2) for i, t in enumerate(texts)] + [(4, "tie", 0, 0), (None, "no id", 0, 0)], "doc_id long, text string, part int, start int").repartition(3)
    path = token_file.write_tokens(docs, f"file://{tmp_path}/t")
    got = token_file.with_crc(token_file.read_tokens(spark, path)).collect()
    at = 0
    want = []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
        ids = np.concatenate([next(tokens.codec().encode([r.text])), [2]]).astype("<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    some = token_file.read_tokens(spark, path, F.col("doc_id") > 7, ids=False)
    assert {r.doc_id for r in some.collect()} == {8, 9} and "ids" not in some.columns
    file = next(p for p in (tmp_path / "t/tokens").glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows)
    group = pq.ParquetFile(file).metadata.row_group(0)
    encodings = {group.column(i).path_in_schema: set(group.column(i).encodings) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in encodings["n_tokens"] and "RLE_DICTIONARY" in encodings["ids.list.element"]
    assert group.column(0).has_offset_index and group.column(0).has_column_index


def test_empty_table(spark):
    path = token_file.write_tokens(spark.createDataFrame([], "doc_id long, text string"))
    assert token_file.with_crc(token_file.read_tokens(spark, path)).collect() == []
