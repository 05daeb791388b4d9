"""Whole-text encoding with a public tokenizer, with the ids of words kept for their next occurrence.

The tokenizer `word_bpe_49k.json` turns white space into one space, lower-cases character by
character and never lets a token cross white space, so a text's ids are the ids of its words, one
after the other. Arrow splits a slice of texts into words and numbers them, so that only the slice's
distinct words are looked at. Nearly all are letters with marks behind them, which the pre-tokenizer
cuts apart: the ids of either are kept, and each Python worker asks the library only for those that
it doesn't hold (see CACHE_CORES). All other words go the library's whole way.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
#: Words that go the library's whole way, and runs of letters or marks, that one worker holds; beyond them the half stays
#: that most slices had. Speed only; results don't depend on it.
CACHE_WORDS, CACHE_CORES = 50_000, 400_000
#: Characters that are encoded at once, and words that are looked up at once (a very long text is a slice of its own).
SLICE_CHARS, STEP = 3_000_000, 1_000_000
#: Letters that normalisation only lower-cases, and marks that the byte-level alphabet leaves as they are. A run of the
#: former and then of the latter is two tokens of the pre-tokenizer at most.
_LETTERS = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7))
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<")
_ONLY_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]*$"
_BYTES = {c: "".join(chr(b) if 0xA1 <= b != 0xAD else chr(0x100 + b - 0x5E) if 0x7F <= b <= 0xA0 else chr(0x143) for b in chr(c).encode()) for c in range(0xC0, 0x100)}
Ids = tuple[np.ndarray, np.ndarray]  # flat, and how many each string has


def _gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of the pool, one after the other."""
    ends = np.cumsum(size)
    where = np.repeat(start - (ends - size), size)
    where += np.arange(len(where))
    return pool[where]


def _strings(array: pa.StringArray) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class Held:
    """The ids of at most `most` strings (or of one call's, if they are more). They stay in Arrow: a lookup is one hash join."""

    def __init__(self, most: int, learn: Callable[[list[str]], Ids]):
        self.most, self.learn = most, learn
        self._take(pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _take(self, words: pa.StringArray, ids: np.ndarray, size: np.ndarray, met: np.ndarray) -> None:
        self.words, self.start, self.size, self.pool, self.met = words, np.cumsum(size) - size, size, ids, met

    def _forget(self) -> None:
        best = np.argsort(-self.met, kind="stable")[: self.most // 2]
        keep = np.sort(best[self.met[best] > 1])
        self._take(self.words.take(pa.array(keep)), _gathered(self.pool, self.start[keep], self.size[keep]), self.size[keep], self.met[keep] // 2)

    def _at(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        return at, np.flatnonzero(at < 0)

    def ids(self, words: pa.StringArray) -> Ids:
        """words: distinct."""
        at, new = self._at(words)
        if len(new):
            if len(self.words) + len(new) > self.most:
                self._forget()
                at, new = self._at(words)
            missed = words.take(pa.array(new))
            ids, size = self.learn(_strings(missed))
            at[new] = np.arange(len(self.words), len(self.words) + len(new))
            self.words = pa.concat_arrays([self.words, missed])
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
            self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, ids])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
        self.met[at] += 1
        return _gathered(self.pool, self.start[at], self.size[at]), self.size[at]


class WordCodec:
    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))
        #: The library's merges alone, for runs of letters or marks that are lower-cased and mapped to the byte alphabet.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.cores, self.marks, self.others = Held(CACHE_CORES, self._merged), Held(CACHE_WORDS, self._merged), Held(CACHE_WORDS, self._whole)

    def _merged(self, runs: list[str]) -> Ids:
        """Of runs of letters or marks; the empty one has none."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(runs), 5000):
            some = runs[i : i + 5000]
            joined = " ".join([w if w.isascii() else w.translate(_BYTES) for w in some])
            ids.append(np.array(self.merges.encode(joined, add_special_tokens=False).ids, np.uint32))
            ends = np.flatnonzero(self.last[ids[-1]]) + 1
            full = np.fromiter(map(bool, some), bool, len(some))
            assert len(ends) == full.sum() and (not len(ends) or ends[-1] == len(ids[-1]))
            size = np.zeros(len(some), np.int64)
            size[full] = np.diff(ends, prepend=0)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _whole(self, words: list[str]) -> Ids:
        found = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _distinct(self, words: pa.StringArray) -> Ids:
        """Of distinct words."""
        core = pc.utf8_rtrim(words, _MARKS)
        plain = pc.match_substring_regex(core, _ONLY_LETTERS)
        cores = pc.utf8_lower(core.filter(plain)).dictionary_encode()
        marks = pc.utf8_ltrim(words.filter(plain), _LETTERS).dictionary_encode()
        # Each word is two spans of one pool: of the cores, of the marks (or nothing) and of the others.
        spans = np.zeros((2, 2, len(words)), np.int64)  # start and size by first and second
        is_plain = plain.to_numpy(zero_copy_only=False)
        pools, used = [], 0
        for held, strings, numbers, place, where in (
            (self.cores, cores.dictionary, cores.indices, 0, is_plain),
            (self.marks, marks.dictionary, marks.indices, 1, is_plain),
            (self.others, words.filter(pc.invert(plain)), None, 0, ~is_plain),
        ):
            ids, size = held.ids(strings)
            start = used + np.cumsum(size) - size
            numbers = np.arange(len(size)) if numbers is None else numbers.to_numpy()
            spans[0, place, where], spans[1, place, where] = start[numbers], size[numbers]
            pools.append(ids)
            used += len(ids)
        start, size = (spans[k].T.ravel() for k in (0, 1))
        return _gathered(np.concatenate(pools), start, size), spans[1].sum(axis=0)

    def _slice(self, texts: pa.StringArray) -> Ids:
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
        parts = []
        for i in range(0, max(1, len(words)), STEP):
            coded = words.slice(i, STEP).dictionary_encode()
            ids, size = self._distinct(coded.dictionary)
            at = coded.indices.to_numpy()
            start, size = (np.cumsum(size) - size)[at], size[at]
            parts.append((_gathered(ids, start, size), size))
        flat, size = (np.concatenate([p[k] for p in parts]) if len(parts) > 1 else parts[0][k] for k in (0, 1))
        after = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]
        return flat, np.diff(after)

    def slices(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids flat, ids of each row) for slices of the texts in order; end_id, if given, ends each text's."""
        chars = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = int(chars[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(chars, done + SLICE_CHARS, "right")))
            flat, size = self._slice(texts.slice(at, to - at))
            if end_id is not None:
                size = size + 1
                own = np.ones(len(flat) + len(size), bool)
                own[np.cumsum(size) - 1] = False
                out = np.full(len(own), end_id, np.uint32)
                out[own] = flat
                flat = out
            yield at, flat, size
            at = to

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """One array of uint32 ids for each text; None counts as empty."""
        for _, flat, size in self.slices(pa.array(list(texts), pa.string())):
            yield from np.split(flat, np.cumsum(size)[:-1])


_codecs: dict[str, WordCodec] = {}


def codec(name: str = TOKENIZER) -> WordCodec:
    """This worker's codec; it lives as long as the worker does."""
    if name not in _codecs:
        _codecs[name] = WordCodec(name)
    return _codecs[name]
