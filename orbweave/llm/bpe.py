"""Byte-level BPE of a whole corpus with a public vocabulary, in batched numpy merge rounds.

Words are split by the vocabulary's pattern. The new words of a batch go into one flat array of symbols; each round looks
up the rank of every adjacent pair by binary search over sorted pair keys, finds the lowest rank of each word and merges
all its occurrences, until no pair of any word has a rank. Words already met by the task are kept with their ids.

Null and empty texts give an empty list; marker strings are ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = os.environ.get("ORBWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that splits text before the merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks a task remembers; beyond it the memory starts afresh.
CHUNKS_KEPT = 400_000
#: Marks the first chunk of a text; a lone surrogate, which no text from Spark holds.
FIRST = "\ud800"
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of a .tiktoken file as sorted pair keys, and the words met so far."""

    def __init__(self, path: str):
        import re

        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_ids = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        self.words = regex.compile(PATTERN).findall
        self.chunks = re.compile(r" (?=\S)").split
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_ids[i], NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words: flat ids and the number of each word's ids."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        n = np.array([len(x) for x in raw], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), n)
        done_sym, done_word = [], []
        while len(sym) > 1:
            rank = np.full(len(sym), NONE, np.int32)
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self._ranks(sym[same], sym[same + 1])
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.concatenate((first, [len(sym)])))
            low = np.repeat(np.minimum.reduceat(rank, first), size)
            live = low != NONE
            if not live.all():  # words without a pair left are done
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, low = sym[live], word[live], rank[live], low[live]
                if not len(sym):
                    break
            hit = rank == low
            at = np.flatnonzero(hit)
            # in a run of touching hits every second one goes: a symbol is used once, from the left
            run = np.concatenate(([True], (np.diff(at) != 1)))
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            sym = sym.copy()
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        done_sym.append(sym)
        done_word.append(word)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(raw))

    def learn(self, new: list[str]) -> None:
        """Remember the ids of new chunks, each given as it stands in the text."""
        split = [self.words(c) for c in new]
        number: dict[str, int] = {}
        k = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64)
        ids, n = self.merge(list(number))
        flat, ends = _gather(ids, np.concatenate(([0], np.cumsum(n))), k)
        upto = np.concatenate(([0], ends))[np.cumsum([len(ws) for ws in split])]
        self.starts = np.concatenate((self.starts, self.starts[-1] + upto))
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offset of each text (one more than texts).

        The pattern takes a space that stands before other than white space into the word after it, so a text may be
        cut before each such space, and equal chunks have equal ids.
        """
        if len(self.at) > CHUNKS_KEPT:
            self.forget()
        split = []
        for t in texts:
            c = self.chunks(t) if t else []
            if c:  # all but the first chunk lost their space to the cut; the first is marked instead
                c[0] = FIRST + c[0]
            split.append(c)
        seen: set[str] = set()
        for c in split:
            seen.update(c)
        new = list(seen.difference(self.at)) if len(seen) < len(self.at) else [c for c in seen if c not in self.at]
        if new:
            before = len(self.starts) - 1
            self.learn([c[1:] if c[0] == FIRST else " " + c for c in new])
            self.at.update(zip(new, range(before, before + len(new)), strict=True))
        find = self.at.__getitem__
        k = np.fromiter((x for c in split for x in map(find, c)), np.int64, sum(map(len, split)))
        flat, ends = _gather(self.flat, self.starts, k)
        return flat, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum([len(c) for c in split])))]


def _gather(flat: np.ndarray, starts: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k-th slices of flat one after another, and where each ends."""
    size = starts[k + 1] - starts[k]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(k) else 0) + np.repeat(starts[k] - ends + size, size)], ends


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of this Python worker, read once."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _pieces(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, so that a batch of very long texts needs no more memory than another."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(size) // most
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(size)]))
    return ((int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def encode_documents(docs: DataFrame, path: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for a, b in _pieces(batch.column(1)):
                flat, offsets = v.encode(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))], [id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def token_counts(docs: DataFrame, path: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens) of every document; 0 for null and empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for a, b in _pieces(batch.column(1)):
                size = np.diff(v.encode(batch.column(1).slice(a, b - a).to_pylist())[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size, pa.int64())], [id_col, "tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, tokens long")
