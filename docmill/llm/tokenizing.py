"""Byte-pair encoding of a corpus with a public rank file, in numpy matrices.

A text is cut into words by the tokenizer's pattern. The distinct new words of a batch are laid out as
matrices of byte ids, bucketed by length and padded. Each round looks all adjacent
pairs up in a hash table, merges the leftmost pair of least rank in every row, closes the gap
and lets finished rows go. Words already seen by a task come from its cache. Narrow:
a scan and a map, no shuffle; only the path of the rank file and the pattern travel to the tasks.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the pattern that splits text ahead of the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rank of a pair that merges to nothing.
NONE = np.int32(2**31 - 1)
#: Words kept by a task between batches, and the longest word (bytes) that goes through the matrices.
#: Longer ones take as many rounds as bytes, so they are merged with a heap, to the same ids.
CACHE_WORDS, LONG = 1 << 19, 2048
#: Cells of one matrix.
CELLS = 1 << 22


class Ranks:
    """A rank file: single bytes, whole tokens, and a hash table of mergeable pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.bits = max(4, int(len(pairs) * 8).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys, values = np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int32)
        slot, self.probes = self._slot(keys), 0
        while len(keys):  # each round places one key per free slot; the others step on
            self.probes += 1
            free = self.keys[slot] == -1
            place, first = np.unique(slot[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.keys[place], self.values[place] = keys[taken], values[taken]
            rest = np.ones(len(keys), dtype=bool)
            rest[taken] = False
            keys, values, slot = keys[rest], values[rest], slot[rest] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; :data:`NONE` where it merges to nothing or a side is padding (-1)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = np.full(keys.shape, NONE, dtype=np.int32)
        seen = self.keys[slot]
        hit = seen == keys
        found[hit] = self.values[slot[hit]]
        open_ = np.nonzero(~hit & (seen != -1))
        while len(open_[0]):
            at = slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            seen = self.keys[at]
            hit = seen == keys[open_]
            found[tuple(x[hit] for x in open_)] = self.values[at[hit]]
            more = ~hit & (seen != -1)
            open_ = tuple(x[more] for x in open_)
        return found

    def merge_matrix(self, ids: np.ndarray) -> np.ndarray:
        """Rows of byte ids, padded with -1 at the end, to rows of token ids."""
        out = np.full_like(ids, -1)
        rows = np.arange(len(ids))
        rank = self.look_up(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = rank.argmin(1)  # the first of equal ones: the leftmost
            best = rank[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                go = ~done
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                if not len(rows):
                    break
                width = max(2, int((ids >= 0).sum(1).max()))
                if width < ids.shape[1]:
                    ids, rank = ids[:, :width], rank[:, : width - 1]
            n, width = ids.shape
            every = np.arange(n)
            ids[every, at] = best
            column = np.arange(width)
            moved = column + (column > at[:, None])  # closes the gap behind the merged pair
            ids = np.concatenate([ids, np.full((n, 1), -1, dtype=ids.dtype)], 1)[every[:, None], moved]
            rank = np.concatenate([rank, np.full((n, 2), NONE, dtype=rank.dtype)], 1)[every[:, None], moved[:, :-1]]
            rank[every, at] = self.look_up(ids[every, at], np.concatenate([ids, np.full((n, 1), -1, dtype=ids.dtype)], 1)[every, at + 1])
            left = at > 0
            rank[every[left], at[left] - 1] = self.look_up(ids[every[left], at[left] - 1], ids[every[left], at[left]])
            rank = rank[:, : width - 1]
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """One long word: the same merges in the same order, from a heap over linked positions."""
        ids = [int(self.byte[b]) for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := self.pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word."""
        found: list = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                found[i] = np.array([whole], dtype=np.int32)
            elif len(w) > LONG:
                found[i] = np.array(self.merge_long(w), dtype=np.int32)
            else:
                buckets.setdefault(max(2, len(w) - 1).bit_length(), []).append(i)
        for bits, members in buckets.items():
            width = 1 << bits
            step = max(1, CELLS // width)
            for s in range(0, len(members), step):
                part = members[s : s + step]
                size = np.array([len(words[i]) for i in part])
                flat = np.frombuffer(b"".join(words[i] for i in part), dtype=np.uint8)
                matrix = np.full((len(part), width), -1, dtype=np.int32)
                matrix[np.arange(width) < size[:, None]] = self.byte[flat]
                merged = self.merge_matrix(matrix)
                kept = merged >= 0
                for i, row in zip(part, np.split(merged[kept], np.cumsum(kept.sum(1))[:-1])):
                    found[i] = row
        return found


@cache
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


class Encoder:
    """Encodes batches of texts; keeps the words it has seen."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.find = load_ranks(path), regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and where each text ends."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        known = len(self.index)
        number, index = [], self.index
        ends = [0]
        for t in texts:
            if t:
                number += [index.setdefault(w, len(index)) for w in self.find(t)]
            ends.append(len(number))
        new = list(index)[known:] if len(index) > known else []
        if new:
            coded = self.ranks.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
            sizes = np.array([len(c) for c in coded], dtype=np.int64)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, *coded])
        return np.array(number, dtype=np.int64), np.array(ends, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the bounds of each text in it."""
        words, ends = self._words(texts)
        size = self.sizes[words]
        sums = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.starts[words] - sums[:-1], size) + np.arange(sums[-1])
        return self.flat[place], sums[ends]

    def count(self, texts: list[str | None]) -> np.ndarray:
        words, ends = self._words(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.sizes[words])])[ends])


def _batches(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` characters at once."""
    size = np.array([len(t or "") for t in batch.column("__text").to_pylist()], dtype=np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _map(df: DataFrame, text: str, keys: list[str], out: str, kind: str, path: str, pattern: str) -> DataFrame:
    df.sparkSession.sparkContext.addFile(path)  # executors get the vocabulary with the job
    shipped = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(SparkFiles.get(shipped), pattern)
        for whole in batches:
            for batch in _batches(whole):
                texts = batch.column("__text").to_pylist()
                if kind == "array<int>":
                    ids, bounds = encoder.encode(texts)
                    column = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                else:
                    column = pa.array(encoder.count(texts))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), column], names=[*keys, out])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", `{out}` {kind}"
    return df.select(*keys, df[text].alias("__text")).mapInArrow(run, schema)


def rank_file(name: str = "byte_bpe_50k", folder: str = FOLDER) -> str:
    return f"{folder}/{name}.tiktoken"


def encode_column(df: DataFrame, text: str, keys: list[str], path: str | None = None, pattern: str = PATTERN, out: str = "ids") -> DataFrame:
    """Keys and the token ids of ``text``, without special tokens, one row per row of ``df``.

    An empty text and a null text have no ids: both give an empty list. Text that spells a special token is
    ordinary text.
    """
    return _map(df, text, keys, out, "array<int>", path or rank_file(), pattern)


def count_column(df: DataFrame, text: str, keys: list[str], path: str | None = None, pattern: str = PATTERN, out: str = "tokens") -> DataFrame:
    """Keys and the number of tokens of ``text``; 0 for an empty or null text."""
    return _map(df, text, keys, out, "long", path or rank_file(), pattern)
