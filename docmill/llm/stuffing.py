"""Keyword-stuffed pages and link lists.

Texts are cut into segments (lines, long ones in parts). Within a text two lag windows are compared: every letter with
those 2 to some dozens of letters before it (positional autocorrelation of letter groups), and every term
with the ten before it (recurrence gaps). Beyond these windows, at any distance in the text, terms and groups of letters
of scripts without spaces count that come back at even gaps (a long list pasted again and again). A segment whose letters mostly recur at such short gaps is
unnaturally regular. From all texts follow the promotion terms: those that stand in regular segments nearly always.
A segment that is a list of nouns with such terms and without the words of sentences is stuffed as well, and so
are links. A text of which more than half is stuffed is found.

All of it is numpy over whole batches: one narrow map measures the texts and writes segments and terms; from these come the counts of
terms, the only thing that is shuffled, and the shares.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.sources.tables import materialize

Batches = Iterator[pa.RecordBatch]

#: Letters that are compared, groups of letters and terms that count as recurring, for scripts without and with spaces.
WIDE, WIDE_LAGS, NARROW, NARROW_LAGS, TERM_LAGS = 3, 20, 5, 40, 10
#: Pairs of letters of scripts without spaces count at the shortest gaps.
PAIR_LAGS = 8
#: Gaps between equal terms or groups at any distance are even if there are so many and their deviation is at most this share of their mean.
EVEN_GAPS, EVEN_SPREAD = 4, 0.5
#: Length of a segment at most; share of recurring letters of a regular one; share of the text that makes a case.
SEGMENT, REGULAR, CASE = 240, 0.40, 0.5
#: A promotion term stands in regular segments this often, in so many texts at least, and in this share of the texts that have any.
PROMO, PROMO_TEXTS, PROMO_SHARE = 0.8, 5, 0.0007
#: Terms of a list that are promotion, at least, and words of sentences, at most; a word stands outside regular segments in this share of the texts that have such.
LIST_PROMO, LIST_WORDS, WORD_SHARE = 0.12, 0.12, 0.0195
#: Letters handled at once.
CHUNK = 1 << 21

LINK = re.compile(
    r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*", re.IGNORECASE | re.DOTALL
)


@cache
def _alpha() -> np.ndarray:
    """Which code points of the basic plane are letters or their marks."""
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x10000)])


def _near(x: np.ndarray, text: np.ndarray, group: int, lags: int) -> np.ndarray:
    """Which places belong to a group of equal values that recurs within so many places of the same text."""
    hit = np.zeros(len(x), dtype=bool)
    for lag in range(2, lags + 1):
        if lag + group > len(x):
            break
        e = (x[lag:] == x[:-lag]) & (text[lag:] == text[:-lag])
        for k in range(1, group):
            e = e[: len(e) - 1] & ((x[lag + k :] == x[: -lag - k]) & (text[lag + k :] == text[: -lag - k]))[: len(e) - 1]
        at = np.flatnonzero(e)
        for k in range(group):
            hit[at + k] = True
            hit[at + lag + k] = True
    return hit


def _even(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which places hold a value that recurs in its text at even gaps, however wide."""
    key = x.view(np.uint64) ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    first = np.ones(len(x), dtype=bool)
    first[1:] = np.diff(key[order]) != 0
    head = np.flatnonzero(first)
    count = np.diff(np.append(head, len(x)))
    gap = np.zeros(len(x))
    gap[1:] = np.diff(order)
    gap[head] = 0
    total, square = (np.add.reduceat(g, head) if len(head) else g for g in (gap, gap * gap))
    n = np.maximum(count - 1, 1)
    even = (count > EVEN_GAPS) & (square / n - (total / n) ** 2 <= (EVEN_SPREAD * total / n) ** 2)
    hit = np.zeros(len(x), dtype=bool)
    hit[order] = np.repeat(even, count)
    return hit


class Page:
    """The measures of a batch of texts; arrays by segment unless said otherwise."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        size = np.array([len(t) for t in low], dtype=np.int64)
        code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(code)
        text = np.repeat(np.arange(len(texts)), size)
        start = np.cumsum(size) - size
        link = np.zeros(n, dtype=bool)
        for i, t in enumerate(low):
            if "." in t or "<a" in t or "](" in t:
                for m in LINK.finditer(t):
                    link[start[i] + m.start() : start[i] + m.end()] = True
        # segments
        first = np.zeros(n, dtype=bool)
        first[start[size > 0]] = True
        first[1:] |= (code[:-1] == 10)
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        first |= (np.arange(n) - begin) % SEGMENT == 0
        seg = np.cumsum(first) - 1
        self.count = int(seg[-1]) + 1 if n else 0
        self.text = text[first]
        visible = (code > 32) & (code != 0xA0) & (code != 0x3000)
        self.visible = np.bincount(seg, weights=visible, minlength=self.count)
        self.link = np.bincount(seg, weights=visible & link, minlength=self.count)
        # letters
        letter = _alpha()[np.minimum(code, 0xFFFF)] & ~link
        at = np.flatnonzero(letter)
        x, xt, xs = code[at], text[at], seg[at]
        hit = np.zeros(len(x), dtype=bool)
        for wide, group, lags in ((True, WIDE, WIDE_LAGS), (True, 2, PAIR_LAGS), (False, NARROW, NARROW_LAGS)):
            own = np.flatnonzero((x >= 0x1100) == wide)
            hit[own[_near(x[own], xt[own], group, lags)]] = True
        own = np.flatnonzero(x >= 0x1100)
        if len(own) >= WIDE:
            y = x[own].astype(np.uint64)
            groups = (y[:-2] << np.uint64(42)) | (y[1:-1] << np.uint64(21)) | y[2:]
            at_even = np.flatnonzero(_even(groups, xt[own][:-2]) & (xt[own][2:] == xt[own][:-2]))
            for k in range(WIDE):
                hit[own[at_even + k]] = True
        # terms: runs of letters; their hash is a sum over the run
        new = np.ones(len(at), dtype=bool)
        new[1:] = np.diff(at) != 1
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(at)))
        place = np.arange(len(at)) - np.repeat(head, length)
        # parts of codes and amounts (KP-4185, 30mm) are no terms
        digit = np.concatenate([(code >= 48) & (code <= 57), [False] * 3])
        after = at[head + length - 1] + 1 if len(head) else head
        dash = np.concatenate([code == 45, [False] * 3])
        plain = ~(digit[after] | (dash[after] & digit[after + 1]) | digit[at[head] - 1])
        part = (x.astype(np.uint64) + np.uint64(7)) * (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        self.term = np.add.reduceat(part, head).view(np.int64) if len(head) else np.zeros(0, dtype=np.int64)
        self.term, self.term_seg, self.term_text = self.term[plain], xs[head][plain], xt[head][plain]
        long = length[plain] >= 2
        again = np.zeros(len(self.term), dtype=bool)
        for lag in range(1, TERM_LAGS + 1):
            if lag >= len(self.term):
                break
            e = (self.term[lag:] == self.term[:-lag]) & (self.term_text[lag:] == self.term_text[:-lag]) & long[lag:]
            again[lag:] |= e
            again[:-lag] |= e
        again |= _even(self.term, self.term_text) & long
        spread = np.zeros(len(head), dtype=bool)
        spread[plain] = again
        hit |= np.repeat(spread, length)
        letters = np.bincount(xs, minlength=self.count)
        self.regular = (np.bincount(xs, weights=hit, minlength=self.count) >= REGULAR * letters) & (letters >= 6)
        self.letters = letters


def _pages(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    texts = [t or "" for t in batch.column("__text").to_pylist()]
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHUNK:
            yield batch.slice(start, i - start), texts[start:i]
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def measured(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, visible, link, regular, terms, segs): of every text the visible characters, link characters and regularity of its segments, and its terms with their segments."""
    schema = f"`{key}` {dict(df.dtypes)[key]}, visible array<int>, link array<int>, regular array<boolean>, terms array<long>, segs array<int>"

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for part, texts in _pages(whole):
                p = Page(texts)
                n = len(texts)
                segments, terms = (np.bincount(x, minlength=n) if p.count else np.zeros(n, dtype=np.int64) for x in (p.text, p.term_text))
                by_segment, by_term = (pa.array(np.append(0, np.cumsum(x)).astype(np.int32)) for x in (segments, terms))
                own = p.term_seg - (np.cumsum(segments) - segments)[p.term_text]
                lists = [(by_segment, p.visible.astype(np.int32)), (by_segment, p.link.astype(np.int32)), (by_segment, p.regular), (by_term, p.term), (by_term, own.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.ListArray.from_arrays(o, pa.array(v)) for o, v in lists)], names=[key, "visible", "link", "regular", "terms", "segs"])

    return df.select(key, df[text].alias("__text")).mapInArrow(run, schema)


def _flat(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in names]


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of measured texts: the text of each segment, and the text and segment of each term."""
    segments, terms = (np.diff(batch.column(c).offsets.to_numpy()) for c in ("visible", "terms"))
    texts = np.arange(batch.num_rows)
    of = np.repeat(texts, terms)
    return np.repeat(texts, segments), of, (np.cumsum(segments) - segments)[of] + _flat(batch, "segs")[0]


def term_counts(pages: DataFrame) -> DataFrame:
    """(term, inside, outside, texts_in, texts_out): places of every term in regular segments and elsewhere, over all measured texts."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            terms, regular = _flat(b, "terms", "regular")
            if not len(terms):
                continue
            _, text, segment = _places(b)
            term, at = np.unique(terms, return_inverse=True)
            inside = regular.astype(bool)[segment]
            texts_of = []
            for side in (inside, ~inside):
                pairs = np.unique(at[side].astype(np.int64) * b.num_rows + text[side])
                texts_of.append(np.bincount(pairs // b.num_rows, minlength=len(term)))
            n_in = np.bincount(at, weights=inside, minlength=len(term)).astype(np.int64)
            n = np.bincount(at, minlength=len(term))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (term, n_in, n - n_in, *texts_of)], names=["term", "inside", "outside", "texts_in", "texts_out"]
            )

    names = ("inside", "outside", "texts_in", "texts_out")
    mapped = pages.select("visible", "regular", "terms", "segs").mapInArrow(run, "term long, " + ", ".join(f"{n} long" for n in names))
    return mapped.groupBy("term").agg(*(F.sum(n).alias(n) for n in names))


def word_lists(pages: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of promotion terms and of words of sentences.

    Both must stand in a share of the texts, so what reaches the driver is bounded by the terms of a text over that share, however large the corpus.
    """
    texts = pages.agg(F.count_if(F.exists("regular", lambda r: r)).alias("regular"), F.count_if(F.exists("regular", lambda r: ~r)).alias("plain")).first()
    both = F.col("inside") + F.col("outside")
    promo = (F.col("inside") >= PROMO * both) & (F.col("texts_in") >= max(PROMO_TEXTS, PROMO_SHARE * texts["regular"]))
    word = (F.col("texts_out") >= max(PROMO_TEXTS, WORD_SHARE * texts["plain"])) & (F.col("inside") < 0.3 * both)
    rows = term_counts(pages).select("term", promo.alias("promo"), word.alias("word")).where("promo or word").collect()
    return tuple(np.sort(np.array([r["term"] for r in rows if r[kind]], dtype=np.int64)) for kind in ("promo", "word"))


def stuffed_share(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, share): how much of each text is keywords, links or tags, from 0 to 1.

    A null, empty or blank text has share 0. Repeated rows are kept; other columns are ignored. Texts are measured once, into a written table.
    """
    pages = materialize(measured(df, key, text), "pages")
    promo, words = word_lists(pages)

    def run(batches: Batches) -> Batches:
        for b in batches:
            visible, link, regular, terms = _flat(b, "visible", "link", "regular", "terms")
            of_segment, _, segment = _places(b)
            n = len(visible)
            count, has_promo, has_words = (np.bincount(segment, weights=w, minlength=n) for w in (None, np.isin(terms, promo), np.isin(terms, words)))
            lists = (has_promo >= LIST_PROMO * count) & (has_words <= LIST_WORDS * count) & (count >= 2)
            part = np.where(regular.astype(bool) | lists | (link >= 0.6 * visible), visible, link)
            total, stuffed = (np.bincount(of_segment, weights=w, minlength=b.num_rows) for w in (visible, part))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(stuffed / np.maximum(total, 1))], names=[key, "share"])

    return pages.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, share double")
