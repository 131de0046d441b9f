"""Language of documents, chunks and lines by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. A line is parsed greedily into the longest
phrases that occur in a language's text (Ziv and Merhav); with n letters, c phrases and N letters of labelled
text, c * log2(N) / n bits a letter estimate the cross entropy, and the language that needs least wins. The
labels are noisy, so the automata are built twice: from all sampled lines, and again from
those whose label the first ones confirm.

The sample is bounded (:data:`CHUNKS`, :data:`LETTERS` a language), so the automata are of
bounded size; everything else reads all rows. Parsing is one narrow map in which all lines of a batch advance through
all automata together, a letter at a time.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The languages, and three-letter codes that mean them.
LANGUAGES = ("ko", "en", "ja", "zh", "de", "fr", "es")
THREE = {"kor": "ko", "eng": "en", "jpn": "ja", "zho": "zh", "chi": "zh", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es"}
#: Bound of the labelled sample: chunks a label, code points a chunk, letters a language.
CHUNKS, CHUNK_CHARS, LETTERS = 200, 4000, 40_000
#: Letters that advance together as one piece; a line on which two languages are this close goes with its text.
PIECE, CLOSE = 400, 0.12
#: Rounds of cleaning the sample's labels, and the lead under which a sampled line is left out.
CLEANINGS, PARTS, SURE = 3, 4, 0.03
LITERAL = 12.0
#: Added to N, so that a language with very little labelled text isn't favoured by a small N.
FLOOR = 10_000

_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\ufe00-\ufe0f]")
_CODE = re.compile(r"[A-Za-z_./+-]*\d[\w./+-]*", re.ASCII)
_WORD = re.compile(r"[가-힣぀-ヿ㐀-鿿]|[^\W\d_]{3,}")
_NOT_LETTERS = re.compile(r"[^\w'’]+|[\d_]+")


def clean_label(label: Column) -> Column:
    """A stored label as one of the languages or ``mixed``; null if it is missing, unknown or unreadable."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^\s*([a-z]{2,5})(?:[-_][a-z0-9]+)*\s*$", 1)
    names = F.create_map(*(F.lit(x) for pair in (*((c, c) for c in (*LANGUAGES, "mixed")), *THREE.items()) for x in pair))
    return F.try_element_at(names, base)


def letters(line: str) -> str:
    """What of a line is parsed: composed words in lower case, without numbers, codes and signs; empty if it has no word."""
    if not line.isascii():
        line = _HIDDEN.sub("", unicodedata.normalize("NFKC", line))
    line = _CODE.sub(" ", line)
    if not _WORD.search(line):
        return ""
    return _NOT_LETTERS.sub(" ", line).strip().lower()


class Automata:
    """Suffix automata of several texts in one numbering, with a hash table of transitions."""

    def __init__(self, texts: dict[str, str]):
        self.names = [k for k in LANGUAGES if texts.get(k)]
        alphabet = sorted(set("".join(texts[k] for k in self.names)))
        self.size = max(1, len(alphabet))
        self.place = np.full(0x110000 if alphabet and ord(alphabet[-1]) > 0xFFFF else 0x10000, -1, dtype=np.int32)
        for i, c in enumerate(alphabet):
            self.place[ord(c)] = i
        self.bits = np.log2(np.array([FLOOR + len(texts[k]) for k in self.names]))
        froms, tos, roots, base = [], [], [], 0
        for k in self.names:
            steps = _suffix_automaton([int(self.place[ord(c)]) for c in texts[k]])
            roots.append(base)
            for s, step in enumerate(steps):
                for a, t in step.items():
                    froms.append((base + s) * self.size + a)
                    tos.append(base + t)
            base += len(steps)
        self.roots = np.array(roots, dtype=np.int64)
        keys, values = np.array(froms, dtype=np.int64), np.array(tos, dtype=np.int32)
        self.shift = 64 - max(4, (len(keys) * 3).bit_length())
        slots = 1 << (64 - self.shift)
        self.keys, self.values = np.full(slots, -1, dtype=np.int64), np.zeros(slots, dtype=np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == -1)
            spot, first = np.unique(at[free], return_index=True)
            self.keys[spot], self.values[spot] = keys[free[first]], values[free[first]]
            rest = np.ones(len(keys), dtype=bool)
            rest[free[first]] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (slots - 1)
        self.first = np.full((self.size + 1, len(self.names)), -1, dtype=np.int32)  # steps from the roots; the last row is for unknown letters
        every = np.arange(self.size)
        for i, r in enumerate(self.roots):
            self.first[:-1, i] = self._step(r * self.size + every)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """Where each state goes; -1 if nowhere."""
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], np.int32(-1))
        go = np.nonzero((seen != keys) & (seen != -1))
        while len(go[0]):
            at[go] = (at[go] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[go]]
            hit = seen == keys[go]
            out[tuple(x[hit] for x in go)] = self.values[at[go][hit]]
            more = ~hit & (seen != -1)
            go = tuple(x[more] for x in go)
        return out

    def bits_per_letter(self, lines: list[str]) -> np.ndarray:
        """(lines, languages): estimated cross entropy of each line; lines must not be empty."""
        pieces = [(i, line[s : s + PIECE]) for i, line in enumerate(lines) for s in range(0, len(line), PIECE)]
        order = sorted(range(len(pieces)), key=lambda p: -len(pieces[p][1]))
        owner = np.array([pieces[p][0] for p in order])
        size = np.array([len(pieces[p][1]) for p in order])
        code = np.frombuffer("".join(pieces[p][1] for p in order).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        flat = np.where(code < len(self.place), self.place[np.minimum(code, len(self.place) - 1)], -1)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        state = np.repeat(self.roots[None, :], len(order), 0)
        phrases, strange = np.zeros(state.shape, dtype=np.int64), np.zeros(state.shape, dtype=np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -t, side="left"))  # pieces longer than t
            a = flat[start[:k] + t]
            now = state[:k]
            known = a >= 0
            step = self._step(np.where(known, a, 0)[:, None] + now * self.size)
            step[~known] = -1
            lost = step < 0
            phrases[:k] += lost & (now != self.roots)
            again = self.first[a]
            none = lost & (again < 0)
            phrases[:k] += none
            strange[:k] += none
            state[:k] = np.where(none, self.roots, np.where(lost, again, step))
        phrases += state != self.roots
        total = np.zeros((len(lines), len(self.names)))
        np.add.at(total, owner, phrases * self.bits + strange * LITERAL)
        return total / np.array([len(x) for x in lines])[:, None]

    def judge(self, lines: list[str], ready: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language of each line (-1 without words), its lead over the next (0 to 1), and all estimates."""
        text = lines if ready else [letters(x) for x in lines]
        distinct = list(dict.fromkeys(t for t in text if t))
        at = {t: i for i, t in enumerate(distinct)}
        if not distinct or not self.names:
            return np.full(len(lines), -1), np.zeros(len(lines)), np.zeros((len(lines), len(self.names)))
        bits = self.bits_per_letter(distinct)
        ranked = np.sort(bits, axis=1)
        lead = 1 - ranked[:, 0] / ranked[:, 1] if bits.shape[1] > 1 else np.ones(len(bits))
        row = np.array([at.get(t, -1) for t in text])
        none = row < 0
        return np.where(none, -1, bits.argmin(1)[row]), np.where(none, 0.0, lead[row]), np.where(none[:, None], 0.0, bits[row])


def _suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for a in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and a not in step[p]:
            step[p][a] = new
            p = link[p]
        if p >= 0:
            q = step[p][a]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(a) == q:
                    step[p][a] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def _fill(lines: list[tuple[str, str]], most: int = LETTERS) -> dict[str, str]:
    """Up to ``most`` letters of each language, distinct lines in the order given."""
    held: dict[str, dict[str, None]] = {k: {} for k in LANGUAGES}
    size: Counter[str] = Counter()
    for lang, text in lines:
        if lang in held and text and text not in held[lang] and size[lang] < most:
            held[lang][text] = None
            size[lang] += len(text) + 1
    return {k: "\n".join(v) for k, v in held.items()}


def train(labelled: DataFrame, key: str, text: str, label: str) -> Automata:
    """Automata from a bounded sample of (key, text, label): at most :data:`CHUNKS` rows of each clean label.

    The sample goes by the hash of the key, so it is the same for the same data. A language without labelled text has no automaton.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64(key), key)
    sample = (
        labelled.select(key, F.substring(text, 1, CHUNK_CHARS).alias("part"), clean_label(F.col(label)).alias("lang"))
        .where(F.col("lang").isin(*LANGUAGES) & (F.length("part") > 0))
        .withColumn("at", F.row_number().over(order))
        .where(F.col("at") <= CHUNKS)
        .collect()
    )
    rows = sorted(sample, key=lambda r: (r["at"], r["lang"]))
    texts = [(r["lang"], [x for line in r["part"].split("\n") if len(x := letters(line)) > 1]) for r in rows]
    return Automata(_fill(_cleaned([t for t in texts if t[1]])))


def _cleaned(texts: list[tuple[str, list[str]]]) -> list[tuple[str, str]]:
    """Lines with the language of their text as found; lines that speak another one are left out.

    A text and its copies are in one part, so none is judged by itself.
    """
    part = [zlib.crc32("\n".join(lines).encode("utf-8", "surrogatepass")) % PARTS for _, lines in texts]
    kept = [[(label, x) for x in lines] for label, lines in texts]
    for _ in range(CLEANINGS):
        new = list(kept)
        for p in range(PARTS):
            model = Automata(_fill([x for k, t in zip(part, kept) if k != p for x in t], LETTERS // 3))
            mine = [i for i, k in enumerate(part) if k == p]
            lines = [x for i in mine for x in texts[i][1]]
            best, lead, bits = model.judge(lines, True)
            bits = bits * np.array([len(x) for x in lines])[:, None] if lines else bits
            at = 0
            for i in mine:
                own = slice(at, at + len(texts[i][1]))
                at = own.stop
                top = int(bits[own].sum(0).argmin()) if model.names else -1
                new[i] = [(model.names[top], x) for x, b, m in zip(texts[i][1], best[own], lead[own]) if b == top and m >= SURE]
        kept = new
    return [x for t in kept for x in t]


def judge_texts(model: Automata, texts: list[str | None]) -> list[tuple[str | None, float, list[tuple[int, str, float]]]]:
    """Of each text: the language of most of its lines, the share of lines that agree weighted by their lead, and its lines (number, language, lead) in another language."""
    lines, owner, number = [], [], []
    for i, t in enumerate(texts):
        for n, x in enumerate((t or "").split("\n"), 1):
            lines.append(x)
            owner.append(i)
            number.append(n)
    best, lead, bits = model.judge(lines)
    by: list[list[int]] = [[] for _ in texts]
    for j in np.flatnonzero(best >= 0):
        by[owner[j]].append(int(j))
    out = []
    for mine in by:
        if not mine:
            out.append((None, 0.0, []))
            continue
        votes: Counter[int] = Counter()
        weight: Counter[int] = Counter()
        for j in mine:
            votes[best[j]] += 1
            weight[best[j]] += lead[j]
        top = max(votes, key=lambda k: (votes[k], weight[k], -k))
        others = [
            (number[j], model.names[best[j]], float(lead[j]))
            for j in mine
            if best[j] != top and bits[j, best[j]] < (1 - CLOSE) * bits[j, top]
        ]
        out.append((model.names[top], 1 - len(others) / len(mine), others))
    return out


def detect(df: DataFrame, keys: list[str], text: str, model: Automata) -> DataFrame:
    """Keys, lang, confidence and others (array of line_no, lang, confidence) of each row's text.

    lang is null for a null or empty text and one without words; its confidence is then 0. Repeated rows are kept.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", lang string, confidence double, others array<struct<line_no: int, lang: string, confidence: double>>"
    other = pa.list_(pa.struct([("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                found = judge_texts(automata, b.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(k) for k in keys),
                        pa.array([x[0] for x in found], type=pa.string()),
                        pa.array([x[1] for x in found], type=pa.float64()),
                        pa.array([[dict(zip(("line_no", "lang", "confidence"), o)) for o in x[2]] for x in found], type=other),
                    ],
                    names=[*keys, "lang", "confidence", "others"],
                )

    return df.select(*keys, df[text].alias("__text")).mapInArrow(run, schema)


def mixed_or_top(counts: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """(key, lang, confidence) from (key, lang, n): the commonest language of a key, or ``mixed`` if another has at least ``share``.

    Languages with equal counts go by name.
    """
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("n", "lang"))))  # a key has as many entries as there are languages
    return counts.groupBy(key).agg(ranked.alias("r"), F.sum("n").alias("all")).select(
        key,
        F.when((F.size("r") > 1) & (F.try_element_at("r", F.lit(2))["n"] >= share * F.col("all")), "mixed").otherwise(F.col("r")[0]["lang"]).alias("lang"),
        (F.col("r")[0]["n"] / F.col("all")).alias("confidence"),
    )
