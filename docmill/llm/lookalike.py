"""One stored form for texts that look the same.

In order: compatibility normalization by the Unicode tables (raised, lowered, circled and fraction
digits keep their form), canonical composition, deletion of ignorable characters, one plain space for
any run of spaces; then letters, digits and signs that several parts of Unicode draw alike. For
these each token is a lattice: every place holds all members of its look-alike class. Viterbi search takes the
path that is best under the pair scores of all letters that stand beside a member, within one script, with a penalty for changing the script.
The lattice depends on the look only, so equal looks give equal strings, and members of
different classes never meet, so visible differences stay; which member is written follows from the path alone.
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

#: Classes of letters and signs that fonts draw alike, the usual member first.
CLASSES = (
    "aаɑα eе oоοօ pрρ cсϲ yу xх sѕ iіι jјϳ hһհ dԁ qԛ wԝ vνѵ uսυ nո gɡց lӏ kκ "
    "AАΑᎪꓮ BВΒᏴꓐ CСϹᏟꓚ DᎠꓓ EЕΕᎬꓰ FϜꓝ GԌᏀꓖ HНΗᎻꓧ IІΙӀ JЈᎫꓙ KКΚᏦꓗ LᏞꓡ MМΜᎷꓟ NΝꓠ OОΟՕꓳ PРΡᏢꓑ "
    "QԚ RᎡꓣ SЅՏᏚꓢ TТΤᎢꓔ UՍꓴ VѴᏙꓦ WԜᎳꓪ XХΧꓫ YΥҮꓬ ZΖᏃꓜ "
    "力カ 口ロ 夕タ 工エ 二ニ 八ハ 卜ト へヘ べベ ぺペ Δ∆ Σ∑ Π∏ "
    "-‐‑‒–−˗⁃ —―─ ·‧∙⋅・ㆍ '’‘ʼ′ \"“”″ ~∼〜 /∕⁄ *∗ |∣│ :∶ 〈⟨ 〉⟩"
).split()
#: Decompositions that change what a reader sees.
VISIBLE = ("<super>", "<sub>", "<circle>", "<fraction>")
#: Log score lost by changing the script inside a token; added to each pair's count.
SWITCH, SMOOTH = 12.0, 0.5

_CLASS_OF = {c: k for k in CLASSES for c in k}
_FOLD = str.maketrans({c: k[0] for k in CLASSES for c in k[1:]})
MEMBERS = sorted(_CLASS_OF)
_IS_MEMBER = np.zeros(0x10000, dtype=bool)
_IS_MEMBER[[ord(c) for c in MEMBERS]] = True
#: A token from its first letter that has look-alikes, or from letters of scripts that mix with them.
_FIRST = "".join(k[0] for k in CLASSES if k[0].isalpha())
_TOKEN = re.compile(rf"[Ͱ-ϿЀ-ԯ԰-֏Ꭰ-Ᏼꓐ-꓿ァ-ヺ]*[{_FIRST}][^\W_]*")
_FOLDED = re.compile("[" + re.escape("".join(c for k in CLASSES for c in k[1:])) + "]")
#: Marks, and letters that may come with an accent while having look-alikes.
_ACCENTED = re.compile("[\u0300-\u058f\u13a0-\u13ff\u1ab0-\u1aff\u1dc0-\u1fff\ua4d0-\ua4ff]")
_SPACES = re.compile(r"[^\S\n]+")
_EDGES = re.compile(r" ?\n ?")
_LINES = re.compile("\r\n?|[\x0b\x0c\x85\u2028\u2029]")
#: Ignorable characters that are not of a control or format category.
_BLANK = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
#: Texts of these characters alone are composed and have neither compatibility forms nor ignorable characters.
_PLAIN = re.compile("[ -~\\n\u00c0-\u00ff\u3001\u3002\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fff\uac00-\ud7a3]*")


def _pictograph(c: str) -> bool:
    return c >= "\U0001f000" or "☀" <= c <= "➿"


def _expand(c: str) -> str:
    """Compatibility decomposition of one character, but for what a reader would see."""
    kind, *rest = unicodedata.decomposition(c).split() or [""]
    if not kind.startswith("<") or kind in VISIBLE or "ㄱ" <= c <= "ㆎ":
        return c
    return "".join(_expand(chr(int(x, 16))) for x in rest)


class _Step(dict):
    """Translation by rule: compatibility, ignorable characters, spaces; each character is looked up once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if c == "\u200d":
            out = c  # kept for joined pictographs, deleted elsewhere
        elif c == "\n":
            out = c
        elif c.isspace() or c == "\u2800":
            out = " "
        elif kind in ("Cc", "Cf") or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef" or c in _BLANK:
            out = ""
        else:
            out = _expand(c)
        self[code] = out
        return out


_STEP = _Step()


def _join(text: str) -> str:
    """Zero-width joiners go, unless they stand between pictographs."""
    if "\u200d" not in text:
        return text
    return "".join(
        c for i, c in enumerate(text) if c != "\u200d" or (0 < i < len(text) - 1 and _pictograph(text[i - 1]) and _pictograph(text[i + 1]))
    )


def simplify(text: str) -> str:
    """All steps ahead of the lattice."""
    if not _PLAIN.fullmatch(text):
        text = _join(_LINES.sub("\n", text).translate(_STEP))
        if _ACCENTED.search(text):
            text = unicodedata.normalize("NFD", text).translate(_FOLD_SAFE)
        text = unicodedata.normalize("NFC", text)
    text = _EDGES.sub("\n", _SPACES.sub(" ", text)).strip(" \n")
    return text.translate(_FOLD) if _FOLDED.search(text) else text


#: Letters only: folded while accents are apart, so that an accented look-alike is met as well.
_FOLD_SAFE = str.maketrans({c: k[0] for k in CLASSES for c in k[1:] if k[0].isascii() and k[0].isalpha()})


@cache
def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    return name.split()[0] if c.isalpha() else ""


class Lattice:
    """Chooses the members of a token's classes. ``pairs`` maps two characters to how often they adjoin."""

    def __init__(self, pairs: dict[str, int]):
        total: dict[str, float] = {}
        for p, n in pairs.items():
            total[p[0]] = total.get(p[0], 0) + n
        self.pairs, self.total, self.known = pairs, total, {}

    def _score(self, a: str, b: str) -> float:
        x, y = _script(a), _script(b)
        if x and y and x != y and {x, y} != {"HIRAGANA", "KATAKANA-HIRAGANA"}:
            return -SWITCH
        return float(np.log((self.pairs.get(a + b, 0) + SMOOTH) / (self.total.get(a, 0) + SMOOTH * len(MEMBERS))))

    def choose(self, token: str) -> str:
        """The best path through a token whose letters are the first members of their classes."""
        found = self.known.get(token)
        if found is None:
            found = self.known[token] = self._search(token) if any(c in _CLASS_OF for c in token) else token
        return found

    def _search(self, token: str) -> str:
        best: dict[str, tuple[float, str]] = {}
        for i, c in enumerate(token):
            step = {}
            for x in _CLASS_OF.get(c, c):
                if not i:
                    step[x] = (float(np.log(self.total.get(x, 0) + SMOOTH)), x)
                else:
                    s, path = max((best[p][0] + self._score(p, x), best[p][1]) for p in best)
                    step[x] = (s, path + x)
            best = step
        return max(best.values())[1]

    def form(self, text: str) -> str:
        """The one form of a text."""
        if len(self.known) > 200_000:
            self.known.clear()
        return _TOKEN.sub(lambda m: self.choose(m[0]), simplify(text))


def pair_counts(texts: DataFrame, column: str) -> dict[str, int]:
    """How often two letters or signs adjoin of which one at least is a member of a look-alike class, over all texts.

    Counted in the tasks, once for each batch; what reaches the driver is at most the number of members times the alphabets in use, however
    large the corpus. Characters beyond the basic plane have no look-alikes and count as one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a line end between texts, so that no pair spans two
            code = np.frombuffer("\n".join(t for t in b.column(0).to_pylist() if t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            code = np.minimum(code, 0xFFFF).astype(np.int64)
            near = (_IS_MEMBER[code[:-1]] | _IS_MEMBER[code[1:]]) & (code[:-1] > 32) & (code[1:] > 32)
            pair, n = np.unique(code[:-1][near] << 16 | code[1:][near], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    rows = texts.select(column).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return {chr(r["pair"] >> 16) + chr(r["pair"] & 0xFFFF): r["n"] for r in rows}


def add_form(df: DataFrame, text: str, pairs: dict[str, int], out: str = "form") -> DataFrame:
    """``df`` with the one form of ``text``. Null gives null; a text without visible characters gives an empty one.

    Narrow; rows, repeated or not, and other columns stay as they are.
    """
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pairs)
        for b in batches:
            forms = [None if t is None else lattice.form(t) for t in b.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forms, type=pa.string())], names=[*names, out])

    return df.mapInArrow(run, schema)


def looks(formed: DataFrame, scope: str, key: str, text: str, *keep: str, form: str = "form") -> DataFrame:
    """(look, look2, stored, key, ...): hashes of each row's look within its scope and of its stored text; texts without visible characters are left out."""
    return formed.where(F.length(form) > 0).select(
        F.xxhash64(scope, form, *keep).alias("look"), F.xxhash64(F.reverse(form), F.length(form), scope, *keep).alias("look2"), F.xxhash64(text, F.length(text)).alias("stored"), F.col(key).alias("key"), *keep
    ).distinct()


def same_look(formed: DataFrame, scope: str, key: str, text: str, *keep: str) -> DataFrame:
    """Pairs (key_a, key_b) of one scope, and of equal ``keep`` columns, whose forms are equal but whose stored texts are not.

    The looks are written once. One that is stored one way alone is dropped before the join, so copies cost nothing; the join is on hashes.
    """
    rows = materialize(looks(formed, scope, key, text, *keep), "looks")
    several = rows.groupBy("look", "look2").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("look", "look2")
    rows = rows.join(several, ["look", "look2"])
    a, b = rows.withColumnRenamed("key", "key_a"), rows.select("look", "look2", F.col("stored").alias("other"), F.col("key").alias("key_b"))
    return a.join(b, ["look", "look2"]).where("stored <> other and key_a < key_b").select(*keep, "key_a", "key_b").distinct()
