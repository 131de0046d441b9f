"""Text expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters for which Python's str.isspace() holds, as a regex class body.
#: Java's and RE2's \s know ASCII only, so it is spelled out for both engines.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: What counts as one token - a Hangul syllable, a Latin word, a number, a sign.
TOKEN = r"[가-힣]|[a-zA-Z]+|\p{Nd}+|[^\p{L}\p{N}_" + SPACE + "]"


def token_count(text: Column) -> Column:
    """Tokens of a text by the token rule; null stays null."""
    return F.regexp_count(text, F.lit(TOKEN))


def strip_spaces(text: Column) -> Column:
    """The text without any Unicode white space."""
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def without_spaces_lower(text: Column) -> Column:
    """Key under which running heads are compared."""
    return F.lower(strip_spaces(text))


def slugify(stem: Column) -> Column:
    """A file's name as an id: lower case, other than letters and digits to single hyphens, 60 characters at most; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9가-힣]+", "-"), "^-+|-+$", "")
    return F.when(bare != "", F.substring(bare, 1, 60))


def file_stem(name: Column) -> Column:
    """A name without its extension of up to four letters."""
    return F.regexp_replace(name, r"\.[A-Za-z]{1,4}$", "")


def undouble(text: Column, digits: bool = True) -> Column:
    """Characters that a damaged font layer printed twice, once."""
    return F.regexp_replace(text, r"([\p{L}\p{N}])\1" if digits else r"(\p{L})\1", "$1")


def char_grams(text: Column, n: int = 3) -> Column:
    """Distinct n-character pieces of a text without white space; an empty array for a shorter one, null for null."""
    # bound to a lambda variable, so that the bare text is made once and not again for every piece
    def pieces(bare: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(bare) - (n - 1)), lambda i: F.substring(bare, i, F.lit(n)))
        return F.when(F.length(bare) >= n, F.array_distinct(each)).when(bare.isNotNull(), F.array().cast("array<string>"))

    return F.transform(F.array(strip_spaces(text)), pieces)[0]


_BLANK = np.array([i for i in range(0x3001) if chr(i).isspace()], dtype=np.uint32)


def pieces_of(text: str | None) -> np.ndarray:
    """The distinct 3-character pieces of a text without white space as sorted numbers (21 bits a character, so no two pieces share one); empty for null and shorter texts."""
    if not isinstance(text, str):
        return np.empty(0, dtype=np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = c[~np.isin(c, _BLANK)].astype(np.int64)
    if len(c) < 3:
        return c[:0]
    pieces = np.sort(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
    return pieces[np.diff(pieces, prepend=-1) != 0]


def gram_overlap(query: Column, text: Column) -> Column:
    """Share of the query's pieces that the whole text has; 0 without any.

    Pieces are looked for in the text, which isn't cut into pieces itself: that takes time with the square of its length.
    """
    def share(x: Column) -> Column:
        return F.when(F.size(x["q"]) > 0, F.size(F.filter(x["q"], lambda g: F.contains(x["t"], g))) / F.size(x["q"])).otherwise(0.0)

    none = F.array().cast("array<string>")
    both = F.struct(F.coalesce(char_grams(query), none).alias("q"), F.coalesce(strip_spaces(text), F.lit("")).alias("t"))
    return F.transform(F.array(both), share)[0]


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def detect_language(text: Column) -> Column:
    """ko if there is any Hangul, else en if there is any Latin letter, else ko."""
    return F.when(text.rlike("[가-힣]"), "ko").when(text.rlike("[A-Za-z]"), "en").otherwise("ko")


def script_of(text: Column) -> Column:
    """cjk, han (Hangul), latin or other, by counts of letters."""
    han, cjk = count_of(text, "[가-힣]"), count_of(text, "[一-鿿]")
    return F.when((cjk > han) & (cjk > 3), "cjk").when(han > 0, "han").when(count_of(text, "[A-Za-z]") > 0, "latin").otherwise("other")


def source_language(text: Column) -> Column:
    """ko, en or mixed, by the ratio of Hangul to Latin letters."""
    ko, en = count_of(text, "[가-힣]"), count_of(text, "[A-Za-z]")
    return (
        F.when(ko == 0, F.when(en > 0, "en").otherwise("mixed"))
        .when((en == 0) | (ko >= en * 0.2), "ko")
        .when(en >= ko * 5, "en")
        .otherwise("mixed")
    )


CITE = r"\[cite:\s*[\d,\s]+\]"


def language_matches(text: Column, language: Column) -> Column:
    """Whether an answer is in the language asked for; Han characters never are."""
    clean = F.regexp_replace(text, CITE, "")
    ko, en = count_of(clean, "[가-힣]"), count_of(clean, "[A-Za-z]")
    fits = F.when(language == "ko", (ko >= 3) & (ko >= en * 0.2)).when(language == "en", (en >= 3) & (en >= ko)).otherwise(True)
    return fits & ~clean.rlike("[一-鿿]")


def estimated_tokens(length: Column) -> Column:
    return F.ceil(length / 1.6).cast("long")


#: Fixed value: the pattern of a question about several documents.
COMPARISON = r"비교|차이|각각|공통|서로|두\s*(?:문서|파일)|여러\s*(?:문서|파일)|compare|difference|both|each\s+(?:document|file)"


def is_comparison(question: Column) -> Column:
    """Whether a question asks about several documents."""
    return F.lower(question).rlike(COMPARISON)


#: Scripts written without spaces between all words, and the letters of the others, as classes of a regular expression in both engines.
DENSE = "가-힣぀-ヿ㐀-䶿一-鿿"
TERM = f"[{DENSE}]+|[0-9]+|[a-zß-öø-ɏͰ-Ͽа-ӿ]+"


def terms(text: Column) -> Column:
    """Search terms in order, repeated ones too: runs of digits and of letters in lower case, accents kept; of Hangul, Han and kana
    runs the overlapping pairs (a run of one as it is), so a word is met inside a compound or ahead of a particle."""

    def pairs(run: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{DENSE}]") & (F.length(run) > 1), each).otherwise(F.array(run))

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), pairs))


def phrase_frequency(wanted: Column, found: Column, slop: int = 2) -> Column:
    """How often an array of terms holds another as a phrase, within ``slop`` places: each window counts 1 / (1 + its width).

    The places of every wanted term, less its own place in the phrase, must all fall into a window that starts with one of them.
    """
    places = F.transform(wanted, lambda w, i: F.filter(F.transform(found, lambda t, p: F.when(t == w, p - i)), lambda x: x.isNotNull()))

    def widths(at: Column) -> Column:
        starts = F.array_distinct(F.flatten(at))
        far = F.transform(starts, lambda b: F.array_max(F.transform(at, lambda own: F.coalesce(F.array_min(F.filter(own, lambda x: x >= b)) - b, F.lit(slop + 1)))))
        return F.aggregate(F.filter(far, lambda x: x <= slop), F.lit(0.0), lambda a, x: a + 1.0 / (1 + x))

    return F.coalesce(F.transform(F.array(places), widths)[0], F.lit(0.0))


def normalize_citations(text: Column) -> Column:
    """[1, 2] as [cite:1, 2]."""
    return F.regexp_replace(text, r"\[(\d+(?:\s*,\s*\d+)*)\]", "[cite:$1]")


def cited_numbers(text: Column) -> Column:
    """Distinct numbers in citations, ascending."""
    marks = F.regexp_extract_all(text, F.lit(CITE), F.lit(0))
    numbers = F.flatten(F.transform(marks, lambda m: F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: n.cast("int"))))


def keep_known(text: Column, most: int) -> Column:
    """Citations with the numbers 1 to ``most`` alone; a citation without any goes. Parts between citations stay as they are."""
    parts = F.split(text, r"(?=\[cite:)|(?<=\])")

    def fixed(p: Column) -> Column:
        known = F.filter(F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0)), lambda n: F.try_to_number(n, F.lit("999999999")).between(1, most))
        return F.when(p.rlike(f"^{CITE}$"), F.when(F.size(known) > 0, F.concat(F.lit("[cite:"), F.array_join(known, ","), F.lit("]"))).otherwise("")).otherwise(p)

    return F.array_join(F.transform(parts, fixed), "")


def sentences(text: Column) -> Column:
    """Array of (n, sentence) of an answer: lines, cut after each citation that follows a sentence's end; those with a letter, numbered from 1."""
    cut = F.regexp_replace(text, rf"([.!?。][ \t]*(?:{CITE}[ \t]*)+)", "$1\n")
    shown = F.filter(F.transform(F.split(cut, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"\p{L}"))
    return F.transform(shown, lambda x, i: F.struct((i + 1).alias("n"), x.alias("sentence")))


def claims_cited(text: Column) -> Column:
    """Whether every line or sentence, as :func:`sentences` cuts them, has a citation; false for a text without any."""
    each = sentences(text)
    return (F.size(each) > 0) & F.forall(each, lambda s: s["sentence"].rlike(CITE))


def single_citation(text: Column) -> Column:
    """The text with its citations taken out and one with all their numbers, ascending, at its end; without any it stays as it is."""
    numbers = cited_numbers(text)
    bare = F.rtrim(F.regexp_replace(text, rf"[ \t]*{CITE}", ""))
    return F.when(F.size(numbers) > 0, F.concat(bare, F.lit(" [cite:"), F.array_join(numbers, ","), F.lit("]"))).otherwise(text)


def given_order(text: Column, n: Column) -> Column:
    """The numbers 1 to ``n`` in the order that the first bracketed list of a model's output gives; missing ones follow, repeated and foreign ones go."""
    first = F.regexp_extract(text, r"\[([\d,\s]*)\]", 1)
    named = F.transform(F.regexp_extract_all(first, F.lit(r"\d+"), F.lit(0)), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int"))
    known = F.coalesce(F.array_distinct(F.filter(named, lambda x: (x >= 1) & (x <= n))), F.array().cast("array<int>"))
    rest = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda x: (x <= n) & ~F.array_contains(known, x))
    return F.concat(known, rest)


def first_object(text: Column, schema: str) -> Column:
    """The first flat JSON object of a model's output as a struct; null if there is none that can be read."""
    return F.from_json(F.regexp_extract(text, r"\{[^{}]*\}", 0), schema)


def excerpt(query: Column, text: Column, lines: int = 4, around: int = 1, most: int = 600) -> Column:
    """The lines of a text that hold most terms of a query, with their neighbours and the first two lines, in order, ``most`` characters at most.

    Terms are runs of two or more Hangul, Latin letters or digits. Of equal lines the later one counts more; a line without a term never does.
    """
    asked = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[가-힣a-z0-9]{2,}"), F.lit(0)))

    def shown(x: Column) -> Column:
        scores = F.transform(x["l"], lambda line, i: F.struct(F.size(F.filter(x["q"], lambda t: F.contains(F.lower(line), t))).alias("n"), i.alias("i")))
        best = F.slice(F.reverse(F.array_sort(F.filter(scores, lambda s: s["n"] > 0))), 1, lines)
        keep = lambda i: (i < 2) | F.exists(best, lambda b: F.abs(b["i"] - i) <= around)
        kept = F.filter(F.transform(x["l"], lambda line, i: F.when(keep(i), line)), lambda line: line.isNotNull())
        return F.substring(F.array_join(kept, "\n"), 1, most)

    return F.transform(F.array(F.struct(asked.alias("q"), F.split(text, "\n").alias("l"))), shown)[0]


def ndcg(gains: Column, n_relevant: Column, k: int) -> Column:
    """Of an array of gains in rank order; the ideal is min(n_relevant, k) ones."""
    dcg = F.aggregate(
        F.transform(F.slice(gains, 1, k), lambda g, i: g / (F.log2(i + F.lit(2.0)))), F.lit(0.0), lambda a, x: a + x
    )
    most = F.least(n_relevant, F.lit(k)).cast("int")
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: 1.0 / F.log2(i + F.lit(1.0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(n_relevant > 0, dcg / ideal).otherwise(0.0)
