"""Splitting oversized texts at natural boundaries.

A text is consumed by one regular expression with bounded quantifiers. Its
alternatives are ordered by the strength of the boundary at which they stop and
each takes as much as fits; the last ones fall back to single characters. The
overlap is a look-back: a piece starts that many characters before the end of
the piece ahead of it. Everything is SQL string and array functions, so a row
never leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import token_count

#: Marks that end a sentence, and marks that may close it.
SENTENCE_END = ".!?。！？…"
CLOSERS = "\"'”’)\\]」』"


def boundary_pattern(limit: int) -> str:
    """The expression that consumes up to ``limit`` code points per match.

    Order of the alternatives: the whole rest; then, if at least half of the limit
    is used, a blank line, a line end, a sentence end; then a line or a
    sentence end anywhere, white space, a place not ahead of a combining mark,
    any character.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    half = max(1, limit // 2)
    line = r"(?:(?<=\n)|(?<=\r)(?!\n))"
    blank = r"(?<=\n[ \t\r]{0,9}\n)"
    sentence = f"(?:(?<=[{SENTENCE_END}][{CLOSERS}]{{0,2}}\\s)|(?<=[。！？]))"
    steps = [
        (1, r"\z"),
        (half, blank),
        (half, line),
        (half, sentence),
        (1, line),
        (1, sentence),
        (1, r"(?<=\s)"),
        (1, r"(?!\p{M})"),
        (1, ""),
    ]
    return "(?s)" + "|".join(f".{{{least},{limit}}}{stop}" for least, stop in steps)


def split_column(text: Column, limit: int, overlap: int = 0) -> Column:
    """Array of struct(piece, shared): the ordered pieces of a text, each within ``limit``.

    ``shared`` says how many code points at the start of a piece repeat the end of
    the ones ahead of it (0 for the first). Dropping them and joining the pieces
    gives the text back. A text within the limit is one piece; an empty text is one
    empty piece; null gives null.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    fresh = F.regexp_extract_all(text, F.lit(boundary_pattern(limit - overlap)), F.lit(0))

    def piece(own: Column, i: Column) -> Column:
        if not overlap:
            return F.struct(own.alias("piece"), F.lit(0).alias("shared"))
        # Two pieces in a row are never both short, so the last eight always hold the look-back.
        ahead = F.array_join(F.slice(fresh, F.greatest(i - 7, F.lit(1)), F.least(i, F.lit(8))), "")
        tail = F.when(i > 0, F.substring(ahead, -overlap, overlap)).otherwise("")
        return F.struct(F.concat(tail, own).alias("piece"), F.length(tail).alias("shared"))

    return F.when(
        F.length(text) <= limit, F.array(F.struct(text.alias("piece"), F.lit(0).alias("shared")))
    ).otherwise(F.transform(fresh, piece))


def split_items(
    df: DataFrame, text: str, limit: int = 1200, overlap: int = 120, max_tokens: int | None = None
) -> DataFrame:
    """Every row of ``df`` with ``__pieces``, the array that :func:`split_column` gives.

    With ``max_tokens`` a text whose pieces would hold more tokens is cut at so many
    characters instead: a token is at least one character, so no piece can exceed it.
    Rows are kept as they are, repeated or not; other columns pass through; an
    empty table gives an empty table.
    """
    col = F.col(text)
    pieces = split_column(col, limit, overlap)
    if max_tokens is not None and max_tokens < limit:
        narrow = split_column(col, max_tokens, min(overlap, max_tokens - 1))
        pieces = F.when(token_count(col) <= max_tokens, pieces).otherwise(
            F.when(F.exists(pieces, lambda p: token_count(p["piece"]) > max_tokens), narrow).otherwise(pieces)
        )
    return df.withColumn("__pieces", pieces)


def explode_pieces(split: DataFrame, *keys: str) -> DataFrame:
    """One row per piece of :func:`split_items`: keys, piece_no (from 1), n_pieces, shared, piece."""
    return split.select(*keys, F.size("__pieces").alias("n_pieces"), F.posexplode("__pieces").alias("p", "x")).select(
        *keys, (F.col("p") + 1).alias("piece_no"), "n_pieces", F.col("x.shared").alias("shared"), F.col("x.piece").alias("piece")
    )
