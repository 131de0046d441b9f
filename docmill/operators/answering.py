"""Evidence for answers: budgets, quotes, grounding, gates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from docmill.functions.text import strip_spaces


def budget_prefix(hits: DataFrame, size: Column, budget: int) -> DataFrame:
    """Ranked hits (query_id, rank) up to the first that would exceed the budget."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(size).over(order)).where(F.col("used") <= budget)


def budget_skip(hits: DataFrame, size: Column, budget: int) -> DataFrame:
    """Ranked hits in order, each taken if it still fits; empty ones never. Adds ``used`` and the block number ``n``.

    A query has as many hits as its legs give, so the fold is over a short array.
    """
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", size.cast("long").alias("size")))).alias("h"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:int,used:bigint,n:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fits = (x["size"] > 0) & (a["used"] + x["size"] <= budget)
        used = a["used"] + x["size"]
        return F.when(
            fits,
            F.struct(used.alias("used"), F.array_append(a["out"], F.struct(x["rank"].alias("rank"), used.alias("used"), (F.size(a["out"]) + 1).alias("n"))).alias("out")),
        ).otherwise(a)

    taken = listed.select("query_id", F.inline(F.aggregate("h", start, step, lambda a: a["out"])))
    return hits.join(taken, ["query_id", "rank"])


#: Characters that an embedder is not shown.
HIDDEN = dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0xFEFF])


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """The compatibility form (NFKC), for which Spark has no function; null stays null, ASCII as it is."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def normalized(texts: pd.Series) -> pd.Series:
    """Compatibility-normalized, without invisible characters, white space single: what an embedder is given."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(HIDDEN).split()))


def forms(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with the compatibility form of a column, made once for each distinct text and joined by it."""
    once = rows.select(text).where(F.col(text).isNotNull()).distinct().withColumn(out, compatible(F.col(text)))
    return rows.join(once, text, "left")


def quote_found(quote: Column, body: Column) -> Column:
    """Whether a quote is in a body, both in compatibility form and spaces aside.

    Under six characters (or the body's length, if that is less) it must have a letter and be a whole line. Null or empty: false.
    """
    bare, whole = strip_spaces(F.coalesce(quote, F.lit(""))), strip_spaces(F.coalesce(body, F.lit("")))
    line = F.exists(F.split(F.coalesce(body, F.lit("")), r"\R|[\x0b\x0c\x1c-\x1e]"), lambda x: strip_spaces(x) == bare)
    short = F.length(bare) < F.least(F.lit(6), F.length(whole))
    return (bare != "") & F.contains(whole, bare) & (~short | (bare.rlike(r"\p{L}") & line))


def grounded_terms(rows: DataFrame, key: str, body: str, *lists: str) -> DataFrame:
    """Rows with each array column cut to the entries that the body holds, both in compatibility form and spaces aside. Null arrays stay null; null bodies hold nothing.

    Bodies and entries are normalized once for each distinct text. ``key`` names the rows; repeated ones must be given once.
    """
    whole = forms(rows.select(key, body), body, "__form").select(key, strip_spaces(F.coalesce("__form", F.lit(""))).alias("__whole"))
    out = rows
    for c in lists:
        each = rows.where(F.col(c).isNotNull()).select(key, F.posexplode(c).alias("__at", "__term"))
        kept = (
            forms(each, "__term", "__form").join(whole, key)
            .withColumn("__bare", strip_spaces(F.col("__form")))
            .where((F.col("__bare") != "") & F.contains(F.col("__whole"), F.col("__bare")))
            .groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__term"))), lambda x: x["__term"]).alias("__kept"))  # one row's list
        )
        out = out.join(kept, key, "left").withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce("__kept", F.array().cast("array<string>")))).drop("__kept")
    return out.select(*rows.columns)
