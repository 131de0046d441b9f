"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import SPACE, TOKEN
from docmill.llm import language, lookalike, neardup, neighbours, packing, splitting, stuffing, tokenizing
from docmill.sources.tables import materialize, table

SECTION_LIMIT, CHUNK_LIMIT, CHUNK_TOKENS, OVERLAP = 1200, 1200, 900, 120
DIM = 48


def _split_sources(spark: SparkSession, sf_dir: str, once: bool = False) -> list[DataFrame]:
    """Sections and chunks as (kind, item_id, __pieces); repeated rows ``once`` ahead of the splitting."""
    found = []
    for kind, key, name, tokens in (
        ("section", "section_id", "sections", None),
        ("chunk", "chunk_id", "chunks", CHUNK_TOKENS),
    ):
        rows = table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).alias("item_id"), "body")
        rows = rows.dropDuplicates(["kind", "item_id"]) if once else rows
        found.append(splitting.split_items(rows, "body", SECTION_LIMIT if tokens is None else CHUNK_LIMIT, OVERLAP, tokens))
    return found


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that the splitter cuts into more than one piece."""
    a, b = (
        s.where(F.size("__pieces") > 1).select("kind", "item_id") for s in _split_sources(spark, sf_dir)
    )
    return a.unionAll(b).distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered pieces of every section and chunk, repeated rows once."""
    a, b = (
        splitting.explode_pieces(s, "kind", "item_id") for s in _split_sources(spark, sf_dir, once=True)
    )
    return a.unionAll(b)


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies to compare: of all chunks, and of the hits within each question."""
    chunks = table(spark, sf_dir, "chunks").select(
        F.lit("chunk").alias("kind"), F.lit("").alias("scope"), F.col("chunk_id").alias("item_id"), "body"
    )
    hits = table(spark, sf_dir, "hits").select(
        F.lit("hit").alias("kind"), F.col("query_id").alias("scope"), F.col("hit_id").alias("item_id"), F.col("source")["body"].alias("body")
    )
    return chunks.unionAll(hits)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks anywhere, and of hits of one question, with nearly the same body."""
    return neardup.similar_rows(_bodies(spark, sf_dir))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, links and copies of every chunk and hit that can be compared."""
    return neardup.grouped_rows(_bodies(spark, sf_dir))


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to compare by look: kind, scope, key, text. The body of a chunk is there for its quotes."""
    blocks = table(spark, sf_dir, "blocks").select(F.lit("block").alias("kind"), F.col("doc_id").alias("scope"), F.col("block_id").alias("key"), "text")
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("kind"), F.lit("").alias("scope"), F.col("chunk_id").alias("key"), "text")
    quotes = table(spark, sf_dir, "quotes").select(F.lit("quote").alias("kind"), F.col("chunk_id").alias("scope"), F.col("quote_id").alias("key"), F.col("quote").alias("text"))
    return blocks.unionAll(chunks).unionAll(quotes)


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every block, chunk and quote, repeated rows once."""
    shown = _shown(spark, sf_dir)
    pairs = lookalike.pair_counts(shown, "text")
    return lookalike.add_form(shown, "text", pairs).select("kind", "key", "form").distinct()


def p3_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block (within its document) and chunk that has a look: kind, key, and the look's id, so equal looks are a class; one row per row."""
    shown = _shown(spark, sf_dir).where("kind <> 'quote'")
    formed = lookalike.add_form(shown, "text", lookalike.pair_counts(_shown(spark, sf_dir), "text"))
    return lookalike.looks(formed, "scope", "key", "text", "kind").select("kind", "key", "look").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that look the same but are stored differently."""
    shown = _shown(spark, sf_dir)
    pairs = lookalike.pair_counts(shown, "text")
    formed = lookalike.add_form(shown.where("kind <> 'quote'"), "text", pairs)
    found = lookalike.same_look(formed, "scope", "key", "text", "kind")
    quotes = lookalike.add_form(table(spark, sf_dir, "quotes").select("quote_id", "chunk_id", "quote").distinct(), "quote", pairs).where(F.length("form") > 0)
    quoted = table(spark, sf_dir, "chunks").select("chunk_id", "body").join(quotes.select("chunk_id").distinct(), "chunk_id", "left_semi").distinct()
    bodies = lookalike.add_form(quoted, "body", pairs, "body_form")
    passages = (
        quotes.join(bodies, "chunk_id")
        .where(F.col("body_form").contains(F.col("form")) & ~F.col("body").contains(F.col("quote")))
        .select(F.lit("quote").alias("kind"), F.col("quote_id").alias("key_a"), F.col("chunk_id").alias("key_b"))
        .distinct()
    )
    return found.unionAll(passages)


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every card, chunk and line in another language, with the stored label.

    kind, item_id, line_no (0 for cards and chunks), label (null if missing), language, confidence. A chunk without words, and a
    card whose document has no chunk with words, has a null language and confidence 0.
    """
    chunks = table(spark, sf_dir, "chunks")
    model = language.train(chunks, "chunk_id", "text", "language")
    rows = chunks.withColumn("label", language.clean_label(F.col("language")))
    judged = materialize(language.detect(rows, ["chunk_id", "doc_id", "label"], "text", model), "judged")
    counts = judged.where("lang is not null").select("doc_id", "chunk_id", "lang").distinct().groupBy("doc_id", "lang").agg(F.count("*").alias("n"))
    right = language.mixed_or_top(counts, "doc_id")
    cards = table(spark, sf_dir, "doc_cards").select("doc_id", language.clean_label(F.col("language")).alias("label")).distinct()
    none = F.lit(0)
    return (
        judged.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("item_id"), none.alias("line_no"), "label", "lang", "confidence")
        .unionAll(
            judged.select(F.lit("segment"), "chunk_id", F.inline("others")).select(
                F.lit("segment").alias("kind"), "chunk_id", "line_no", F.lit(None).cast("string").alias("label"), "lang", "confidence"
            )
        )
        .unionAll(cards.join(right, "doc_id", "left").select(F.lit("card"), "doc_id", none, "label", "lang", F.coalesce("confidence", F.lit(0.0))))
        .withColumnRenamed("lang", "language")
        .dropDuplicates(["kind", "item_id", "line_no", "label"])
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards and chunks whose label is missing or wrong, and lines in another language than their text, with the right one."""
    return (
        p4_languages(spark, sf_dir)
        .where(F.col("language").isNotNull() & ~F.col("label").eqNullSafe(F.col("language")))
        .select("kind", "item_id", "line_no", "language")
        .distinct()
    )


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), F.col("embedding").alias("vector"))
    cards = table(spark, sf_dir, "doc_cards").select(F.lit("card").alias("kind"), F.col("doc_id").alias("key"), F.col("embedding").alias("vector"))
    return chunks.unionAll(cards)


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of every chunk and card, with their cosine."""
    return neighbours.similar_vectors(_embeddings(spark, sf_dir), DIM, 5)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the five most similar to the other."""
    return (
        p5_neighbours(spark, sf_dir)
        .select("kind", F.least("key", "other").alias("id_a"), F.greatest("key", "other").alias("id_b"))
        .distinct()
    )


def p5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy graph search: the vectors whose number in the index is divisible by 20, against all others of their kind."""
    index = neighbours.index_vectors(_embeddings(spark, sf_dir), DIM)
    graph = neighbours.neighbour_graph(index)
    asked = index.where(F.col("vid") % 20 == 0).select("kind", F.concat_ws("/", "kind", "key").alias("query"), "unit")
    found = neighbours.greedy_search(asked, graph, index, k=6)
    names = index.select("vid", F.concat_ws("/", "kind", "key").alias("name"), F.col("key").alias("other"))
    return (
        found.select("kind", "query", F.explode("near").alias("n"))
        .select("kind", "query", F.col("n.vid").alias("vid"), F.round("n.sim", 6).alias("cosine"))
        .join(names, "vid")
        .where("query <> name")
        .select("kind", "query", "other", "cosine")
    )


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizing.encode_column(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the containers of each capacity; copies (case, spaces and signs aside) and one source are kept apart."""
    text = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), "source", F.when(F.length(text) > 0, F.xxhash64(text)).alias("cluster"), "text"
    )
    sized = materialize(tokenizing.count_column(documents, "text", ["item_id", "source", "cluster"], out="size"), "sized")
    # a fixed table of a few rows
    capacities = {r["name"]: r["capacity"] for r in table(spark, sf_dir, "containers").collect()}
    return packing.pack(sized, capacities).withColumnRenamed("item_id", "doc_id").withColumnRenamed("size", "tokens")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document is keywords, links or tags."""
    return stuffing.stuffed_share(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are stuffed by more than half."""
    return p8_shares(spark, sf_dir).where(F.col("share") > stuffing.CASE).select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_forms": p3_forms,
    "p3_looks": p3_looks,
    "p4_found": p4_found,
    "p4_languages": p4_languages,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p5_search": p5_search,
    "p6_ids": p6_ids,
    "p7_packed": p7_packed,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
}

ORACLES = {
    "p1_found": f"""
        WITH t AS (SELECT DISTINCT 'chunk' AS kind, '' AS scope, chunk_id AS id, body FROM chunks
                   UNION SELECT DISTINCT 'hit', query_id, hit_id, source['body'] FROM hits WHERE query_id IS NOT NULL),
          b AS (SELECT kind, scope, id, regexp_replace(body, '[{SPACE}]+', '', 'g') AS s FROM t WHERE body IS NOT NULL),
          g AS (SELECT kind, scope, id, list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS g FROM b WHERE length(s) >= 3),
          e AS (SELECT kind, scope, id, len(g) AS n, unnest(g) AS x FROM g),
          p AS (SELECT a.kind, a.id AS id_a, b.id AS id_b, a.n + b.n AS n, count(*) AS shared FROM e a JOIN e b
                ON a.kind = b.kind AND a.scope = b.scope AND a.x = b.x AND a.id < b.id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n GROUP BY ALL)
        SELECT kind, id_a, id_b FROM p WHERE shared >= 0.7 * (n - shared)
    """,
    "p2_found": f"""
        SELECT DISTINCT 'section' AS kind, section_id AS item_id FROM sections WHERE length(body) > {SECTION_LIMIT}
        UNION
        SELECT DISTINCT 'chunk' AS kind, chunk_id AS item_id FROM chunks
        WHERE length(body) > {CHUNK_LIMIT} OR len(regexp_extract_all(body, '{TOKEN}')) > {CHUNK_TOKENS}
    """,
}
