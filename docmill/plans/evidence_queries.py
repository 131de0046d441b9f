"""Queries over sections as cards, samples of documents, excerpts, harvested training rows and the stored index, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions import text as X
from docmill.operators import chunking, evaluation, retrieval
from docmill.plans.layout_queries import C, blocks, chunks
from docmill.plans.retrieval_queries import BM25, CARD, CARDS, DIM, HITS, VEC, bm25_sql, card_legs, cards, chunk_scores, hits, questions, vectors
from docmill.sources import index_store
from docmill.sources.tables import materialize, scratch, table

QUERIES, ORACLES = {}, {}
SECTION_TOP = 3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def section_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of ten consecutive chunks: card_id, chunk_ids, text (their summaries, or titles where there are none), vector (mean unit vector)."""
    c = chunks(spark, d, "doc_id", "seq", "title", "summary", "embedding").withColumn("card_id", F.format_string("%s#group%04d", "doc_id", F.floor(F.col("seq") / 10).cast("int")))
    listed = c.groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id", F.coalesce("summary", "title", F.lit("")).alias("t")))).alias("c"))
    means = retrieval.mean_vectors(c.withColumnRenamed("embedding", "vector"), ["card_id"], DIM)
    return listed.select("card_id", F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"), F.array_join(F.transform("c", lambda x: x["t"]), " ").alias("text")).join(means, "card_id", "left")


SECTION_CARDS = f"""{C}, ck AS (SELECT DISTINCT ON (doc_id) * FROM doc_cards),
      sc AS (SELECT format('{{}}#group{{:04d}}', doc_id, seq // 10) AS card_id, list(chunk_id ORDER BY seq, chunk_id) AS chunk_ids, string_agg(coalesce(summary, title, ''), ' ' ORDER BY seq, chunk_id) AS text FROM c GROUP BY 1),
      su AS (SELECT format('{{}}#group{{:04d}}', doc_id, seq // 10) AS card_id, chunk_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM c WHERE len(embedding) = 48 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
      sm AS (SELECT card_id, list(x ORDER BY pos) AS v FROM (SELECT card_id, pos, round(avg(x), 9) AS x FROM (SELECT card_id, unnest(range(1, 49)) AS pos, unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS x FROM su) GROUP BY 1, 2) GROUP BY 1),
      {bm25_sql('sc', 'card_id', {'text': 1.0})},
      sq AS (SELECT q.id AS query_id, sm.card_id, round(list_cosine_similarity(list_transform(ck.embedding, lambda x: CAST(x AS DOUBLE)), sm.v), 6) AS cos FROM questions q JOIN ck USING (doc_id), sm WHERE len(ck.embedding) = 48 AND list_sum(list_transform(ck.embedding, lambda x: abs(x))) > 0),
      sl AS (SELECT query_id, key AS card_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM scored UNION ALL SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, card_id) AS rank FROM sq),
      sf2 AS (SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, card_id) AS card_rank FROM (SELECT query_id, card_id, round(sum(1.0 / (60 + rank)), 12) AS f FROM sl WHERE rank <= {SECTION_TOP} GROUP BY 1, 2)),
      se AS (SELECT query_id, card_rank, unnest(chunk_ids) AS chunk_id, generate_subscripts(chunk_ids, 1) AS pos FROM sf2 JOIN sc USING (card_id) WHERE card_rank <= {SECTION_TOP}),
      sr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY p.p, p.r) AS place FROM (SELECT query_id, chunk_id, min({{'p': pos, 'r': card_rank}}) AS p FROM se GROUP BY 1, 2))"""


@query(f"WITH {SECTION_CARDS} SELECT query_id, chunk_id, place FROM sr WHERE place <= 20")
def section_routing(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the best section cards of each question, by their text and by vector, fused by rank, taken in turn."""
    c = materialize(section_cards(spark, d), "section-cards")
    asked = questions(spark, d).select("query_id", "query", "doc_id")
    vector = asked.join(cards(spark, d).select("doc_id", F.col("embedding").alias("vector")), "doc_id").select("query_id", "vector")
    legs = {
        "bm25": retrieval.top(retrieval.bm25(asked.select("query_id", "query"), c.select("card_id", "text"), "card_id", {"text": 1.0}, k=SECTION_TOP), "card_id", SECTION_TOP),
        "knn": retrieval.knn(vector, c.select("card_id", "vector"), "card_id", DIM, SECTION_TOP),
    }
    best = retrieval.fuse_legs(legs, "card_id", SECTION_TOP, SECTION_TOP).select("query_id", "card_id", F.col("rank").alias("card_rank"))
    return retrieval.round_robin(best.join(c.select("card_id", "chunk_ids"), "card_id"), 20).select("query_id", "chunk_id", F.col("at").alias("place"))


@query(f"""WITH {SECTION_CARDS}, {HITS}, un AS (SELECT query_id, chunk_id, {{'p': CASE WHEN rank <= 14 THEN 0 ELSE 2 END, 'r': rank}} AS spot FROM h UNION ALL SELECT query_id, chunk_id, {{'p': 1, 'r': place}} FROM sr WHERE place <= 6),
      fo AS (SELECT query_id, chunk_id, min(spot) AS spot FROM un GROUP BY 1, 2), pl AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY spot, chunk_id) AS place FROM fo)
    SELECT * FROM pl WHERE place <= 20""")
def mixed_pool(spark: SparkSession, d: str) -> DataFrame:
    """The first 14 hits, six chunks by section routing, then the other hits; each once, 20 in all."""
    return retrieval.interleave(hits(spark, d), section_routing(spark, d).withColumnRenamed("place", "rank"))


@query(f"""
    WITH {C}, {BM25.replace(' scored AS', ' chunk_scored AS')}, r AS (SELECT query_id, doc_id, key, score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, key) AS i FROM chunk_scored JOIN c ON c.chunk_id = key),
      t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE i = 1)
    SELECT query_id, doc_id, rank FROM t WHERE rank <= 2""")
def lexical_routing(spark: SparkSession, d: str) -> DataFrame:
    """The two documents with the best chunks of each question."""
    scored = chunk_scores(spark, d, questions(spark, d).select("query_id", "query"), 2, "doc_id")
    return retrieval.collapse(scored, "chunk_id", "doc_id", 2).select("query_id", "doc_id", "rank")


@query(f"""
    WITH l AS (WITH {C}, {BM25}, r AS (SELECT query_id, doc_id, key, score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, key) AS i FROM scored JOIN c ON c.chunk_id = key)
           SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE i = 1),
      k2 AS (WITH {CARDS} SELECT query_id, doc_id, rank FROM cardfuse WHERE rank <= 3),
      f AS (SELECT query_id, doc_id, min(spot) AS spot FROM (SELECT query_id, doc_id, rank AS spot FROM l WHERE rank <= 2 UNION ALL SELECT query_id, doc_id, 10 + rank FROM k2) GROUP BY 1, 2)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY spot, doc_id) AS place FROM f""")
def routed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each question in order: by their chunks' words, then by their cards; each once."""
    by_card = retrieval.fuse_legs(card_legs(spark, d), "doc_id", 3).select("query_id", F.col("doc_id").alias("chunk_id"), "rank")
    both = retrieval.interleave(lexical_routing(spark, d).withColumnRenamed("doc_id", "chunk_id"), by_card, 2, 3, 5)
    return both.withColumnRenamed("chunk_id", "doc_id")


EXTRA = 2
VARIANTS = f"""SELECT id || '|0' AS query_id, query FROM questions UNION ALL
      SELECT query_id || '|' || i, requirement FROM (SELECT query_id, requirement, row_number() OVER (PARTITION BY query_id ORDER BY requirement) AS i FROM (SELECT DISTINCT query_id, requirement FROM quotes WHERE requirement IS NOT NULL AND query_id IN (SELECT id FROM questions))) WHERE i <= {EXTRA}"""


@query(f"""
    WITH {C}, {CARD}, {VEC}, {bm25_sql('c', 'chunk_id', retrieval.CHUNK_FIELDS, retrieval.CHUNK_PHRASES, VARIANTS)},
      vl AS (SELECT split_part(query_id, '|', 1) AS query_id, split_part(query_id, '|', 2) AS leg, key AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM scored),
      al2 AS (SELECT query_id, chunk_id, rank FROM vl WHERE rank <= 50 UNION ALL SELECT query_id, chunk_id, rank FROM vec),
      fz AS (SELECT query_id, chunk_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS fused FROM al2 GROUP BY 1, 2))
    SELECT query_id, chunk_id, fused, rank, CASE WHEN query_id IN (SELECT query_id FROM uq) THEN '' ELSE 'knn' END AS degraded FROM fz WHERE rank <= 5""")
def multi_query_search(spark: SparkSession, d: str) -> DataFrame:
    """Each question with up to two of its requirements as further queries: a BM25 leg for each and the vector leg, fused by rank; ``degraded`` names a leg that could not run."""
    q = questions(spark, d)
    needs = table(spark, d, "quotes").where("requirement is not null").select("query_id", F.col("requirement").alias("query")).distinct().join(q.select("query_id").distinct(), "query_id", "left_semi")
    numbered = needs.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("query"))).where(F.col("i") <= EXTRA)  # a question's few requirements
    variants = q.select("query_id", "query", F.lit(0).alias("i")).unionByName(numbered).select(F.concat_ws("|", "query_id", F.col("i").cast("string")).alias("query_id"), "query")
    lex = retrieval.top(chunk_scores(spark, d, variants, retrieval.CANDIDATES), "chunk_id", retrieval.CANDIDATES)
    part = F.split("query_id", r"\|")
    legs = lex.select(part[0].alias("query_id"), F.concat(F.lit("bm25+"), part[1]).alias("leg"), "chunk_id", "rank").unionAll(vectors(spark, d).select("query_id", F.lit("knn").alias("leg"), "chunk_id", "rank"))
    able = q.select("query_id", "doc_id").join(cards(spark, d).where(retrieval.usable("embedding", DIM)).select("doc_id"), "doc_id").select("query_id").distinct().withColumn("able", F.lit(True))
    best = retrieval.rrf(legs, "chunk_id").where("rank <= 5").join(able, "query_id", "left")
    return best.select("query_id", "chunk_id", "fused", "rank", F.when(F.col("able"), "").otherwise("knn").alias("degraded"))


@query(f"""
    WITH {C}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, chunk_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM c),
      w AS (SELECT DISTINCT doc_id, CASE WHEN least(20, n) = 1 THEN 0 ELSE CAST(round_even(unnest(range(0, least(20, n))) * (n - 1) / (least(20, n) - 1), 0) AS BIGINT) END AS i FROM (SELECT doc_id, count(*) AS n FROM c GROUP BY 1))
    SELECT doc_id, chunk_id, i AS place, substr(trim(regexp_replace(coalesce(body, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 260) AS head FROM o JOIN w USING (doc_id, i)""")
def card_samples(spark: SparkSession, d: str) -> DataFrame:
    """Twenty evenly spread chunks of each document and the start of their bodies: what a document card is written from."""
    c = chunks(spark, d, "doc_id", "seq", "body").withColumn("part", F.floor(F.col("seq") / chunking.BLOCK))
    numbered = chunking.running_number(c, "doc_id", ["seq", "chunk_id"], F.lit(1), "i", "part").withColumn("i", (F.col("i") - 1).cast("int"))
    total = c.groupBy("doc_id").agg(F.count("*").alias("n"))
    head = F.substring(F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+", " ")), 1, 260)
    return retrieval.spread_sample(numbered, "doc_id", "i", total).select("doc_id", "chunk_id", F.col("i").alias("place"), head.alias("head"))


@query("""
    WITH p AS (SELECT doc_id, max(page_index) AS n FROM blocks GROUP BY 1), w AS (SELECT doc_id, unnest(CASE WHEN n <= 8 THEN range(1, n + 1) ELSE list_distinct(list_transform(range(1, 9), lambda i: greatest(1, CAST(round_even(n * i / 9, 0) AS BIGINT)))) END) AS page_index FROM p)
    SELECT doc_id, page_index, count(DISTINCT block_id) AS lines FROM w JOIN blocks USING (doc_id, page_index) GROUP BY 1, 2""")
def sampled_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines of up to eight pages of each document, evenly spread: what a profile looks at."""
    b = blocks(spark, d).select("doc_id", "page_index", "block_id")
    pages = b.groupBy("doc_id").agg(F.max("page_index").alias("n"))
    spread = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.greatest(F.lit(1), F.bround(F.col("n") * i / 9).cast("int")))
    wanted = pages.where("n >= 1").select("doc_id", F.explode(F.when(F.col("n") <= 8, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array_distinct(spread))).alias("page_index"))
    return b.join(wanted, ["doc_id", "page_index"]).groupBy("doc_id", "page_index").agg(F.count("*").alias("lines"))


@query(f"""
    WITH RECURSIVE {C}, t AS (SELECT doc_id, 1 AS level, seq // 10 AS node, count(*) AS chunks, sum(length(coalesce(body, ''))) AS chars FROM c GROUP BY 1, 3 UNION ALL
      (SELECT doc_id, level, node, sum(chunks) AS chunks, sum(chars) AS chars FROM (SELECT t.doc_id, t.level + 1 AS level, t.node // 10 AS node, chunks, chars FROM t JOIN (SELECT doc_id, max(seq) AS top FROM c GROUP BY 1) m USING (doc_id) WHERE m.top >= pow(10, t.level)) GROUP BY 1, 2, 3))
    SELECT doc_id, level, node, CAST(chunks AS BIGINT) AS chunks, CAST(chars AS BIGINT) AS chars FROM t""")
def summary_tree(spark: SparkSession, d: str) -> DataFrame:
    """Ten chunks make a node, ten nodes one of the next level, up to one root a document: the order in which summaries are merged."""
    c = chunks(spark, d, "doc_id", "seq", "body").withColumn("chars", F.length(F.coalesce("body", F.lit("")))).drop("body")
    height = F.greatest(F.length(F.max("seq").cast("string")), F.lit(1))  # levels: the digits of the last number
    depths = c.groupBy("doc_id").agg(height.alias("height"))
    leaves = c.groupBy("doc_id", F.floor(F.col("seq") / 10).alias("node")).agg(F.count("*").alias("chunks"), F.sum("chars").alias("chars"))
    levels = leaves.join(depths, "doc_id").withColumn("level", F.explode(F.sequence(F.lit(1), "height")))
    node = F.floor(F.col("node") / F.pow(F.lit(10), F.col("level") - 1)).cast("long")
    return levels.groupBy("doc_id", "level", node.alias("node")).agg(F.sum("chunks").alias("chunks"), F.sum("chars").alias("chars"))


@query("SELECT id AS query_id FROM questions WHERE id NOT IN (SELECT query_id FROM hits WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL)")
def questions_to_resume(spark: SparkSession, d: str) -> DataFrame:
    """Questions without a delivered hit: where an interrupted run goes on."""
    done = table(spark, d, "hits").where("query_id is not null and chunk_id is not null").select("query_id").distinct()
    return questions(spark, d).select("query_id").distinct().join(done, "query_id", "left_anti")


@query(f"WITH {C} SELECT chunk_id, doc_id, seq, title, page FROM c WHERE chunk_id IN (SELECT chunk_id FROM quotes)")
def quoted_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by a list of ids, those that quotes name; ids without a chunk give none."""
    ids = table(spark, d, "quotes").select("chunk_id").distinct()
    return chunks(spark, d, "doc_id", "seq", "title", "page").join(ids, "chunk_id", "left_semi")


@query("""
    WITH t AS (SELECT DISTINCT doc_id, regexp_replace(text, '([.!?。][ \\t]*(?:\\[cite:[ \\t\\n\\f\\r]*[0-9, \\t\\n\\f\\r]+\\][ \\t]*)+)', '\\1' || chr(10), 'g') AS x FROM documents WHERE text IS NOT NULL),
      s AS (SELECT doc_id, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(y)), lambda y: regexp_matches(y, '\\p{L}')) AS l FROM t),
      u AS (SELECT doc_id, unnest(list_transform(range(1, len(l) + 1), lambda i: {'n': i, 'chars': length(l[i])})) AS z FROM s)
    SELECT doc_id, z.n AS n, z.chars AS chars FROM u""")
def answer_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut like answers: lines, and sentences that end with citations."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    return t.select("doc_id", F.inline(X.sentences(F.col("text")))).select("doc_id", F.col("n").cast("long").alias("n"), F.length("sentence").cast("long").alias("chars"))


@query("""
    WITH t AS (SELECT DISTINCT doc_id, regexp_replace(text, '\\[([0-9]+(?:[ \\t\\n\\f\\r]*,[ \\t\\n\\f\\r]*[0-9]+)*)\\]', '[cite:\\1]', 'g') AS x FROM documents WHERE text IS NOT NULL),
      n AS (SELECT doc_id, x, list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(x, '\\[cite:[ \\t\\n\\f\\r]*[0-9, \\t\\n\\f\\r]+\\]'), lambda m: regexp_extract_all(m, '[0-9]+'))), lambda v: TRY_CAST(v AS INTEGER)))) AS c FROM t)
    SELECT doc_id, rtrim(regexp_replace(x, '[ \\t]*\\[cite:[ \\t\\n\\f\\r]*[0-9, \\t\\n\\f\\r]+\\]', '', 'g')) || ' [cite:' || array_to_string(c, ',') || ']' AS text FROM n WHERE len(c) > 0""")
def single_citations(spark: SparkSession, d: str) -> DataFrame:
    """Texts with citations, with one citation at the end instead."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", X.normalize_citations(F.col("text")).alias("text")).distinct()
    return t.where(F.size(X.cited_numbers(F.col("text"))) > 0).select("doc_id", X.single_citation(F.col("text")).alias("text"))


@query("""
    WITH t AS (SELECT DISTINCT doc_id, regexp_extract(text, '\\[([0-9, \\t\\n\\x0B\\f\\r]*)\\]', 1) AS x FROM documents WHERE text IS NOT NULL),
      k AS (SELECT doc_id, list_transform(regexp_extract_all(x, '[0-9]+'), lambda v: TRY_CAST(v AS INTEGER)) AS a FROM t),
      u AS (SELECT doc_id, list_filter(list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda v: v IS NOT NULL), lambda v: v BETWEEN 1 AND 5) AS a FROM k)
    SELECT doc_id, array_to_string(list_concat(a, list_filter([1, 2, 3, 4, 5], lambda v: NOT list_contains(a, v))), ',') AS places FROM u""")
def given_orders(spark: SparkSession, d: str) -> DataFrame:
    """The order of five candidates that the first bracketed list of each text gives."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    return t.select("doc_id", F.array_join(X.given_order(F.col("text"), F.lit(5)), ",").alias("places"))


@query(f"""
    WITH {HITS}, e AS (SELECT h.query_id, h.chunk_id, list_distinct(regexp_extract_all(lower(query), '[가-힣a-z0-9]{{2,}}')) AS q, string_split(body, chr(10)) AS l FROM h JOIN questions x ON x.id = h.query_id WHERE body IS NOT NULL),
      z AS (SELECT query_id, chunk_id, l, list_filter(list_transform(range(1, len(l) + 1), lambda i: {{'n': len(list_filter(q, lambda t: contains(lower(l[i]), t))), 'i': i - 1}}), lambda s: s.n > 0) AS sc FROM e),
      y AS (SELECT query_id, chunk_id, l, list_slice(list_reverse_sort(sc), 1, 4) AS best FROM z)
    SELECT query_id, chunk_id, substr(array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: i < 2 OR len(list_filter(best, lambda b: abs(b.i - i) <= 1)) > 0), lambda i: l[i + 1]), chr(10)), 1, 600) AS excerpt FROM y""")
def relevant_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Of each hit the lines that hold most terms of its question, with their neighbours."""
    h = hits(spark, d).where("body is not null").join(questions(spark, d).select("query_id", "query"), "query_id")
    return h.select("query_id", "chunk_id", X.excerpt(F.col("query"), F.col("body")).alias("excerpt"))


def _script_sql(x: str) -> str:
    n = "len(regexp_extract_all({}, '{}'))".format
    return f"CASE WHEN {n(x, '[一-鿿]')} > {n(x, '[가-힣]')} AND {n(x, '[一-鿿]')} > 3 THEN 'cjk' WHEN {n(x, '[가-힣]')} > 0 THEN 'han' WHEN {n(x, '[A-Za-z]')} > 0 THEN 'latin' ELSE 'other' END"


PER_CHUNK, DEPTH = 2, 20
GENERATED = f"""gl AS (SELECT chunk_id, text, unnest(list_filter(list_transform(string_split(queries, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS query, generate_subscripts(list_filter(list_transform(string_split(queries, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1) AS pos FROM c WHERE queries IS NOT NULL AND text IS NOT NULL),
      gs AS (SELECT chunk_id, query, pos, {_script_sql('query')} = {_script_sql('text')} AS fits FROM gl),
      gn AS (SELECT *, coalesce(sum(CASE WHEN fits THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM gs),
      gq AS (SELECT chunk_id || '?' || pos AS query_id, chunk_id, query, fits FROM gn WHERE used < {PER_CHUNK})"""


def generated_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries that were generated for chunks (query_id, chunk_id, query, fits): the first two of each chunk in its script, and with ``fits`` false those ahead of them in another."""
    c = chunks(spark, d, "text", "queries").where("queries is not null and text is not null")
    lines = F.filter(F.transform(F.split("queries", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    each = c.select("chunk_id", X.script_of(F.col("text")).alias("script"), F.posexplode(lines).alias("pos", "query")).withColumn("fits", X.script_of(F.col("query")) == F.col("script"))
    ahead = Window.partitionBy("chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # the lines of one chunk
    used = F.coalesce(F.sum(F.col("fits").cast("int")).over(ahead), F.lit(0))
    return each.withColumn("used", used).where(F.col("used") < PER_CHUNK).select(F.concat_ws("?", "chunk_id", (F.col("pos") + 1).cast("string")).alias("query_id"), "chunk_id", "query", "fits")


def _harvest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = materialize(generated_queries(spark, d), "generated")
    top = retrieval.top(chunk_scores(spark, d, asked.where("fits").select("query_id", "query"), DEPTH), "chunk_id", DEPTH)
    right = asked.select("query_id", F.col("chunk_id").alias("own"))
    return asked, materialize(top.join(right, "query_id").withColumn("label", (F.col("chunk_id") == F.col("own")).cast("int")).drop("own"), "harvest")


HARVEST = f"""{C}, {GENERATED}, {bm25_sql('c', 'chunk_id', retrieval.CHUNK_FIELDS, retrieval.CHUNK_PHRASES, 'SELECT query_id, query FROM gq WHERE fits')},
      hv AS (SELECT s.query_id, key AS chunk_id, CASE WHEN key = gq.chunk_id THEN 1 ELSE 0 END AS label, s.rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM scored) s JOIN gq USING (query_id) WHERE s.rank <= {DEPTH})"""


@query(f"WITH {HARVEST} SELECT * FROM hv WHERE query_id IN (SELECT query_id FROM hv WHERE label = 1)")
def harvested_rows(spark: SparkSession, d: str) -> DataFrame:
    """Training rows without raters: the first 20 hits of generated queries, their own chunk the positive; queries that miss it are left out."""
    _, rows = _harvest(spark, d)
    found = rows.where("label = 1").select("query_id")
    return rows.join(found, "query_id", "left_semi").select("query_id", "chunk_id", "label", "rank")


@query(f"""WITH {HARVEST}, r AS (SELECT query_id, min(rank) FILTER (label = 1) AS rank FROM hv GROUP BY 1)
    SELECT (SELECT count(*) FROM gq WHERE fits) AS n_queries, (SELECT count(*) FROM gq WHERE NOT fits) AS skipped_lang, (SELECT count(*) FROM gq WHERE fits) - (SELECT count(rank) FROM r) AS skipped_missing, (SELECT round(avg(1.0 / rank), 6) FROM r) AS mrr""")
def harvest_counters(spark: SparkSession, d: str) -> DataFrame:
    asked, rows = _harvest(spark, d)
    mrr = evaluation.mean_reciprocal_rank(rows, F.col("rank")).select(F.col("n").alias("found"), "mrr")
    counts = asked.agg(F.count_if("fits").alias("n_queries"), F.count_if(~F.col("fits")).alias("skipped_lang"))
    return counts.crossJoin(mrr).select("n_queries", "skipped_lang", (F.col("n_queries") - F.col("found")).alias("skipped_missing"), "mrr")  # one row each


@query(f"""
    WITH {C}, k AS (SELECT doc_id, chunk_id, seq, body, CASE WHEN len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN 1 ELSE 0 END AS has FROM c WHERE doc_id NOT IN (SELECT doc_id FROM questions) OR body IS NOT NULL),
      m AS (SELECT k.*, coalesce(q.quotes, 0) AS quotes FROM k LEFT JOIN (SELECT chunk_id, count(DISTINCT quote_id) AS quotes FROM quotes GROUP BY 1) q USING (chunk_id))
    SELECT doc_id, count(*) AS chunks, CAST(sum(length(coalesce(body, ''))) AS BIGINT) AS chars, CAST(sum(has) AS BIGINT) AS vectors, CAST(sum(quotes) AS BIGINT) AS quotes FROM m WHERE NOT (doc_id IN (SELECT doc_id FROM hits) AND chunk_id NOT IN (SELECT chunk_id FROM hits WHERE chunk_id IS NOT NULL) AND seq % 2 = 1) GROUP BY 1""")
def index_after_updates(spark: SparkSession, d: str) -> DataFrame:
    """The stored index after a bulk write with vectors, a replacement of documents, an upsert of a column and the removal of stale rows, by document.

    Documents that questions ask about are replaced by their chunks with a body; the upsert counts each chunk's quotes; of documents with hits the chunks of odd number without one are stale.
    """
    path = scratch(spark, "stored")
    c = chunks(spark, d, "doc_id", "seq", "body", "embedding")
    index_store.replace_documents(index_store.join_payload(c.drop("embedding"), c.select("chunk_id", "embedding")), path)
    asked = questions(spark, d).select("doc_id").distinct()
    index_store.replace_documents(index_store.join_payload(c.drop("embedding").join(asked, "doc_id", "left_semi").where("body is not null"), c.select("chunk_id", "embedding")), path)
    rows = index_store.read_index(spark, path, vectors=True)
    quotes = table(spark, d, "quotes").where("chunk_id is not null").groupBy("chunk_id").agg(F.count_distinct("quote_id").alias("quotes"))
    rows = index_store.with_columns(rows, quotes, "chunk_id")
    h = table(spark, d, "hits").select("doc_id", "chunk_id").where("chunk_id is not null").distinct()
    keep = h.unionAll(rows.join(h.select("doc_id").distinct(), "doc_id", "left_semi").where("seq % 2 = 0").select("doc_id", "chunk_id"))
    live = index_store.without_stale(rows, keep, "chunk_id", "doc_id")
    return live.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum(F.length(F.coalesce("body", F.lit("")))).alias("chars"), F.count("embedding").alias("vectors"), F.coalesce(F.sum("quotes"), F.lit(0)).alias("quotes")
    )


@query("""
    WITH a AS (SELECT doc_id, count(DISTINCT label) AS labels, coalesce(bool_or(label = 'stuffed'), false) AS stuffed, count(*) FILTER (label IS NULL) > 0 AS unrated FROM page_labels GROUP BY 1)
    SELECT a.doc_id, labels, stuffed, unrated, d.doc_id IS NULL AS unknown FROM a LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id)""")
def graded_pages(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts joined with the rows they are about: how many different ones, whether any is missing, and whether the row exists."""
    a = table(spark, d, "page_labels").groupBy("doc_id").agg(
        F.count_distinct("label").alias("labels"), F.coalesce(F.bool_or(F.col("label") == "stuffed"), F.lit(False)).alias("stuffed"), (F.count_if(F.col("label").isNull()) > 0).alias("unrated")
    )
    known = table(spark, d, "documents").select("doc_id").distinct().withColumn("known", F.lit(True))
    return a.join(known, "doc_id", "left").select("doc_id", "labels", "stuffed", "unrated", F.col("known").isNull().alias("unknown"))
