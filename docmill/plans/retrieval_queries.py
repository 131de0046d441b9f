"""Queries over questions, hits and the index, and the same in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions import text as X
from docmill.functions.text import SPACE
from docmill.operators import answering, evaluation, retrieval, telemetry
from docmill.plans.layout_queries import C, chunks
from docmill.sources.tables import materialize, scratch, table
from docmill.streaming import inbox

QUERIES, ORACLES = {}, {}
DIM = 48


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").withColumnRenamed("id", "query_id")


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Delivered hits as ranked candidates: repeated rows once, a chunk once a question, best first."""
    h = table(spark, d, "hits").dropDuplicates(["hit_id"]).where("query_id is not null and chunk_id is not null")
    best = h.groupBy("query_id", "chunk_id").agg(F.max(F.struct("fused", F.col("hit_id").alias("hit"))).alias("b")).select("query_id", "chunk_id", F.col("b.fused").alias("fused"), F.col("b.hit").alias("hit_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "chunk_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= retrieval.CANDIDATES).join(h.select("hit_id", "doc_id", F.col("source")["body"].alias("body")), "hit_id")


def index_rows(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "doc_id", "title", "path", "text", "summary", "keywords", "entities")


def cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_cards").dropDuplicates(["doc_id"])


def index_of(spark: SparkSession, d: str, name: str, rows: DataFrame, key: str, fields: dict[str, float], by: str | None = None) -> str:
    """The index of a table's rows, built once in a session for each state of its files."""
    fs = lambda f: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
    files = sorted(table(spark, d, name).inputFiles())
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    state = hashlib.sha1("|".join(f"{f} {fs(f).getFileSystem(conf).getFileStatus(fs(f)).getModificationTime()}" for f in files).encode()).hexdigest()
    setting = f"docmill.index.{name}.{'-'.join(fields)}.{state}"
    path = spark.conf.get(setting, None)
    if path is None:
        path = scratch(spark, f"index-{name}")
        retrieval.write_index(rows, key, list(fields), path, by)
        spark.conf.set(setting, path)
    return path


def chunk_scores(spark: SparkSession, d: str, asked: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """BM25 with phrases of (query_id, query) over all chunks: the best ``k`` chunks of each, or with ``by`` those of the best ``k`` documents."""
    rows = index_rows(spark, d)
    index = index_of(spark, d, "chunks", rows, "chunk_id", retrieval.CHUNK_FIELDS, "doc_id")
    return retrieval.bm25(asked, rows, "chunk_id", retrieval.CHUNK_FIELDS, index, retrieval.CHUNK_PHRASES, k, by)


def card_scores(spark: SparkSession, d: str, k: int) -> DataFrame:
    rows = cards(spark, d).select("doc_id", *retrieval.CARD_FIELDS)
    index = index_of(spark, d, "doc_cards", rows, "doc_id", retrieval.CARD_FIELDS)
    return retrieval.bm25(questions(spark, d).select("query_id", "query"), rows, "doc_id", retrieval.CARD_FIELDS, index, k=k)


def lexical(spark: SparkSession, d: str, k: int = retrieval.CANDIDATES) -> DataFrame:
    return retrieval.top(chunk_scores(spark, d, questions(spark, d).select("query_id", "query"), k), "chunk_id", k)


def vectors(spark: SparkSession, d: str, k: int = retrieval.CANDIDATES) -> DataFrame:
    """The vector leg. There is no embedding model here: a question's vector is that of the card of the document it is about."""
    asked = questions(spark, d).select("query_id", "doc_id").join(cards(spark, d).select("doc_id", F.col("embedding").alias("vector")), "doc_id")
    return retrieval.knn(asked.select("query_id", "vector"), chunks(spark, d, "embedding").withColumnRenamed("embedding", "vector"), "chunk_id", DIM, k)


def terms_sql(text: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(lower({text}), '{X.TERM}'), lambda r: CASE WHEN len(r) > 1 AND regexp_matches(r, '^[{X.DENSE}]') THEN list_transform(range(1, len(r)), lambda i: substr(r, i, 2)) ELSE [r] END))"


def bm25_sql(source: str, key: str, fields: dict[str, float], phrases: dict[str, float] | None = None, asked: str = "SELECT id AS query_id, query FROM questions") -> str:
    """CTEs up to ``scored`` (query_id, key, score)."""
    parts = " UNION ALL ".join(f"SELECT {key} AS key, '{f}' AS field, {f'array_to_string({f}, $$ $$)' if f in ('keywords', 'entities', 'aliases', 'topics') else f} AS t FROM {source}" for f in fields)
    boost = lambda weights: " ".join(f"WHEN '{f}' THEN {w}" for f, w in weights.items())
    idf = "ln(1 + (n - df + 0.5) / (df + 0.5))"
    beside = ""
    if phrases:
        beside = f"""pc AS (SELECT query_id, key, field, sum({idf}) AS idf, any_value(ln) AS ln FROM ask JOIN po USING (term) JOIN df USING (field, term), tot WHERE field IN ({', '.join(f"'{f}'" for f in phrases)}) GROUP BY 1, 2, 3 HAVING count(*) = any_value(n_terms)),
      pp AS (SELECT pc.*, list_transform(range(1, len(q.l) + 1), lambda i: list_filter(list_transform(range(1, len(tk.l) + 1), lambda p: CASE WHEN tk.l[p] = q.l[i] THEN p - i END), lambda x: x IS NOT NULL)) AS places FROM pc JOIN tk USING (key, field) JOIN qt q USING (query_id)),
      pw AS (SELECT query_id, key, field, idf, ln, list_filter(list_transform(list_distinct(flatten(places)), lambda b: list_max(list_transform(places, lambda own: coalesce(list_min(list_filter(own, lambda x: x >= b)) - b, 3)))), lambda w: w <= 2) AS widths FROM pp),
      pf AS (SELECT *, list_sum(list_transform(widths, lambda w: 1.0 / (1 + w))) AS freq FROM pw WHERE len(widths) > 0),
      ph AS (SELECT query_id, key, max((CASE field {boost(phrases)} END) * idf * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * ln / al))) AS extra FROM pf JOIN al USING (field) GROUP BY 1, 2),
      """
    score = f"SELECT query_id, key, max(s) + 0.3 * (sum(s) - max(s)) AS best FROM sf GROUP BY 1, 2"
    return f"""fl AS ({parts}), tk AS (SELECT key, field, {terms_sql('t')} AS l FROM fl WHERE t IS NOT NULL),
      po AS (SELECT key, field, ln, term, count(*) AS tf FROM (SELECT key, field, len(l) AS ln, unnest(l) AS term FROM tk) GROUP BY ALL),
      al AS (SELECT field, avg(ln) AS al FROM (SELECT DISTINCT key, field, ln FROM po) GROUP BY field), tot AS (SELECT count(*) AS n FROM {source}),
      df AS (SELECT field, term, count(*) AS df FROM po GROUP BY 1, 2), qt AS (SELECT query_id, {terms_sql('query')} AS l FROM ({asked})),
      ask AS (SELECT query_id, len(list_distinct(l)) AS n_terms, unnest(list_distinct(l)) AS term FROM qt),
      sf AS (SELECT query_id, key, field, sum((CASE field {boost(fields)} END) * {idf} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ln / al))) AS s
             FROM ask JOIN po USING (term) JOIN df USING (field, term) JOIN al USING (field), tot GROUP BY 1, 2, 3),
      {beside}scored AS (SELECT query_id, key, round(best{' + coalesce(extra, 0)' if phrases else ''}, 6) AS score FROM ({score}){' LEFT JOIN ph USING (query_id, key)' if phrases else ''})"""


BM25 = bm25_sql("c", "chunk_id", retrieval.CHUNK_FIELDS, retrieval.CHUNK_PHRASES)
LEX = "lex AS (SELECT * FROM (SELECT query_id, key AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM scored) WHERE rank <= 50)"
CARD = "k AS (SELECT DISTINCT ON (doc_id) * FROM doc_cards)"
VEC = """uc AS (SELECT chunk_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM c WHERE len(embedding) = 48 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
      uq AS (SELECT q.id AS query_id, list_transform(k.embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM questions q JOIN k USING (doc_id) WHERE len(k.embedding) = 48 AND list_sum(list_transform(k.embedding, lambda x: abs(x))) > 0),
      cs AS (SELECT query_id, chunk_id, round(list_cosine_similarity(uq.v, uc.v), 6) AS cos FROM uq, uc),
      vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, chunk_id) AS rank FROM cs) WHERE rank <= 50)"""


@query(f"WITH {C}, {BM25}, {LEX} SELECT * FROM lex")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical(spark, d)


@query(f"WITH {C}, {CARD}, {VEC} SELECT * FROM vec")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d)


def fused(spark: SparkSession, d: str) -> DataFrame:
    legs = lexical(spark, d).select("query_id", F.lit("bm25").alias("leg"), "chunk_id", "rank").unionAll(vectors(spark, d).select("query_id", F.lit("knn").alias("leg"), "chunk_id", "rank"))
    return retrieval.rrf(legs, "chunk_id").where(F.col("rank") <= retrieval.CANDIDATES)


FUSED = """lg AS (SELECT query_id, chunk_id, rank FROM lex UNION ALL SELECT query_id, chunk_id, rank FROM vec),
      fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS fused FROM lg GROUP BY 1, 2)) WHERE rank <= 50)"""


def _kept_sql(source: str) -> str:
    """CTEs from ``source`` (query_id, rank, body) up to ``kept`` (query_id, rank)."""
    return f"""g AS (SELECT query_id, rank, CASE WHEN length(b) >= 3 THEN list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) ELSE [] END AS g
            FROM (SELECT query_id, rank, regexp_replace(coalesce(body, ''), '[{SPACE}]+', '', 'g') AS b FROM {source})),
      pr AS (SELECT x.query_id, y.rank, x.rank AS better, len(list_intersect(x.g, y.g)) AS shared, len(x.g) AS nx, len(y.g) AS ny FROM g x JOIN g y ON x.query_id = y.query_id AND x.rank < y.rank AND len(x.g) > 0 AND len(y.g) > 0),
      nr AS (SELECT g.query_id, g.rank, coalesce(list(better) FILTER (shared >= 0.7 * (nx + ny - shared)), []) AS near FROM g LEFT JOIN pr USING (query_id, rank) GROUP BY 1, 2),
      fold AS (SELECT query_id, rank, [rank] AS kept FROM nr WHERE rank = 1 UNION ALL
        SELECT nr.query_id, nr.rank, CASE WHEN list_has_any(fold.kept, nr.near) THEN fold.kept ELSE list_append(fold.kept, nr.rank) END FROM fold JOIN nr ON nr.query_id = fold.query_id AND nr.rank = fold.rank + 1),
      kept AS (SELECT query_id, unnest(kept) AS rank FROM (SELECT query_id, max_by(kept, rank) AS kept FROM fold GROUP BY 1))"""


@query(f"""
    WITH RECURSIVE {C}, {CARD}, {BM25}, {LEX}, {VEC}, {FUSED}, fb AS (SELECT fu.*, c.body FROM fu JOIN c USING (chunk_id)), {_kept_sql('fb')}
    SELECT query_id, chunk_id, fused, final_rank FROM (SELECT query_id, chunk_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS final_rank FROM fu JOIN kept USING (query_id, rank)) WHERE final_rank <= 5""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Both legs of all questions, fused by rank, near duplicates of better hits left out, the best five."""
    f = materialize(fused(spark, d).select("query_id", "chunk_id", "fused", "rank"), "fused")
    flags = retrieval.suppress_near(f.join(chunks(spark, d, "body"), "chunk_id"), "chunk_id", "body", first=5)
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return f.join(flags.where("kept"), ["query_id", "rank"]).withColumn("final_rank", final).select("query_id", "chunk_id", "fused", "final_rank")


HITS = """ho AS (SELECT DISTINCT ON (hit_id) hit_id, query_id, chunk_id, doc_id, fused, source['body'] AS body FROM hits),
      hb AS (SELECT query_id, chunk_id, max({'f': fused, 'h': hit_id}) AS b FROM ho WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
      hr AS (SELECT * FROM (SELECT query_id, chunk_id, b.f AS fused, b.h AS hit_id, row_number() OVER (PARTITION BY query_id ORDER BY b.f DESC, chunk_id) AS rank FROM hb) WHERE rank <= 50),
      h AS (SELECT hr.*, ho.doc_id, ho.body FROM hr JOIN ho USING (hit_id))"""


@query(f"WITH RECURSIVE {HITS}, {_kept_sql('h')} SELECT h.query_id, h.chunk_id, h.rank, kept.rank IS NOT NULL AS kept FROM h LEFT JOIN kept USING (query_id, rank)")
def hits_without_near(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.suppress_near(materialize(hits(spark, d), "hits"), "chunk_id", "body").select("query_id", "chunk_id", "rank", "kept")


@query(f"""
    WITH {C}, {BM25}, r AS (SELECT query_id, doc_id, key, score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, key) AS i FROM scored JOIN c ON c.chunk_id = key),
      t AS (SELECT query_id, doc_id, key AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE i = 1)
    SELECT * FROM t WHERE rank <= 2""")
def lexical_documents(spark: SparkSession, d: str) -> DataFrame:
    scored = chunk_scores(spark, d, questions(spark, d).select("query_id", "query"), 2, "doc_id")
    return retrieval.collapse(scored, "chunk_id", "doc_id", 2).select("query_id", "doc_id", "chunk_id", "score", "rank")


def card_legs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Cards by their fields and by vector; as in :func:`vectors` a question's vector is that of the card of its document."""
    k = cards(spark, d).select("doc_id", F.col("embedding").alias("vector"))
    asked = questions(spark, d).select("query_id", "doc_id").join(k, "doc_id").select("query_id", "vector")
    return {"bm25": retrieval.top(card_scores(spark, d, 20), "doc_id", 20), "knn": retrieval.knn(asked, k, "doc_id", DIM, 20)}


CARDS = f"""{CARD}, {bm25_sql('k', 'doc_id', retrieval.CARD_FIELDS)},
      ul AS (SELECT doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM k WHERE len(embedding) = 48 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
      kl AS (SELECT q.id AS query_id, b.doc_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM questions q JOIN ul a USING (doc_id), ul b),
      legs AS (SELECT query_id, key AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM scored UNION ALL
               SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kl),
      cardfuse AS (SELECT query_id, doc_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS fused FROM legs WHERE rank <= 20 GROUP BY 1, 2))"""


@query(f"WITH {CARDS} SELECT * FROM cardfuse WHERE rank <= 3")
def card_routing(spark: SparkSession, d: str) -> DataFrame:
    """The three best document cards of each question, by fields and by vector, 20 candidates each, fused by rank."""
    return retrieval.fuse_legs(card_legs(spark, d), "doc_id", 3).select("query_id", "doc_id", "fused", "rank")


@query(f"""WITH {CARDS}, r AS (SELECT q.id, min(rank) AS rank FROM questions q LEFT JOIN cardfuse f ON f.query_id = q.id AND f.doc_id = q.doc_id GROUP BY q.id)
    SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS doc_at_1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 6) AS doc_at_3 FROM r""")
def card_routing_scores(spark: SparkSession, d: str) -> DataFrame:
    """How often the right document's card is first, and among the first three."""
    found = retrieval.fuse_legs(card_legs(spark, d), "doc_id", 40).select("query_id", "doc_id", "rank")
    right = questions(spark, d).select("query_id", "doc_id").join(found, ["query_id", "doc_id"], "left")
    at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1).otherwise(0)), 6)
    return right.agg(F.count("*").alias("n"), at(1).alias("doc_at_1"), at(3).alias("doc_at_3"))


@query(f"""
    WITH {C}, {HITS}, w AS (SELECT DISTINCT h.query_id, c.doc_id, unnest([greatest(c.seq - 1, 0), c.seq, c.seq + 1]) AS seq FROM h JOIN c USING (chunk_id) WHERE h.rank <= 4),
      t AS (SELECT w.query_id, c.chunk_id, row_number() OVER (PARTITION BY w.query_id ORDER BY w.doc_id, w.seq, c.chunk_id) AS rn FROM w JOIN c USING (doc_id, seq))
    SELECT query_id, chunk_id, rn AS place FROM t WHERE rn <= 16""")
def neighbour_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "doc_id", "seq")
    return retrieval.neighbours(hits(spark, d).drop("doc_id").join(c, "chunk_id"), c).select("query_id", "chunk_id", F.col("at").alias("place"))


CARDS10 = f"""gr AS (SELECT doc_id, seq // 10 AS grp, list(chunk_id ORDER BY seq, chunk_id) AS ids FROM c GROUP BY 1, 2),
      hc AS (SELECT h.query_id, c.doc_id, c.seq // 10 AS grp, sum(1.0 / (60 + h.rank)) AS s FROM h JOIN c USING (chunk_id) GROUP BY 1, 2, 3),
      cr AS (SELECT * FROM (SELECT query_id, ids, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id, grp) AS card_rank FROM hc JOIN gr USING (doc_id, grp)) WHERE card_rank <= 3)"""


@query(f"""
    WITH {C}, {HITS}, {CARDS10}, e AS (SELECT query_id, card_rank, unnest(ids) AS chunk_id, generate_subscripts(ids, 1) AS pos FROM cr),
      f AS (SELECT query_id, chunk_id, min({{'p': pos, 'r': card_rank}}) AS p FROM e GROUP BY 1, 2), t AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY p.p, p.r) AS rn FROM f)
    SELECT query_id, chunk_id, rn AS place FROM t WHERE rn <= 20""")
def section_round_robin(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "doc_id", "seq", "page", "end_page")
    groups = retrieval.section_groups(c)
    of = c.select("chunk_id", F.format_string("%s#group%04d", "doc_id", F.floor(F.col("seq") / 10).cast("int")).alias("card_id"))
    scored = hits(spark, d).join(of, "chunk_id").groupBy("query_id", "card_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 12).alias("score"))
    ranked = retrieval.top(scored.join(groups, "card_id"), "card_id", 3).withColumnRenamed("rank", "card_rank")
    return retrieval.round_robin(ranked, 20).select("query_id", "chunk_id", F.col("at").alias("place"))


MULTI = f"regexp_matches(lower(query), '{X.COMPARISON}')"


@query(f"""
    WITH {HITS}, q AS (SELECT id AS query_id, {MULTI} AS multi FROM questions), o AS (SELECT h.*, multi, first(h.doc_id) OVER (PARTITION BY query_id ORDER BY rank) AS best FROM h JOIN q USING (query_id)),
      t AS (SELECT query_id, chunk_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS evidence_rank FROM o WHERE multi OR doc_id = best)
    SELECT * FROM t WHERE evidence_rank <= 5""")
def evidence(spark: SparkSession, d: str) -> DataFrame:
    multi = questions(spark, d).select("query_id", X.is_comparison(F.col("query")).alias("multi"))
    return retrieval.one_document(hits(spark, d).join(multi, "query_id")).select("query_id", "chunk_id", "doc_id", "evidence_rank")


MENTIONS = f"""ka AS (SELECT DISTINCT doc_id, lower(doc_id) AS low, regexp_extract_all(lower(doc_id), '{retrieval.WORD}') AS w FROM doc_cards),
      na AS (SELECT DISTINCT doc_id, trim(unnest(list_concat([low, translate(low, '-_', '  '), regexp_replace(regexp_replace(low, '{retrieval.DATE}', '-', 'g'), '^[-_ ]+|[-_ ]+$', '', 'g')],
        list_filter(w, lambda x: NOT regexp_matches(x, '^[0-9]+$')),
        flatten(list_transform(range(1, len(w)), lambda i: CASE WHEN regexp_matches(w[i], '^[0-9]+$') AND regexp_matches(w[i + 1], '^[0-9]+$') THEN [] ELSE [w[i] || ' ' || w[i + 1], w[i] || '-' || w[i + 1]] END))))) AS alias FROM ka),
      qc AS (SELECT id AS query_id, replace(regexp_replace(lower(query), '[^0-9a-zA-Z가-힣]+', ' ', 'g'), ' ', '') AS compact FROM questions),
      mn AS (SELECT query_id, doc_id, max(length(alias)) AS longest FROM qc JOIN na ON length(alias) >= 3 AND translate(alias, ' -', '') <> '' AND contains(compact, translate(alias, ' -', '')) GROUP BY 1, 2),
      named AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY longest DESC, doc_id) AS rank FROM mn)"""


@query(f"WITH {MENTIONS} SELECT * FROM named")
def document_mentions(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.mentions(questions(spark, d), cards(spark, d)).select("query_id", "doc_id", "longest", "rank")


@query(f"""
    WITH {MENTIONS}, n AS (SELECT query_id, list(doc_id ORDER BY rank) AS named FROM named GROUP BY 1), q AS (SELECT id AS query_id, {MULTI} AS multi, CASE WHEN bucket = 'A' THEN [doc_id] ELSE [] END AS given, coalesce(named, []) AS named FROM questions LEFT JOIN n ON n.query_id = id),
      r AS (SELECT query_id, multi, given, named, CASE WHEN len(given) > 0 THEN given ELSE named END AS chosen FROM q)
    SELECT query_id, array_to_string(chosen, ',') AS doc_ids, multi OR len(chosen) > 1 AS several, array_to_string(CASE WHEN len(given) > 0 AND len(named) > 1 THEN list_filter(named, lambda x: NOT list_contains(given, x)) ELSE [] END, ',') AS missing FROM r""")
def question_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Documents to search: the given one for questions of bucket A, else those that the question names."""
    q = questions(spark, d).select("query_id", "query", F.when(F.col("bucket") == "A", F.array("doc_id")).alias("given"))
    named = retrieval.mentions(q, cards(spark, d))
    r = retrieval.route(q, named, X.is_comparison(F.col("query")), "given")
    return r.select("query_id", F.array_join("doc_ids", ",").alias("doc_ids"), "several", F.array_join("missing", ",").alias("missing"))


@query(f"SELECT id AS query_id, CASE WHEN regexp_matches(query, '[가-힣]') THEN 'ko' WHEN regexp_matches(query, '[A-Za-z]') THEN 'en' ELSE 'ko' END AS language, {MULTI} AS multi FROM questions")
def question_routes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    return questions(spark, d).select("query_id", X.detect_language(q).alias("language"), X.is_comparison(q).alias("multi"))


@query(f"WITH {HITS}, u AS (SELECT query_id, chunk_id, rank, CAST(sum(length(coalesce(body, ''))) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM h) SELECT * FROM u WHERE used <= 6000")
def context_until_full(spark: SparkSession, d: str) -> DataFrame:
    return answering.budget_prefix(hits(spark, d), F.length(F.coalesce("body", F.lit(""))), 6000).select("query_id", "chunk_id", "rank", "used")


@query(f"""
    WITH RECURSIVE {HITS}, z AS (SELECT query_id, chunk_id, rank, CASE WHEN trim(translate(coalesce(body, ''), chr(9) || chr(10) || chr(13), '   ')) = '' THEN 0 ELSE length(body) END AS n FROM h),
      r AS (SELECT query_id, rank, CASE WHEN n > 0 AND n <= 3000 THEN n ELSE 0 END AS used, n > 0 AND n <= 3000 AS taken FROM z WHERE rank = 1 UNION ALL
        SELECT z.query_id, z.rank, CASE WHEN n > 0 AND r.used + n <= 3000 THEN r.used + n ELSE r.used END, n > 0 AND r.used + n <= 3000 FROM r JOIN z ON z.query_id = r.query_id AND z.rank = r.rank + 1)
    SELECT query_id, chunk_id, rank, CAST(used AS BIGINT) AS used, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r JOIN z USING (query_id, rank) WHERE taken""")
def context_that_fits(spark: SparkSession, d: str) -> DataFrame:
    body = F.coalesce("body", F.lit(""))
    size = F.when(F.trim(F.translate(body, "\t\n\r", "   ")) == "", 0).otherwise(F.length(body))
    return answering.budget_skip(hits(spark, d), size, 3000).select("query_id", "chunk_id", "rank", "used", "n")


@query()
def valid_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quotes").select("quote_id", "chunk_id", "quote").distinct()
    q, c = answering.forms(q, "quote", "quote_form"), answering.forms(chunks(spark, d, "body"), "body", "body_form")
    return q.join(c, "chunk_id").select("quote_id", answering.quote_found(F.col("quote_form"), F.col("body_form")).alias("valid"))


@query()
def grounded_keywords(spark: SparkSession, d: str) -> DataFrame:
    return answering.grounded_terms(chunks(spark, d, "body", "keywords", "entities"), "chunk_id", "body", "keywords", "entities").select("chunk_id", "keywords", "entities")


@query("""
    SELECT DISTINCT chunk_id, CASE WHEN content_type IN ('concept', 'procedure', 'policy', 'reference', 'table', 'other') THEN content_type END AS content_type,
      CASE WHEN language IN ('ko', 'en') THEN language END AS language FROM chunks""")
def checked_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Values outside the closed lists become null."""
    types = ("concept", "procedure", "policy", "reference", "table", "other")
    c = table(spark, d, "chunks")
    return c.select("chunk_id", F.when(F.col("content_type").isin(*types), F.col("content_type")).alias("content_type"), F.when(F.col("language").isin("ko", "en"), F.col("language")).alias("language")).distinct()


@query("""
    WITH n AS (SELECT DISTINCT doc_id, list_sort(list_distinct(flatten(list_transform(regexp_extract_all(text, '\\[[0-9]+(?:\\s*,\\s*[0-9]+)*\\]'), lambda m: list_transform(regexp_extract_all(m, '[0-9]+'), lambda x: TRY_CAST(x AS INTEGER)))))) AS c FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, array_to_string(list_filter(c, lambda x: x <= 3), ',') AS known, len(c) AS cited FROM n WHERE len(c) > 0""")
def cited_sources(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that a text cites, and those of them that are valid where three sources are."""
    t = table(spark, d, "documents").where("text is not null")
    marked = X.normalize_citations(F.col("text"))
    rows = t.select("doc_id", X.cited_numbers(marked).alias("all"), X.cited_numbers(X.keep_known(marked, 3)).alias("known")).distinct().where(F.size("all") > 0)
    return rows.select("doc_id", F.array_join("known", ",").alias("known"), F.size("all").cast("long").alias("cited"))


def _cover(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.covered(questions(spark, d), chunks(spark, d, "doc_id", "page", "end_page", "section_ids"))


TARGETS = """tg AS (SELECT DISTINCT id AS query_id, doc_id, unnest(CASE WHEN len(coalesce(sections, [])) > 0 THEN sections ELSE list_transform(pages, lambda p: 'p' || p) END) AS target FROM questions),
      hd AS (SELECT DISTINCT doc_id, chunk_id, unnest(list_concat(coalesce(section_ids, []), list_transform(range(page, greatest(coalesce(end_page, page), page) + 1), lambda p: 'p' || p))) AS target FROM c WHERE page IS NOT NULL),
      cv AS (SELECT tg.query_id, hd.chunk_id, target FROM tg JOIN hd USING (doc_id, target))"""
SCORES = f"""{HITS}, {TARGETS}, tp AS (SELECT * FROM h WHERE rank <= 5), sn AS (SELECT tp.query_id, tp.rank, target FROM tp JOIN cv USING (query_id, chunk_id)),
      nw AS (SELECT DISTINCT query_id, rank, 1 AS gain FROM (SELECT query_id, target, min(rank) AS rank FROM sn GROUP BY 1, 2)), rl AS (SELECT DISTINCT query_id, rank, 1 AS rel FROM sn),
      hh AS (SELECT tp.query_id, tp.rank, tp.doc_id, coalesce(gain, 0) AS gain, coalesce(rel, 0) AS rel FROM tp LEFT JOIN nw USING (query_id, rank) LEFT JOIN rl USING (query_id, rank)),
      ag AS (SELECT query_id, sum(gain / log2(rank + 1)) AS dcg, sum(rel) / count(*) AS prec, min(rank) FILTER (rel = 1) AS first_rank, count(*) FILTER (rel = 1 AND gain = 0) AS dup, min_by(doc_id, rank) AS top_doc FROM hh GROUP BY 1),
      wn AS (SELECT query_id, count(*) AS n, list_sum(list_transform(range(1, least(count(*), 5) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM tg GROUP BY 1), gt AS (SELECT query_id, count(DISTINCT target) AS got FROM sn GROUP BY 1),
      sc AS (SELECT q.id AS query_id, q.doc_id, q.bucket, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(got / n, 0), 6) AS recall, round(coalesce(prec, 0), 6) AS chunk_precision, round(coalesce(1.0 / first_rank, 0), 6) AS rr,
             coalesce(first_rank, 0) AS first_rank, coalesce(dup, 0) AS duplicate_hits, coalesce(top_doc = q.doc_id, false) AS right_doc
             FROM questions q LEFT JOIN wn ON wn.query_id = q.id LEFT JOIN ag ON ag.query_id = q.id LEFT JOIN gt ON gt.query_id = q.id)"""


@query(f"WITH {C}, {SCORES} SELECT * FROM sc")
def ranking_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.score(questions(spark, d), hits(spark, d), _cover(spark, d)).na.fill(0, ["first_rank"])


@query(f"""
    WITH {C}, {SCORES} SELECT coalesce(bucket, 'all') AS bucket, coalesce(doc_id, 'all') AS doc_id, count(*) AS n, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(chunk_precision), 6) AS chunk_precision,
      round(avg(duplicate_hits), 6) AS duplicate_hits, round(avg(rr), 6) AS mrr, round(avg(CAST(right_doc AS INTEGER)), 6) AS right_doc, count(*) FILTER (rr = 0) AS zero_hit
    FROM sc WHERE bucket <> 'E' GROUP BY GROUPING SETS ((), (bucket), (doc_id))""")
def ranking_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summarize(ranking_scores(spark, d)).na.fill("all", ["bucket", "doc_id"])


@query(f"""
    WITH {C}, {HITS}, {TARGETS}, fr AS (SELECT h.query_id, target, min(h.rank) AS rank FROM h JOIN cv USING (query_id, chunk_id) WHERE h.rank <= 20 GROUP BY 1, 2),
      wn AS (SELECT query_id, count(*) AS n FROM tg GROUP BY 1), ks AS (SELECT unnest([1, 5, 10, 20]) AS k),
      pq AS (SELECT q.id AS query_id, ks.k, coalesce(any_value(wn.n), 0) AS n, count(fr.target) AS got, min(fr.rank) AS best, coalesce(list_sum(list_transform(list_distinct(list(fr.rank)), lambda r: 1 / log2(r + 1))), 0) AS gain
             FROM questions q CROSS JOIN ks LEFT JOIN wn ON wn.query_id = q.id LEFT JOIN fr ON fr.query_id = q.id AND fr.rank <= ks.k WHERE bucket <> 'E' GROUP BY 1, 2)
    SELECT k, count(*) AS n, round(avg(CASE WHEN got > 0 THEN 1 ELSE 0 END), 6) AS hit, round(avg(CASE WHEN n > 0 THEN round(got / n, 6) ELSE 0 END), 6) AS recall,
      round(avg(CASE WHEN n > 0 THEN round(gain / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1))), 6) ELSE 0 END), 6) AS ndcg, round(avg(coalesce(round(1.0 / best, 6), 0)), 6) AS mrr FROM pq GROUP BY k""")
def metrics_at_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.at_cutoffs(questions(spark, d), hits(spark, d), materialize(_cover(spark, d), "cover"))


CAUSES = f"""{HITS}, {TARGETS}, {_kept_sql('h')},
      kr AS (SELECT h.query_id, h.chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM h JOIN kept USING (query_id, rank)),
      dr AS (SELECT query_id, chunk_id FROM h ANTI JOIN kept USING (query_id, rank)),
      fd AS (SELECT x.query_id, min(kr.rank) AS best, max(CASE WHEN dr.chunk_id IS NOT NULL THEN 1 END) AS gone FROM (SELECT DISTINCT query_id, chunk_id FROM cv) x LEFT JOIN kr USING (query_id, chunk_id) LEFT JOIN dr USING (query_id, chunk_id) GROUP BY 1),
      cz AS (SELECT q.id AS query_id, bucket, CASE WHEN fd.query_id IS NULL THEN 'chunking' WHEN best IS NULL THEN CASE WHEN gone = 1 THEN 'dedupe' ELSE 'candidate' END WHEN best <= 5 THEN 'success' ELSE 'rank' END AS cause, coalesce(best, 0) AS best_rank
             FROM questions q LEFT JOIN fd ON fd.query_id = q.id WHERE bucket <> 'E')"""


@query(f"WITH RECURSIVE {C}, {CAUSES} SELECT * FROM cz")
def failure_causes(spark: SparkSession, d: str) -> DataFrame:
    h = materialize(retrieval.suppress_near(materialize(hits(spark, d), "hits"), "chunk_id", "body"), "kept")
    kept = h.where("kept").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return evaluation.causes(questions(spark, d), kept, _cover(spark, d), h.where("not kept")).na.fill(0, ["best_rank"])


@query(f"WITH RECURSIVE {C}, {CAUSES} SELECT cause, count(*) FILTER (bucket = 'A') AS a, count(*) FILTER (bucket = 'B') AS b, count(*) FILTER (bucket = 'C') AS c, count(*) FILTER (bucket = 'D') AS d FROM cz GROUP BY cause")
def cause_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return failure_causes(spark, d).groupBy("cause").pivot("bucket", ["A", "B", "C", "D"]).count().na.fill(0).toDF("cause", "a", "b", "c", "d")


@query()
def bootstrap_of_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Delivered hits against the hybrid search on the same questions."""
    q, cover = questions(spark, d), materialize(_cover(spark, d), "cover")
    doc = chunks(spark, d, "doc_id")
    mine = materialize(hybrid_search(spark, d).withColumnRenamed("final_rank", "rank").join(doc, "chunk_id"), "found")
    a, b = evaluation.score(q, hits(spark, d), cover), evaluation.score(q, mine, cover)
    both = a.where("bucket <> 'E'").join(b.select("query_id", F.col("ndcg").alias("nb"), F.col("rr").alias("rb"), F.col("recall").alias("cb")), "query_id")
    pairs = both.select("query_id", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(x).alias("a"), F.col(y).alias("b")) for m, x, y in (("ndcg", "ndcg", "nb"), ("recall", "recall", "cb"), ("mrr", "rr", "rb"))))))
    return evaluation.paired_bootstrap(materialize(pairs, "pairs"))


def _ltr_hits(spark: SparkSession, d: str) -> DataFrame:
    lex = lexical(spark, d, 20).select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    vec = vectors(spark, d, 20).select("query_id", "chunk_id", F.col("rank").alias("knn_rank"), F.col("cos").alias("knn_score"))
    both = lex.join(vec, ["query_id", "chunk_id"], "full")
    return both.join(questions(spark, d).select("query_id", "query"), "query_id").join(chunks(spark, d, "doc_id", "title", "body", "depth", "token_len"), "chunk_id")


def _grams_sql(text: str) -> str:
    bare = f"regexp_replace(coalesce({text}, ''), '[{SPACE}]+', '', 'g')"
    return f"list_distinct(list_transform(range(1, length({bare}) - 1), lambda i: substr({bare}, i, 3)))"


def _overlap_sql(text: str) -> str:
    q = _grams_sql("query")
    return f"round(CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, {_grams_sql(text)})) / len({q}) ELSE 0 END, 6)"


@query(f"""
    WITH {C}, {CARD}, {BM25}, {LEX}, {VEC}, x AS (SELECT query_id, chunk_id, l.rank AS br, l.score AS bs, v.rank AS kr, v.cos AS ks FROM (SELECT * FROM lex WHERE rank <= 20) l FULL JOIN (SELECT * FROM vec WHERE rank <= 20) v USING (query_id, chunk_id)),
      y AS (SELECT x.*, q.query, c.doc_id, c.title, c.body, c.depth, c.token_len FROM x JOIN questions q ON q.id = x.query_id JOIN c USING (chunk_id))
    SELECT query_id, chunk_id, round(coalesce(1.0 / (60 + br), 0), 6) AS bm25_rr, round(coalesce(1.0 / (60 + kr), 0), 6) AS knn_rr,
      round(coalesce(CASE WHEN stddev_pop(bs) OVER w > 0 THEN (bs - avg(bs) OVER w) / stddev_pop(bs) OVER w END, 0), 6) AS bm25_z, round(coalesce(ks, 0), 6) AS knn_cos,
      CASE WHEN br IS NOT NULL AND kr IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS both_legs, round(coalesce(least(depth, 4) / 4.0, 0), 6)::DOUBLE AS depth_norm, round(coalesce(least(token_len, 512) / 512.0, 0), 6)::DOUBLE AS len_norm,
      round(count(*) OVER (PARTITION BY query_id, doc_id) / count(*) OVER w, 6) AS doc_share, {_overlap_sql('title')} AS title_gram, {_overlap_sql('body')} AS body_gram FROM y WINDOW w AS (PARTITION BY query_id)""")
def rank_features(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.rank_features(_ltr_hits(spark, d))


@query()
def learned_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates reordered by a model that is fitted on whether they cover a target of their question."""
    rows = evaluation.rank_features(_ltr_hits(spark, d)).join(_cover(spark, d).select("query_id", "chunk_id").distinct().withColumn("label", F.lit(1)), ["query_id", "chunk_id"], "left").na.fill(0, ["label"])
    rows = materialize(rows, "ltr")
    return evaluation.rerank(rows, evaluation.fit_reranker(rows)).select("query_id", "chunk_id", "label", F.round("ltr_score", 6).alias("ltr_score"), "ltr_rank")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("trace"), F.col("event_type").alias("category"), "event_id", "ts", "value")


DUR = "du AS (SELECT user_id AS trace, event_type AS category, event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS micros FROM events)"


@query(f"WITH {DUR} SELECT trace, event_id, coalesce(micros, -1) AS micros FROM du")
def stage_durations(spark: SparkSession, d: str) -> DataFrame:
    """Microseconds from each event of a trace to the next; -1 for the last."""
    s = telemetry.stage_durations(_events(spark, d))
    return s.select("trace", "event_id", F.coalesce(F.round(F.col("seconds") * 1e6).cast("long"), F.lit(-1)).alias("micros"))


@query(f"""
    WITH {DUR}, g AS (SELECT trace, category, round(sum(micros) / 1e6, 2) AS seconds, count(*) AS spans FROM du WHERE micros IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY seconds DESC, category) AS rank FROM g)
    SELECT * FROM r WHERE rank <= 5""")
def slowest_stages(spark: SparkSession, d: str) -> DataFrame:
    s = telemetry.stage_durations(_events(spark, d)).where("seconds is not null")
    return telemetry.span_rollup(s).withColumn("seconds", F.round("seconds", 2))


@query("""
    SELECT event_type AS category, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS p95, max(value) AS largest, round(sum(value), 4) AS total
    FROM events WHERE value IS NOT NULL GROUP BY 1""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.run_summary(_events(spark, d), "category")


@query("""
    WITH k AS (SELECT DISTINCT doc_id FROM doc_cards), q AS (SELECT id, count(*) AS n, min(doc_id) AS doc_id FROM questions GROUP BY id)
    SELECT q.id, n > 1 AS repeated, k.doc_id IS NULL AS unknown_doc FROM q LEFT JOIN k USING (doc_id)""")
def gold_check(spark: SparkSession, d: str) -> DataFrame:
    """Questions by whether their id is repeated or their document is unknown."""
    q = table(spark, d, "questions").groupBy("id").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    known = cards(spark, d).select("doc_id").distinct().withColumn("known", F.lit(True))
    return q.join(known, "doc_id", "left").select("id", (F.col("n") > 1).alias("repeated"), F.col("known").isNull().alias("unknown_doc"))


@query("SELECT hit_id, chunk_id FROM (SELECT DISTINCT hit_id, chunk_id, source['body'] AS body FROM hits) h LEFT JOIN (SELECT DISTINCT chunk_id, body AS now FROM chunks) c USING (chunk_id) WHERE body IS DISTINCT FROM now")
def stale_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose body is not the chunk's of today."""
    h = table(spark, d, "hits").select("hit_id", "chunk_id", F.col("source")["body"].alias("body")).distinct()
    now = table(spark, d, "chunks").select("chunk_id", F.col("body").alias("now")).distinct()
    return h.join(now, "chunk_id", "left").where(~F.col("body").eqNullSafe(F.col("now"))).select("hit_id", "chunk_id")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table read as a stream."""
    return inbox.run_hourly(spark, d)
