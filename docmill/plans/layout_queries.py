"""Queries over lines, sections and chunks, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.functions.text import SPACE, TOKEN
from docmill.operators import chunking, layout
from docmill.sources.tables import materialize, table

QUERIES, ORACLES = {}, {}
LINE = ("doc_id", "page_index", "block_order")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines, repeated rows once."""
    return table(spark, d, "blocks").dropDuplicates(["block_id"])


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Columns of chunks, repeated rows once; what differs between deliveries is the time alone."""
    return table(spark, d, "chunks").select("chunk_id", *columns).dropDuplicates(["chunk_id"])


def sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").dropDuplicates(["section_id"])


B = "b AS (SELECT DISTINCT ON (block_id) * FROM blocks)"
C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks)"
S = "s AS (SELECT DISTINCT ON (section_id) * FROM sections)"
TIER = "round_even(size / 0.5, 0) * 0.5"
N = "len(regexp_extract_all(body, '{}'))".format


@query(f"""
    WITH {C}, n AS (SELECT chunk_id, body, {N('[가-힣]')} AS ko, {N('[A-Za-z]')} AS en, {N('[一-鿿]')} AS han FROM c WHERE body IS NOT NULL)
    SELECT chunk_id, {N(TOKEN)} AS tokens, CAST(ceil(length(body) / 1.6) AS BIGINT) AS est_tokens,
      CASE WHEN ko > 0 THEN 'ko' WHEN en > 0 THEN 'en' ELSE 'ko' END AS language,
      CASE WHEN han > ko AND han > 3 THEN 'cjk' WHEN ko > 0 THEN 'han' WHEN en > 0 THEN 'latin' ELSE 'other' END AS script,
      CASE WHEN ko = 0 THEN CASE WHEN en > 0 THEN 'en' ELSE 'mixed' END WHEN en = 0 OR ko >= en * 0.2 THEN 'ko' WHEN en >= ko * 5 THEN 'en' ELSE 'mixed' END AS source_language
    FROM n""")
def text_profile(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("body")
    return chunks(spark, d, "body").where("body is not null").select(
        "chunk_id", X.token_count(b).cast("long").alias("tokens"), X.estimated_tokens(F.length(b)).alias("est_tokens"),
        X.detect_language(b).alias("language"), X.script_of(b).alias("script"), X.source_language(b).alias("source_language"),
    )


@query("""
    SELECT DISTINCT source, substring(regexp_replace(regexp_replace(lower(regexp_replace(source, '\\.[A-Za-z]{1,4}$', '')), '[^a-z0-9가-힣]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM doc_cards""")
def card_slugs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "doc_cards")
    return c.select("source", X.slugify(X.file_stem(F.col("source"))).alias("slug")).distinct()


@query("SELECT doc_id, count(DISTINCT chunk_id) AS chunks, max(end_page) AS last_page FROM chunks GROUP BY doc_id")
def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("chunks"), F.max("end_page").alias("last_page"))


@query("""
    WITH k AS (SELECT doc_id, min(source) AS source FROM doc_cards GROUP BY doc_id), c AS (SELECT doc_id, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY doc_id),
      s AS (SELECT doc_id, count(DISTINCT section_id) AS sections FROM sections GROUP BY doc_id)
    SELECT doc_id, source, coalesce(chunks, 0) AS chunks, coalesce(sections, 0) AS sections, source IS NOT NULL AND coalesce(chunks, 0) > 0 AS complete
    FROM k FULL JOIN c USING (doc_id) FULL JOIN s USING (doc_id)""")
def doc_listing(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "doc_cards").groupBy("doc_id").agg(F.min("source").alias("source"))
    c = table(spark, d, "chunks").groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("chunks"))
    s = table(spark, d, "sections").groupBy("doc_id").agg(F.count_distinct("section_id").alias("sections"))
    out = k.join(c, "doc_id", "full").join(s, "doc_id", "full").na.fill(0, ["chunks", "sections"])
    return out.withColumn("complete", F.col("source").isNotNull() & (F.col("chunks") > 0))


@query(f"""
    WITH {C}, {S}, v AS (SELECT DISTINCT doc_id, unnest(section_ids) AS section_id FROM c),
      a AS (SELECT doc_id, count(*) AS chunks, list_sort(list(length(body)))[count(body) // 2 + 1] AS median_len, max(length(body)) AS max_len, count(*) FILTER (length(body) > 1200) AS oversize FROM c GROUP BY doc_id),
      e AS (SELECT doc_id, count(*) FILTER (trim(coalesce(body, '')) = '') AS empty_sections FROM s GROUP BY doc_id),
      l AS (SELECT doc_id, count(*) AS uncovered FROM s ANTI JOIN v USING (doc_id, section_id) GROUP BY doc_id)
    SELECT doc_id, chunks, median_len, max_len, oversize, coalesce(empty_sections, 0) AS empty_sections, coalesce(uncovered, 0) AS uncovered
    FROM a LEFT JOIN e USING (doc_id) LEFT JOIN l USING (doc_id)""")
def chunk_report(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_report(chunks(spark, d, "doc_id", "body", "section_ids"), sections(spark, d).select("doc_id", "section_id", "body"))


@query(f"""
    WITH RECURSIVE {S}, t AS (SELECT section_id, body, string_split(body, chr(10)) AS l FROM s WHERE body IS NOT NULL),
      r AS (SELECT section_id, l, 1 AS i, 1 AS piece, length(l[1]) + 1 AS size FROM t WHERE length(body) > 1200 UNION ALL
        SELECT section_id, l, i + 1, CASE WHEN size + length(l[i + 1]) + 1 > 1200 THEN piece + 1 ELSE piece END,
          CASE WHEN size + length(l[i + 1]) + 1 > 1200 THEN length(l[i + 1]) + 1 ELSE size + length(l[i + 1]) + 1 END FROM r WHERE i < len(l))
    SELECT section_id, piece, CAST(sum(length(l[i])) + count(*) - 1 AS BIGINT) AS chars FROM r GROUP BY section_id, piece
    UNION ALL SELECT section_id, 1, length(body) FROM t WHERE length(body) <= 1200""")
def split_bodies(spark: SparkSession, d: str) -> DataFrame:
    pieces = sections(spark, d).where("body is not null").select("section_id", F.posexplode(chunking.split_body(F.col("body"))).alias("p", "x"))
    return pieces.select("section_id", (F.col("p") + 1).alias("piece"), F.length("x").cast("long").alias("chars"))


@query(f"""
    WITH RECURSIVE {S}, o AS (SELECT doc_id, seq, section_id, length(coalesce(body, '')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM s),
      r AS (SELECT doc_id, i, section_id, seq, seq AS first_seq, n AS total FROM o WHERE i = 1 UNION ALL
        SELECT o.doc_id, o.i, o.section_id, o.seq, CASE WHEN r.total >= 120 THEN o.seq ELSE r.first_seq END, CASE WHEN r.total >= 120 THEN o.n ELSE r.total + o.n END
        FROM r JOIN o ON o.doc_id = r.doc_id AND o.i = r.i + 1)
    SELECT section_id, first_seq FROM r""")
def section_packs(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.pack_sections(sections(spark, d).select("doc_id", "section_id", "seq", "body"))
    first = rows.groupBy("doc_id", "run", "group").agg(F.min("seq").alias("first_seq"))
    return rows.join(first, ["doc_id", "run", "group"]).select("section_id", "first_seq")


@query(f"""
    WITH RECURSIVE {S}, o AS (SELECT doc_id, seq, section_id, length(coalesce(body, '')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM s),
      r AS (SELECT doc_id, i, section_id, seq, seq AS first_seq, n AS total FROM o WHERE i = 1 UNION ALL
        SELECT o.doc_id, o.i, o.section_id, o.seq, CASE WHEN r.total >= 120 THEN o.seq ELSE r.first_seq END, CASE WHEN r.total >= 120 THEN o.n ELSE r.total + o.n END
        FROM r JOIN o ON o.doc_id = r.doc_id AND o.i = r.i + 1),
      g AS (SELECT r.doc_id, first_seq, string_agg(CASE WHEN r.seq > first_seq AND title IS NOT NULL THEN title || chr(10) ELSE '' END || coalesce(body, ''), chr(10) ORDER BY r.seq) AS body, string_agg(r.section_id, ',' ORDER BY r.seq) AS section_ids,
        min_by(title, r.seq) AS title, min_by(path, r.seq) AS path, min_by(depth, r.seq) AS depth, min_by(start_page, r.seq) AS page, max_by(end_page, r.seq) AS end_page FROM r JOIN s USING (section_id) GROUP BY 1, 2),
      t AS (SELECT doc_id, first_seq, string_split(body, chr(10)) AS l FROM g WHERE length(body) > 1200),
      w AS (SELECT doc_id, first_seq, l, 1 AS i, 0 AS piece, length(l[1]) + 1 AS size FROM t UNION ALL
        SELECT doc_id, first_seq, l, i + 1, CASE WHEN size + length(l[i + 1]) + 1 > 1200 THEN piece + 1 ELSE piece END,
          CASE WHEN size + length(l[i + 1]) + 1 > 1200 THEN length(l[i + 1]) + 1 ELSE size + length(l[i + 1]) + 1 END FROM w WHERE i < len(l)),
      p AS (SELECT doc_id, first_seq, piece, string_agg(l[i], chr(10) ORDER BY i) AS body FROM w GROUP BY 1, 2, 3 UNION ALL SELECT doc_id, first_seq, 0, body FROM g WHERE length(body) <= 1200),
      q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_seq, piece) - 1 AS seq FROM p WHERE trim(translate(body, chr(10) || chr(9) || chr(13), '   ')) <> '')
    SELECT q.doc_id, format('{{}}#c{{:04d}}', q.doc_id, seq) AS chunk_id, seq, section_ids, title, path, depth, page, end_page, q.body, CASE WHEN coalesce(path, '') <> '' THEN path || chr(10) || chr(10) || q.body ELSE q.body END AS text,
      length(q.body) AS char_len, len(regexp_extract_all(q.body, '{TOKEN}')) AS token_len FROM q JOIN g USING (doc_id, first_seq)""")
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = sections(spark, d).select("doc_id", "section_id", "seq", "title", "path", "depth", "start_page", "end_page", "body")
    return chunking.chunk_sections(s).withColumn("section_ids", F.array_join("section_ids", ","))


@query(f"""
    WITH RECURSIVE {B}, o AS (SELECT doc_id, page_index, length(coalesce(text, '')) AS n, trim(translate(coalesce(text, ''), chr(9) || chr(10) || chr(13), '   ')) <> '' AS shown, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, block_order) AS i FROM b),
      r AS (SELECT doc_id, i, page_index, n, shown, 1 AS g, n + 1 AS size FROM o WHERE i = 1 UNION ALL
        SELECT o.doc_id, o.i, o.page_index, o.n, o.shown, CASE WHEN r.size + o.n + 1 > 1200 THEN r.g + 1 ELSE r.g END, CASE WHEN r.size + o.n + 1 > 1200 THEN o.n + 1 ELSE r.size + o.n + 1 END
        FROM r JOIN o ON o.doc_id = r.doc_id AND o.i = r.i + 1),
      k AS (SELECT doc_id, g, first(page_index ORDER BY i) AS page, last(page_index ORDER BY i) AS end_page, CAST(sum(n) + count(*) - 1 AS BIGINT) AS chars FROM r GROUP BY doc_id, g HAVING bool_or(shown))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS seq, page, end_page, chars FROM k""")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_fixed(blocks(spark, d)).select("doc_id", "seq", "page", "end_page", F.length("body").cast("long").alias("chars"))


KEY = f"lower(regexp_replace(text, '[{SPACE}]+', '', 'g'))"
REPEATED = f"""k AS (SELECT doc_id, page_index, block_order, {KEY} AS key FROM b WHERE {KEY} <> ''),
      p AS (SELECT doc_id, key FROM k GROUP BY doc_id, key HAVING count(DISTINCT page_index) >= 3),
      dropped AS (SELECT doc_id, page_index, block_order FROM (SELECT k.*, row_number() OVER (PARTITION BY doc_id, key ORDER BY page_index, block_order) AS rn FROM k JOIN p USING (doc_id, key)) WHERE rn > 1)"""


@query(f"WITH {B}, {REPEATED} SELECT * FROM dropped")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.repeated_lines(blocks(spark, d))


@query(f"WITH {B} SELECT doc_id, {TIER} AS size_bin, CAST(sum(n_chars) AS BIGINT) AS chars FROM b WHERE size IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1, 2")
def size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return layout.size_histogram(blocks(spark, d))


SIZES = f"""h AS (SELECT doc_id, {TIER} AS size_bin, sum(n_chars) AS chars FROM b WHERE size IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1, 2),
      w AS (SELECT *, row_number() OVER o AS rn, sum(chars) OVER (PARTITION BY doc_id ORDER BY chars DESC, size_bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead, sum(chars) OVER (PARTITION BY doc_id) AS total
            FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY chars DESC, size_bin)),
      sizes AS (SELECT doc_id, max(size_bin) FILTER (rn = 1) AS modal_size, max(size_bin) AS ceiling FROM w WHERE rn = 1 OR ahead < 0.8 * total GROUP BY doc_id)"""


@query(f"WITH {B}, {SIZES} SELECT * FROM sizes")
def body_sizes(spark: SparkSession, d: str) -> DataFrame:
    return layout.body_sizes(blocks(spark, d))


def _headings(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    found = layout.headings_by_font(layout.heading_candidates(b, layout.repeated_lines(b)), layout.body_sizes(b))
    return layout.heading_levels(found).withColumn("title", F.col("text"))


WEIGHT = "lower(regexp_replace(fontname, '^[A-Z]{6}\\+', ''))"
HEADINGS = f"""{SIZES}, {REPEATED},
      cand AS (SELECT b.* FROM b ANTI JOIN dropped USING (doc_id, page_index, block_order) WHERE trim(text) <> '' AND NOT regexp_matches(text, '{layout.ONLY_SYMBOL}') AND length(trim(text)) <= 80),
      f AS (SELECT cand.*, CASE WHEN size >= ceiling * 1.05 THEN 'size' WHEN (CASE {' '.join(f"WHEN contains({WEIGHT}, '{p}') THEN {w}" for p, w in layout.FONT_WEIGHTS)} END) >= 5 THEN 'bold' END AS signal FROM cand JOIN sizes USING (doc_id)),
      heads AS (SELECT doc_id, page_index, block_order, text AS title, signal, dense_rank() OVER (PARTITION BY doc_id ORDER BY {TIER} DESC) AS level FROM f WHERE signal IS NOT NULL)"""


@query(f"WITH {B}, {HEADINGS} SELECT * FROM heads")
def font_headings(spark: SparkSession, d: str) -> DataFrame:
    return _headings(spark, d).select(*LINE, "title", "signal", "level")


@query(f"""
    WITH RECURSIVE {B}, {HEADINGS},
      q AS (SELECT *, least(level, 6) AS lv, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, block_order) - 1 AS seq FROM heads),
      up AS (SELECT q.doc_id, q.seq, max(p.seq) AS parent_seq FROM q LEFT JOIN q p ON p.doc_id = q.doc_id AND p.seq < q.seq AND p.lv < q.lv GROUP BY ALL),
      r AS (SELECT q.doc_id, q.seq, q.title AS path, 0 AS depth, up.parent_seq FROM q JOIN up USING (doc_id, seq) WHERE up.parent_seq IS NULL UNION ALL
        SELECT q.doc_id, q.seq, r.path || ' > ' || q.title, r.depth + 1, up.parent_seq FROM r JOIN up ON up.doc_id = r.doc_id AND up.parent_seq = r.seq JOIN q ON q.doc_id = up.doc_id AND q.seq = up.seq),
      m AS (SELECT b.doc_id, b.text, b.page_index, q.seq AS head, sum(CASE WHEN q.seq IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.doc_id ORDER BY b.page_index, b.block_order) AS upto FROM b LEFT JOIN q USING (doc_id, page_index, block_order)),
      y AS (SELECT doc_id, upto - 1 AS seq, max(page_index) AS end_page, count(*) FILTER (head IS NULL) AS block_count, sum(length(coalesce(text, ''))) FILTER (head IS NULL) AS n FROM m WHERE upto > 0 GROUP BY 1, 2)
    SELECT doc_id, CAST(seq AS INTEGER) AS seq, path, depth, CASE WHEN parent_seq IS NOT NULL THEN format('{{}}#s{{:04d}}', doc_id, parent_seq) END AS parent_id, end_page, block_count, CAST(coalesce(n, 0) + greatest(block_count - 1, 0) AS BIGINT) AS chars FROM r JOIN y USING (doc_id, seq)""")
def layout_sections(spark: SparkSession, d: str) -> DataFrame:
    heads = materialize(chunking.section_heads(_headings(spark, d)), "section-heads")
    s = chunking.sections(blocks(spark, d), heads)
    return s.select(
        "doc_id", "seq", "path", "depth", "parent_id", "end_page", F.col("block_count").cast("long").alias("block_count"), F.length("body").cast("long").alias("chars")
    )


def _numbering_sql() -> str:
    """The numberings without look-ahead, which that engine lacks: a letter other than these, or the end, is taken instead."""
    plain = [(p.replace("(?![", "(?:[^").replace("])", "]|$)") if "(?!" in p else p, n) for p, n in layout.NUMBERING]
    each = " UNION ALL ".join(f"SELECT doc_id, page_index, block_order, '{n}' AS pattern, TRY_CAST(nullif(regexp_extract(trim(text), '{p}', 1), '') AS INTEGER) AS ordinal FROM b" for p, n in plain)
    return f"nl AS (SELECT * FROM ({each}) WHERE ordinal BETWEEN 1 AND {layout.MAX_ORDINAL})"


@query(f"""
    WITH {B}, {_numbering_sql()}, st AS (SELECT *, lag(ordinal) OVER o AS before FROM nl WINDOW o AS (PARTITION BY doc_id, pattern ORDER BY page_index, block_order)),
      rn AS (SELECT *, sum(CASE WHEN before IS NULL OR ordinal < before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pattern ORDER BY page_index, block_order) AS run FROM st WHERE before IS NULL OR before <> ordinal),
      lr AS (SELECT doc_id, pattern, max(n) AS longest_run FROM (SELECT doc_id, pattern, run, count(*) AS n FROM rn GROUP BY 1, 2, 3) GROUP BY 1, 2),
      sq AS (SELECT doc_id, pattern, list_distinct(list(ordinal)) AS seen, max(ordinal) AS max_ordinal, count(DISTINCT page_index) AS pages FROM nl GROUP BY 1, 2)
    SELECT doc_id, pattern, len(seen) AS observed, max_ordinal, pages, array_to_string(list_filter(range(1, max_ordinal + 1), lambda x: NOT list_contains(seen, x)), ',') AS missing, longest_run,
      len(seen) >= 3 AND len(seen) / max_ordinal >= 0.5 AND pages >= 3 AND longest_run >= 8 AS usable FROM sq JOIN lr USING (doc_id, pattern)""")
def numbering_sequences(spark: SparkSession, d: str) -> DataFrame:
    return layout.numbering_sequences(blocks(spark, d)).withColumn("missing", F.array_join("missing", ","))


@query(f"""
    WITH {B}, o AS (SELECT DISTINCT doc_id, page_index, unnest(range(CAST(greatest(0, least(159, floor(x0 / 3.825))) AS BIGINT), CAST(greatest(0, least(159, floor(x1 / 3.825))) AS BIGINT) + 1)) AS bin FROM b WHERE x1 >= x0),
      w AS (SELECT *, lead(bin) OVER (PARTITION BY doc_id, page_index ORDER BY bin) AS after FROM o)
    SELECT doc_id, page_index, round((bin + 1) * 3.825, 3) AS lo, round(after * 3.825, 3) AS hi FROM w WHERE (after - bin - 1) * 3.825 >= 3.0""")
def page_gutters(spark: SparkSession, d: str) -> DataFrame:
    return layout.gutters(blocks(spark, d))


@query(f"""
    WITH {B}, p AS (SELECT doc_id, page_index, max(col_index) + 1 AS columns FROM b GROUP BY 1, 2), n AS (SELECT doc_id, columns, count(*) AS n, min(page_index) AS f FROM p GROUP BY 1, 2),
      t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS pages, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rn FROM n)
    SELECT doc_id, CASE WHEN n >= 0.5 * pages THEN columns ELSE 1 END AS columns, CAST(pages AS BIGINT) AS pages FROM t WHERE rn = 1""")
def column_counts(spark: SparkSession, d: str) -> DataFrame:
    return layout.stable_columns(blocks(spark, d).groupBy("doc_id", "page_index").agg((F.max("col_index") + 1).alias("columns")))


GUTTERS = """ob AS (SELECT DISTINCT doc_id, page_index, unnest(range(CAST(greatest(0, least(159, floor(x0 / 3.825))) AS BIGINT), CAST(greatest(0, least(159, floor(x1 / 3.825))) AS BIGINT) + 1)) AS bin FROM b WHERE x1 >= x0),
      gu AS (SELECT doc_id, page_index, round((bin + 1) * 3.825, 3) AS lo, round(after * 3.825, 3) AS hi FROM (SELECT *, lead(bin) OVER (PARTITION BY doc_id, page_index ORDER BY bin) AS after FROM ob) WHERE (after - bin - 1) * 3.825 >= 3.0),
      bi AS (SELECT doc_id, page_index, coalesce(greatest(0.5, median(bottom - top) * 0.6), 1.0) AS bin FROM b WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND bottom IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2),
      co AS (SELECT b.block_id, count(*) FILTER (gu.hi IS NOT NULL AND (b.x0 + b.x1) / 2 >= gu.hi) AS col, coalesce(bool_or(b.x0 < gu.lo AND b.x1 > gu.hi), false) AS crosses FROM b LEFT JOIN gu USING (doc_id, page_index) GROUP BY b.block_id)"""
LINES = f"""{GUTTERS}, pl AS (SELECT b.*, co.col, CAST(round_even(bottom / bin, 0) AS BIGINT) AS row, trim(text) <> '' AS shown, regexp_replace(fontname, '^.*\\+', '') AS font FROM b JOIN bi USING (doc_id, page_index) JOIN co USING (block_id) WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND bottom IS NOT NULL AND text IS NOT NULL),
      ln AS (SELECT doc_id, page_index, col AS "column", row, list(shown ORDER BY x0, block_order) AS sh, list(font ORDER BY x0, block_order) FILTER (shown AND font IS NOT NULL) AS fonts, list(text ORDER BY x0, block_order) AS ts, list(x0 ORDER BY x0, block_order) AS xs, list(x1 ORDER BY x0, block_order) AS es,
        coalesce(median(CASE WHEN x1 > x0 AND length(text) > 0 THEN (x1 - x0) / length(text) END), 1.0) AS width, round(median(CASE WHEN shown THEN size END), 2) AS size, round(min(CASE WHEN shown THEN x0 END), 2) AS x0, round(max(CASE WHEN shown THEN x1 END), 2) AS x1,
        round(min(CASE WHEN shown THEN top END), 2) AS top, round(max(CASE WHEN shown THEN bottom END), 2) AS bottom, CAST(sum(length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g'))) AS BIGINT) AS n_chars, count(*) FILTER (shown) AS pieces FROM pl GROUP BY 1, 2, 3, 4),
      lines AS (SELECT doc_id, page_index, "column", row, trim(regexp_replace(array_to_string(list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN i > 1 AND xs[i] - es[i - 1] > 0.3 * width AND NOT regexp_matches(ts[i - 1], '[ \t\n\x0B\f\r]$') AND NOT regexp_matches(ts[i], '^[ \t\n\x0B\f\r]') AND i > 1 THEN ' ' ELSE '' END || ts[i]), ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text,
        size, coalesce(list_transform(list_sort(list_transform(range(1, len(fonts) + 1), lambda i: {{'n': -len(list_filter(fonts, lambda f: f = fonts[i])), 'i': i}})), lambda z: fonts[z.i])[1], '') AS fontname, x0, x1, top, bottom, n_chars, pieces FROM ln WHERE n_chars > 0)"""


@query(f"WITH {B}, {LINES} SELECT * FROM lines")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the positioned pieces of every page: by column and row, with spaces at gaps, and the dominant font."""
    b = blocks(spark, d)
    return layout.build_lines(b, layout.gutters(b))


@query(f"WITH {B}, bb AS (SELECT *, median(bottom - top) OVER (PARTITION BY doc_id, page_index) AS m FROM b) SELECT block_id, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY round_even((top + bottom) / 2 / coalesce(greatest(0.5, m * 0.6), 1.0), 0) NULLS FIRST, x0 NULLS FIRST, block_order) AS place FROM bb")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(blocks(spark, d)).select("block_id", "place")


@query(f"WITH {B}, t AS (SELECT doc_id, max(bottom) AS h FROM b GROUP BY 1) SELECT block_id FROM b JOIN t USING (doc_id) WHERE top BETWEEN 0.08 * h AND 0.92 * h")
def band_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines between the running heads and feet: within the middle 84 per cent of the height."""
    return layout.in_band(blocks(spark, d), 0.08, 0.92).select("block_id")


@query(f"""WITH {B}, f AS (SELECT doc_id, regexp_replace(fontname, '^.*\\+', '') AS font, size, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS chars FROM b WHERE fontname IS NOT NULL AND size IS NOT NULL GROUP BY 1, 2, 3)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, font, size) AS rank FROM f) WHERE rank <= 6""")
def top_fonts(spark: SparkSession, d: str) -> DataFrame:
    return layout.top_fonts(blocks(spark, d))


@query(f"WITH {B} SELECT doc_id, count(*) AS pieces, round(avg(CASE WHEN (CASE {' '.join(f"WHEN contains({WEIGHT}, '{p}') THEN {w}" for p, w in layout.FONT_WEIGHTS)} END) IS NULL THEN 0 ELSE 1 END), 6) AS known FROM b GROUP BY 1")
def weight_coverage(spark: SparkSession, d: str) -> DataFrame:
    return layout.weight_coverage(blocks(spark, d)).withColumn("known", F.round("known", 6))


@query(f"""
    WITH {B}, {SIZES}, {LINES}, a AS (SELECT doc_id, count(*) AS pieces, count(*) FILTER (crosses) AS crossing, round(avg(n_chars), 3) AS mean_chars FROM b LEFT JOIN co USING (block_id) GROUP BY 1), l AS (SELECT doc_id, count(*) AS lines FROM lines GROUP BY 1)
    SELECT doc_id, pieces, coalesce(lines, 0) AS lines, pieces - coalesce(lines, 0) AS joined, crossing, mean_chars, modal_size FROM a LEFT JOIN l USING (doc_id) LEFT JOIN sizes USING (doc_id)""")
def document_audit(spark: SparkSession, d: str) -> DataFrame:
    """By document: pieces, lines that they make, the difference, pieces across a gutter, mean characters, commonest size."""
    b = blocks(spark, d)
    gaps = layout.gutters(b)
    pieces = layout.with_columns(b, gaps).groupBy("doc_id").agg(F.count("*").alias("pieces"), F.count_if("crosses").alias("crossing"), F.round(F.avg("n_chars"), 3).alias("mean_chars"))
    lines = layout.build_lines(b, gaps).groupBy("doc_id").agg(F.count("*").alias("lines"))
    joined = pieces.join(lines, "doc_id", "left").join(layout.body_sizes(b).select("doc_id", "modal_size"), "doc_id", "left").na.fill(0, ["lines"])
    return joined.select("doc_id", "pieces", "lines", (F.col("pieces") - F.col("lines")).alias("joined"), "crossing", "mean_chars", "modal_size")


@query(f"""
    WITH {B}, t AS (SELECT doc_id, length(text) AS n, len(list_filter(range(1, length(text)), lambda i: text[i] = text[i + 1] AND regexp_matches(text[i], '^\\p{{L}}$'))) AS pairs FROM b WHERE text IS NOT NULL)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS chars, CASE WHEN sum(n) >= 20 THEN round(sum(pairs) / sum(greatest(n - 1, 0)), 6) ELSE 0 END AS doubled FROM t GROUP BY doc_id""")
def doubled_ratio(spark: SparkSession, d: str) -> DataFrame:
    return layout.doubled_ratio(blocks(spark, d)).select("doc_id", "chars", F.round("doubled", 6).alias("doubled"))


@query("""
    SELECT doc_id, CASE WHEN sum(length(text)) > 0 THEN round(sum(length(text) - length(replace(text, '�', '')) + length(text) - length(regexp_replace(text, '\\(cid:[0-9]+\\)', '', 'g'))) / sum(length(text)), 6) ELSE 1 END AS unreadable,
      CASE WHEN sum(length(text)) > 0 THEN round(sum(length(text) - length(replace(text, ' ', ''))) / sum(length(text)), 6) ELSE 0 END AS spaces
    FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY doc_id""")
def page_quality(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    n = F.sum(F.length("text"))
    bad = F.sum(2 * F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit(""))) - F.length(F.regexp_replace("text", r"\(cid:[0-9]+\)", "")))
    space = F.sum(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))))
    return t.groupBy("doc_id").agg(F.when(n > 0, F.round(bad / n, 6)).otherwise(1.0).alias("unreadable"), F.when(n > 0, F.round(space / n, 6)).otherwise(0.0).alias("spaces"))
