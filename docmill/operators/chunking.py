"""From headed lines to sections and chunks.

What depends on everything ahead of it (paths of headings, packing) is cut at places where its state is known again,
so that no task gets a whole document unless the document has no such place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions.text import SPACE, token_count
from docmill.sources.tables import materialize

#: Characters of a chunk at most, and of a group of short sections at least; sections per block of a running number, and lines per block of a document without headings.
MAX_CHARS, MIN_CHARS, BLOCK, LINES = 1200, 120, 4096, 4096


def running_number(df: DataFrame, group: str, order: list[str], value: Column, out: str, parts: str) -> DataFrame:
    """``df`` with the running sum of ``value`` in ``order`` within ``group``, in two steps: within parts (a column that ascends with the order, such as the page), and over the sums of the parts.

    A group as large as a third of all rows is so spread over as many tasks as it has parts.
    """
    inner = Window.partitionBy(group, parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(group, parts).agg(F.sum(value).alias("__sum"))
    offsets = sums.select(group, parts, F.coalesce(F.sum("__sum").over(Window.partitionBy(group).orderBy(parts).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    return df.withColumn("__own", F.sum(value).over(inner)).join(offsets, [group, parts]).withColumn(out, (F.col("__own") + F.col("__ahead")).cast("long")).drop("__own", "__ahead")


def section_heads(headings: DataFrame, top: int = 6) -> DataFrame:
    """Paths of headings (doc_id, page_index, block_order, title, level): seq, path, depth, parent seq.

    An ancestor of a heading is the last heading of a lower level ahead of it that no heading of a level lower still has ended
    since. For each level that is one running maximum, taken in two steps like :func:`running_number` (within a page, and over the pages' last headings), so
    the stack is ``top`` columns instead of a loop, and a document's headings are spread over its pages; levels beyond ``top`` count as ``top``.
    """
    rows = headings.withColumn("level", F.least("level", F.lit(top)))
    rows = materialize(running_number(rows, "doc_id", ["page_index", "block_order"], F.lit(1), "seq", "page_index").withColumn("seq", (F.col("seq") - 1).cast("int")), "heads")
    of = {k: F.max(F.when(F.col("level") == k, F.struct("seq", "title"))) for k in range(1, top + 1)}
    pages = rows.groupBy("doc_id", "page_index").agg(*(c.alias(f"__p{k}") for k, c in of.items()))
    before = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.select("doc_id", "page_index", *(F.max(f"__p{k}").over(before).alias(f"__p{k}") for k in of))
    ahead = Window.partitionBy("doc_id", "page_index").orderBy("block_order").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__o{k}": c.over(ahead) for k, c in of.items()}).join(pages, ["doc_id", "page_index"])
    rows = rows.withColumns({f"__l{k}": F.coalesce(f"__o{k}", f"__p{k}") for k in of})
    # an ancestor of level k counts if it is below the heading's level and came after every ancestor of a lower level
    chain = F.filter(
        F.array(*(F.when((F.lit(k) < F.col("level")) & F.greatest(*(F.coalesce(F.col(f"__l{j}.seq"), F.lit(-1)) for j in range(1, k)), F.lit(-1), F.lit(-1)).__lt__(F.coalesce(F.col(f"__l{k}.seq"), F.lit(-1))), F.col(f"__l{k}")) for k in range(1, top + 1))),
        lambda x: x.isNotNull(),
    )
    return rows.withColumn("chain", chain).select(
        "doc_id", "page_index", "block_order", "title", "level", "seq",
        F.array_join(F.concat(F.transform("chain", lambda x: x["title"]), F.array("title")), " > ").alias("path"),
        F.size("chain").alias("depth"),
        F.try_element_at("chain", F.lit(-1))["seq"].alias("parent_seq"),
    )


def sections(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Sections of headed lines: a heading, and as body the lines up to the next. Lines ahead of the first heading belong to none."""
    keys = ["doc_id", "page_index", "block_order"]
    marked = lines.select(*keys, "text").join(heads.select(*keys, F.col("seq").alias("head")), keys, "left")
    numbered = running_number(marked, "doc_id", keys[1:], F.when(F.col("head").isNotNull(), 1).otherwise(0), "upto", "page_index").where("upto > 0")
    body = (
        numbered.withColumn("seq", (F.col("upto") - 1).cast("int"))
        .groupBy("doc_id", "seq")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("page_index", "block_order", "text")))).alias("b"),  # one section
            F.max("page_index").alias("end_page"),
        )
    )
    section_id = F.format_string("%s#s%04d", "doc_id", "seq")
    return heads.join(body, ["doc_id", "seq"]).select(
        "doc_id", section_id.alias("section_id"), "seq", "title", "path", "depth",
        F.when(F.col("parent_seq").isNotNull(), F.format_string("%s#s%04d", "doc_id", "parent_seq")).alias("parent_id"),
        F.col("page_index").alias("start_page"), "end_page",
        F.array_join(F.transform("b", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("body"), F.size("b").alias("block_count"),
    )


def split_body(body: Column, limit: int = MAX_CHARS) -> Column:
    """Array of pieces: the whole body if it fits, else lines packed greedily, a line counting one more than its length; a longer line is a piece of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def step(a: Column, line: Column) -> Column:
        full = (F.size(a["open"]) > 0) & (a["size"] + F.length(line) + 1 > limit)
        return F.struct(
            F.when(full, F.array_append(a["done"], F.array_join(a["open"], "\n"))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(line)).otherwise(F.array_append(a["open"], line)).alias("open"),
            F.when(full, F.length(line) + 1).otherwise(a["size"] + F.length(line) + 1).alias("size"),
        )

    packed = F.aggregate(F.split(body, "\n"), empty, step, lambda a: F.array_append(a["done"], F.array_join(a["open"], "\n")))
    return F.when(F.length(body) <= limit, F.array(body)).otherwise(packed)


def pack_sections(rows: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Number of the group of each section (doc_id, seq, ...): consecutive sections are grouped until their bodies have ``least`` characters.

    A section that long ends its group whatever came before, so the runs between such sections are independent: they are packed
    each in a fold of its own. Null bodies count as empty.
    """
    size = F.length(F.coalesce("body", F.lit("")))
    rows = rows.withColumn("__size", size).withColumn("__part", F.floor(F.col("seq") / BLOCK))
    rows = running_number(rows, "doc_id", ["seq"], F.when(F.col("__size") >= least, 1).otherwise(0), "__upto", "__part")
    rows = rows.withColumn("run", F.col("__upto") - F.when(F.col("__size") >= least, 1).otherwise(0))
    sizes = F.array_sort(F.collect_list(F.struct("seq", F.col("__size").alias("n"))))

    def step(a: Column, x: Column) -> Column:
        total = a["total"] + x["n"]
        return F.struct(F.when(total >= least, 0).otherwise(total).alias("total"), F.when(total >= least, a["group"] + 1).otherwise(a["group"]).alias("group"), F.array_append(a["out"], F.struct(x["seq"].alias("seq"), a["group"].alias("group"))).alias("out"))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("group"), F.array().cast("array<struct<seq:int,group:int>>").alias("out"))
    packed = rows.groupBy("doc_id", "run").agg(sizes.alias("s")).select("doc_id", "run", F.inline(F.aggregate("s", start, step, lambda a: a["out"])))
    return rows.drop("__size", "__part", "__upto").join(packed, ["doc_id", "run", "seq"])


def chunk_sections(rows: DataFrame, limit: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    """Chunks of sections: groups of short ones, the rest as they are, long ones split. Blank pieces are left out.

    Within a group the bodies follow each other with the titles of all but the first. A chunk has the first section's title, path
    and page and the last one's end page; ``text`` has the path ahead of the body.
    """
    grouped = pack_sections(rows, least).groupBy("doc_id", "run", "group").agg(F.array_sort(F.collect_list(F.struct("seq", "section_id", "title", "path", "depth", "start_page", "end_page", F.coalesce("body", F.lit("")).alias("body")))).alias("g"))
    body = F.array_join(F.flatten(F.transform("g", lambda x, i: F.when(i == 0, F.array(x["body"])).otherwise(F.array(x["title"], x["body"])))), "\n")
    pieces = grouped.select(
        "doc_id", "g", F.posexplode(split_body(body, limit)).alias("piece", "body")
    ).where(F.trim(F.translate("body", "\n\t\r", "   ")) != "")
    first, last = F.col("g")[0], F.element_at("g", -1)
    numbered = (
        pieces.select("doc_id", first["seq"].alias("first_seq"), "piece", F.transform("g", lambda x: x["section_id"]).alias("section_ids"), first["title"].alias("title"), first["path"].alias("path"), first["depth"].alias("depth"), first["start_page"].alias("page"), last["end_page"].alias("end_page"), "body")
        .withColumn("__part", F.floor(F.col("first_seq") / BLOCK))
    )
    numbered = running_number(numbered, "doc_id", ["first_seq", "piece"], F.lit(1), "seq", "__part").withColumn("seq", (F.col("seq") - 1).cast("int"))
    return numbered.select(
            "doc_id", F.format_string("%s#c%04d", "doc_id", "seq").alias("chunk_id"), "seq", "section_ids", "title", "path", "depth", "page", "end_page", "body",
            F.when(F.coalesce("path", F.lit("")) != "", F.concat("path", F.lit("\n\n"), "body")).otherwise(F.col("body")).alias("text"),
            F.length("body").alias("char_len"), token_count(F.col("body")).alias("token_len"),
    )


def chunk_fixed(lines: DataFrame, limit: int = MAX_CHARS, block_lines: int = LINES) -> DataFrame:
    """Chunks of lines without headings: doc_id, seq, page, end_page, body; lines in reading order until the next would exceed the limit. Blank chunks are left out and not counted.

    Each break depends on all before it, but only through the line at which the open chunk began. So a document's lines are cut into blocks, and a
    task finds for its block where a chunk that begins at any of the first lines of the block would break, up to the first break in the next
    block. As a chunk has ``limit`` characters and each line counts one at least, that is at most ``limit`` entries a block and no chunk spans three (``block_lines`` must exceed ``limit``). What remains of a
    document is a walk over its blocks, a few numbers each; then every block makes its own chunks. No task gets a document's lines.
    """
    if block_lines <= limit:
        raise ValueError("a block must have more lines than a chunk may have characters")
    keys = ["page_index", "block_order"]
    rows = running_number(lines.select("doc_id", *keys, F.coalesce("text", F.lit("")).alias("text")), "doc_id", keys, F.lit(1), "line", "page_index")
    rows = materialize(rows.select("doc_id", (F.col("line") - 1).alias("line"), "page_index", "text", F.floor((F.col("line") - 1) / block_lines).alias("block")), "lines")
    sizes = rows.select("doc_id", "block", "line", F.length("text").alias("n"))
    # a block sees the first lines of the next one, so that it can say where a chunk that is open at its end breaks
    seen = sizes.unionAll(sizes.where((F.col("block") > 0) & (F.col("line") % block_lines <= limit)).withColumn("block", F.col("block") - 1))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        line, ends = pdf["line"].to_numpy(), np.cumsum(pdf["n"].to_numpy() + 1)
        doc, block = pdf["doc_id"].iat[0], int(pdf["block"].iat[0])
        starts = ends - (pdf["n"].to_numpy() + 1)
        after = np.maximum(np.searchsorted(ends, starts + limit, side="right"), np.arange(len(line)) + 1)  # the line at which a chunk begun here breaks
        own = int((line < (block + 1) * block_lines).sum())
        out = np.arange(len(line) + 1)
        for i in range(own - 1, -1, -1):
            out[i] = out[after[i]] if after[i] < own else after[i]
        first = min(own, limit + 1)
        return pd.DataFrame({"doc_id": doc, "block": block, "exits": [(line[0] + out[:first]).tolist()]})

    ways = seen.groupBy("doc_id", "block").applyInPandas(exits, "doc_id string, block long, exits array<long>")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, found = 0, []
        for block, ends in zip(*(pdf.sort_values("block")[c] for c in ("block", "exits"))):
            found.append((pdf["doc_id"].iat[0], int(block), int(entry)))
            at = entry - int(block) * block_lines
            entry = int(ends[at]) if at < len(ends) else entry
        return pd.DataFrame(found, columns=["doc_id", "block", "entry"])

    entries = ways.groupBy("doc_id").applyInPandas(walk, "doc_id string, block long, entry long")

    def breaks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        entry, line, size = int(pdf["entry"].iat[0]), pdf["line"].to_numpy(), pdf["n"].to_numpy() + 1
        begun, held, out = -1, 0, np.full(len(line), -1, dtype=np.int64)
        for i in range(len(line)):
            if line[i] < entry:
                continue  # it belongs to the chunk that an earlier block began
            if begun < 0 or held + size[i] > limit:
                begun, held = line[i], 0
            held += size[i]
            out[i] = begun
        return pd.DataFrame({"doc_id": pdf["doc_id"], "line": line, "begun": out})

    begun = sizes.join(entries, ["doc_id", "block"]).groupBy("doc_id", "block").applyInPandas(breaks, "doc_id string, line long, begun long")
    # lines ahead of a block's entry belong to the last chunk that began before
    last = begun.where("begun >= 0").groupBy("doc_id", F.floor(F.col("line") / block_lines).alias("block")).agg(F.max("begun").alias("last"))
    carried = last.select("doc_id", (F.col("block") + 1).alias("block"), F.col("last"))
    owned = rows.join(begun, ["doc_id", "line"]).join(carried, ["doc_id", "block"], "left").withColumn("begun", F.when(F.col("begun") < 0, F.col("last")).otherwise(F.col("begun")))
    made = owned.groupBy("doc_id", "begun").agg(F.array_sort(F.collect_list(F.struct("line", "page_index", "text"))).alias("l"))  # one chunk
    body = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    shown = made.select("doc_id", "begun", F.col("l")[0]["page_index"].cast("int").alias("page"), F.element_at("l", -1)["page_index"].cast("int").alias("end_page"), body.alias("body")).where(~F.col("body").rlike(rf"^[{SPACE}]*$"))
    shown = shown.withColumn("__part", F.floor(F.col("begun") / block_lines))
    return running_number(shown, "doc_id", ["begun"], F.lit(1), "seq", "__part").select("doc_id", (F.col("seq") - 1).cast("int").alias("seq"), "page", "end_page", "body")


def chunk_report(chunks: DataFrame, sections_: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """By document: chunks, upper median and largest length, chunks beyond the limit, sections without body, sections that no chunk covers."""
    size = F.length("body")
    by = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"),
        F.expr("percentile_disc(0.5000001) within group (order by length(body))").cast("long").alias("median_len"),
        F.max(size).cast("long").alias("max_len"),
        F.count_if(size > limit).alias("oversize"),
    )
    covered = chunks.select("doc_id", F.explode("section_ids").alias("section_id")).distinct()
    lost = sections_.join(covered, ["doc_id", "section_id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("uncovered"))
    blank = sections_.groupBy("doc_id").agg(F.count_if(F.trim(F.coalesce("body", F.lit(""))) == "").alias("empty_sections"))
    return by.join(blank, "doc_id", "left").join(lost, "doc_id", "left").na.fill(0, ["empty_sections", "uncovered"])
