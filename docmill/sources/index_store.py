"""The index as a partitioned table: bulk write, replacement of a document, upsert of columns, removal of stale rows, cache of model output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def join_payload(chunks: DataFrame, vectors: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Index rows of chunks with their vectors (chunk_id, embedding) and generated queries (chunk_id, queries array).

    A chunk without vector, or with one of zeros alone, has a null embedding; queries are joined by line breaks.
    """
    usable = F.when(F.exists("embedding", lambda x: x != 0), F.col("embedding"))
    out = chunks.join(vectors.select("chunk_id", usable.alias("embedding")), "chunk_id", "left")
    if queries is not None:
        out = out.join(queries.select("chunk_id", F.array_join("queries", "\n").alias("queries")), "chunk_id", "left")
    return out


def replace_documents(rows: DataFrame, path: str) -> None:
    """Write index rows by document; documents that ``rows`` has are replaced as a whole, others stay. Nothing changes if the write fails."""
    rows.write.mode("overwrite").partitionBy("doc_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_index(spark: SparkSession, path: str, docs: list[str] | None = None, vectors: bool = False) -> DataFrame:
    """The index, without vectors unless asked for. An empty or missing list of documents means all of them."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    rows = rows.where(F.col("doc_id").isin(docs)) if docs else rows
    return rows if vectors else rows.drop("embedding", "context_embedding")


def with_columns(rows: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``update`` merged in by key: new values win, rows without any keep theirs. A key must be in ``update`` once."""
    new = [c for c in update.columns if c != key]
    joined = rows.join(update.select(key, *(F.col(c).alias(f"__new_{c}") for c in new)), key, "left")
    for c in new:
        joined = joined.withColumn(c, F.coalesce(F.col(f"__new_{c}"), F.col(c)) if c in rows.columns else F.col(f"__new_{c}"))
    return joined.drop(*(f"__new_{c}" for c in new))


def without_stale(rows: DataFrame, keep: DataFrame, key: str, scope: str) -> DataFrame:
    """Rows without those that their scope no longer has. Scopes that ``keep`` lacks altogether stay."""
    seen = keep.select(scope).distinct().withColumn("__seen", F.lit(True))
    live = keep.select(key).distinct().withColumn("__live", F.lit(True))
    return rows.join(seen, scope, "left").join(live, key, "left").where("__seen is null or __live is not null").drop("__seen", "__live")


def cache_key(*columns: str):
    """Fingerprint of what a model was asked."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def cache_misses(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key, ...) that the cache lacks, each once."""
    return asked.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def manifest(rows: DataFrame) -> DataFrame:
    """One row for each document of the index (doc_id, page, chunk_id, ...): version, pages, chunks."""
    return rows.groupBy("doc_id").agg(F.lit(VERSION).alias("version"), F.count_distinct("page").alias("pages"), F.count_distinct("chunk_id").alias("chunks"))


def unfinished(rows: DataFrame, written: DataFrame) -> DataFrame:
    """Documents (doc_id) of the index that a written manifest lacks, or holds in another version or with other numbers: those to index again."""
    same = written.where(F.col("version") == VERSION)
    return manifest(rows).join(same, ["doc_id", "version", "pages", "chunks"], "left_anti").select("doc_id")
