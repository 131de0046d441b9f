"""Streams: telemetry by the hour, and an inbox of index rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.sources.index_store import replace_documents
from docmill.sources.tables import shared_dir


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour and type with a watermark; works on a stream and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    by = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


def run_hourly(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """Run the hourly stream over the files that are there now and read the result."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    out = f"{shared_dir(spark).rstrip('/')}/hourly-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    run = hourly(source).writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).drop("batch")


def watch_inbox(spark: SparkSession, inbox: str, index: str, checkpoint: str, schema):
    """Replace the documents of each arriving file of index rows in the index. Returns the running query."""
    rows = spark.readStream.schema(schema).parquet(inbox)
    return rows.writeStream.foreachBatch(lambda batch, _: replace_documents(batch, index)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
