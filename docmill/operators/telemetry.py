"""Rollups over traces of runs: stage durations, slowest stages, summaries, token costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stage_durations(events: DataFrame) -> DataFrame:
    """Seconds from each event of a trace (trace, event_id, ts) to the next; null for the last."""
    order = Window.partitionBy("trace").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.withColumn("seconds", F.lead(micros).over(order) / 1e6 - micros / 1e6)


def span_rollup(spans: DataFrame, k: int = 5) -> DataFrame:
    """By trace the seconds by category, and their share; the k slowest categories of each trace, ties by name."""
    by = spans.groupBy("trace", "category").agg(F.round(F.sum("seconds"), 6).alias("seconds"), F.count("*").alias("spans"))
    order = Window.partitionBy("trace").orderBy(F.desc("seconds"), "category")
    return by.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def run_summary(rows: DataFrame, by: str) -> DataFrame:
    """Count, mean, nearest-rank 95th percentile, largest and sum of ``value``. Null values are left out."""
    return rows.where("value is not null").groupBy(by).agg(
        F.count("*").alias("n"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"),
        F.max("value").alias("largest"),
        F.round(F.sum("value"), 4).alias("total"),
    )
