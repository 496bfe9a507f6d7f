"""The run log as a stream: JSON lines appended, windows of finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "finished_at timestamp, topic string, engine string, input long, cached long, output long, duration_ms long, audit_status string"


def append(runs: DataFrame, path: str) -> None:
    """K6."""
    runs.write.mode("append").json(path)


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def daily(runs: DataFrame, late: str = "2 days") -> DataFrame:
    """Runs a day, their tokens, minutes and worst status. Works
    on a stream and on a table alike; late rows are kept for ``late``."""
    marked = runs.withWatermark("finished_at", late) if runs.isStreaming else runs
    return marked.groupBy(F.window("finished_at", "1 day").alias("w"), "topic").agg(F.count(F.lit(1)).alias("runs"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.round(F.sum("duration_ms") / 60000, 1).alias("minutes"), F.max(F.when(F.col("audit_status") == "fail", 1).otherwise(0)).alias("failed")).select(F.col("w.start").alias("day"), "topic", "runs", "input", "output", "minutes", "failed")


def usage(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls (input, cached, output, failed) summed up: tokens of each kind,
    agents and how many of them failed."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return calls.groupBy(*keys).agg(total("input"), total("cached"), total("output"), F.count(F.lit(1)).alias("agents"), F.count_if("failed").alias("failed"))


def stage_times(marks: DataFrame, *keys: str) -> DataFrame:
    """Marks (stage, at in milliseconds, status, meta) -> each stage's first
    start, last end, duration (none below zero) and the meta of all its marks,
    of which a later one wins."""
    began = F.min(F.when(F.col("status") == "start", F.col("at")))
    ended = F.max(F.when(F.col("status") != "start", F.col("at")))
    spans = marks.groupBy(*keys, "stage").agg(began.alias("started"), ended.alias("ended"))
    entries = marks.select(*keys, "stage", "at", F.explode("meta").alias("k", "v")).groupBy(*keys, "stage", "k").agg(F.max_by("v", "at").alias("v"))
    metas = entries.groupBy(*keys, "stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("meta"))
    return spans.join(metas, [*keys, "stage"], "left").withColumn("ms", F.greatest(F.lit(0).cast("long"), F.col("ended") - F.col("started")))
