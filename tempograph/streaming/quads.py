"""Events as a stream of quads: windowed counts with late data, and rule heads predicted from a static background."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def quad_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet events as they arrive: (sub, rel, obj, at)."""
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return events.select(F.col("user_id").alias("sub"), F.col("event_type").alias("rel"), F.get_json_object("props", "$.k").cast("long").alias("obj"), F.col("ts").cast("timestamp").alias("at"))


def windowed_counts(quads: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Facts per relation and window; state older than the watermark is dropped."""
    return quads.withWatermark("at", late).groupBy(F.window("at", width), "rel").agg(F.count(F.lit(1)).alias("n"))


def triggered(quads: DataFrame, rules: DataFrame) -> DataFrame:
    """Stream-static join: one-atom rules whose body a fact matches, with the head that it predicts."""
    single = rules.where(F.size("body_rels") == 1).select("rule_id", "head_rel", F.col("body_rels")[0].alias("rel"), "conf")
    return quads.join(single, "rel").select("sub", F.col("head_rel").alias("rel"), "obj", "at", "rule_id", "conf")
