"""Readers of the parquet tables the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record_times(spark: SparkSession, sf_dir: str, topic: str = "series") -> DataFrame:
    """(rec_offset, arrival in us) of each record of a topic; repeated deliveries give one row."""
    q = table(spark, sf_dir, "queue_records").where((F.col("topic") == topic) & F.col("rec_offset").isNotNull())
    return q.groupBy("rec_offset").agg(F.min(F.unix_micros("rec_time")).alias("arrival"))


def arrived_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples with a value, with the arrival time of the record that carried them."""
    s = table(spark, sf_dir, "samples").where(F.col("v").isNotNull() & F.col("t").isNotNull())
    return s.join(record_times(spark, sf_dir), "rec_offset")


def series_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per series id: metric, type, unit, step_s. Repeated rows of an id fall together."""
    m = table(spark, sf_dir, "metric_meta").select("metric", "type", "unit", "step_s").dropDuplicates(["metric"])
    s = table(spark, sf_dir, "series").groupBy(F.col("id").alias("series_id")).agg(F.min("metric").alias("metric"))
    return s.join(F.broadcast(m), "metric")  # a metric catalogue: one row per metric name, not per series
