"""Canonical tables (lumenspar.model) from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar import model
from lumenspar.functions import sketch
from lumenspar.sources.tables import table

HOUR = 3600
KINDS = {"app.event.count": "count", "app.event.value": "gauge", "app.event.rate": "rate", "app.event.dist": "distribution", "app.price.bucket": "count"}


def events(spark: SparkSession, d: str) -> DataFrame:
    """events with ts_s, ts_ms and the shard, tier and service the samples and logs are tagged with."""
    e = table(spark, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    u = F.col("user_id")
    return e.select("event_id", "user_id", "event_type", "value", "props", ms.alias("ts_ms"), F.floor(ms / 1000).cast("bigint").alias("ts_s"), F.concat(F.lit("u"), (u % 8).cast("string")).alias("shard"), F.when(u % 8 < 2, "gold").alias("tier"), F.concat(F.lit("svc-"), (u % 4).cast("string")).alias("service"))


def _tagged(df: DataFrame) -> DataFrame:
    t = model.tags(shard=F.col("shard"), tier=F.col("tier"), type=F.col("event_type"))
    return df.withColumn("tags", t).withColumn("series_key", model.series_key(F.col("metric"), F.col("tags")))


def metric_samples(spark: SparkSession, d: str, interval: int = HOUR) -> DataFrame:
    """app.event.count (events per interval), app.event.rate (per second) and app.event.value (last value)."""
    e = events(spark, d).withColumn("ts_s", F.col("ts_s") - F.pmod(F.col("ts_s"), F.lit(interval)))
    a = e.groupBy("event_type", "shard", "tier", "ts_s").agg(F.count("*").cast("double").alias("n"), F.max_by("value", "event_id").alias("last"))
    m = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in (("app.event.count", F.col("n")), ("app.event.rate", F.col("n") / interval), ("app.event.value", F.col("last"))))))
    return _tagged(a.select("event_type", "shard", "tier", "ts_s", m.alias("m")).select("event_type", "shard", "tier", "ts_s", "m.metric", "m.value")).select("metric", "tags", "series_key", "ts_s", "value")


def sketches(spark: SparkSession, d: str, interval: int = HOUR) -> tuple[DataFrame, DataFrame]:
    """(sketch_bins, sketch_points) of events.value as app.event.dist."""
    e = _tagged(events(spark, d).withColumn("ts_s", F.col("ts_s") - F.pmod(F.col("ts_s"), F.lit(interval))).withColumn("metric", F.lit("app.event.dist")))
    keys = ["metric", "tags", "series_key", "ts_s"]
    return sketch.bins(e, keys, "value"), sketch.exact(e, keys, "value").withColumn("gamma", F.lit(sketch.GAMMA))


def price_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative buckets of lineitem prices per ship day as app.price.bucket, tagged flag and upper_bound."""
    bounds = [1000.0, 5000.0, 10000.0, 20000.0, 40000.0, 60000.0]
    li = table(spark, d, "lineitem").select(F.unix_timestamp(F.to_date("l_shipdate").cast("timestamp")).alias("ts_s"), F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("p"))
    c = li.groupBy("flag", "ts_s").agg(*(F.count_if(F.col("p") <= b).cast("double").alias(f"c{i}") for i, b in enumerate(bounds)), F.count("*").cast("double").alias("call"))
    e = c.select("flag", "ts_s", F.explode(F.array(*(F.struct(F.lit(str(b)).alias("u"), F.col(f"c{i}").alias("value")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("u"), F.col("call").alias("value")))).alias("x"))
    s = e.select(F.lit("app.price.bucket").alias("metric"), model.tags(flag=F.col("flag"), upper_bound=F.col("x.u")).alias("tags"), "ts_s", F.col("x.value").alias("value"))
    return s.withColumn("series_key", model.series_key(F.col("metric"), F.col("tags"))).select("metric", "tags", "series_key", "ts_s", "value")


def event_logs(spark: SparkSession, d: str) -> DataFrame:
    """events as logs: one log per event."""
    return events(spark, d).select(F.col("event_id").alias("seq"), F.col("ts_ms").alias("ts"), F.concat_ws(" ", "event_type", F.lit("by user"), F.col("user_id").cast("string")).alias("message"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("status"), "service", F.lit("app").alias("source"), F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"), F.array(F.lit("env:prod"), F.concat(F.lit("shard:"), "shard")).alias("tags"), F.col("props").alias("attrs"), F.lit(None).cast("string").alias("trace_id"), F.lit(None).cast("string").alias("span_id"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """orders joined with lineitem as traces: a root span per order, a child per line; children are numbered by a total
    order of all columns, since the natural key repeats."""
    from pyspark.sql import Window

    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 1000
    hexid = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    root = o.select(hexid(F.col("o_orderkey") + 1, 32).alias("trace_id"), hexid(F.col("o_orderkey") + 1, 16).alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("shop").alias("service"), F.lit("http.request").alias("name"), F.concat(F.lit("GET /orders/"), F.col("o_orderpriority")).alias("resource"), F.lit("web").alias("type"), start.alias("start"), (F.floor(F.col("o_totalprice")) * 10).cast("bigint").alias("duration"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("error"), F.create_map(F.lit("http.status_code"), F.when(F.col("o_orderstatus") == "P", "500").otherwise("200"), F.lit("env"), F.lit("prod")).alias("meta"), F.create_map(F.lit("_top_level"), F.lit(1.0)).alias("metrics"))
    order = Window.partitionBy("l_orderkey").orderBy(*(F.col(c) for c in li.columns if c != "l_orderkey"))
    n = li.withColumn("n", F.row_number().over(order)).join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    child = n.select(hexid(F.col("l_orderkey") + 1, 32).alias("trace_id"), F.concat(hexid(F.col("n"), 4), hexid(F.col("l_orderkey") + 1, 12)).alias("span_id"), hexid(F.col("l_orderkey") + 1, 16).alias("parent_id"), F.concat(F.lit("supplier-"), (F.col("l_suppkey") % 5).cast("string")).alias("service"), F.lit("supplier.pick").alias("name"), F.concat(F.lit("part "), (F.col("l_partkey") % 10).cast("string")).alias("resource"), F.lit("worker").alias("type"), (start + F.col("n") * 100).alias("start"), (F.col("l_quantity") * 1000).cast("bigint").alias("duration"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("error"), F.create_map(F.lit("env"), F.lit("prod")).alias("meta"), F.create_map(F.lit("_top_level"), F.lit(1.0)).alias("metrics"))
    return root.unionByName(child)
