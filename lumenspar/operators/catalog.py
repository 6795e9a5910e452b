"""Metadata, cardinality and governance of metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspar import model


def select(samples: DataFrame, metric: str, start_s: int, end_s: int) -> DataFrame:
    """Samples of a metric with both bounds inclusive, by series and time."""
    return samples.where((F.col("metric") == metric) & F.col("ts_s").between(start_s, end_s)).orderBy("series_key", "ts_s")


def merge_sources(sources: list[DataFrame]) -> DataFrame:
    """One sample per (series_key, ts_s) of several sources; the earlier source in the list wins, and within one the
    smallest value."""
    u = sources[0].withColumn("src", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        u = u.unionByName(s.withColumn("src", F.lit(i)))
    return u.groupBy("series_key", "ts_s").agg(F.min_by(F.struct("metric", "tags", "value"), F.struct("src", "value")).alias("x")).select("x.metric", "x.tags", "series_key", "ts_s", "x.value")


def metric_names(samples: DataFrame, prefix: str = "", limit: int = 1000) -> DataFrame:
    return samples.where(F.col("metric").startswith(prefix)).select("metric").distinct().orderBy("metric").limit(limit)


def tag_keys(samples: DataFrame, metric: str) -> DataFrame:
    return samples.where(F.col("metric") == metric).select(F.explode("tags.key").alias("key")).distinct()


def tag_values(samples: DataFrame, metric: str, key: str) -> DataFrame:
    """Distinct values of a key; the empty value of a bare tag is left out."""
    return samples.where(F.col("metric") == metric).select(F.explode("tags").alias("t")).where((F.col("t.key") == key) & (F.col("t.value") != "")).select(F.col("t.value").alias("value")).distinct()


def series_counts(samples: DataFrame) -> DataFrame:
    return samples.select("metric", "series_key").distinct().groupBy("metric").agg(F.count("*").alias("series"))


def tag_cardinality(samples: DataFrame, metric: str) -> DataFrame:
    """(key, series, values): series that carry the key (once each) and its distinct non-empty values."""
    s = samples.where(F.col("metric") == metric).select("series_key", "tags").dropDuplicates(["series_key"]).select("series_key", F.explode("tags").alias("t"))
    return s.groupBy(F.col("t.key").alias("key")).agg(F.count_distinct("series_key").alias("series"), F.count_distinct(F.nullif(F.col("t.value"), F.lit(""))).alias("values"))


def top_cardinality(counts: DataFrame, by: str, name: str, limit: int) -> DataFrame:
    """A page of cardinalities, most first, with the total and whether it was cut. The limit is the feature."""
    total = F.count("*").over(Window.partitionBy(F.lit(0)))  # one row per metric or key
    return counts.withColumn("total", total).withColumn("truncated", F.col("total") > limit).orderBy(F.desc(by), name).limit(limit)


def discover(samples: DataFrame, metrics: list[str], key: str = "service", limit: int = 100) -> DataFrame:
    """Values of a key over the metrics that a template queries."""
    return samples.where(F.col("metric").isin(metrics)).select(F.explode("tags").alias("t")).where((F.col("t.key") == key) & (F.trim("t.value") != "")).select(F.trim("t.value").alias("value")).distinct().orderBy("value").limit(limit)


def type_conflicts(arrivals: DataFrame, registry: DataFrame) -> DataFrame:
    """arrivals with `registered` and `accepted`: the first type seen of a metric holds (the registry's, else that of the
    smallest arrival); a null type is unknown and conflicts with nothing."""
    first = arrivals.where("type is not null").groupBy("metric").agg(F.min_by("type", "arrival").alias("first_type"))
    j = arrivals.join(first, "metric", "left").join(registry.select("metric", F.col("type").alias("known")), "metric", "left")
    reg = F.coalesce("known", "first_type")
    return j.withColumn("registered", reg).withColumn("accepted", F.col("type").isNull() | (F.col("type") == reg)).drop("known", "first_type")


def apply_tag_rules(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """rules: one row per metric with mode 'deny' or 'allow' and keys. Denied keys are dropped, or only allowed ones kept;
    metrics without a rule stay as they are."""
    r = F.broadcast(rules.select("metric", "mode", "keys"))  # configuration: one row per metric with a rule
    j = samples.join(r, "metric", "left")
    kept = F.when(F.col("mode") == "deny", F.filter("tags", lambda t: ~F.array_contains("keys", t["key"]))).when(F.col("mode") == "allow", F.filter("tags", lambda t: F.array_contains("keys", t["key"]))).otherwise(F.col("tags"))
    return j.withColumn("tags", kept).drop("mode", "keys").withColumn("series_key", model.series_key(F.col("metric"), F.col("tags")))


def series_limit(samples: DataFrame, per_metric: int, window_s: int = 3600) -> DataFrame:
    """samples with `accepted`: the first per_metric series of a metric to appear in each window are active (by first
    time, ties by key); series past the limit are refused. Ranking runs on one row per series and window."""
    w = F.col("ts_s") - F.pmod(F.col("ts_s"), F.lit(window_s))
    d = samples.withColumn("w", w)
    first = d.groupBy("metric", "w", "series_key").agg(F.min("ts_s").alias("t"))
    rank = F.row_number().over(Window.partitionBy("metric", "w").orderBy("t", "series_key"))
    return d.join(first.select("metric", "w", "series_key", (rank <= per_metric).alias("accepted")), ["metric", "w", "series_key"]).drop("w")


def cap_values(df: DataFrame, group: list[str], value: str, order: str, cap: int, other: str) -> DataFrame:
    """Values of a column past the first `cap` of a group to appear fold into `other` (stream labels, stat names,
    resources per service, container names). First seen by `order`, ties by value."""
    first = df.groupBy(*group, value).agg(F.min(order).alias("t"))
    rank = F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("t", value))
    keep = first.select(*group, F.col(value).alias("_v"), (rank <= cap).alias("_own"))
    on = [F.col(f"d.{g}").eqNullSafe(F.col(f"k.{g}")) for g in group] + [F.col(f"d.{value}").eqNullSafe(F.col("k._v"))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.alias("d").join(keep.alias("k"), cond, "left").select(*(F.when(F.col("k._own"), F.col(f"d.{c}")).otherwise(F.lit(other)).alias(c) if c == value else F.col(f"d.{c}") for c in df.columns))


def append_only(samples: DataFrame, arrival: str = "arrival", offset: str | None = None, block: int = 32768) -> DataFrame:
    """samples with `outcome`: stored if newer than all that arrived before in the series, duplicate if it repeats the
    newest (t, v), else rejected.

    offset: an integer that never falls as arrival rises (default: arrival, if it is one). A series is worked in blocks
    of `block` offsets; a block begins with one row that carries the newest (t, v) of the blocks before it, so no task
    holds a whole hot series. Without an offset a series is one block.
    """
    if offset is None and samples.select(arrival).schema[0].dataType.typeName() in ("byte", "short", "integer", "long"):
        offset = arrival
    at = F.coalesce(F.floor(F.col(offset) / block), F.lit(-1)).cast("bigint") if offset else F.lit(0).cast("bigint")  # nulls sort first
    # the smallest of these is the first to arrive with the newest time
    own = F.when(F.col("ts_s").isNotNull(), F.struct((-F.col("ts_s")).alias("n"), F.col(arrival).alias("a"), F.col("value").alias("v")))
    d = samples.withColumn("_block", at).withColumn("_own", own)
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.groupBy("series_key", "_block").agg(F.min("_own").alias("_own"))
    carried = blocks.select("series_key", "_block", F.min("_own").over(before("series_key").orderBy("_block")).alias("_own")).where("_own is not null")
    u = d.withColumn("_row", F.lit(True)).unionByName(carried.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    u = u.withColumn("_new", F.min("_own").over(before("series_key", "_block").orderBy("_row", arrival))).where("_row")
    same = (F.col("ts_s") == -F.col("_new.n")) & (F.col("value") == F.col("_new.v"))
    return u.withColumn("outcome", F.when(F.coalesce(F.col("ts_s") > -F.col("_new.n"), F.lit(True)), "stored").when(same, "duplicate").otherwise("rejected")).drop("_block", "_own", "_row", "_new")


def last_write(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The row that arrived last of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), arrival).alias("x")).select(*keys, *(F.col(f"x.{c}") for c in rest))


def new_logs(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Logs of a batch that aren't stored already (same stream, ts and body); copies within the batch stay."""
    body = F.xxhash64("message", "attrs", F.array_join("tags", "\x1f"), "trace_id", "span_id")
    key = ["service", "source", "host", "status", "ts"]
    s = stored.select(*key, body.alias("_b")).distinct()
    b = batch.withColumn("_b", body)
    cond = F.lit(True)
    for c in [*key, "_b"]:
        cond = cond & F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}"))
    return b.alias("b").join(s.alias("s"), cond, "left_anti").drop("_b")


def retain_days(df: DataFrame, ts_ms: str, now_ms: int, days: int = 7) -> DataFrame:
    """Rows of the last `days` whole UTC days and today."""
    first = (now_ms // 86_400_000 - days) * 86_400_000
    return df.where(F.col(ts_ms) >= first)


def retain_traces(spans: DataFrame, now_us: int, hours: int) -> DataFrame:
    """Whole traces whose first hour is within the last `hours`."""
    cut = (now_us // 3_600_000_000 - hours) * 3_600_000_000
    old = spans.groupBy("trace_id").agg(F.min("start").alias("s")).where(F.col("s") < cut)
    return spans.join(old, "trace_id", "left_anti")
