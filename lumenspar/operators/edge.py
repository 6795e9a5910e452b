"""Edge aggregation: statsd lines, buckets of counters, gauges, sets, histograms and distributions, cumulative readings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspar import model
from lumenspar.functions import sketch

# Limits and shapes of names and tags.
NAME = r"^[A-Za-z][A-Za-z0-9_.]{0,199}$"
TAG_KEY = r"^[a-z][a-z0-9_.\-/]*$"
MAX_TAG_BYTES, MAX_TAGS = 200, 50
STATSD_TYPES = {"c": "count", "g": "gauge", "s": "set", "h": "histogram", "ms": "histogram", "d": "distribution"}


def split_datagrams(df: DataFrame, value: str = "value") -> DataFrame:
    """(line) of each datagram: separated by newlines, carriage returns dropped, empty lines skipped."""
    return df.select(F.explode(F.split(value, "\n")).alias("line")).select(F.regexp_replace("line", r"\r+$", "").alias("line")).where("line <> ''")


def parse_statsd(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with name, type, value, member (of sets), rate, tags (texts), client_ts and reason (null if accepted).

    Sections after the type are @rate, #tags and Tts; unknown ones are ignored. Events (_e{) and service checks (_sc|)
    are told apart by their reason. A null line is malformed.
    """
    c = F.col(line)
    head = F.regexp_extract(c, r"^([^:|]+):([^|]*)\|(c|g|s|h|ms|d)(?:\|.*)?$", 1)
    raw = F.regexp_extract(c, r"^([^:|]+):([^|]*)\|", 2)
    kind = F.regexp_extract(c, r"^[^:|]+:[^|]*\|(c|g|s|h|ms|d)(?:\||$)", 1)
    parts = F.slice(F.split(c, r"\|"), 3, 1000)
    rate_text = F.get(F.filter(parts, lambda p: p.startswith("@")), F.lit(0))
    rate = F.when(rate_text.isNull(), F.lit(1.0)).otherwise(F.substring(rate_text, 2, 100).try_cast("double"))
    tags = F.get(F.filter(parts, lambda p: p.startswith("#")), F.lit(0))
    ts = F.get(F.filter(parts, lambda p: p.rlike(r"^T\d+$")), F.lit(0))
    mapped = F.create_map(*(F.lit(x) for kv in STATSD_TYPES.items() for x in kv))
    v = raw.try_cast("double")
    reason = F.when(c.startswith("_e{"), "event").when(c.startswith("_sc|"), "service check").when(c.isNull() | (head == "") | (kind == ""), "malformed").when(~head.rlike(NAME), "bad name").when((kind != "s") & (v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "bad value").when(rate.isNull() | (rate <= 0) | (rate > 1) | (1 / F.nullif(rate, F.lit(0.0)) == float("inf")), "bad rate")
    return lines.select("*", head.alias("name"), F.try_element_at(mapped, kind).alias("type"), F.when(kind != "s", v).alias("value"), F.when(kind == "s", raw).alias("member"), rate.alias("rate"), F.when(tags.isNotNull(), F.filter(F.split(F.substring(tags, 2, 1 << 20), ","), lambda t: t != "")).otherwise(F.array().cast("array<string>")).alias("tags"), F.substring(ts, 2, 20).try_cast("bigint").alias("client_ts"), reason.alias("reason"))


def normalize_name(c: Column) -> Column:
    """Illegal characters become `_`; null if the name is empty, too long or doesn't begin with a letter."""
    n = F.regexp_replace(c, r"[^A-Za-z0-9_.]", "_")
    return F.when(n.rlike(NAME), n)


def normalize_tag(c: Column) -> Column:
    """Key in lower case with illegal characters as `_`, trailing colon dropped; null if it can't be a tag."""
    key = F.regexp_replace(F.lower(F.regexp_extract(c, r"^([^:]*)", 1)), r"[^a-z0-9_.\-/]", "_")
    value = F.regexp_replace(c, r"^[^:]*:?", "")
    t = F.when(value == "", key).otherwise(F.concat(key, F.lit(":"), value))
    return F.when(key.rlike(TAG_KEY) & (F.octet_length(t) <= MAX_TAG_BYTES) & ~t.rlike(r"[,\n]"), t)


def canonical_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(tags))


def decorate(tags: Column, own: list[str], host: str) -> Column:
    """Agent tags added, and the host unless the sample has one; at most MAX_TAGS."""
    t = F.array_union(tags, F.array(*map(F.lit, own)).cast("array<string>"))
    t = F.when(F.exists(tags, lambda x: x.startswith("host:")), t).otherwise(F.array_union(t, F.array(F.lit(f"host:{host}"))))
    return F.slice(F.array_sort(t), 1, MAX_TAGS)


def event_time(client_ts: Column, now: Column, reach_s: int = 60) -> Column:
    """The client's time if it is within reach_s of the arrival, else the arrival."""
    return F.when(F.abs(client_ts - now) <= reach_s, client_ts).otherwise(now)


def bucket(ts: Column, interval: int) -> Column:
    return ts - F.pmod(ts, F.lit(interval))


def rebucket_late(df: DataFrame, ts: str, arrival: str, interval: int, grace_s: int = 0) -> DataFrame:
    """`bucket` and `moved`: a sample whose bucket was flushed before it arrived moves to the oldest bucket open then; it
    is never dropped."""
    own = bucket(F.col(ts), interval)
    oldest = bucket(F.col(arrival) - grace_s, interval)
    return df.withColumn("bucket", F.greatest(own, oldest)).withColumn("moved", own < oldest)


def counters(df: DataFrame, keys: list[str], rate: str = "rate") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("value") / F.col(rate)).alias("value"))


def gauges(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The value that arrived last."""
    return df.groupBy(*keys).agg(F.max_by("value", arrival).alias("value"))


def sets(df: DataFrame, keys: list[str], member: str = "member") -> DataFrame:
    return df.select(*keys, member).distinct().groupBy(*keys).agg(F.count(member).alias("value"))


def histograms(df: DataFrame, keys: list[str], rate: str = "rate") -> DataFrame:
    """avg (unweighted), min, max, median, p95 (nearest rank) and count (weighted by 1 / rate)."""
    return df.groupBy(*keys).agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.sum(1 / F.col(rate)).alias("count"))


def distributions(df: DataFrame, keys: list[str], rate: str = "rate") -> tuple[DataFrame, DataFrame]:
    w = 1 / F.col(rate)
    return sketch.bins(df, keys, "value", w), sketch.exact(df, keys, "value", w)


def zero_fill(buckets: DataFrame, key: str, ts: str, interval: int, expiry_s: int = 300) -> DataFrame:
    """Counter buckets with the empty ones after data, up to expiry_s, as 0; between data only where the gap allows."""
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    end = F.least(F.coalesce(nxt - interval, F.col(ts) + expiry_s), F.col(ts) + expiry_s)
    x = buckets.withColumn("_e", end).withColumn("_z", F.when(F.col("_e") > F.col(ts), F.sequence(F.col(ts) + interval, F.col("_e"), F.lit(interval).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    own = x.select(key, ts, F.col("value"))
    return own.unionByName(x.select(key, F.explode("_z").alias(ts), F.lit(0.0).alias("value")))


def counter_rate(df: DataFrame, key: str, ts: str, value: str, forget_s: float = math.inf) -> DataFrame:
    """rate (per second) and change of cumulative readings: null for the first, after a fall, when time stands still,
    for values that aren't finite and after a gap of more than forget_s."""
    w = Window.partitionBy(key).orderBy(ts)
    pv, dt = F.lag(value).over(w), F.col(ts) - F.lag(ts).over(w)
    ok = (F.col(value) >= pv) & (dt > 0) & (F.abs(F.col(value)) < float("inf")) & (F.abs(pv) < float("inf")) & ~F.isnan(value) & ~F.isnan(pv)
    if forget_s < math.inf:
        ok = ok & (dt <= forget_s)
    return df.withColumn("change", F.col(value) - pv).withColumn("rate", F.when(ok, (F.col(value) - pv) / dt))


def histogram_deltas(df: DataFrame, key: str, ts: str, bounds: str, counts: str) -> DataFrame:
    """deltas of cumulative bucket counts between scrapes, per bucket: any fall or a change of layout is a restart, after
    which the current counts are the delta; counts are then undone against their running maximum."""
    w = Window.partitionBy(key).orderBy(ts)
    pc, pb = F.lag(counts).over(w), F.lag(bounds).over(w)
    d = df.withColumn("_pc", pc).withColumn("_pb", pb)
    reset = F.col("_pc").isNull() | ~F.col("_pb").eqNullSafe(F.col(bounds)) | F.exists(F.zip_with(counts, "_pc", lambda a, b: a < b), lambda x: F.coalesce(x, F.lit(True)))
    cum = F.when(reset, F.col(counts)).otherwise(F.zip_with(counts, "_pc", lambda a, b: a - b))
    d = d.withColumn("_first", F.col("_pc").isNull()).withColumn("_cum", cum)
    part = F.transform("_cum", lambda x, i: F.greatest(F.lit(0.0), x - F.coalesce(F.array_max(F.slice("_cum", 1, i)), F.lit(0.0))))
    return d.withColumn("deltas", F.when(~F.col("_first"), part)).drop("_pc", "_pb", "_first", "_cum")


def cumulate(buckets: Column) -> Column:
    """Per-bucket counts as cumulative ones, which histogram_quantile expects."""
    return F.transform(buckets, lambda x, i: F.aggregate(F.slice(buckets, 1, i + 1), F.lit(0.0), lambda a, b: a + b))


def multiline(lines: DataFrame, file: str, line_no: str, line: str, start: str, most: int = 500) -> DataFrame:
    """(file, first_line, n_lines, event): a line that fits `start` begins an event, others append; at most `most` lines
    go into one event, the next begins another."""
    w = Window.partitionBy(file).orderBy(line_no)
    d = lines.withColumn("_e", F.sum(F.when(F.col(line).rlike(start), 1).otherwise(0)).over(w))
    d = d.withColumn("_p", F.floor((F.row_number().over(Window.partitionBy(file, "_e").orderBy(line_no)) - 1) / most))
    return d.groupBy(file, "_e", "_p").agg(F.min(line_no).alias("first_line"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line_no, line))), lambda x: x[line]), "\n").alias("event")).drop("_e", "_p")


def samples_from(aggregated: DataFrame, name: str, ts: str, tags: str, value: str = "value") -> DataFrame:
    """Aggregated rows as metric_samples."""
    t = model.parse_tags(F.col(tags))
    return aggregated.select(F.col(name).alias("metric"), t.alias("tags"), model.series_key(F.col(name), t).alias("series_key"), F.col(ts).alias("ts_s"), F.col(value).cast("double").alias("value"))
