"""Wire payloads: decoding and validation with a reason per rejected series, log or span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspar.operators.edge import MAX_TAGS, NAME, TAG_KEY

# Limits of the wire formats.
FUTURE_S = 600
MAX_BINS, MAX_POINTS, MAX_SERIES, MAX_SPANS = 2048, 1000, 5000, 5000
STATUSES = ("debug", "info", "warn", "error", "critical")
MAX_MESSAGE, MAX_ATTRS = 256 * 1024, 64 * 1024
SERIES = "struct<series:array<struct<metric:string,type:string,interval:bigint,tags:array<string>,points:array<array<double>>>>>"
SKETCH = "struct<gamma:double,count:double,sum:double,min:double,max:double,zero_count:double,bins:array<array<double>>,neg_bins:array<array<double>>>"
SKETCHES = f"struct<series:array<struct<metric:string,tags:array<string>,interval:bigint,points:array<struct<ts:bigint,sketch:{SKETCH}>>>>>"
LOGS = "struct<logs:array<struct<ts:bigint,message:string,status:string,service:string,source:string,host:string,tags:array<string>,attrs:string,trace_id:string,span_id:string>>>"
SPAN = "struct<trace_id:string,span_id:string,parent_id:string,service:string,name:string,resource:string,type:string,start:bigint,duration:bigint,error:int,meta:map<string,string>,metrics:map<string,double>>"


def decode(payloads: DataFrame, payload: str, schema: str, items: str, most: int = MAX_SERIES) -> DataFrame:
    """One row per item of each payload, with `payload_ok`: broken JSON, and a payload of more than `most` items, give one
    row without an item."""
    d = payloads.withColumn("_p", F.from_json(payload, schema, {"mode": "PERMISSIVE"}))
    d = d.withColumn("_p", F.when(F.size(F.coalesce(F.col(f"_p.{items}"), F.array())) <= most, F.col("_p")))
    return d.select("*", F.posexplode_outer(f"_p.{items}").alias("item_no", "item")).withColumn("payload_ok", F.col("item").isNotNull()).drop("_p")


def decode_spans(payloads: DataFrame, payload: str) -> DataFrame:
    """Spans of flat ({spans: [...]}) and chunked ({chunks: [{spans: [...]}]}) payloads; chunk_no is 0 in flat ones. A
    payload of more than MAX_SPANS spans is refused whole and gives no row."""
    d = payloads.withColumn("_p", F.from_json(payload, f"struct<spans:array<{SPAN}>,chunks:array<struct<priority:int,spans:array<{SPAN}>>>>"))
    one = F.when(F.col("_p.spans").isNotNull(), F.array(F.struct(F.lit(None).cast("int").alias("priority"), F.col("_p.spans").alias("spans")))).otherwise(F.col("_p.chunks"))
    size = F.aggregate(one, F.lit(0), lambda n, x: n + F.greatest(F.size(x["spans"]), F.lit(0)))
    c = d.where(size <= MAX_SPANS).select("*", F.posexplode(one).alias("chunk_no", "_c")).drop("_p")
    return c.select("*", F.col("_c.priority").alias("priority"), F.posexplode("_c.spans").alias("span_no", "item")).drop("_c")


def _bad_tags(tags: Column) -> Column:
    bad = F.exists(tags, lambda t: t.isNull() | ~F.regexp_extract(t, r"^([^:]*)", 1).rlike(TAG_KEY) | (F.octet_length(t) > 200) | t.rlike(r"[,\n]"))
    return F.coalesce(bad, F.lit(False))


def series_reason(now_s: int, max_age_s: int = 0) -> Column:
    """Why a series (item) is rejected; null if it is accepted. The first broken rule names the reason."""
    p = F.col("item.points")
    t = lambda x: F.get(x, F.lit(0))
    v = lambda x: F.get(x, F.lit(1))
    some = lambda f: F.coalesce(F.exists(p, f), F.lit(False))
    out = F.when(~F.coalesce(F.col("item.metric").rlike(NAME), F.lit(False)), "bad metric name").when(~F.coalesce(F.col("item.type").isin("count", "rate", "gauge"), F.lit(False)), "unknown type")
    out = out.when((F.col("item.type") == "gauge") & (F.coalesce("item.interval", F.lit(0)) != 0), "gauge with an interval").when(F.col("item.type").isin("count", "rate") & (F.coalesce("item.interval", F.lit(0)) <= 0), "interval must be positive")
    out = out.when(F.size(F.coalesce("item.tags", F.array().cast("array<string>"))) > MAX_TAGS, "too many tags").when(_bad_tags(F.col("item.tags")), "bad tag").when(F.coalesce(F.size(p), F.lit(0)) <= 0, "no points")
    out = out.when(some(lambda x: (F.size(x) != 2) | t(x).isNull() | v(x).isNull() | F.isnan(v(x)) | (F.abs(v(x)) == float("inf"))), "value isn't finite")
    out = out.when(some(lambda x: t(x) <= 0), "timestamp must be positive").when(some(lambda x: t(x) > now_s + FUTURE_S), "timestamp in the future")
    return out.when(some(lambda x: t(x) < now_s - max_age_s), "timestamp too old") if max_age_s else out


def sketch_reason(now_s: int) -> Column:
    """Why a sketch series (item) is rejected."""
    p = F.col("item.points")
    rising = lambda b: F.forall(F.zip_with(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), F.slice(b, 2, F.greatest(F.size(b), F.lit(1))), lambda x, y: F.get(x, F.lit(0)) < F.get(y, F.lit(0))), lambda z: F.coalesce(z, F.lit(False)))
    none = F.array().cast("array<array<double>>")
    bad = lambda x: x["sketch"].isNull() | ~(x["sketch"]["gamma"] > 1) | ~(x["sketch"]["count"] >= 0) | F.isnan(x["sketch"]["sum"]) | (x["sketch"]["min"] > x["sketch"]["max"])
    total = lambda x: F.aggregate(F.concat(F.coalesce(x["sketch"]["bins"], none), F.coalesce(x["sketch"]["neg_bins"], none)), F.coalesce(x["sketch"]["zero_count"], F.lit(0.0)), lambda a, b: a + F.get(b, F.lit(1)))
    some = lambda f: F.coalesce(F.exists(p, f), F.lit(False))
    out = F.when(~F.coalesce(F.col("item.metric").rlike(NAME), F.lit(False)), "bad metric name").when(F.coalesce("item.interval", F.lit(0)) <= 0, "interval must be positive").when(_bad_tags(F.col("item.tags")), "bad tag")
    out = out.when(F.coalesce(F.size(p), F.lit(0)) <= 0, "no points").when(F.size(p) > MAX_POINTS, "too many points").when(some(lambda x: (x["ts"] <= 0) | (x["ts"] > now_s + FUTURE_S)), "bad timestamp").when(some(bad), "inconsistent sketch")
    out = out.when(some(lambda x: (F.size(F.coalesce(x["sketch"]["bins"], none)) > MAX_BINS) | (F.size(F.coalesce(x["sketch"]["neg_bins"], none)) > MAX_BINS)), "too many bins")
    out = out.when(some(lambda x: ~rising(F.coalesce(x["sketch"]["bins"], none)) | ~rising(F.coalesce(x["sketch"]["neg_bins"], none))), "bins aren't ascending")
    return out.when(some(lambda x: F.abs(total(x) - x["sketch"]["count"]) > 1e-6 * F.greatest(F.lit(1.0), x["sketch"]["count"])), "counts don't add up")


def log_reason(now_ms: int) -> Column:
    """Why a log (item) is rejected."""
    i = F.col
    out = F.when(i("item.ts").isNull() | (i("item.ts") < 1_000_000_000_000), "timestamp isn't in ms").when(i("item.ts") > now_ms + FUTURE_S * 1000, "timestamp in the future")
    out = out.when(~F.coalesce(i("item.status").isin(*STATUSES), F.lit(False)), "unknown status").when(F.coalesce("item.service", F.lit("")) == "", "no service").when(_bad_tags(i("item.tags")), "bad tag")
    out = out.when(~F.coalesce(i("item.trace_id").rlike("^([0-9a-f]{32}|)$"), F.lit(True)), "bad trace_id").when(~F.coalesce(i("item.span_id").rlike("^([0-9a-f]{16}|)$"), F.lit(True)), "bad span_id")
    return out.when(F.octet_length(F.coalesce("item.attrs", F.lit(""))) > MAX_ATTRS, "attributes too large")


def truncated_message(c: Column) -> tuple[Column, Column]:
    """(message, whether it was cut) at MAX_MESSAGE bytes between characters."""
    over = F.coalesce(F.octet_length(c) > MAX_MESSAGE, F.lit(False))
    cut = F.udf(lambda s: s if s is None else s.encode()[:MAX_MESSAGE].decode(errors="ignore"), "string", useArrow=True)
    return F.when(over, cut(c)).otherwise(c), over


def span_reason(now_us: int) -> Column:
    """Why a span (item) is rejected."""
    i = F.col
    hexed = lambda c, n: F.coalesce(i(c).rlike(f"^[0-9a-f]{{{n}}}$"), F.lit(False))
    out = F.when(~hexed("item.trace_id", 32), "bad trace_id").when(~hexed("item.span_id", 16), "bad span_id").when((F.coalesce("item.parent_id", F.lit("")) != "") & ~hexed("item.parent_id", 16), "bad parent_id")
    out = out.when((F.coalesce("item.service", F.lit("")) == "") | (F.octet_length("item.service") > 100), "bad service").when(F.coalesce("item.name", F.lit("")) == "", "no name").when(~F.coalesce(i("item.error").isin(0, 1), F.lit(False)), "error must be 0 or 1")
    return out.when(~F.coalesce(i("item.duration") >= 0, F.lit(False)), "negative duration").when(~F.coalesce(i("item.start") >= 1_000_000_000_000_000, F.lit(False)), "start isn't in us").when(i("item.start") > now_us + FUTURE_S * 1_000_000, "start in the future")


def normalize_spans(spans: DataFrame, meta: int = 100, metrics: int = 50) -> DataFrame:
    """Unknown types become custom; at most `meta` and `metrics` entries in order of key."""
    keep = lambda c, n: F.map_from_entries(F.slice(F.array_sort(F.map_entries(c)), 1, n))
    return spans.withColumns({"type": F.when(F.col("type").isin("web", "http", "sql", "cache", "queue", "worker", "custom"), F.col("type")).otherwise("custom"), "meta": keep(F.col("meta"), meta), "metrics": keep(F.col("metrics"), metrics)})


def propagation(trace: Column, parent: Column, priority: Column) -> Column:
    """STRUCT<trace_id, parent_id, priority> of the propagation headers; null if they are malformed."""
    ok = trace.rlike("^[0-9a-f]{32}$") & parent.rlike("^[0-9a-f]{16}$") & ~trace.rlike("^0+$")
    return F.when(ok, F.struct(trace.alias("trace_id"), parent.alias("parent_id"), F.coalesce(priority.try_cast("int"), F.lit(1)).alias("priority")))
