"""Traces: lookup, entry-span search, service edges and map, request/error/duration tables, sampling, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspar.functions import sketch

HOUR_US = 3_600_000_000
SAMPLING_FACTOR = 1111111111111111111  # fixed value of the sampling hash
TWO64 = 1 << 64


def distinct_spans(spans: DataFrame, arrival: str | None = None) -> DataFrame:
    """One row per (trace_id, span_id): of a span written again the row that arrived last, or, if no column tells, the one
    with the latest end, then the largest duration, then by its texts."""
    rest = [c for c in spans.columns if c not in ("trace_id", "span_id")]
    order = [F.col(arrival)] if arrival else [F.col("start") + F.col("duration"), F.col("duration"), *(F.col(c) for c in rest if spans.schema[c].dataType.typeName() in ("string", "integer", "long"))]
    x = spans.groupBy("trace_id", "span_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return x.select(*(F.col(c) if c in ("trace_id", "span_id") else F.col(f"x.{c}") for c in spans.columns))


def trace(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.where(F.col("trace_id") == trace_id).orderBy("start", "span_id")


def orphans(spans: DataFrame) -> DataFrame:
    """Spans whose parent isn't among the spans of their trace."""
    ids = spans.select("trace_id", F.col("span_id").alias("parent_id"))
    return spans.where(F.coalesce("parent_id", F.lit("")) != "").join(ids, ["trace_id", "parent_id"], "left_anti")


def trace_view(spans: DataFrame) -> DataFrame:
    """Per trace: start, duration (us), span_count, errors, services, orphans."""
    own = F.struct(F.col("span_id").alias("id"), F.lit(True).alias("own"), F.lit(0).alias("refs"))
    ref = F.when(F.coalesce("parent_id", F.lit("")) != "", F.struct(F.col("parent_id").alias("id"), F.lit(False).alias("own"), F.lit(1).alias("refs")))
    ids = spans.select("trace_id", F.explode(F.array_compact(F.array(own, ref))).alias("x")).groupBy("trace_id", "x.id").agg(F.max("x.own").alias("own"), F.sum("x.refs").alias("refs"))
    o = ids.where("not own").groupBy("trace_id").agg(F.sum("refs").alias("orphans"))
    v = spans.groupBy("trace_id").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("duration")) - F.min("start")).alias("duration"), F.count("*").alias("span_count"), F.sum("error").cast("bigint").alias("errors"), F.array_sort(F.collect_set("service")).alias("services"))
    return v.join(o, "trace_id", "left").fillna(0, ["orphans"])


def env() -> Column:
    return F.coalesce(F.try_element_at(F.col("meta"), F.lit("env")), F.lit(""))


def is_entry() -> Column:
    return F.coalesce(F.try_element_at(F.col("metrics"), F.lit("_top_level")) == 1, F.lit(False))


def entry_spans(spans: DataFrame) -> DataFrame:
    """Entry spans with env, status_code and trace_error (any span of the trace failed)."""
    failed = spans.where("error = 1").select("trace_id").distinct().withColumn("trace_error", F.lit(True))
    e = spans.where(is_entry()).join(failed, "trace_id", "left")
    return e.select("trace_id", "span_id", "parent_id", "service", "name", "resource", "type", "start", "duration", "error", env().alias("env"), F.try_element_at("meta", F.lit("http.status_code")).alias("status_code"), F.coalesce("trace_error", F.lit(False)).alias("trace_error"))


def search_entries(spans: DataFrame, start: int, end: int, env_: str = "", service: str = "", resource: str = "", name: str = "", errors: bool = False, min_duration: int = 0, max_duration: int = 0, status_code: str = "", limit: int = 50, after: tuple[int, str, str] | None = None) -> DataFrame:
    """A page (at most 500) of entry spans with start in [start, end] us, newest first; empty arguments don't filter."""
    d = entry_spans(spans).where(F.col("start").between(start, end))
    for on, c in ((env_, F.col("env") == env_), (service, F.col("service") == service), (resource, F.lower("resource").contains(resource.lower())), (name, F.col("name") == name), (errors, (F.col("error") == 1) | F.col("trace_error")), (min_duration, F.col("duration") >= min_duration), (max_duration, F.col("duration") <= max_duration), (status_code, F.col("status_code") == status_code)):
        if on:
            d = d.where(c)
    if after:
        s, t, p = after
        d = d.where((F.col("start") < s) | (F.col("start") == s) & ((F.col("trace_id") > t) | (F.col("trace_id") == t) & (F.col("span_id") > p)))
    return d.orderBy(F.desc("start"), "trace_id", "span_id").limit(min(500, limit))


def service_edges(spans: DataFrame, start: int, end: int) -> DataFrame:
    """(env, parent, child, calls, errors, dur_sum) over the whole hours that overlap [start, end]: entry spans whose
    parent belongs to another service, in the child's hour; negative durations count as 0."""
    e = spans.where(is_entry() & F.col("parent_id").isNotNull()).select("trace_id", "parent_id", F.col("service").alias("child"), "start", "duration", "error", env().alias("env"))
    p = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("service").alias("parent"))
    hour = F.col("start") - F.pmod(F.col("start"), F.lit(HOUR_US))
    e = e.withColumn("hour", hour).where((F.col("hour") + HOUR_US > start) & (F.col("hour") <= end))
    return e.join(p, ["trace_id", "parent_id"]).where("parent <> child").groupBy("env", "parent", "child").agg(F.count("*").alias("calls"), F.sum("error").cast("bigint").alias("errors"), F.sum(F.greatest("duration", F.lit(0))).alias("dur_sum"))


def services(spans: DataFrame, start: int, end: int) -> DataFrame:
    return spans.where(is_entry() & F.col("start").between(start, end)).select(env().alias("env"), "service").distinct()


def service_map(spans: DataFrame, start: int, end: int) -> DataFrame:
    """Nodes: (env, service, calls_in, errors_in, calls_out); services without edges included."""
    e = service_edges(spans, start, end)
    ins = e.select("env", F.col("child").alias("service"), F.col("calls").alias("i"), F.col("errors").alias("x"), F.lit(0).cast("bigint").alias("o"))
    outs = e.select("env", F.col("parent").alias("service"), F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("x"), F.col("calls").alias("o"))
    none = services(spans, start, end).select("env", "service", *(F.lit(0).cast("bigint").alias(c) for c in "ixo"))
    return ins.unionByName(outs).unionByName(none).groupBy("env", "service").agg(F.sum("i").alias("calls_in"), F.sum("x").alias("errors_in"), F.sum("o").alias("calls_out"))


def status_class(code: Column) -> Column:
    c = code.try_cast("int")
    return F.when(c.between(100, 599), F.concat(F.floor(c / 100).cast("string"), F.lit("xx")))


def clean_tag(c: Column, most: int = 150) -> Column:
    """Commas and newlines become spaces; at most `most` bytes, cut between characters."""
    t = F.translate(c, ",\n\r", "   ")
    return F.when(F.octet_length(t) <= most, t).otherwise(F.udf(lambda s: s if s is None else s.encode()[:most].decode(errors="ignore"), "string", useArrow=True)(t))


def red_samples(spans: DataFrame, interval_s: int = 10) -> DataFrame:
    """(name, service, resource, env, status_class, ts_s, hits, errors) of entry and measured spans at their end."""
    d = spans.where(is_entry() | F.coalesce(F.try_element_at("metrics", F.lit("_measured")) == 1, F.lit(False)))
    end = F.floor((F.col("start") + F.col("duration")) / 1_000_000)
    d = d.select("name", clean_tag(F.col("service")).alias("service"), clean_tag(F.col("resource")).alias("resource"), env().alias("env"), F.coalesce(status_class(F.try_element_at("meta", F.lit("http.status_code"))), F.lit("")).alias("status_class"), (end - F.pmod(end, F.lit(interval_s))).cast("bigint").alias("ts_s"), "error", (F.col("duration") / 1e6).alias("secs"))
    return d


def concentrate(spans: DataFrame, interval_s: int = 10) -> tuple[DataFrame, DataFrame]:
    """(counts, duration sketch bins): trace.<name>.hits and .errors per bucket, trace.<name>.duration in seconds."""
    d = red_samples(spans, interval_s)
    keys = ["name", "service", "resource", "env", "status_class", "ts_s"]
    return d.groupBy(*keys).agg(F.count("*").alias("hits"), F.sum("error").cast("bigint").alias("errors")), sketch.bins(d, keys, "secs")


def red_table(spans: DataFrame, start: int, end: int, by: list[str] | None = None, most: int = 50) -> DataFrame:
    """Requests, requests per second, errors, error share and p50, p95, p99 in ms per group of the window, most requests
    first. most is the feature: a table of at most so many rows."""
    by = by or ["name", "service"]
    d = red_samples(spans).where(F.col("ts_s").between(start // 1_000_000, end // 1_000_000))
    # one pass: requests, errors and extremes ride on the sketch's bins, and the bins of a group meet once
    v = F.col("secs")
    bins = d.groupBy(*by, sketch.sign(v).alias("sign"), sketch.index(v).alias("idx")).agg(F.count("*").alias("c"), F.sum("error").alias("e"), F.min(v).alias("min"), F.max(v).alias("max"))
    w = Window.partitionBy(*by)
    place = F.struct("sign", (F.col("sign") * F.col("idx")).alias("o"))
    r = bins.withColumn("k", F.when(F.col("idx").isNotNull(), F.col("c"))).select("*", F.sum("k").over(w.orderBy("sign", F.col("sign") * F.col("idx"))).alias("cum"), F.sum("k").over(w).alias("n"))
    at = lambda q: F.min_by(sketch.estimate(F.col("sign"), F.col("idx")), F.when(F.col("idx").isNotNull() & (F.col("cum") > F.greatest(F.lit(0.0), q * (F.col("n") - 1))), place))
    ps = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    t = r.groupBy(*by).agg(F.sum("c").alias("requests"), F.sum("e").cast("bigint").alias("errors"), F.min("min").alias("min"), F.max("max").alias("max"), *(at(q).alias(c) for c, q in ps.items()))
    ms = [F.round(F.least(F.greatest(F.col(c), F.col("min")), F.col("max")) * 1000, 6).alias(f"{c}_ms") for c in ps]
    return t.select(*by, "requests", F.round(F.col("requests") / ((end - start) / 1e6), 9).alias("per_second"), "errors", F.round(F.col("errors") / F.col("requests") * 100, 6).alias("error_pct"), *ms).orderBy(F.desc("requests"), *by).limit(most)


def head_sampled(trace_id: Column, rate: float) -> Column:
    """The head sampling decision: low 64 bits of the id times a fixed factor, modulo 2 ** 64, below rate * 2 ** 64."""
    low = F.conv(F.right(trace_id, F.lit(16)), 16, 10).cast("decimal(20,0)")
    # the product of two 64-bit numbers needs 39 digits, so the high and low halves are multiplied apart
    hi, lo = F.floor(low / F.lit(1 << 32).cast("decimal(20,0)")).cast("decimal(10,0)"), F.pmod(low, F.lit(1 << 32).cast("decimal(20,0)")).cast("decimal(10,0)")
    f = F.lit(SAMPLING_FACTOR).cast("decimal(20,0)")
    part = F.pmod((hi * f).cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(38,0)")) * F.lit(1 << 32).cast("decimal(20,0)")
    h = F.pmod((part + (lo * f).cast("decimal(38,0)")).cast("decimal(38,0)"), F.lit(str(TWO64)).cast("decimal(38,0)"))
    return h < F.lit(str(int(rate * TWO64))).cast("decimal(38,0)") if rate < 1 else F.lit(True)


def normalize_path(path: Column, segments: int = 8) -> Column:
    """URL path without query, its ids as :id: digits, UUIDs, 12 or more hex digits, 16 or more id characters with a
    digit; at most `segments` segments."""
    p = F.regexp_replace(path, r"[?#].*$", "")
    ident = lambda s: s.rlike(r"^(\d+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{12,}|(?=[A-Za-z_-]*\d)[A-Za-z0-9_-]{16,})$")
    parts = F.split(p, "/")
    return F.array_join(F.transform(F.slice(parts, 1, segments + 1), lambda s: F.when(ident(s), ":id").otherwise(s)), "/")


def sampled_rates(spans: DataFrame, target_per_s: float, window_s: int = 10) -> DataFrame:
    """(env, service, window, rate): min(1, target / observed) of entry spans per window."""
    s = F.floor(F.col("start") / 1_000_000)
    c = spans.where(is_entry()).groupBy(env().alias("env"), "service", (s - F.pmod(s, F.lit(window_s))).cast("bigint").alias("window")).agg(F.count("*").alias("n"))
    return c.select("env", "service", "window", F.least(F.lit(1.0), F.lit(target_per_s * window_s) / F.col("n")).alias("rate"))


def late_parents(children: DataFrame, parents: DataFrame, wait: str = "60 seconds") -> DataFrame:
    """Streaming: children joined with parents that arrive up to `wait` after them; unresolved ones come out with null.

    Both need event_time and a trace_id; children a parent_id, parents a span_id and parent_service.
    """
    c = children.withWatermark("event_time", wait).alias("c")
    p = parents.withWatermark("event_time", wait).alias("p")
    on = (F.col("c.trace_id") == F.col("p.trace_id")) & (F.col("c.parent_id") == F.col("p.span_id")) & F.expr(f"p.event_time BETWEEN c.event_time - interval {wait} AND c.event_time + interval {wait}")
    return c.join(p, on, "leftOuter").select("c.*", F.col("p.parent_service"))


def sample_chunks(chunks: DataFrame, errors_per_s: float = 10, rare_per_s: float = 5, rare_ttl_s: int = 300) -> DataFrame:
    """(host, chunk_id, kept, why): replay of the chunk sampler per host in order of ts_s, chunk_id.

    A chunk of priority 1 or more is kept, one of -1 dropped; else an error chunk within the error budget, else the first
    of its signature in rare_ttl_s seconds within the rare budget. Budgets are token buckets of one second's tokens.
    The state is sequential per host; hosts run in parallel. Chunks stream through in order of time: a task holds one
    batch and the signatures of the last rare_ttl_s seconds, never a whole host.
    """
    import pandas as pd

    def run(batches):
        host, tokens, at, seen = None, {}, {}, {}

        def allow(kind: str, rate: float, t: float) -> bool:
            if at[kind] is not None:
                tokens[kind] = min(rate, tokens[kind] + (t - at[kind]) * rate)
            at[kind] = t
            if tokens[kind] >= 1:
                tokens[kind] -= 1
                return True
            return False

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.host != host:
                    host, tokens, at, seen = r.host, {"error": errors_per_s, "rare": rare_per_s}, {"error": None, "rare": None}, {}
                why = ""
                if r.priority == -1:
                    why = "dropped"
                elif r.priority >= 1:
                    why = "priority"
                elif r.error and allow("error", errors_per_s, r.ts_s):
                    why = "error"
                else:
                    last = seen.get(r.signature)
                    if (last is None or r.ts_s - last > rare_ttl_s) and allow("rare", rare_per_s, r.ts_s):
                        why = "rare"
                        seen[r.signature] = r.ts_s
                out.append((r.host, r.chunk_id, why not in ("", "dropped"), why))
            if out and len(seen) > 100_000:
                now = pdf.ts_s.iloc[-1]
                seen = {k: t for k, t in seen.items() if now - t <= rare_ttl_s}
            yield pd.DataFrame(out, columns=["host", "chunk_id", "kept", "why"])

    d = chunks.select("host", "chunk_id", "ts_s", "priority", "error", "signature").where("host is not null")
    return d.repartition("host").sortWithinPartitions("host", "ts_s", "chunk_id").mapInPandas(run, "host string, chunk_id bigint, kept boolean, why string")
