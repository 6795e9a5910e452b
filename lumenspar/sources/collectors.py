"""What collectors compute from raw readings: rates and sums over tags. The readings come as tables; polling is elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspar.operators.edge import counter_rate


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def host_cpu(readings: DataFrame) -> DataFrame:
    """(host, ts, mode, percent) of cumulative CPU seconds per mode: each mode's share of the time that passed in all
    modes; nothing for the first reading or after a restart (any fall)."""
    r = counter_rate(readings.withColumn("key", F.concat_ws("|", "host", "mode")), "key", "ts", "seconds")
    w = Window.partitionBy("host", "ts")
    whole = F.sum("change").over(w)
    ok = F.min(F.when(F.col("rate").isNotNull(), 1).otherwise(0)).over(w) == 1
    return r.select("host", "ts", "mode", F.when(ok & (whole > 0), _share(F.col("change"), whole)).alias("percent")).where("percent is not null")


def cumulative_rates(readings: DataFrame, keys: list[str], ts: str, metric: str, value: str, restart: str | None = None) -> DataFrame:
    """(keys..., metric, ts, rate) of cumulative totals (disk, network, database statistics). A change of the `restart`
    column (a run id) drops the baseline, as does a fall."""
    key = F.concat_ws("|", *keys, metric, *([restart] if restart else []))
    return counter_rate(readings.withColumn("_k", key), "_k", ts, value).select(*keys, metric, F.col(ts).alias("ts"), "rate").where("rate is not null")


def disk_usage(readings: DataFrame) -> DataFrame:
    """(host, device, ts, used_pct): a device mounted several times counts once."""
    return readings.dropDuplicates(["host", "device", "ts"]).select("host", "device", "ts", _share(F.col("used"), F.col("total")).alias("used_pct"))


def container_metrics(readings: DataFrame) -> DataFrame:
    """(metric, tags, ts, value): containers with the same tags are one; values are summed, uptime and memory limits are
    the largest."""
    largest = F.col("metric").isin("container.uptime", "container.memory.limit")
    return readings.where("value is not null").groupBy("metric", "tags", "ts").agg(F.when(F.first(largest), F.max("value")).otherwise(F.sum("value")).alias("value"))


def container_lifetimes(events: DataFrame) -> DataFrame:
    """(container, ts, action, lifetime_s, oom) of each death: seconds since the last start, null if none was seen; oom
    tells whether the container ran out of memory since then."""
    w = Window.partitionBy("container").orderBy("ts", "action")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("action") == "start", F.col("ts")), ignorenulls=True).over(before)
    oom = F.last(F.when(F.col("action") == "oom", F.col("ts")), ignorenulls=True).over(before)
    died = F.last(F.when(F.col("action") == "die", F.col("ts")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = events.withColumns({"_s": start, "_o": oom, "_d": died}).where("action = 'die'")
    fresh = F.col("_d").isNull() | (F.col("_s") > F.col("_d"))
    return d.select("container", "ts", F.when(fresh, F.col("ts") - F.col("_s")).alias("lifetime_s"), F.coalesce(F.col("_o") >= F.col("_s"), F.lit(False)).alias("oom"))


def buffer_hit(rates: DataFrame) -> DataFrame:
    """(db, ts, buffer_hit): hit blocks over all blocks of the interval, from the two rates; null without any."""
    p = rates.groupBy("db", "ts").agg(F.max(F.when(F.col("metric") == "blks_hit", F.col("rate"))).alias("h"), F.max(F.when(F.col("metric") == "blks_read", F.col("rate"))).alias("r"))
    return p.select("db", "ts", _share(F.col("h"), F.col("h") + F.col("r")).alias("buffer_hit"))


def process_metrics(readings: DataFrame) -> DataFrame:
    """(label, ts, processes, rss, threads, fds, cpu_pct) of all processes under a label: unreadable ones (null rss) count;
    fds is null unless all could be read; CPU is the sum of the rates per (pid, started)."""
    r = counter_rate(readings.withColumn("_k", F.concat_ws("|", "label", "pid", "started")), "_k", "ts", "cpu_seconds")
    return r.groupBy("label", "ts").agg(F.count("*").alias("processes"), F.sum("rss").alias("rss"), F.sum("threads").alias("threads"), F.when(F.count("fds") == F.count("*"), F.sum("fds")).alias("fds"), (F.sum("rate") * 100).alias("cpu_pct"))


def http_checks(results: DataFrame) -> DataFrame:
    """results (url, ts, status, seconds, body, expected, pattern, cert_until) with can_connect, up and ssl_days_left: up
    needs the expected status (200 to 399 by default) and, if there is one, the pattern in the body."""
    status = F.when(F.col("expected").isNotNull(), F.col("status") == F.col("expected")).otherwise(F.col("status").between(200, 399))
    body = F.col("pattern").isNull() | F.coalesce(F.regexp_like("body", F.col("pattern")), F.lit(False))
    return results.select("url", "ts", F.col("status").isNotNull().cast("int").alias("can_connect"), "status", "seconds", F.coalesce(status & body, F.lit(False)).cast("int").alias("up"), ((F.col("cert_until") - F.col("ts")) / 86_400).alias("ssl_days_left"))


def increases(readings: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, ts, increase) of an engine's own cumulative counters per report; a fall restarts from zero."""
    w = Window.partitionBy(key).orderBy(ts)
    p = F.lag(value).over(w)
    return readings.select(key, ts, F.when(p.isNotNull(), F.when(F.col(value) < p, F.col(value)).otherwise(F.col(value) - p)).alias("increase")).where("increase is not null")


def expand_template(template: dict, host: str, ports: list[int]) -> dict:
    """A check's configuration with %%host%% and %%port%% (the first), %%port_0%%, %%port_1%% ... filled in."""
    def fill(x: object) -> object:
        if isinstance(x, dict):
            return {k: fill(v) for k, v in x.items()}
        if isinstance(x, list):
            return [fill(v) for v in x]
        if not isinstance(x, str):
            return x
        x = x.replace("%%host%%", host)
        for i, p in reversed(list(enumerate(ports))):
            x = x.replace(f"%%port_{i}%%", str(p))
        return x.replace("%%port%%", str(ports[0])) if ports else x

    return fill(template)
