"""Log pipeline columns: severity, time, trace ids and remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspar.operators.redaction import redact, redact_attrs  # noqa: F401  # stages of the pipeline

# Names and number ranges (inclusive) of severities.
STATUSES = {
    "debug": ("trace", "debug", "verbose", "silly", "fine", "debug1", "debug2", "debug3", "debug4", "debug5", ".", "-"),
    "info": ("info", "notice", "informational", "log", "success", "statement", "detail", "hint", "context", "*"),
    "warn": ("warn", "warning", "#"),
    "error": ("error", "err", "exception", "severe"),
    "critical": ("critical", "crit", "fatal", "alert", "emerg", "emergency", "panic"),
}
STATUS_NUMBERS = {"critical": ((0, 2), (51, 60)), "error": ((3, 3), (41, 50)), "warn": ((4, 4), (31, 40)), "info": ((5, 6), (21, 30)), "debug": ((7, 7), (10, 20))}


def known_severity(name: Column) -> Column:
    """One of the five statuses, null if the name or number isn't one of a severity. Case and white space are ignored."""
    text = F.lower(F.trim(name))
    number = F.when(text.rlike(r"^[+-]?\d{1,9}$"), text.try_cast("int"))
    out = None
    for status, names in STATUSES.items():
        hit = text.isin(*names)
        for lo, hi in STATUS_NUMBERS[status]:
            hit = hit | F.coalesce(number.between(lo, hi), F.lit(False))
        out = F.when(hit, status) if out is None else out.when(hit, status)
    return out


def severity(name: Column) -> Column:
    """known_severity; what is missing or unknown is info."""
    return F.coalesce(known_severity(name), F.lit("info"))


def epoch_ms(x: Column) -> Column:
    """ms of an epoch number whose unit is told by its size: s, ms, us or ns; null below 1e9 and from 1e20."""
    x = x.cast("double")
    return F.when(x < 1e9, None).when(x < 1e11, F.floor(x * 1000)).when(x < 1e14, F.floor(x)).when(x < 1e17, F.floor(x / 1000)).when(x < 1e20, F.floor(x / 1_000_000)).cast("bigint")


def parse_time(c: Column) -> Column:
    """ms of a time as text: ISO 8601 with or without a zone (UTC), `29 Sep 2026 04:58:03.453`, or an epoch number."""
    t = F.regexp_replace(F.regexp_replace(c, r",(\d)", r".$1"), r" UTC$", "Z")
    shapes = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "dd MMM yyyy HH:mm:ss[.SSS]", "yyyy-MM-dd HH:mm:ss Z")
    return F.coalesce(epoch_ms(c.try_cast("double")), *(F.unix_millis(F.try_to_timestamp(t, F.lit(s))) for s in shapes))


def trace_id(c: Column, decimal: bool = False) -> Column:
    """Lower-case hex of 32 digits (16 are padded); decimal ids are converted; null if it is neither."""
    if decimal:
        return F.when(c.rlike(r"^\d{1,20}$"), F.lpad(F.lower(F.conv(c, 10, 16)), 32, "0"))
    h = F.lower(c)
    return F.when(h.rlike("^[0-9a-f]{32}$"), h).when(h.rlike("^[0-9a-f]{16}$"), F.lpad(h, 32, "0"))


def remap(parsed: DataFrame, attrs: str = "attrs") -> DataFrame:
    """message, status and ts of parsed JSON lines: the first of message, msg / level, levelname, severity / timestamp,
    time, ts, @timestamp; a numeric status is an HTTP code."""
    first = lambda *ks: F.coalesce(*(F.get_json_object(attrs, f"$['{k}']") for k in ks))
    code = F.get_json_object(attrs, "$.status").try_cast("int")
    return parsed.withColumns({"message": first("message", "msg"), "status": severity(first("level", "levelname", "severity")), "ts": parse_time(first("timestamp", "time", "ts", "@timestamp")), "status_code": code})


def exclude(df: DataFrame, message: str, patterns: list[str]) -> DataFrame:
    for p in patterns:
        df = df.where(~F.coalesce(F.col(message).rlike(p), F.lit(False)))
    return df


def rate_limit(df: DataFrame, source: str, ts_ms: str, per_second: int, order: str) -> DataFrame:
    """At most per_second rows of a source in each second, in order: the batch form of the opt-in limiter."""
    sec = F.floor(F.col(ts_ms) / 1000)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(source, sec).orderBy(order))).where(F.col("_r") <= per_second).drop("_r")
