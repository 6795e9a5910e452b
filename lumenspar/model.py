"""Canonical tables and tag columns.

metric_samples  metric, tags ARRAY<STRUCT<key,value>> (a sorted set; a key may have two values), series_key, ts_s, value
metric_meta     metric, type
sketch_bins     metric, tags, series_key, ts_s, sign (-1, 0, 1), idx, count  beside  sketch_points (exact aggregates)
logs            seq, ts, message, status, service, source, host, tags ARRAY<STRING>, attrs (JSON text), trace_id, span_id
spans           trace_id, span_id, parent_id, service, name, resource, type, start (us), duration (us), error, meta, metrics
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = "array<struct<key:string,value:string>>"


def tags(**pairs: Column) -> Column:
    """A sorted tag set of the given keys; null values are absent tags."""
    return F.array_sort(F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in pairs.items()))))


def parse_tags(texts: Column) -> Column:
    """Tags from `k:v` texts: sorted, without repeats; a bare tag has the value ''."""
    return F.array_sort(F.array_distinct(F.transform(texts, lambda t: F.struct(F.regexp_extract(t, r"^([^:]*)", 1).alias("key"), F.when(F.instr(t, ":") > 0, F.regexp_replace(t, r"^[^:]*:", "")).otherwise("").alias("value")))))


def tag_texts(t: Column) -> Column:
    return F.transform(t, lambda x: F.when(x["value"] == "", x["key"]).otherwise(F.concat(x["key"], F.lit(":"), x["value"])))


def series_key(metric: Column, t: Column) -> Column:
    return F.concat(metric, F.lit("|"), F.array_join(tag_texts(t), ","))


def first_value(t: Column, key: str) -> Column:
    """The first (smallest) value of a key, null if the key is absent."""
    return F.get(F.filter(t, lambda x: x["key"] == key), F.lit(0))["value"]


def has_value(t: Column, key: str, value: str) -> Column:
    """True if any value of the key is `value`, or fits it if it holds `*`."""
    return F.exists(t, lambda x: (x["key"] == key) & glob(x["value"], value))


def glob(c: Column, pattern: str) -> Column:
    """Whole match in which only `*` is special."""
    if "*" not in pattern:
        return c == pattern
    if pattern == "*":
        return c.isNotNull()
    if pattern.count("*") == 1 and pattern.endswith("*"):
        return c.startswith(pattern[:-1])
    return c.like("".join({"*": "%", "%": r"\%", "_": r"\_", "\\": "\\\\"}.get(x, x) for x in pattern))


def scope(t: Column) -> Column:
    """`k:v,k2:v2` of a group's tags, `*` without any."""
    return F.when(F.size(t) == 0, F.lit("*")).otherwise(F.array_join(tag_texts(t), ","))


def at_most(df: DataFrame, column: str, most: int, message: str) -> DataFrame:
    """df, or an error when it is read if `column` has more than `most` distinct values. The count is one row."""
    n = df.select(column).distinct().limit(most + 1).agg(F.count("*").alias("_n"))
    guard = n.select(F.when(F.col("_n") > most, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
    return df.join(F.broadcast(guard), F.col("_ok")).drop("_ok")
