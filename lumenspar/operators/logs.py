"""Search, paging, histograms and facets over logs."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspar.logql import compile_filter, with_attributes
from lumenspar.logql.compile import label

NICE_STEPS_MS = tuple(int(x * 1000) for x in (1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400, 172800, 604800))


def auto_step(start: int, end: int, bars: int = 60) -> int:
    """The smallest nice step in ms that gives at most `bars` bars."""
    return next((s for s in NICE_STEPS_MS if (end - start) / s <= bars), NICE_STEPS_MS[-1])


def cursor(ts: int, seq: int) -> str:
    return base64.urlsafe_b64encode(f"{ts}.{seq}".encode()).decode().rstrip("=")


def read_cursor(text: str) -> tuple[int, int]:
    ts, _, seq = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode().partition(".")
    return int(ts), int(seq)


def search(logs: DataFrame, query: str, start: int, end: int, limit: int = 100, newest_first: bool = True, after: str = "") -> DataFrame:
    """One page of logs in [start, end], by (ts, seq); `after` is the cursor of the page before. The limit is the
    feature: a page (at most 10 000)."""
    if not 1 <= limit <= 10_000:
        raise ValueError("the limit must lie between 1 and 10000")
    d = logs.where(F.col("ts").between(start, end))
    if after:
        t, s = read_cursor(after)
        d = d.where((F.col("ts") < t) | (F.col("ts") == t) & (F.col("seq") < s) if newest_first else (F.col("ts") > t) | (F.col("ts") == t) & (F.col("seq") > s))
    order = [F.desc("ts"), F.desc("seq")] if newest_first else [F.asc("ts"), F.asc("seq")]
    return compile_filter(d, query).orderBy(*order).limit(limit)


def group_value(by: str) -> Column:
    """A label, or the first value of an attribute (@path) as text; missing is ''."""
    if by.startswith("@"):
        return F.coalesce(F.get(F.filter("attr_flat", lambda a: a["path"] == by[1:]), F.lit(0))["text"], F.lit(""))
    return label(by)


def histogram(logs: DataFrame, query: str, start: int, end: int, step: int, by: str = "", groups: int = 100) -> DataFrame:
    """(bucket, [grp,] n) counts per step of ts, sparse. Past `groups` distinct values the rest fold into (other): the
    ones with the most logs keep their name, ties by value."""
    d = logs.where(F.col("ts").between(start, end))
    if by.startswith("@"):
        d = with_attributes(d)
    d = compile_filter(d, query).withColumn("bucket", F.col("ts") - F.pmod(F.col("ts"), F.lit(step)))
    if not by:
        return d.groupBy("bucket").agg(F.count("*").alias("n"))
    c = d.groupBy("bucket", group_value(by).alias("grp")).agg(F.count("*").alias("n"))
    keep = c.groupBy("grp").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "grp").limit(groups).select("grp", F.lit(True).alias("own"))
    j = c.join(F.broadcast(keep), "grp", "left")  # at most `groups` rows
    return j.groupBy("bucket", F.when(F.col("own"), F.col("grp")).otherwise("(other)").alias("grp")).agg(F.sum("n").alias("n"))


def facets(logs: DataFrame, query: str, keys: list[str], start: int, end: int, limit: int = 10) -> DataFrame:
    """(key, value, n): for each key the `limit` most frequent values (ties by value); an array counts once for each of
    its distinct values, a missing value not at all. The limit is the feature: a top list."""
    d = with_attributes(logs.where(F.col("ts").between(start, end))) if any(k.startswith("@") for k in keys) else logs.where(F.col("ts").between(start, end))
    d = compile_filter(d, query)

    def values(key: str) -> Column:
        if key.startswith("@"):
            return F.array_distinct(F.transform(F.filter("attr_flat", lambda a: a["path"] == key[1:]), lambda a: a["text"]))
        return F.filter(F.array(label(key)), lambda v: v != "")

    vals = [F.struct(F.lit(k).alias("key"), values(k).alias("vs")) for k in keys]
    x = d.select(F.explode(F.array(*vals)).alias("f")).select("f.key", F.explode("f.vs").alias("value"))
    c = x.groupBy("key", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    return c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")


def merge_pages(tail: DataFrame, page: DataFrame, limit: int) -> DataFrame:
    """Live tail and page as one newest-first list: a multiset union on (ts, service, host, message)."""
    key = ["ts", "service", "host", "message"]
    w = Window.partitionBy(*key).orderBy("seq")
    a, b = tail.withColumn("r", F.row_number().over(w)), page.withColumn("r", F.row_number().over(w))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*key, "r"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return b.unionByName(a.alias("a").join(b.alias("b"), cond, "left_anti")).drop("r").orderBy(F.desc("ts"), F.desc("seq")).limit(limit)
