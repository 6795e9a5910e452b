"""Quantile sketches with relative error, as relational bins.

A value v falls into bin ceil(ln|v| / ln gamma) of its sign; zero has a bin of its own. Bins add, so a sketch of any
group is groupBy(...).agg(sum(count)); count, sum, min and max are kept exactly beside them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
INV_LN_GAMMA = 1 / math.log(GAMMA)
MAX_BINS = 2048


def sign(v: Column) -> Column:
    return F.signum(v).cast("int")


def index(v: Column) -> Column:
    return F.when(v == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(v)) * F.lit(INV_LN_GAMMA))).cast("int")


def bins(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """(keys..., sign, idx, count): null values are ignored; weight defaults to 1."""
    v, w = F.col(value), weight if weight is not None else F.lit(1.0)
    return df.where(v.isNotNull()).groupBy(*keys, sign(v).alias("sign"), index(v).alias("idx")).agg(F.sum(w).alias("count"))


def collapse(b: DataFrame, keys: list[str], most: int = MAX_BINS) -> DataFrame:
    """At most `most` contiguous bins per sign: the low end falls into the lowest bin that is kept."""
    top = F.max("idx").over(Window.partitionBy(*keys, "sign"))
    return b.withColumn("idx", F.greatest(F.col("idx"), top - (most - 1))).groupBy(*keys, "sign", "idx").agg(F.sum("count").alias("count"))


def merge(b: DataFrame, keys: list[str]) -> DataFrame:
    return b.groupBy(*keys, "sign", "idx").agg(F.sum("count").alias("count"))


def exact(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """(keys..., count, sum, min, max) beside the bins."""
    w = weight if weight is not None else F.lit(1.0)
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*keys).agg(F.sum(w).alias("count"), F.sum(v * w).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))


def estimate(sgn: Column, idx: Column) -> Column:
    return sgn * 2 * F.pow(F.lit(GAMMA), idx) / (GAMMA + 1)


def quantiles(merged: DataFrame, stats: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """(keys..., one column per quantile). merged: (keys..., sign, idx, count); stats: (keys..., min, max).

    The bin is the first, in order of value, whose running count exceeds q * (n - 1); its estimate is clamped to
    [min, max]; q = 0 is the minimum and q = 1 the maximum.
    """
    w = Window.partitionBy(*keys).orderBy("sign", F.col("sign") * F.col("idx")) if keys else Window.orderBy("sign", F.col("sign") * F.col("idx"))
    every = Window.partitionBy(*keys)
    r = merged.select("*", F.sum("count").over(w).alias("cum"), F.sum("count").over(every).alias("n"))
    place = F.struct("sign", (F.col("sign") * F.col("idx")).alias("o"))
    picks = [F.min_by(estimate(F.col("sign"), F.col("idx")), F.when(F.col("cum") > F.greatest(F.lit(0.0), q * (F.col("n") - 1)), place)).alias(f"e_{c}") for c, q in qs.items()]
    got = r.groupBy(*keys).agg(*picks) if keys else r.agg(*picks)
    j = got.join(stats.select(*keys, "min", "max"), keys) if keys else got.crossJoin(stats.select("min", "max"))
    fit = lambda c, q: F.col("min") if q <= 0 else F.col("max") if q >= 1 else F.least(F.greatest(F.col(f"e_{c}"), F.col("min")), F.col("max"))
    return j.select(*keys, *(fit(c, q).alias(c) for c, q in qs.items()))


def ranges(merged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., lower, upper, count): the value range of each bin, (lower, upper] for positive ones."""
    up, lo = F.pow(F.lit(GAMMA), F.col("idx")), F.pow(F.lit(GAMMA), F.col("idx") - 1)
    return merged.select(*keys, F.when(F.col("sign") > 0, lo).when(F.col("sign") < 0, -up).otherwise(0.0).alias("lower"), F.when(F.col("sign") > 0, up).when(F.col("sign") < 0, -lo).otherwise(0.0).alias("upper"), "count")


def from_histogram(df: DataFrame, keys: list[str], bounds: str, counts: str, parts: int = 16) -> DataFrame:
    """Bins of histograms with per-bucket counts: each bucket is spread over `parts` midpoints; the +Inf bucket falls on
    the last finite bound, the first lower bound is 0 if its upper one is positive, else the bound itself."""
    z = df.select(*keys, F.posexplode(F.arrays_zip(F.col(bounds).alias("b"), F.col(counts).alias("c"))).alias("i", "z"), F.col(bounds).alias("bs"))
    before = F.when(F.col("i") > 0, F.element_at("bs", F.col("i").cast("int")))
    upper = F.when(F.col("z.b") == float("inf"), before).otherwise(F.col("z.b"))
    lower = F.coalesce(before, F.when(upper > 0, F.lit(0.0)).otherwise(upper))
    pts = z.where(F.col("z.c") > 0).select(*keys, lower.alias("lo"), upper.alias("hi"), F.col("z.c").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    return bins(pts.withColumn("v", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("p") + 0.5) / parts).withColumn("w", F.col("c") / float(parts)), keys, "v", F.col("w"))


def encode(bins: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """points with a column `bins` that holds a sketch's bins in one row: per sign the first index, the gaps to the next
    ones, and the counts, at most MAX_BINS each. Empty sketches have none."""
    part = lambda c: F.struct(F.get(F.transform(c, lambda x: x["idx"]), F.lit(0)).alias("first"), F.zip_with(F.slice(c, 2, MAX_BINS), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: a["idx"] - b["idx"]).alias("gaps"), F.transform(c, lambda x: x["count"]).alias("counts"))
    per = collapse(bins, keys).groupBy(*keys, "sign").agg(F.array_sort(F.collect_list(F.struct("idx", "count"))).alias("x"))
    one = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("sign", part(F.col("x")).alias("p")))).alias("bins"))
    return points.join(one, keys, "left")


def decode(encoded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., sign, idx, count) of encoded sketches."""
    p = encoded.select(*keys, F.explode("bins").alias("s")).select(*keys, "s.sign", "s.p.*")
    q = p.select(*keys, "sign", "first", F.posexplode(F.arrays_zip(F.concat(F.array(F.lit(0)), "gaps").alias("gap"), F.col("counts").alias("count"))).alias("i", "x"))
    at = F.sum("x.gap").over(Window.partitionBy(*keys, "sign").orderBy("i"))  # at most MAX_BINS rows
    return q.select(*keys, "sign", (F.col("first") + at).cast("int").alias("idx"), F.col("x.count").alias("count"))
