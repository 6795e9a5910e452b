"""Queries of the metric language over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.functions import sketch
from lumenspar.metricql import Engine
from lumenspar.sources import adapters

DAY = 86_400
FROM, TO = 1_704_067_200, 1_704_067_200 + 30 * DAY - 1


def engine(spark: SparkSession, d: str) -> Engine:
    bins, points = adapters.sketches(spark, d)
    samples = adapters.metric_samples(spark, d).unionByName(adapters.price_histogram(spark, d))
    return Engine(spark, samples, adapters.KINDS, bins, points)


def _ask(text: str, interval: int = DAY, start: int = FROM, end: int = TO, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = engine(spark, d).query(text, start, end, interval, **options).points()
        return p.select("scope", "ts_ms", F.round("value", 6).alias("value"))

    return run


# SQL pieces: samples per series (type, shard, tier) and bucket, then groups, then dense lines

EVENTS = """e AS (SELECT event_id, user_id, event_type AS type, 'u' || (user_id % 8) AS shard, CASE WHEN user_id % 8 < 2 THEN 'gold' END AS tier, value,
  epoch_us(ts) // 1000000 // 3600 * 3600 AS ts_s FROM events)"""
SAMPLES = {
    "count": "SELECT type, shard, tier, ts_s, count(*)::DOUBLE AS value FROM e GROUP BY ALL",
    "rate": "SELECT type, shard, tier, ts_s, count(*) / 3600.0 AS value FROM e GROUP BY ALL",
    "value": "SELECT type, shard, tier, ts_s, arg_max(value, event_id) AS value FROM e GROUP BY ALL",
}
TIME = {"avg": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "count": "count(value)::DOUBLE", "last": "arg_max(value, ts_s)"}


def _scope(by: list[str]) -> str:
    if not by:
        return "'*'"
    return "coalesce(nullif(concat_ws(',', " + ", ".join(f"'{k}:' || {k}" for k in sorted(by)) + "), ''), '*')"


def _cte(metric: str, time: str, space: str, by: list[str], where: str = "true", iv: int = DAY, start: int = FROM, end: int = TO, name: str = "") -> str:
    first, n = start // iv * iv, (end - start // iv * iv) // iv + 1
    g = ", ".join(by) + ", " if by else ""
    agg = "count(v)::DOUBLE" if space == "count" else f"{space}(v)"
    return f"""s{name} AS ({SAMPLES[metric]}),
  t{name} AS (SELECT type, shard, tier, ts_s // {iv} * {iv} AS b, {TIME[time]} AS v FROM s{name} WHERE ts_s BETWEEN {first} AND {first + n * iv - 1} AND ({where}) GROUP BY ALL),
  g{name} AS (SELECT {g}b, {agg} AS v FROM t{name} GROUP BY ALL),
  l{name} AS (SELECT x.scope, x.b, y.v FROM (SELECT DISTINCT {_scope(by)} AS scope, unnest(range({first}, {first + n * iv}, {iv})) AS b FROM g{name}) x
    LEFT JOIN (SELECT {_scope(by)} AS scope, b, v FROM g{name}) y ON x.scope = y.scope AND x.b = y.b)"""


def _sql(cte: str, value: str = "v", source: str = "l") -> str:
    return f"WITH {EVENTS}, {cte} SELECT scope, b * 1000 AS ts_ms, round({value}, 6) AS value FROM {source}"


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, text: str, sql: str | None = None, **options) -> None:
    Q[name] = _ask(text, **options)
    if sql:
        SQL[name] = sql


for _a in ("sum", "avg", "min", "max"):
    _add(f"metric_{_a}_by", f"{_a}:app.event.count{{*}} by {{shard}}", _sql(_cte("count", "sum", _a, ["shard"])))
_add("metric_count_series", "count:app.event.count{*} by {type}", _sql(_cte("count", "sum", "count", ["type"])))
for _m in TIME:
    _add(f"metric_rollup_{_m}", f"sum:app.event.value{{*}} by {{type}}.rollup({_m})", _sql(_cte("value", _m, "sum", ["type"])))
_add("metric_default_rollup_gauge", "avg:app.event.value{*} by {shard}", _sql(_cte("value", "avg", "avg", ["shard"])))
_F = {
    "eq": ("type:click", "type = 'click'"), "glob": ("type:c*", "type LIKE 'c%'"), "has_key": ("tier:*", "tier IS NOT NULL"), "not": ("!tier:gold", "tier IS DISTINCT FROM 'gold'"), "not_glob": ("!type:*e*", "type NOT LIKE '%e%'"),
    "in": ("shard IN (u1,u3,u5*)", "shard IN ('u1', 'u3') OR shard LIKE 'u5%'"), "not_in": ("!tier IN (gold,silver)", "tier IS NULL OR tier NOT IN ('gold', 'silver')"), "and": ("type:click,!shard:u1", "type = 'click' AND shard <> 'u1'"),
}
for _n, (_q, _w) in _F.items():
    _add(f"metric_filter_{_n}", f"sum:app.event.count{{{_q}}} by {{shard}}", _sql(_cte("count", "sum", "sum", ["shard"], _w)))
_add("metric_filter_var", "sum:app.event.count{$who} by {type}", _sql(_cte("count", "sum", "sum", ["type"], "shard IN ('u2', 'u4') ")), bound={"Who": ["shard:u2", "shard:u4"]})
_add("metric_missing_group_key", "sum:app.event.count{*} by {tier}", _sql(_cte("count", "sum", "sum", ["tier"])))
_add("metric_as_rate", "sum:app.event.count{*} by {shard}.as_rate()", _sql(_cte("count", "sum", "sum", ["shard"]), f"v / {DAY}.0"))
_add("metric_as_count", "sum:app.event.rate{*} by {shard}.as_count()", _sql(_cte("rate", "sum", "sum", ["shard"]), f"v * {DAY}.0"))
_H = {"interval": 3600, "end": FROM + 5 * DAY - 1}
_hc = _cte("count", "sum", "sum", ["type"], "shard = 'u1'", 3600, FROM, FROM + 5 * DAY - 1)
_W = "(PARTITION BY scope ORDER BY b"
_known = f"k AS (SELECT *, last_value(v IGNORE NULLS) OVER {_W}) AS v0, last_value(CASE WHEN v IS NOT NULL THEN b END IGNORE NULLS) OVER {_W}) AS b0, first_value(v IGNORE NULLS) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1, first_value(CASE WHEN v IS NOT NULL THEN b END IGNORE NULLS) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b1 FROM l)"
_add("metric_fill_zero", "sum:app.event.count{shard:u1} by {type}.fill(zero)", _sql(_hc, "coalesce(v, 0)"), **_H)
_add("metric_fill_last", "sum:app.event.count{shard:u1} by {type}.fill(last)", _sql(f"{_hc}, {_known}", "coalesce(v, v0)", "k"), **_H)
_add("metric_fill_last_limited", "sum:app.event.count{shard:u1} by {type}.fill(last, 7200)", _sql(f"{_hc}, {_known}", "coalesce(v, CASE WHEN b - b0 <= 7200 THEN v0 END)", "k"), **_H)
_add("metric_fill_zero_limited", "sum:app.event.count{shard:u1} by {type}.fill(zero, 7200)", _sql(f"{_hc}, {_known}", "coalesce(v, CASE WHEN b - b0 <= 7200 THEN 0 END)", "k"), **_H)
_add("metric_fill_linear", "sum:app.event.count{shard:u1} by {type}.fill(linear)", _sql(f"{_hc}, {_known}", "coalesce(v, CASE WHEN b1 IS NOT NULL THEN v0 + (v1 - v0) * (b - b0) / (b1 - b0) END)", "k"), **_H)
_dc = _cte("value", "avg", "avg", ["type"])
_add("metric_fn_abs", "abs(avg:app.event.value{*} by {type} - 100)", _sql(_dc, "abs(v - 100)"))
_add("metric_fn_log2", "log2(avg:app.event.value{*} by {type} - 40)", _sql(_dc, "CASE WHEN v - 40 > 0 THEN log2(v - 40) END"))
_add("metric_fn_log10", "log10(avg:app.event.value{*} by {type} - 40)", _sql(_dc, "CASE WHEN v - 40 > 0 THEN log10(v - 40) END"))
_add("metric_fn_clamp_min", "clamp_min(avg:app.event.value{*} by {type}, 55)", _sql(_dc, "CASE WHEN v IS NOT NULL THEN greatest(v, 55) END"))
_add("metric_fn_clamp_max", "clamp_max(avg:app.event.value{*} by {type}, 45)", _sql(_dc, "CASE WHEN v IS NOT NULL THEN least(v, 45) END"))
_add("metric_fn_diff", "diff(avg:app.event.value{*} by {type})", _sql(_dc, f"v - lag(v) OVER {_W})"))
_add("metric_fn_moving_avg", "moving_avg(avg:app.event.value{*} by {type}, 3)", _sql(_dc, f"avg(v) OVER {_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"))
_add("metric_fn_timeshift", f"timeshift(sum:app.event.count{{*}} by {{shard}}, -{2 * DAY})", f"WITH {EVENTS}, {_cte('count', 'sum', 'sum', ['shard'], start=FROM - 2 * DAY, end=TO - 2 * DAY)} SELECT scope, (b + {2 * DAY}) * 1000 AS ts_ms, round(v, 6) AS value FROM l")
_top = lambda order: f"WITH {EVENTS}, {_cte('count', 'sum', 'sum', ['shard'])}, r AS (SELECT scope, row_number() OVER (ORDER BY sum(v) {order} NULLS LAST, scope) AS n FROM l GROUP BY scope) SELECT scope, b * 1000 AS ts_ms, round(v, 6) AS value FROM l WHERE scope IN (SELECT scope FROM r WHERE n <= 3)"
_add("metric_fn_top_desc", 'top(sum:app.event.count{*} by {shard}, 3, "sum")', _top("DESC"))
_add("metric_fn_top_asc", 'top(sum:app.event.count{*} by {shard}, 3, "sum", "asc")', _top("ASC"))
_two = lambda where, op: f"WITH {EVENTS}, {_cte('count', 'sum', 'sum', ['shard'], where, name='1')}, {_cte('count', 'sum', 'sum', ['shard'], name='2')} SELECT scope, b * 1000 AS ts_ms, round({op}, 6) AS value FROM l1 JOIN l2 USING (scope, b)"
for _n, _op, _expr in (("add", "+", "l1.v + l2.v"), ("sub", "-", "l1.v - l2.v"), ("mul", "*", "l1.v * l2.v"), ("div", "/", "l1.v / nullif(l2.v, 0)")):
    _add(f"metric_arith_{_n}", f"sum:app.event.count{{type:click}} by {{shard}} {_op} sum:app.event.count{{*}} by {{shard}}", _two("type = 'click'", _expr))
_add("metric_arith_drop_unmatched", "sum:app.event.count{tier:gold} by {shard} / sum:app.event.count{*} by {shard}", _two("tier = 'gold'", "l1.v / nullif(l2.v, 0)"))
_add("metric_arith_scalar", "-(100.5 - sum:app.event.count{*} by {shard} * 2)", _sql(_cte("count", "sum", "sum", ["shard"]), "-(100.5 - v * 2)"))
_add("metric_constant", "2 * 3 + 1", f"SELECT '*' AS scope, unnest(range({FROM}, {FROM + 30 * DAY}, {DAY})) * 1000 AS ts_ms, 7.0::DOUBLE AS value")
_add("metric_flagship", "sum:app.event.count{type:click} by {shard}.as_rate()", _sql(_cte("count", "sum", "sum", ["shard"], "type = 'click'"), f"v / {DAY}.0"))

_G = repr(sketch.GAMMA)
_BINS = f"bins AS (SELECT type, ts_s // {DAY} * {DAY} AS b, CASE WHEN value = 0 THEN 0 ELSE sign(value) END::INT AS sg, CASE WHEN value = 0 THEN 0 ELSE ceil(ln(abs(value)) * {sketch.INV_LN_GAMMA!r}) END::INT AS ix, count(*)::DOUBLE AS c, min(value) AS lo, max(value) AS hi FROM e WHERE value IS NOT NULL GROUP BY ALL)"


def _pct(q: float) -> str:
    return f"""WITH {EVENTS}, {_BINS},
  r AS (SELECT *, sum(c) OVER (PARTITION BY type, b ORDER BY sg, sg * ix) AS cum, sum(c) OVER (PARTITION BY type, b) AS n, min(lo) OVER (PARTITION BY type, b) AS mn, max(hi) OVER (PARTITION BY type, b) AS mx FROM bins),
  p AS (SELECT type, b, arg_min(sg * 2 * pow({_G}, ix) / ({_G} + 1), sg * 100000 + sg * ix) AS est, any_value(mn) AS mn, any_value(mx) AS mx FROM r WHERE cum > greatest(0, {q} * (n - 1)) GROUP BY ALL)
  SELECT x.scope, x.b * 1000 AS ts_ms, round(least(greatest(est, mn), mx), 6) AS value FROM (SELECT DISTINCT 'type:' || type AS scope, unnest(range({FROM}, {FROM + 30 * DAY}, {DAY})) AS b FROM p) x LEFT JOIN p ON x.scope = 'type:' || p.type AND x.b = p.b"""


for _p in ("p50", "p75", "p90", "p95", "p99"):
    _add(f"sketch_percentile_{_p}", f"{_p}:app.event.dist{{*}} by {{type}}", _pct(int(_p[1:]) / 100))


def sketch_dist_bins(spark: SparkSession, d: str) -> DataFrame:
    r = engine(spark, d).distribution("dist:app.event.dist{*} by {type}", FROM, TO, DAY)
    return r.select("scope", (F.col("b") * 1000).alias("ts_ms"), F.explode("bins").alias("x")).select("scope", "ts_ms", F.round("x.lower", 6).alias("lower"), F.round("x.upper", 6).alias("upper"), F.col("x.count").cast("bigint").alias("n"))


SQL["sketch_dist_bins"] = f"""WITH {EVENTS}, {_BINS} SELECT 'type:' || type AS scope, b * 1000 AS ts_ms, round(CASE WHEN sg > 0 THEN pow({_G}, ix - 1) WHEN sg < 0 THEN -pow({_G}, ix) ELSE 0 END, 6) AS lower,
  round(CASE WHEN sg > 0 THEN pow({_G}, ix) WHEN sg < 0 THEN -pow({_G}, ix - 1) ELSE 0 END, 6) AS upper, sum(c)::BIGINT AS n FROM bins GROUP BY ALL"""


def sketch_side_series(spark: SparkSession, d: str) -> DataFrame:
    """Each sketch's .count, .sum (counts) and .min, .max (gauges)."""
    _, p = adapters.sketches(spark, d)
    x = F.explode(F.array(*(F.struct(F.concat("metric", F.lit(f".{c}")).alias("metric"), F.lit(k).alias("kind"), F.col(c).cast("double").alias("value")) for c, k in (("count", "count"), ("sum", "count"), ("min", "gauge"), ("max", "gauge")))))
    return p.where("count > 0").select("series_key", "ts_s", x.alias("x")).select("series_key", "ts_s", "x.metric", "x.kind", F.round("x.value", 6).alias("value"))


_KEY = "'app.event.dist|shard:' || shard || coalesce(',tier:' || tier, '') || ',type:' || type"
SQL["sketch_side_series"] = f"""WITH {EVENTS}, p AS (SELECT {_KEY} AS series_key, ts_s, count(*)::DOUBLE AS count, sum(value) AS sum, min(value) AS min, max(value) AS max FROM e GROUP BY ALL)
  SELECT series_key, ts_s, 'app.event.dist.' || name AS metric, CASE WHEN name IN ('count', 'sum') THEN 'count' ELSE 'gauge' END AS kind, round(value, 6) AS value FROM (UNPIVOT p ON count, sum, min, max INTO NAME name VALUE value)"""

_PH = {"interval": DAY * 30, "start": 694_224_000 // (DAY * 30) * DAY * 30, "end": 694_224_000 + 2500 * DAY}
_add("histogram_quantile", "histogram_quantile(0.9, sum:app.price.bucket{*} by {flag,upper_bound})", f"""
  WITH li AS (SELECT l_returnflag AS flag, epoch(l_shipdate)::BIGINT // {DAY * 30} * {DAY * 30} AS b, l_extendedprice AS p FROM lineitem WHERE epoch(l_shipdate)::BIGINT BETWEEN {_PH["start"]} AND {_PH["end"] // (DAY * 30) * DAY * 30 + DAY * 30 - 1}),
  c AS (SELECT flag, b, u, count(*) FILTER (p <= u)::DOUBLE AS c FROM li, (SELECT unnest([1000.0, 5000.0, 10000.0, 20000.0, 40000.0, 60000.0, 'inf'::DOUBLE]) AS u) GROUP BY ALL),
  w AS (SELECT *, max(c) OVER (PARTITION BY flag, b) AS n, lag(u) OVER (PARTITION BY flag, b ORDER BY u) AS pu, lag(c) OVER (PARTITION BY flag, b ORDER BY u) AS pc FROM c),
  f AS (SELECT flag, b, arg_min(CASE WHEN u = 'inf'::DOUBLE THEN pu WHEN c = coalesce(pc, 0) THEN u ELSE coalesce(pu, 0) + (u - coalesce(pu, 0)) * (0.9 * n - coalesce(pc, 0)) / (c - coalesce(pc, 0)) END, u) AS v FROM w WHERE c >= 0.9 * n GROUP BY ALL)
  SELECT x.scope, x.b * 1000 AS ts_ms, round(v, 6) AS value FROM (SELECT DISTINCT 'flag:' || flag AS scope, unnest(range({_PH["start"]}, {_PH["end"]} + 1, {DAY * 30})) AS b FROM f) x LEFT JOIN f ON x.scope = 'flag:' || f.flag AND x.b = f.b""", **_PH)


def histogram_to_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Per-bucket histograms of order prices as sketch bins."""
    from lumenspar.sources.tables import table

    o = table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").alias("p"))
    b = [50000.0, 100000.0, 200000.0, 300000.0]
    c = o.groupBy("o_orderpriority").agg(F.array(*(F.count_if((F.col("p") > lo) & (F.col("p") <= hi)).cast("double") for lo, hi in zip([-1.0, *b], [*b, float("inf")], strict=True))).alias("counts")).withColumn("bounds", F.array(*map(F.lit, [*b, float("inf")])))
    return sketch.from_histogram(c, ["o_orderpriority"], "bounds", "counts").select("o_orderpriority", "sign", "idx", F.round("count", 6).alias("count"))


SQL["histogram_to_sketch"] = f"""WITH b AS (SELECT * FROM (VALUES (0.0, 50000.0, -1.0, 50000.0), (50000.0, 100000.0, 50000.0, 100000.0), (100000.0, 200000.0, 100000.0, 200000.0), (200000.0, 300000.0, 200000.0, 300000.0), (300000.0, 300000.0, 300000.0, 1e300)) t(lo, hi, a, z)),
  c AS (SELECT o_orderpriority, lo, hi, count(*)::DOUBLE AS c FROM orders JOIN b ON o_totalprice > a AND o_totalprice <= z GROUP BY ALL),
  v AS (SELECT o_orderpriority, lo + (hi - lo) * (p + 0.5) / 16.0 AS v, c / 16.0 AS w FROM c, (SELECT unnest(range(16)) AS p))
  SELECT o_orderpriority, 1::INT AS sign, ceil(ln(v) * {sketch.INV_LN_GAMMA!r})::INT AS idx, round(sum(w), 6) AS count FROM v GROUP BY ALL"""

QUERIES = Q | {f.__name__: f for f in (sketch_dist_bins, sketch_side_series, histogram_to_sketch)}
