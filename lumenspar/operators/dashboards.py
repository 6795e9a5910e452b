"""Dashboards: definition checks, template binding and the reducers behind widgets."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspar.metricql.evaluate import reduce_points
from lumenspar.metricql.syntax import AGGREGATORS, FUNCTIONS, METHODS, Query, QueryError, metrics, parse, variables

# Widget kinds and what they take.
REDUCED = ("query_value", "toplist", "table")
PLAIN = ("timeseries", "heatmap", "note")
MAX_WIDGETS, MAX_QUERIES, MAX_ROWS = 100, 10, 100


def validate(definition: dict) -> list[str]:
    """Faults of a dashboard definition: every query parses, every variable is declared, reducers where they belong."""
    faults = []
    declared = {v["name"].lower() for v in definition.get("variables", [])}
    widgets = definition.get("widgets", [])
    if len(widgets) > MAX_WIDGETS:
        faults.append(f"more than {MAX_WIDGETS} widgets")
    for i, w in enumerate(widgets):
        at, kind, queries = f"widget {i}", w.get("type"), w.get("queries", [])
        if kind not in REDUCED + PLAIN:
            faults.append(f"{at}: unknown type {kind}")
            continue
        if kind == "note":
            continue
        if not queries or len(queries) > MAX_QUERIES:
            faults.append(f"{at}: needs 1 to {MAX_QUERIES} queries")
        if (kind in REDUCED) != bool(w.get("reducer")):
            faults.append(f"{at}: {kind} {'needs a' if kind in REDUCED else 'takes no'} reducer")
        if w.get("limit", 1) > MAX_ROWS:
            faults.append(f"{at}: at most {MAX_ROWS} rows")
        dists = 0
        for q in queries:
            try:
                n = parse(q)
            except QueryError as e:
                faults.append(f"{at}: {e}")
                continue
            dists += isinstance(n, Query) and n.agg == "dist"
            faults += [f"{at}: ${v} isn't declared" for v in variables(n) if v not in declared]
        if kind == "heatmap" and not (len(queries) == dists == 1) or kind != "heatmap" and dists:
            faults.append(f"{at}: a heatmap takes exactly one dist: query, and nothing else does")
    return faults


def bind(definition: dict, **values: str) -> dict[str, list[str]]:
    """Template variables with their tags: the given value, else the default; no value means no constraint."""
    out = {}
    for v in definition.get("variables", []):
        x = values.get(v["name"], v.get("default", ""))
        out[v["name"].lower()] = [f"{v.get('tag', v['name'])}:{x}"] if x and x != "*" else []
    return out


def used_metrics(definition: dict) -> list[str]:
    return sorted({m for w in definition.get("widgets", []) for q in w.get("queries", []) for m in metrics(parse(q))})


def vocabulary() -> dict[str, tuple[str, ...]]:
    """Words an editor completes."""
    return {"aggregators": AGGREGATORS, "functions": tuple(FUNCTIONS), "methods": METHODS, "modifiers": ("rollup", "as_rate", "as_count", "fill")}


def structured(metric: str, agg: str = "avg", where: list[str] | None = None, by: list[str] | None = None) -> tuple[str, list[str]]:
    """A query's text from its parts, and warnings: a bare tag is widened to `key:*`."""
    warn, ms = [], []
    for t in where or []:
        if ":" not in t:
            warn.append(f"{t} is read as {t}:*")
            t = f"{t}:*"
        ms.append(t)
    text = f"{agg}:{metric}{{{','.join(ms) or '*'}}}" + (f" by {{{','.join(by)}}}" if by else "")
    return str(parse(text)), warn


def reduced(lines: DataFrame, reducer: str) -> DataFrame:
    """(scope, value) of each line's points that aren't null."""
    return lines.groupBy("scope").agg(reduce_points(reducer).alias("value"))


def toplist(lines: DataFrame, reducer: str, limit: int = 10) -> DataFrame:
    """The first lines by value, ties by scope. The limit is the feature (at most MAX_ROWS)."""
    return reduced(lines, reducer).orderBy(F.col("value").desc_nulls_last(), "scope").limit(min(MAX_ROWS, limit))


def conditional(value: str, rules: list[tuple[str, float, str]], default: str = "") -> Column:
    """The format of the first rule (op, level, format) that a value meets."""
    ops: dict[str, Callable] = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
    out = None
    for op, level, fmt in rules:
        c = ops[op](F.col(value), F.lit(level))
        out = F.when(c, fmt) if out is None else out.when(c, fmt)
    return F.lit(default) if out is None else out.otherwise(default)


def align(lines: DataFrame, scopes: list[str]) -> DataFrame:
    """One row per time with a column per named line."""
    return lines.groupBy((F.col("b") * 1000).alias("ts_ms")).pivot("scope", scopes).agg(F.first("v"))


def heatmap(distribution: DataFrame, bands: list[float]) -> DataFrame:
    """(scope, b, band, count): bins shared out over value bands in proportion to their overlap; band is its lower edge,
    and what lies outside the bands falls into the nearest."""
    x = distribution.select("scope", "b", F.explode("bins").alias("x")).select("scope", "b", "x.*")
    edges = list(zip(bands, [*bands[1:], None], strict=True))
    span = F.when(F.col("upper") > F.col("lower"), F.col("upper") - F.col("lower"))

    def part(lo: float, hi: float | None, first: bool) -> Column:
        a = F.col("lower") if first else F.greatest(F.col("lower"), F.lit(lo))
        z = F.col("upper") if hi is None else F.least(F.col("upper"), F.lit(hi))
        inside = (F.col("lower") >= (float("-inf") if first else lo)) & (F.lit(True) if hi is None else F.col("lower") < hi)
        return F.when(span.isNull(), inside.cast("double")).otherwise(F.greatest(F.lit(0.0), (z - a) / span))

    cells = F.explode(F.array(*(F.struct(F.lit(lo).alias("band"), part(lo, hi, i == 0).alias("p")) for i, (lo, hi) in enumerate(edges))))
    y = x.select("scope", "b", "count", cells.alias("c")).where("c.p > 0")
    return y.groupBy("scope", "b", F.col("c.band").alias("band")).agg(F.round(F.sum(F.col("count") * F.col("c.p")), 6).alias("count"))


def template_name(text: str) -> bool:
    return bool(re.fullmatch(r"[a-z][a-z0-9_]*", text))
