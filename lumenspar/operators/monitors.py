"""Monitors: query syntax, window evaluation, the status machine with hysteresis, backtests and timelines."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspar import model
from lumenspar.logql.syntax import LABELS
from lumenspar.metricql.syntax import Node, Query, QueryError, number, parse, walk

TIME_AGGS = ("avg", "sum", "min", "max", "last", "pct_nonnull")
OPS = (">=", "<=", "==", "!=", ">", "<")
DAY = 86_400
_TAIL = re.compile(r"(>=|<=|==|!=|>|<)\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*$")
_METRIC = re.compile(rf"\s*({'|'.join(TIME_AGGS)})\s*\(\s*last_(\d+)(m|h)\s*\)\s*:(.*)$", re.S)
_LOGS = re.compile(r'\s*logs\(\s*"((?:[^"\\]|\\.)*)"\s*\)\s*\.rollup\(\s*"count"\s*\)(?:\s*\.by\(\s*"([^"]+)"\s*\))?\s*\.last\(\s*"(\d+)(m|h)"\s*\)\s*$', re.S)


@dataclass(frozen=True)
class MonitorQuery:
    """kind metric or logs; window in seconds; by is a log monitor's field."""

    kind: str
    time_agg: str
    window: int
    text: str
    op: str
    threshold: float
    by: str = ""
    node: Node | None = field(default=None, compare=False)

    def __str__(self) -> str:
        span = f"{self.window // 3600}h" if self.window % 3600 == 0 else f"{self.window // 60}m"
        if self.kind == "logs":
            by = f'.by("{self.by}")' if self.by else ""
            return f'logs({json.dumps(self.text, ensure_ascii=False)}).rollup("count"){by}.last("{span}") {self.op} {number(self.threshold)}'
        return f"{self.time_agg}(last_{span}):{self.node} {self.op} {number(self.threshold)}"


def parse_query(text: str) -> MonitorQuery:
    """The comparison is read from the right; the rest is a metric or log query with its window of 1 minute to 24 hours."""
    tail = _TAIL.search(text)
    if not tail:
        raise QueryError("a monitor ends with a comparison, as in `> 5`")
    head, op, level = text[: tail.start()], tail[1], float(tail[2])
    m, logs = _METRIC.match(head), _LOGS.match(head)
    if logs:
        q, by, n, unit = logs.groups()
        if by and by not in LABELS and not by.startswith("@"):
            raise QueryError(f"a log monitor groups by one of {', '.join(LABELS)} or an @attribute, not {by}")
        out = MonitorQuery("logs", "sum", int(n) * (3600 if unit == "h" else 60), re.sub(r"\\(.)", r"\1", q), op, level, by or "")
    elif m:
        agg, n, unit, inner = m.groups()
        node = parse(inner.strip())
        out = MonitorQuery("metric", agg, int(n) * (3600 if unit == "h" else 60), inner.strip(), op, level, node=node)
        rolls = {x.seconds for q in walk(node) if isinstance(q, Query) for x in q.modifiers if x.name == "rollup" and x.seconds}
        if len(rolls) > 1 or any(out.window % r or DAY % r for r in rolls):
            raise QueryError("a rollup must divide the window and a day, and all must be the same")
    else:
        raise QueryError("expected agg(last_5m):query or logs(\"...\").rollup(\"count\").last(\"5m\")")
    if not 60 <= out.window <= DAY:
        raise QueryError("the window must lie between 1m and 24h")
    return out


def step(q: MonitorQuery, most: int = 1500) -> int:
    """Bucket width: the explicit rollup, else 10 s, else the smallest multiple of 10 s that keeps the window within
    `most` buckets and divides it and a day."""
    if q.node is not None:
        for n in walk(q.node):
            if isinstance(n, Query) and (r := n.modifier("rollup")) and r.seconds:
                return r.seconds
    s = 10
    while q.window // s > most or q.window % s or DAY % s:
        s += 10
    return s


def window(q: MonitorQuery, now: int, delay: int = 0) -> tuple[int, int]:
    """[from, to): the end is cut to the step after the delay."""
    s = step(q)
    to = (now - delay) // s * s
    return to - q.window, to


@dataclass(frozen=True)
class Thresholds:
    op: str
    critical: float
    warning: float | None = None
    critical_recovery: float | None = None
    warning_recovery: float | None = None

    def __post_init__(self) -> None:
        if self.op in ("==", "!="):
            if any(x is not None for x in (self.warning, self.critical_recovery, self.warning_recovery)):
                raise QueryError(f"{self.op} takes a critical level only")
            return
        s = 1 if self.op.startswith(">") else -1
        for a, b, strict in ((self.warning, self.critical, True), (self.critical_recovery, self.critical, False), (self.warning_recovery, self.warning, False)):
            if a is not None and (b is None or (s * a >= s * b if strict else s * a > s * b)):
                raise QueryError("thresholds are out of order")


def holds(op: str, v: float, level: float) -> bool:
    return {">": v > level, ">=": v >= level, "<": v < level, "<=": v <= level, "==": v == level, "!=": v != level}[op]


@dataclass(frozen=True)
class Options:
    min_failures: int = 1
    no_data_s: int = 0  # 0: never NO_DATA
    renotify_s: int = 0
    muted: bool = False
    forget_s: int = 86_400  # a group without data for this long is deleted


def next_level(t: Thresholds, status: str, v: float, failures: int, o: Options) -> str:
    """The status that a value leads to: a level is entered past its threshold and left past its recovery. `failures` is
    the number of evaluations in a row, this one included, past the critical level."""
    past = lambda level, recovery=None: level is not None and holds(t.op, v, level if recovery is None else recovery)
    if failures >= max(1, o.min_failures):
        return "ALERT"
    if status == "ALERT" and past(t.critical, t.critical_recovery):
        return "ALERT"
    if past(t.warning):
        return "WARN"
    if status in ("WARN", "ALERT") and past(t.warning, t.warning_recovery):
        return "WARN"
    return "OK"


@dataclass
class State:
    status: str = "OK"
    since: int = 0
    breaches: int = 0
    last_data: int = 0
    notified: int = 0


def advance(s: State, t: Thresholds, o: Options, now: int, v: float | None, window_end: int | None = None, data_at: int | None = None) -> str:
    """One evaluation; returns the kind of notification ('' for none): alert, warn, recovery, no_data or renotify.

    Silence is measured from the newest data (data_at) to the end of the window, which both default to now. Data after
    NO_DATA is judged as if the group were new. A muted monitor's state advances, and nobody is told.
    """
    to = s.status
    if v is None:
        if o.no_data_s and s.last_data and (now if window_end is None else window_end) - s.last_data >= o.no_data_s:
            to, s.breaches = "NO_DATA", 0
    else:
        s.last_data = now if data_at is None else data_at
        s.breaches = s.breaches + 1 if holds(t.op, v, t.critical) else 0
        to = next_level(t, "OK" if s.status == "NO_DATA" else s.status, v, s.breaches, o)
    event = ""
    if to != s.status:
        s.status, s.since = to, now
        event = {"ALERT": "alert", "WARN": "warn", "OK": "recovery", "NO_DATA": "no_data"}[to]
    elif o.renotify_s and to in ("ALERT", "NO_DATA") and now - s.notified >= o.renotify_s:
        event = "renotify"
    if o.muted:
        return ""
    if event:
        s.notified = now
    return event


def reduce_windows(points: DataFrame, agg: str, window_s: int, step_s: int, require_full: bool = False) -> DataFrame:
    """(scope, tick, value): each group's window value at the end of every bucket, over dense points (scope, b, v).

    Empty buckets are skipped; with require_full a window that has one gives null. pct_nonnull is the share of buckets
    with a value. All ticks come from one pass with a range frame; nothing is fetched per tick.
    """
    w = Window.partitionBy("scope").orderBy("b").rangeBetween(-(window_s - step_s), 0)
    n = window_s // step_s
    have = F.count("v").over(w)
    last = F.last("v", ignorenulls=True).over(w)
    val = {"avg": F.avg("v").over(w), "sum": F.sum("v").over(w), "min": F.min("v").over(w), "max": F.max("v").over(w), "last": last, "pct_nonnull": have * 100.0 / n}[agg]
    if require_full:
        val = F.when(have == n, val)
    first = F.min("b").over(Window.partitionBy("scope"))
    return points.select("scope", (F.col("b") + step_s).alias("tick"), val.alias("value"), ((F.col("b") - first) >= window_s - step_s).alias("_full")).where("_full").drop("_full")


def reduce_whole(points: DataFrame, agg: str, require_full: bool = False) -> DataFrame:
    """(scope, value) over all buckets of dense points: one evaluation."""
    have, n = F.count("v"), F.count("*")
    val: Column = {"avg": F.avg("v"), "sum": F.sum("v"), "min": F.min("v"), "max": F.max("v"), "last": F.max_by("v", F.when(F.col("v").isNotNull(), F.col("b"))), "pct_nonnull": have * 100.0 / n}[agg]
    return points.groupBy("scope").agg((F.when(have == n, val) if require_full else val).alias("value"))


def log_counts(counts: DataFrame, start: int, end: int, step_s: int, groups: int = 100) -> DataFrame:
    """Dense zeros of a log monitor: (bucket ms, grp, n) to points (scope, b, v); a missing group value is (none). More than
    `groups` group values are an error when the points are read."""
    counts = model.at_most(counts, "grp", groups, f"the monitor has more than {groups} groups; group by a field with fewer values")
    scope = F.when(F.col("grp") == "", "(none)").otherwise(F.col("grp"))
    m = counts.groupBy(scope.alias("scope")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("bucket") / 1000).cast("bigint").alias("b"), F.col("n").cast("double").alias("v")))).alias("m"))
    b = F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(end - step_s).cast("bigint"), F.lit(step_s).cast("bigint")))
    return m.select("scope", "m", b.alias("b")).select("scope", "b", F.coalesce(F.try_element_at("m", F.col("b")), F.lit(0.0)).alias("v"))


def replay(ticks: DataFrame, t: Thresholds, o: Options | None = None) -> DataFrame:
    """(scope, tick, value, status, event) of every tick of every group in order: a backtest.

    Status depends on the status before, so a group is replayed in one task; a group is one alert with at most one row
    per tick of the backtest's window (20 000 ticks), whatever the data behind it.
    """
    o = o or Options()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        s, status, event, seen = State(), [], [], False
        for tick, v in zip(pdf.tick, pdf.value, strict=True):
            v = None if pd.isna(v) else float(v)
            if seen and v is None and o.forget_s and tick - s.last_data >= o.forget_s:
                s, seen = State(), False  # deleted; data makes it a new group
            seen |= v is not None  # a group begins with its first value
            event.append(advance(s, t, o, int(tick), v) if seen else "")
            status.append(s.status if seen else None)
        return pdf.assign(status=status, event=event)[["scope", "tick", "value", "status", "event"]]

    return ticks.select("scope", "tick", "value").groupBy("scope").applyInPandas(run, "scope string, tick bigint, value double, status string, event string")


def timeline(replayed: DataFrame) -> DataFrame:
    """(scope, status, since, until): the runs of equal status; until is null for the last."""
    w = Window.partitionBy("scope").orderBy("tick")
    d = replayed.where("status is not null").withColumn("p", F.lag("status").over(w)).where(~F.col("status").eqNullSafe(F.col("p")))
    return d.select("scope", "status", F.col("tick").alias("since"), F.lead("tick").over(w).alias("until"))


def list_events(replayed: DataFrame, start: int | None = None, end: int | None = None, kinds: tuple[str, ...] = (), scope: str | None = None, limit: int = 500) -> DataFrame:
    """(tick, scope, event, status, value) of notifications in [start, end), newest first; limit is 1 to 5000."""
    if not 1 <= limit <= 5000:
        raise QueryError("limit: want 1 to 5000")
    d = replayed.where("event <> ''")
    for on, c in ((start is not None, F.col("tick") >= F.lit(start)), (end is not None, F.col("tick") < F.lit(end)), (bool(kinds), F.col("event").isin(*kinds)), (scope is not None, F.col("scope") == F.lit(scope))):
        if on:
            d = d.where(c)
    return d.select("tick", "scope", "event", "status", "value").orderBy(F.desc("tick"), "scope").limit(limit)


def list_monitors(monitors: DataFrame, states: DataFrame, status: str = "", name: str = "") -> DataFrame:
    """Monitors with their worst status and number of groups, worst first; without states OK."""
    rank = F.when(F.col("status") == "ALERT", 3).when(F.col("status") == "WARN", 2).when(F.col("status") == "NO_DATA", 1).otherwise(0)
    s = states.dropDuplicates(["monitor_id", "group_key"]).groupBy("monitor_id").agg(F.max(rank).alias("worst"), F.count("*").alias("groups"), F.count_if(F.col("status") == "ALERT").alias("alerting"))
    j = F.broadcast(monitors).join(s, F.col("id") == F.col("monitor_id"), "left")  # definitions are configuration
    out = j.select("id", "name", F.element_at(F.array(*map(F.lit, ("OK", "NO_DATA", "WARN", "ALERT"))), F.coalesce("worst", F.lit(0)) + 1).alias("status"), F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("alerting", F.lit(0)).alias("alerting"), F.coalesce("worst", F.lit(0)).alias("worst"))
    if status:
        out = out.where(F.col("status") == status)
    if name:
        out = out.where(F.lower("name").contains(name.lower()))
    return out.orderBy(F.desc("worst"), "name").drop("worst")


def phase(uid: str, interval_s: int) -> int:
    """A monitor's offset within its interval: 64-bit FNV-1a of its uid."""
    h = 0xCBF29CE484222325
    for b in uid.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h % interval_s


_FIELD = re.compile(r"\{\{\s*\.(\w+)(?:\.(\w+))?\s*\}\}")


def render(template: str, values: dict[str, object]) -> str:
    """{{.Name}} and {{.Tags.key}} filled in; an unknown field is an error, so a template can be proven when it is saved."""
    def sub(m: re.Match[str]) -> str:
        if m[1] not in values:
            raise QueryError(f"the template has no field {m[1]}")
        v = values[m[1]]
        v = v.get(m[2], "") if m[2] and isinstance(v, dict) else v
        return number(v) if isinstance(v, float) else str(v)

    return _FIELD.sub(sub, template)


def mentions(template: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\S)@([A-Za-z][\w-]*)", template)))
