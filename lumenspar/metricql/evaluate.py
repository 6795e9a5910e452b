"""Compilation of metric queries to DataFrames.

Each selector is filter -> time aggregate per series and bucket -> space aggregate per group and bucket -> dense lines.
Both aggregates are partial in the map; a group's line is made dense from one row per group (a map of at most
`max_buckets` entries), so empty buckets cost no join. A Frame is a constant or lines (tags, b, v), b a bucket's start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspar import model
from lumenspar.functions import sketch
from lumenspar.metricql.syntax import PERCENTILES, Binary, Call, Matcher, Modifier, Node, Number, Query, QueryError, Text, Unary, parse, variables, walk


@dataclass(frozen=True)
class Grid:
    """Buckets of `interval` seconds from `first`; with clamp only [start, end] is read."""

    first: int
    interval: int
    n: int
    start: int
    end: int
    clamp: bool = False

    def shifted(self, seconds: int) -> Grid:
        return Grid(self.first + seconds, self.interval, self.n, self.start + seconds, self.end + seconds, self.clamp)

    @property
    def last(self) -> int:
        return self.first + (self.n - 1) * self.interval


def default_interval(start: int, end: int) -> int:
    """About 300 buckets, in tens of seconds."""
    return max(10, -(-(-(-(end - start) // 300)) // 10) * 10)


def plan_grid(node: Node, start: int, end: int, interval: int = 0, max_buckets: int = 1500, clamp: bool = False) -> Grid:
    if not 0 <= start < end <= 253_402_300_799:
        raise QueryError("the window must end after it starts and lie between 1970 and 9999")
    rolls = {m.seconds for q in walk(node) if isinstance(q, Query) for m in q.modifiers if m.name == "rollup" and m.seconds}
    if len(rolls) > 1:
        raise QueryError(f"rollups of different widths in one query: {sorted(rolls)}")
    iv = interval or next(iter(rolls), 0) or default_interval(start, end)
    first = start // iv * iv
    n = (end - first) // iv + 1
    if n > max_buckets:
        raise QueryError(f"{n} buckets are more than {max_buckets}; use a wider interval")
    return Grid(first, iv, n, start, end, clamp)


@dataclass
class Frame:
    """A constant, or lines (tags, b, v) dense over the grid."""

    scalar: float | None = None
    lines: DataFrame | None = None


@dataclass
class Result:
    """lines: (scope, tags, b in s, v), every line dense; warnings() may run the anti-joins it needs."""

    lines: DataFrame
    grid: Grid
    _warn: list[Callable[[], str | None]] = field(default_factory=list)

    def warnings(self) -> list[str]:
        return [w for f in self._warn if (w := f())]

    def points(self) -> DataFrame:
        """(scope, ts_ms, value) rows."""
        return self.lines.select("scope", (F.col("b") * 1000).alias("ts_ms"), F.col("v").alias("value"))

    def series(self) -> DataFrame:
        """One row per line: (scope, tags, points ARRAY<STRUCT<ts_ms,value>>), not-a-number as null, by scope."""
        p = F.struct((F.col("b") * 1000).alias("ts_ms"), F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v")).alias("value"))
        return self.lines.groupBy("scope", "tags").agg(F.array_sort(F.collect_list(p)).alias("points")).orderBy("scope")


PROMOTED = ("service", "env", "host", "route", "status")  # tags that stores keep as columns too, by their first value


class Engine:
    """Answers metric queries over metric_samples and, for percentiles, sketch_bins and sketch_points."""

    def __init__(self, spark: SparkSession, samples: DataFrame, kinds: dict[str, str], sketch_bins: DataFrame | None = None, sketch_points: DataFrame | None = None, max_series: int = 1000, max_buckets: int = 1500) -> None:
        self.spark, self.samples, self.kinds = spark, samples, kinds
        self.sketch_bins, self.sketch_points = sketch_bins, sketch_points
        self.max_series, self.max_buckets = max_series, max_buckets
        self._shared: dict[tuple, DataFrame] | None = None
        self._held: list[DataFrame] = []

    def release(self) -> None:
        """Gives back the selections that batches keep for their results; results may still be read, at full cost."""
        while self._held:
            self._held.pop().unpersist()

    def query(self, text: str | Node, start: int, end: int, interval: int = 0, bound: dict[str, list[str]] | None = None, clamp: bool = False) -> Result:
        """bound: template variable -> tags `k:v` it stands for."""
        node = parse(text) if isinstance(text, str) else text
        if any(isinstance(q, Query) and q.agg == "dist" for q in walk(node)):
            raise QueryError("dist: answers with a distribution; use distribution()")
        bound = {k.lower(): v for k, v in (bound or {}).items()}
        grid = plan_grid(node, start, end, interval, self.max_buckets, clamp)
        warn: list[Callable[[], str | None]] = []
        frame = self._eval(node, grid, bound, warn)
        lines = frame.lines if frame.lines is not None else self._constant(frame.scalar, grid)
        return Result(lines.select(model.scope(F.col("tags")).alias("scope"), "tags", "b", "v"), grid, warn)

    def batch(self, texts: dict[str, str], start: int, end: int, **options) -> dict[str, Result | QueryError]:
        """Several queries over one window; equal selections share one plan, and each fails on its own."""
        if len(texts) > 50:
            raise QueryError("a batch has at most 50 queries")
        self._shared = {}
        out: dict[str, Result | QueryError] = {}
        try:
            for name, text in texts.items():
                try:
                    out[name] = self.query(text, start, end, **options)
                except QueryError as e:
                    out[name] = e
        finally:
            self._shared = None
        return out

    def validate(self, text: str) -> dict[str, object]:
        """The canonical text and variables of a query, or its error with the column."""
        try:
            n = parse(text)
            return {"query": str(n), "variables": variables(n)}
        except QueryError as e:
            return {"error": e.message, "col": e.col}

    # leaves

    def _matchers(self, q: Query, bound: dict[str, list[str]], warn: list) -> list[Matcher]:
        out: list[Matcher] = []
        for m in q.matchers:
            if not m.var:
                out.append(m)
                continue
            if m.var not in bound:
                raise QueryError(f"the variable ${m.var} isn't bound", q.col)
            if not bound[m.var]:
                warn.append(lambda v=m.var: f"${v} is bound to nothing and doesn't constrain the query")
            keys: dict[str, list[str]] = {}
            for tag in bound[m.var]:
                k, _, v = tag.partition(":")
                keys.setdefault(k.lower(), []).append(v)
            out += [Matcher(k, tuple(v), is_in=len(v) > 1) for k, v in keys.items()]
        return out

    @staticmethod
    def _condition(m: Matcher, t: Column) -> Column:
        if m.is_in:  # tested on the first value of the key
            v = model.first_value(t, m.key)
            c = F.lit(False)
            for x in m.values:
                c = c | model.glob(v, x)
            c = F.coalesce(c, F.lit(False))
        else:
            c = model.has_value(t, m.key, m.values[0])
        return ~c if m.negated else c

    def _select(self, df: DataFrame, q: Query, metric: str, grid: Grid, bound: dict, warn: list) -> DataFrame:
        lo, hi = (max(grid.first, grid.start), grid.end) if grid.clamp else (grid.first, grid.last + grid.interval - 1)
        d = df.where((F.col("metric") == metric) & F.col("ts_s").between(lo, hi))
        for m in self._matchers(q, bound, warn):
            d = d.where(self._condition(m, F.col("tags")))
            if m.key in PROMOTED and m.key in df.columns and not m.negated:  # what the scan can skip by
                plain = m.is_in and not any("*" in v for v in m.values)
                d = d.where(F.col(m.key).isin(*m.values) if plain else F.col(m.key).isNotNull())
        return d.withColumn("b", F.col("ts_s") - F.pmod(F.col("ts_s") - grid.first, F.lit(grid.interval)))

    @staticmethod
    def _group(t: Column, by: tuple[str, ...]) -> Column:
        """The group's tags: the keys of `by` that the series has, by key."""
        return model.tags(**{k: model.first_value(t, k) for k in sorted(by)}) if by else F.array().cast(model.TAGS)

    def _kind(self, metric: str) -> str:
        return self.kinds.get(metric, "")

    def _leaf(self, q: Query, grid: Grid, bound: dict, warn: list) -> DataFrame:
        kind = self._kind(q.metric)
        roll = q.modifier("rollup")
        if q.agg in PERCENTILES:
            if kind != "distribution":
                raise QueryError(f"{q.agg} needs a distribution; {q.metric} is a {kind or 'metric of unknown type'}", q.col)
            if roll:
                warn.append(lambda: f"rollup({roll.arg}) isn't used on a percentile: sketches are merged")
            return self._percentile(q, grid, bound, warn)
        if kind == "distribution":
            raise QueryError(f"{q.metric} is a distribution; ask for {', '.join(q.metric + s for s in ('.count', '.sum', '.min', '.max'))} or a percentile", q.col)
        method = roll.arg if roll else "sum" if kind in ("count", "rate") else "avg"
        key = ("leaf", q.metric, tuple(self._matchers(q, bound, [])), method, grid)
        per = self._shared.get(key) if self._shared is not None else None
        if per is None:
            agg = {"avg": F.avg("value"), "sum": F.sum("value"), "min": F.min("value"), "max": F.max("value"), "count": F.count("value").cast("double"), "last": F.max_by("value", "ts_s")}[method]
            per = self._select(self.samples, q, q.metric, grid, bound, warn).where("value is not null").groupBy("series_key", "tags", "b").agg(agg.alias("v"))
            if self._shared is not None:
                self._shared[key] = per = per.persist()
                self._held.append(per)
        per = model.at_most(per, "series_key", self.max_series, f"{q.metric}: the query selects more than {self.max_series} series")
        space = {"avg": F.avg("v"), "sum": F.sum("v"), "min": F.min("v"), "max": F.max("v"), "count": F.count("v").cast("double")}[q.agg]
        return self._dense(per.groupBy(self._group(F.col("tags"), q.by).alias("tags"), "b").agg(space.alias("v")), grid)

    def _merged(self, q: Query, grid: Grid, bound: dict, warn: list) -> tuple[DataFrame, DataFrame]:
        if self.sketch_bins is None or self.sketch_points is None:
            raise QueryError("there is no sketch store")
        g = self._group(F.col("tags"), q.by).alias("g")
        bins = self._select(self.sketch_bins, q, q.metric, grid, bound, warn).groupBy(g, "b", "sign", "idx").agg(F.sum("count").alias("count"))
        bins = sketch.collapse(bins, ["g", "b"])
        read = self._select(self.sketch_points, q, q.metric, grid, bound, []).where("count > 0")
        pts = model.at_most(read, "series_key", self.max_series, f"{q.metric}: the query selects more than {self.max_series} series").groupBy(g, "b").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.count_distinct("gamma").alias("gammas"))
        pts = pts.where(F.when(F.col("gammas") > 1, F.raise_error("sketches of different gamma can't be merged")).otherwise(F.lit(True)).cast("boolean"))
        return bins, pts

    def _percentile(self, q: Query, grid: Grid, bound: dict, warn: list) -> DataFrame:
        bins, pts = self._merged(q, grid, bound, warn)
        got = sketch.quantiles(bins, pts, ["g", "b"], {"v": int(q.agg[1:]) / 100})
        return self._dense(got.withColumnRenamed("g", "tags"), grid)

    def distribution(self, text: str, start: int, end: int, interval: int = 0, bound: dict[str, list[str]] | None = None) -> DataFrame:
        """(scope, b, count, sum, min, max, bins ARRAY<STRUCT<lower,upper,count>>) of a single `dist:` query."""
        q = parse(text)
        if not isinstance(q, Query) or q.agg != "dist" or q.modifiers:
            raise QueryError("one dist: query without modifiers or arithmetic is needed")
        if self._kind(q.metric) != "distribution":
            raise QueryError(f"{q.metric} isn't a distribution", q.col)
        grid = plan_grid(q, start, end, interval, self.max_buckets)
        bins, pts = self._merged(q, grid, {k.lower(): v for k, v in (bound or {}).items()}, [])
        arr = sketch.ranges(bins.where("count > 0"), ["g", "b"]).groupBy("g", "b").agg(F.array_sort(F.collect_list(F.struct("lower", "upper", "count"))).alias("bins"))
        return pts.join(arr, ["g", "b"]).select(model.scope(F.col("g")).alias("scope"), "b", "count", "sum", "min", "max", "bins")

    def _dense(self, sparse: DataFrame, grid: Grid) -> DataFrame:
        """Every group with every bucket; a group without any point isn't a line."""
        m = sparse.groupBy("tags").agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"))
        b = F.sequence(F.lit(grid.first).cast("bigint"), F.lit(grid.last).cast("bigint"), F.lit(grid.interval).cast("bigint"))
        return m.select("tags", "m", F.explode(b).alias("b")).select("tags", "b", F.try_element_at("m", F.col("b")).alias("v"))

    def _constant(self, x: float | None, grid: Grid) -> DataFrame:
        d = self.spark.range(1).select(F.array().cast(model.TAGS).alias("tags"), F.explode(F.sequence(F.lit(grid.first).cast("bigint"), F.lit(grid.last).cast("bigint"), F.lit(grid.interval).cast("bigint"))).alias("b"))
        return d.withColumn("v", F.lit(x).cast("double"))

    # the tree

    def _eval(self, n: Node, grid: Grid, bound: dict, warn: list) -> Frame:
        if isinstance(n, Number):
            return Frame(n.value)
        if isinstance(n, Unary):
            return self._map(self._eval(n.node, grid, bound, warn), lambda v: -v, lambda x: -x)
        if isinstance(n, Query):
            lines = self._leaf(n, grid, bound, warn)
            for m in n.modifiers:
                lines = self._modify(lines, m, n, grid)
            return Frame(lines=lines)
        if isinstance(n, Binary):
            return self._binary(n, grid, bound, warn)
        if isinstance(n, Call):
            return self._call(n, grid, bound, warn)
        raise QueryError(f"{n} can't be evaluated")

    @staticmethod
    def _map(f: Frame, col: Callable[[Column], Column], num: Callable[[float], float | None]) -> Frame:
        if f.lines is None:
            return Frame(None if f.scalar is None else num(f.scalar))
        return Frame(lines=f.lines.withColumn("v", col(F.col("v"))))

    def _modify(self, lines: DataFrame, m: Modifier, q: Query, grid: Grid) -> DataFrame:
        kind = self._kind(q.metric)
        v = F.col("v")
        if m.name in ("as_rate", "as_count"):
            if kind not in ("count", "rate", ""):
                raise QueryError(f".{m.name}() needs a count or a rate; {q.metric} is a {kind}", q.col)
            if m.name == "as_rate":
                return lines.withColumn("v", v / float(grid.interval))
            return lines.withColumn("v", v * float(grid.interval)) if kind == "rate" else lines
        if m.name == "fill" and m.arg != "null":
            return fill(lines, m.arg, m.seconds // grid.interval if m.seconds else 0, grid.interval, bool(m.seconds))
        return lines

    def _binary(self, n: Binary, grid: Grid, bound: dict, warn: list) -> Frame:
        a, b = self._eval(n.left, grid, bound, warn), self._eval(n.right, grid, bound, warn)
        cols: dict[str, Callable[[Column, Column], Column]] = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.try_divide(x, y)}
        if a.lines is None and b.lines is None:
            x, y = a.scalar, b.scalar
            if x is None or y is None or n.op == "/" and y == 0:
                return Frame(None)
            return Frame({"+": x + y, "-": x - y, "*": x * y, "/": x / y if y else None}[n.op])
        op = cols[n.op]
        if b.lines is None:
            return Frame(lines=a.lines.withColumn("v", op(F.col("v"), F.lit(b.scalar).cast("double"))))
        if a.lines is None:
            return Frame(lines=b.lines.withColumn("v", op(F.lit(a.scalar).cast("double"), F.col("v"))))
        left, right = a.lines, b.lines

        def dropped() -> str | None:
            l, r = left.select("tags").distinct(), right.select("tags").distinct()
            names = [x[0] for x in l.join(r, "tags", "left_anti").unionByName(r.join(l, "tags", "left_anti")).select(model.scope(F.col("tags"))).orderBy(F.lit(1)).take(20)]
            return f"lines on one side of {n.op} only were dropped: {'; '.join(names)}" if names else None

        warn.append(dropped)
        j = left.join(right.select("tags", "b", F.col("v").alias("v2")), ["tags", "b"])
        return Frame(lines=j.select("tags", "b", op(F.col("v"), F.col("v2")).alias("v")))

    def _call(self, n: Call, grid: Grid, bound: dict, warn: list) -> Frame:
        num = lambda x: -x.node.value if isinstance(x, Unary) else x.value
        if n.name == "timeshift":
            secs = int(num(n.args[1]))
            if secs % grid.interval:
                raise QueryError(f"timeshift must be a multiple of the interval of {grid.interval} s", n.col)
            f = self._eval(n.args[0], grid.shifted(secs), bound, warn)
            return f if f.lines is None else Frame(lines=f.lines.withColumn("b", F.col("b") - secs))
        if n.name == "histogram_quantile":
            return self._histogram(n, num(n.args[0]), grid, bound, warn)
        f = self._eval(n.args[0], grid, bound, warn)
        w = Window.partitionBy("tags").orderBy("b")
        import math

        log = lambda fn: lambda x: fn(x) if x > 0 else None
        if n.name == "abs":
            return self._map(f, F.abs, abs)
        if n.name == "log2":
            return self._map(f, lambda v: F.when(v > 0, F.log2(v)), log(math.log2))
        if n.name == "log10":
            return self._map(f, lambda v: F.when(v > 0, F.log10(v)), log(math.log10))
        if n.name in ("clamp_min", "clamp_max"):
            x = num(n.args[1])
            low = n.name == "clamp_min"
            return self._map(f, lambda v: F.when(v.isNotNull(), (F.greatest if low else F.least)(v, F.lit(float(x)))), lambda y: (max if low else min)(y, x))
        if n.name == "diff":
            return Frame(0.0 if f.scalar is not None else None) if f.lines is None else Frame(lines=f.lines.withColumn("v", F.col("v") - F.lag("v").over(w)))
        if n.name == "moving_avg":
            k = int(num(n.args[1]))
            if k < 1:
                raise QueryError("moving_avg needs at least one bucket", n.col)
            return f if f.lines is None else Frame(lines=f.lines.withColumn("v", F.avg("v").over(w.rowsBetween(-(k - 1), 0))))
        if n.name == "top":
            return f if f.lines is None else Frame(lines=self._top(f.lines, n, int(num(n.args[1]))))
        raise QueryError(f"{n.name} isn't known", n.col)

    @staticmethod
    def _top(lines: DataFrame, n: Call, k: int) -> DataFrame:
        """The first k lines by a reducer of their points; ties by scope, lines without a point last either way."""
        words = [a.value for a in n.args[2:] if isinstance(a, Text)]
        reducer, order = words[0] if words else "mean", words[1] if len(words) > 1 else "desc"
        score = reduce_points(reducer)
        s = lines.groupBy("tags").agg(score.alias("s")).withColumn("scope", model.scope(F.col("tags")))
        by = F.col("s").desc_nulls_last() if order == "desc" else F.col("s").asc_nulls_last()
        return lines.join(s.orderBy(by, "scope").limit(max(0, k)).select("tags"), "tags", "left_semi")

    def _histogram(self, n: Call, q: float, grid: Grid, bound: dict, warn: list) -> Frame:
        if not 0 <= q <= 1:
            raise QueryError("the quantile must lie between 0 and 1", n.col)
        arg = n.args[1]
        if not any(isinstance(x, Query) and "upper_bound" in x.by for x in walk(arg)):
            raise QueryError("histogram_quantile needs buckets grouped by upper_bound", n.col)
        f = self._eval(arg, grid, bound, warn)
        text = model.first_value(F.col("tags"), "upper_bound")
        up = F.when(text.isin("+Inf", "Inf"), F.lit(float("inf"))).otherwise(text.try_cast("double"))
        d = f.lines.where(up.isNotNull() & ~F.isnan(up)).select(F.filter("tags", lambda x: x["key"] != "upper_bound").alias("tags"), "b", F.when(F.col("v").isNotNull(), F.struct(up.alias("u"), F.col("v").alias("c"))).alias("x"))
        g = d.groupBy("tags", "b").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        return Frame(lines=g.select("tags", "b", histogram_quantile(F.col("xs"), q).alias("v")))


def histogram_quantile(xs: Column, q: float) -> Column:
    """The q-quantile of cumulative buckets sorted by bound (an array of (u, c)), by linear interpolation.

    null without counts; the +Inf bucket gives the bound before it; the first bucket starts at 0, or is its bound if that
    isn't positive; buckets with equal counts give their bound.
    """
    total = F.element_at(xs, -1)["c"]
    rank = F.lit(q) * total
    at = F.array_position(F.transform(xs, lambda x: x["c"] >= rank), True).cast("int")
    cur, prev = F.try_element_at(xs, at), F.when(at > 1, F.try_element_at(xs, F.greatest(at - 1, F.lit(1))))
    lo = F.coalesce(prev["u"], F.lit(0.0))
    below = F.coalesce(prev["c"], F.lit(0.0))
    mid = lo + (cur["u"] - lo) * F.try_divide(rank - below, cur["c"] - below)
    return F.when((F.size(xs) > 0) & (total > 0) & (at > 0), F.when(cur["u"] == float("inf"), prev["u"]).when(prev["u"].isNull() & (cur["u"] <= 0), cur["u"]).when(cur["c"] == below, cur["u"]).otherwise(mid))


def reduce_points(reducer: str, v: str = "v", b: str = "b") -> Column:
    """mean, sum, min, max or last of the points that aren't null."""
    return {"mean": F.avg(v), "avg": F.avg(v), "sum": F.sum(v), "min": F.min(v), "max": F.max(v), "last": F.max_by(v, F.when(F.col(v).isNotNull(), F.col(b)))}[reducer]


def fill(lines: DataFrame, mode: str, reach: int, interval: int, limited: bool) -> DataFrame:
    """Null buckets of dense lines filled: zero, last or linear, only within `reach` buckets of the last real value if
    limited. A leading run is filled only by zero without a limit; linear needs a real value on either side."""
    w = Window.partitionBy("tags").orderBy("b")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    real = F.when(F.col("v").isNotNull(), F.col("b"))
    v0, b0 = F.last("v", ignorenulls=True).over(back), F.last(real, ignorenulls=True).over(back)
    near = (F.col("b") - b0) <= reach * interval if limited else F.lit(True)
    if mode == "zero":
        new = F.when(near if limited else F.lit(True), F.lit(0.0))
    elif mode == "last":
        new = F.when(near, v0)
    else:
        v1, b1 = F.first("v", ignorenulls=True).over(ahead), F.first(real, ignorenulls=True).over(ahead)
        new = F.when(near, v0 + (v1 - v0) * (F.col("b") - b0) / (b1 - b0))
    return lines.withColumn("v", F.coalesce("v", new))
