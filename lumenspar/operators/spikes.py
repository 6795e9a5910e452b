"""Readings that a source cannot or would not have produced.

A reading is flagged as
  impossible  its value is outside what the source's unit allows;
  spike       it, alone or in a run of at most `longest_run` readings, stands off both the readings before and after it
              by more than the source's steps do: off the band between the medians of the `reach` readings on either
              side by more than Q3 + fence * (Q3 - Q1) of the source's steps |v(i) - v(i-1)| in that hour context;
  stuck       it is one of `stuck_run` or more readings in a row without any variance.
Levels, slopes and daily cycles move both medians, so they never count as spikes.

Quantiles come from sketches: logarithmic bins of the steps per source and hour of day, mergeable by adding. A source is
seen once, in order of time, by one group of a sorted partition, which sketches its steps, sets its fences by hour and
flags. A source with more than `hot_rows` rows is cut into segments of `segment_rows` readings, each with a halo of the
readings next in time, however far; its segments are sketched first, the sketches are merged over partitions, and the fences
go back to the segments, which flag by them. So every reading is held against the fence of its own hour, and a source gives
the same flags whether it is cut or not. Only hot sources are shuffled more often, and no task holds a whole one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspar.operators.arrowgroups import map_groups
from lumenspar.session import cut

# What a reading of a unit can be at all.
UNIT_LIMITS = {"percent": (0.0, 100.0), "%": (0.0, 100.0), "fraction": (0.0, 1.0), "boolean": (0.0, 1.0), "celsius": (-273.15, math.inf)}
OTHER_LIMITS = (0.0, math.inf)
UNITS = [*UNIT_LIMITS, "other"]
GAMMA = 1.08
HALO = 32
META_T = -(2**63)
CUT = 1000  # added to the code of a source that is cut into segments


def unit_code(unit: Column, continuous: Column) -> Column:
    """The number under which step 1 gets a source's limits: 2 * index in UNITS, plus 1 if it is continuous."""
    code = F.coalesce(*(F.when(unit == u, F.lit(2 * i)) for i, u in enumerate(UNIT_LIMITS)), F.lit(2 * len(UNIT_LIMITS)))
    return code + F.when(continuous, 1).otherwise(0)


def impossible(v: Column, unit: Column) -> Column:
    """True if v can't be a value of the unit; NaN counts as impossible, null as possible."""
    bad = (v < OTHER_LIMITS[0]) | F.isnan(v)
    out = F.when(unit.isNull(), bad)
    for u, (lo, hi) in UNIT_LIMITS.items():
        out = out.when(unit == u, (v < lo) | (v > hi) | F.isnan(v))
    return F.coalesce(out.otherwise(bad), F.lit(False))


def _side_medians(v: np.ndarray, g: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the `reach` readings before and after each reading within its group (NaN if there is none)."""
    n, out = len(v), []
    for side in (-1, 1):
        w = np.full((n, reach), np.nan)
        for j in range(1, reach + 1):
            if n > j:
                a, b = (slice(j, None), slice(None, -j)) if side < 0 else (slice(None, -j), slice(j, None))
                w[a, j - 1] = np.where(g[a] == g[b], v[b], np.nan)
        k = (~np.isnan(w)).sum(1)
        w.sort(axis=1)
        at = np.maximum(k - 1, 0)
        rows = np.arange(n)
        out.append((w[rows, at // 2] + w[rows, (at + 1) // 2]) / 2)
    return out[0], out[1]


def sketch_bins(step: np.ndarray) -> np.ndarray:
    """The logarithmic bin of each step."""
    with np.errstate(divide="ignore"):
        return np.where(step > 0, np.ceil(np.log(step) / math.log(GAMMA)), -20000).clip(-20000, 20000).astype(np.int64)


def _limits(group: np.ndarray, b: np.ndarray, n: np.ndarray, groups: int, fence: float) -> tuple[np.ndarray, np.ndarray]:
    """(Q3 + fence * (Q3 - Q1), number of steps) of each group, of its sketch (bins b with counts n)."""
    order = np.lexsort((b, group))
    group, b, cum = group[order], b[order], np.cumsum(n[order])
    total = np.bincount(group, n[order], groups).astype(np.int64)
    before = np.cumsum(total) - total
    out = np.full(groups, np.inf)
    some = np.flatnonzero(total)
    if len(some):
        pick = lambda q: b[np.searchsorted(cum, before[some] + q * (total[some] - 1), side="right")]
        value = lambda x: np.where(x <= -20000, 0.0, 2 * GAMMA ** x.astype(float) / (GAMMA + 1))
        q1, q3 = value(pick(0.25)), value(pick(0.75))
        out[some] = q3 + fence * (q3 - q1)
    return out, total


def hour_fences(g: np.ndarray, hour: np.ndarray, b: np.ndarray, n: np.ndarray, groups: int, fence: float, context: int) -> np.ndarray:
    """The fence of each group and hour: of the hour's own steps if they are at least `context`, else of all steps."""
    own, many = _limits(g * 24 + hour, b, n, groups * 24, fence)
    every, _ = _limits(g, b, n, groups, fence)
    return np.maximum(np.where(many.reshape(groups, 24) >= context, own.reshape(groups, 24), every[:, None]), 1e-12)


STEP1 = "k bigint, what int, t bigint, v double, n bigint, before bigint"
SKETCHED = "k bigint, hour int, bin int, n bigint"
COUNT, CANDIDATE, STUCK, IMPOSSIBLE = range(4)


def _readings(tab: pa.Table, start: np.ndarray) -> tuple:
    """Columns of whole (k, seg) groups sorted by (k, seg, t, arrival), without what describes the group: its first row
    carries its code in v, those after it (arrival: the hour) the fences of a source that is cut."""
    t, v, halo = tab.column("t").to_numpy(), tab.column("v").to_numpy(zero_copy_only=False), tab.column("halo").to_numpy(zero_copy_only=False).astype(bool)
    k = tab.column("k").to_numpy()
    g = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(t))))
    about = t == META_T
    hour = tab.column("arrival").fill_null(-1).to_numpy()
    code = np.full(len(start), -1)
    head = about & (hour < 0)
    code[g[head]] = v[head].astype(int)
    fences = np.full((len(start), 24), np.inf)
    given = about & (hour >= 0)
    fences[g[given], hour[given]] = v[given]
    segment = code >= CUT
    code[segment] -= CUT
    keep = ~about
    keep[1:] &= (t[1:] != t[:-1]) | (g[1:] != g[:-1])
    keep &= code[g] >= 0  # readings of no known source
    return k[keep], g[keep], t[keep], v[keep], halo[keep], code, segment, fences


def _steps(g: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has a reading before it in its group, |step from it|)."""
    same = np.zeros(len(g), bool)
    same[1:] = g[1:] == g[:-1]
    return same, np.where(same, np.abs(np.diff(v, prepend=v[:1])), np.nan)


def _counted(g: np.ndarray, hour: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(g, hour, bin, count) of the distinct bins."""
    u, n = np.unique((g * 24 + hour) * 65536 + b + 32768, return_counts=True)
    return u // 65536 // 24, u // 65536 % 24, u % 65536 - 32768, n


def sketch(tab: pa.Table, start: np.ndarray) -> pa.RecordBatch:
    """The steps of segments of hot sources, counted by hour and bin."""
    k, g, t, v, halo, code, _, _ = _readings(tab, start)
    live = code[g] % 2 == 1
    k, g, t, v, halo = k[live], g[live], t[live], v[live], halo[live]
    same, step = _steps(g, v)
    s = np.flatnonzero(same & ~halo)
    at, hour, b, n = _counted(g[s], (t[s] // 3_600_000 % 24).astype(np.int64), sketch_bins(step[s]))
    source = np.zeros(len(start), np.int64)
    source[g] = k
    return pa.record_batch([pa.array(source[at]), pa.array(hour.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n)], names=["k", "hour", "bin", "n"])


def merged_fences(tab: pa.Table, start: np.ndarray, fence: float, context: int) -> pa.RecordBatch:
    """(k, hour, fence) of hot sources from the merged sketches of their segments."""
    g = np.repeat(np.arange(len(start)), np.diff(np.append(start, tab.num_rows)))
    f = hour_fences(g, tab.column("hour").to_numpy().astype(np.int64), tab.column("bin").to_numpy().astype(np.int64), tab.column("n").to_numpy(), len(start), fence, context)
    k = tab.column("k").to_numpy()[start]
    return pa.record_batch([pa.array(np.repeat(k, 24)), pa.array(np.tile(np.arange(24), len(k)).astype(np.int64)), pa.array(f.ravel())], names=["k", "hour", "fence"])


def scan(tab: pa.Table, start: np.ndarray, least: int, reach: int, stuck_run: int, fence: float, context: int) -> pa.RecordBatch:
    """Flags of whole sources and of segments; of the latter `decide` counts the readings and joins the runs."""
    k, g, t, v, halo, code, segment, fences = _readings(tab, start)
    out: list[tuple] = []

    def emit(what: int, at: np.ndarray, **cols: np.ndarray) -> None:
        if len(at):
            z = np.zeros(len(at), np.int64)
            out.append((k[at], z + what, t[at], v[at], cols.get("n", z), cols.get("before", z)))

    lo = np.array([x for u in UNITS for x in [UNIT_LIMITS.get(u, OTHER_LIMITS)[0]] * 2])
    hi = np.array([x for u in UNITS for x in [UNIT_LIMITS.get(u, OTHER_LIMITS)[1]] * 2])
    c = code[g]
    emit(IMPOSSIBLE, np.flatnonzero(~halo & ((v < lo[c]) | (v > hi[c]))))
    whole = np.bincount(g, minlength=len(start))
    live = (c % 2 == 1) & (segment[g] | (whole[g] >= least))  # of a segment, only step 2 knows how many its source has
    if live.any():
        t, v, halo, k, g = t[live], v[live], halo[live], k[live], g[live]
        same, step = _steps(g, v)
        own = ~halo
        ug, at = np.unique(g[own], return_index=True)
        emit(COUNT, np.flatnonzero(own)[at], n=np.bincount(g[own], minlength=len(start))[ug])
        # stuck: runs of equal values
        run = np.cumsum(~(same & (step == 0)))
        emit(STUCK, np.flatnonzero(own & (np.bincount(run)[run] >= stuck_run)))
        # spikes: off the band of both sides by more than the hour's fence, which whole sources set here
        hour = (t // 3_600_000 % 24).astype(np.int64)
        s = np.flatnonzero(same & ~segment[g])
        fences = np.where(segment[:, None], fences, hour_fences(*_counted(g[s], hour[s], sketch_bins(step[s])), len(start), fence, context))
        left, right = _side_medians(v, g, reach)
        low, high = np.fmin(left, right), np.fmax(left, right)
        both = ~np.isnan(left) & ~np.isnan(right)
        dev = np.where(v < low, low - v, np.where(v > high, v - high, 0.0))
        cand = np.flatnonzero(own & both & (dev > fences[g, hour]))
        emit(CANDIDATE, cand, before=np.where(same, np.roll(t, 1), META_T)[cand])
    types = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in STEP1.split(", ")]
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * len(types)
    return pa.record_batch([pa.array(x.astype(y.to_pandas_dtype())) for x, y in zip(cols, types, strict=True)], names=names)


def decide(tab: pa.Table, start: np.ndarray, least: int, longest_run: int) -> pa.RecordBatch:
    """Step 2 on whole sources sorted by (k, what, t): what has enough readings, and runs that are short enough."""
    k, what, t, v, n, before = (tab.column(c).to_numpy() for c in ("k", "what", "t", "v", "n", "before"))
    g = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
    enough = np.bincount(g, np.where(what == COUNT, n, 0), len(start)) >= least
    # candidates next to one another form a run
    c = what == CANDIDATE
    joins = np.zeros(len(k), bool)
    joins[1:] = c[1:] & c[:-1] & (g[1:] == g[:-1]) & (before[1:] == t[:-1])
    run = np.cumsum(~joins)
    short = np.bincount(run)[run] <= longest_run if len(run) else c
    why = np.where(what == IMPOSSIBLE, "impossible", np.where(what == STUCK, "stuck", "spike"))
    keep = (what == IMPOSSIBLE) | enough[g] & ((what == STUCK) | c & short)
    return pa.record_batch([pa.array(k[keep]), pa.array(t[keep]), pa.array(v[keep]), pa.array(why[keep].astype(object), pa.string())], names=["k", "t", "v", "why"])


def _segments(hot: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(k, seg, t, v, arrival, halo) of the rows of hot sources, and (k, segs): segments of `size` readings by time, each
    with the HALO readings before and after it. Rows with the same k and t are one reading.

    Readings are numbered without a task that holds a whole source: ranges of (k, t) are numbered each by itself, and a
    prefix sum over one row per range makes the numbers go on.
    """
    ranges = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(cut(hot, "hot_rows").repartitionByRange(ranges, "k", "t").withColumn("range", F.spark_partition_id()), "ranged")  # a range's number holds for one execution, hence the cut
    per = cut(ranged.groupBy("k", "range").agg(F.count_distinct("t").alias("n")), "ranges")
    first = per.select("k", "range", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    segs = per.groupBy("k").agg(F.ceil(F.sum("n") / size).cast("bigint").alias("segs"))
    at = F.col("first") + F.dense_rank().over(Window.partitionBy("k", "range").orderBy("t")) - 1
    r = ranged.join(first.join(segs, "k"), ["k", "range"]).withColumn("at", at).withColumn("own", F.floor(F.col("at") / size).cast("bigint")).withColumn("off", F.pmod("at", F.lit(size)))
    place = lambda d, halo: F.struct((F.col("own") + d).alias("seg"), F.lit(halo).alias("halo"))
    places = F.array_compact(F.array(place(0, False), F.when(F.col("off") < HALO, place(-1, True)), F.when(F.col("off") >= size - HALO, place(1, True))))
    return r.select("k", "segs", "t", "v", "arrival", F.explode(places).alias("p")).where("p.seg >= 0 and p.seg < segs").select("k", "p.seg", "t", "v", "arrival", "p.halo"), segs


def flag_readings(readings: DataFrame, sources: DataFrame, key: str, t: str = "t", v: str = "v", arrival: str = "arrival", unit: str = "unit", continuous: str = "continuous", least: int = 60, reach: int = 8, longest_run: int = 3, stuck_run: int = 10, fence: float = 4.5, context: int = 120, hot_rows: int = 100_000, segment_rows: int = 50_000, broadcast_rows: int = 500_000) -> DataFrame:
    """(key, t, v, why) of flagged readings; why is impossible, spike or stuck. One reading may have several reasons.

    readings: key BIGINT, t in ms, v, arrival (of rows with the same key and t the earliest is the reading). sources:
    one row per key with its unit and whether it is continuous (null: not). Rows with a null key, t or v, NaN values,
    readings of no known source and further columns are ignored. spike and stuck need `least` readings in the source.
    A source's first and last reading have only one side and are never spikes. Empty tables give an empty result.
    """
    src = readings.select(F.col(key).cast("bigint").alias("k"), F.col(t).cast("bigint").alias("t"), F.nanvl(F.col(v).cast("double"), F.lit(None)).alias("v"), F.col(arrival).cast("bigint").alias("arrival")).where("k is not null and t is not null and v is not null")
    hot = cut(src.groupBy("k").agg(F.count("*").alias("rows")).where(F.col("rows") > hot_rows).select("k"), "hot")
    many = hot.count()
    small = F.broadcast if many <= broadcast_rows else lambda df: df  # 16 bytes a row; a longer list is joined like any other table
    columns = ["k", "seg", "t", "v", "arrival", "halo"]
    plain = (src.join(small(hot), "k", "left_anti") if many else src).select("k", F.lit(0).cast("bigint").alias("seg"), "t", "v", "arrival", F.lit(False).alias("halo"))
    about = sources.select(F.col(key).cast("bigint").alias("k"), unit_code(F.col(unit), F.coalesce(F.col(continuous), F.lit(False))).cast("double").alias("v")).where("k is not null")
    about = about.select("k", F.lit(0).cast("bigint").alias("seg"), F.lit(META_T).cast("bigint").alias("t"), "v", F.lit(None).cast("bigint").alias("arrival"), F.lit(False).alias("halo"))
    rows = plain.unionByName(about.join(small(hot), "k", "left_anti") if many else about)
    order = ["t", "arrival", "v"]
    if many:
        parts, sizes = _segments(src.join(small(hot), "k"), max(segment_rows, HALO))
        each = small(sizes).select("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("segs") - 1)).alias("seg"))
        codes = about.drop("seg").join(each, "k").withColumn("v", F.col("v") + CUT).select(*columns)
        parts = cut(parts.unionByName(codes), "segments")  # read twice: to sketch and to flag
        fences = map_groups(map_groups(parts, ["k", "seg"], order, SKETCHED, sketch).groupBy("k", "hour", "bin").agg(F.sum("n").alias("n")), ["k"], [], "k bigint, hour bigint, fence double", lambda tab, start: merged_fences(tab, start, fence, context))
        fences = fences.join(each, "k").select("k", "seg", F.lit(META_T).cast("bigint").alias("t"), F.col("fence").alias("v"), F.col("hour").alias("arrival"), F.lit(False).alias("halo"))
        rows = rows.unionByName(parts).unionByName(fences)
    step1 = map_groups(rows, ["k", "seg"], order, STEP1, lambda tab, start: scan(tab, start, least, reach, stuck_run, fence, context))
    step2 = map_groups(step1, ["k"], ["what", "t"], "k bigint, t bigint, v double, why string", lambda tab, start: decide(tab, start, least, longest_run))
    return step2.withColumnRenamed("k", key).withColumnRenamed("t", t)


def flag_groups(states: DataFrame, source: str, group: str, value: str, unit: str, fence: float = 3.0, impossible_only: Column | None = None) -> DataFrame:
    """(source, group, value, why) of one value per group that is impossible for its unit or outside the source's
    quantile sketch fences [Q1 - fence * IQR, Q3 + fence * IQR].

    The sketch (logarithmic bins of about 1 %, counted in the JVM) leaves out values that are impossible anyway. Rows
    with a null source or value and repeated rows are ignored; sources with under 8 values only have impossible ones.
    """
    d = states.select(F.col(source).alias("src"), F.col(group).alias("grp"), F.col(value).cast("double").alias("x"), F.col(unit).alias("unit"), F.coalesce(impossible_only if impossible_only is not None else F.lit(False), F.lit(False)).alias("only")).where("src is not null and x is not null").distinct()
    d = d.withColumn("bad", impossible(F.col("x"), F.col("unit")))
    lg = math.log(1.02)
    b = F.when(F.col("x") == 0, F.lit(0)).otherwise(F.signum("x") * (F.ceil(F.log(F.abs("x")) / lg) + 40000)).cast("bigint")
    bins = d.where("not bad and not only").groupBy("src", b.alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("src")
    run = bins.select("*", F.sum("n").over(w.orderBy("b")).alias("cum"), F.sum("n").over(w).alias("all")).where("all >= 8")
    mid = F.when(F.col("b") == 0, F.lit(0.0)).otherwise(F.signum("b") * F.exp((F.abs("b") - 40000 - 0.5) * lg))
    at = lambda q: F.min_by(mid, F.when(F.col("cum") > q * (F.col("all") - 1), F.col("b")))
    q = run.groupBy("src").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    f = q.select("src", (F.col("q1") - fence * (F.col("q3") - F.col("q1"))).alias("lo"), (F.col("q3") + fence * (F.col("q3") - F.col("q1"))).alias("hi"))
    out = d.join(f, "src", "left").withColumn("why", F.when(F.col("bad"), F.lit("impossible")).when(~F.col("only") & ((F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi"))), F.lit("outside")))
    return out.where("why is not null").select(F.col("src").alias(source), F.col("grp").alias(group), F.col("x").alias(value), "why")
