"""Per-period aggregates by event time, corrected as late events arrive, with a cut-off.

Checkpoint and replay: for each (key, period) the readings that arrived before publication are folded in event-time
order into an ordered state (count, sum, min, max, first, last, rise), and that state is snapshotted after every
`checkpoint_every` readings. Late readings restore the snapshot that precedes the earliest of them, replay the sorted
suffix (on-time and late readings together) on it, and replace the period's output. Readings past the cut-off change
nothing and are counted. `rise` (sum of the increases between neighbouring readings of a period) depends on the order,
so an insertion can't be patched in; it must be replayed.

`LateEventStore` keeps the ordered readings of open periods between batches, so late readings of a later batch bring back
their own periods and no other history.

The state key is (key, period), so a hot key is spread over its periods and no task holds more than one period of one
key beside its batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspar.session import cut, drop_since, mark
from lumenspar.sources.versions import VersionedGroups

SCHEMA = (
    "k {key}, period_start bigint, n_first bigint, sum_first double, min_first double, max_first double, last_first double, rise_first double, "
    "n bigint, sum double, min double, max double, last double, rise double, n_late bigint, n_cut bigint, replayed bigint"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _fold(first: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """State of each run of readings; first: the index at which each run begins."""
    last = np.append(first[1:], len(v)) - 1
    up = np.maximum(np.diff(v, prepend=v[:1]), 0)
    up[first] = 0
    return {"n": last - first + 1, "sum": np.add.reduceat(v, first), "min": np.minimum.reduceat(v, first), "max": np.maximum.reduceat(v, first), "head": v[first], "last": v[last], "rise": np.add.reduceat(up, first)}


def _join(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """State of a's readings followed by b's."""
    return {"n": a["n"] + b["n"], "sum": a["sum"] + b["sum"], "min": np.minimum(a["min"], b["min"]), "max": np.maximum(a["max"], b["max"]), "head": a["head"], "last": b["last"], "rise": a["rise"] + b["rise"] + np.maximum(b["head"] - a["last"], 0)}


def _snapshots(blocks: dict[str, np.ndarray], nth: np.ndarray) -> dict[str, np.ndarray]:
    """Running state after each block within its group (nth: 0, 1, 2 ... in the group), by doubling."""
    state, step = blocks, 1
    while step <= (nth.max() if len(nth) else 0):
        at = np.flatnonzero(nth >= step)
        done = _join({k: x[at - step] for k, x in state.items()}, {k: x[at] for k, x in state.items()})
        state = {k: x.copy() for k, x in state.items()}
        for k in state:
            state[k][at] = done[k]
        step *= 2
    return state


def replay(t: pa.Table, start: np.ndarray, period_ms: int, publish_us: int, close_us: int, every: int) -> pa.RecordBatch:
    """Outputs of all groups of a table sorted by (k, period_start, t, arrival, tie)."""
    ts = t.column("t").to_numpy()
    fresh = np.ones(len(ts), bool)
    fresh[1:] = ts[1:] != ts[:-1]
    fresh[start] = True
    keep = np.flatnonzero(fresh)  # of the same (key, t) the one that arrived first
    start = np.searchsorted(keep, start)
    v, arrival = t.column("v").to_numpy()[keep], t.column("arrival").to_numpy()[keep]
    period = t.column("period_start").to_numpy()[keep]
    size = np.diff(np.append(start, len(keep)))
    g = np.repeat(np.arange(len(start)), size)
    end = (period + period_ms) * 1000
    late, cut = (arrival > end + publish_us) & (arrival <= end + close_us), arrival > end + close_us
    on = ~late & ~cut
    groups = len(start)
    res = {f"{k}{s}": np.full(groups, np.nan) for k in ("sum", "min", "max", "last", "rise") for s in ("_first", "")}
    n_first = np.bincount(g[on], minlength=groups)
    snap, block0 = None, np.zeros(groups, np.int64)
    before = np.cumsum(on) - on - (np.cumsum(on) - on)[start][g] if len(g) else np.zeros(0, np.int64)  # on-time readings before this one in its group
    if on.any():
        rank, go = before[on], g[on]
        first = np.flatnonzero(rank % every == 0)
        nth = rank[first] // every
        snap = _snapshots(_fold(first, v[on]), nth)
        blocks = np.bincount(go[first], minlength=groups)
        block0 = np.cumsum(blocks) - blocks
        has = np.flatnonzero(n_first)
        for k in ("sum", "min", "max", "last", "rise"):
            res[f"{k}_first"][has] = snap[k][(block0 + blocks - 1)[has]]
            res[k][has] = res[f"{k}_first"][has]
    n = n_first.copy()
    replayed = np.zeros(groups, np.int64)
    if late.any():
        hit, at = np.unique(g[late], return_index=True)
        back = np.full(groups, -1)
        back[hit] = before[np.flatnonzero(late)[at]] // every  # the snapshot to restore: so many whole blocks
        live = on | late
        suffix = live & (back[g] >= 0) & (before >= back[g] * every)
        gs = g[suffix]
        first = np.flatnonzero(np.diff(gs, prepend=-1))
        state = _fold(first, v[suffix])
        replayed[hit] = state["n"]
        old = back[hit] > 0
        if old.any():
            from_ = (block0 + back - 1)[hit[old]]
            merged = _join({k: x[from_] for k, x in snap.items()}, {k: x[old] for k, x in state.items()})
            for k in state:
                state[k][old] = merged[k]
        n[hit] = state["n"]
        for k in ("sum", "min", "max", "last", "rise"):
            res[k][hit] = state[k]
    dbl = lambda x: pa.array(x, pa.float64(), mask=np.isnan(x))
    cols = [t.column("k").take(pa.array(keep[start])).combine_chunks(), pa.array(period[start]), pa.array(n_first, pa.int64()), *(dbl(res[f"{k}_first"]) for k in ("sum", "min", "max", "last", "rise")), pa.array(n, pa.int64()), *(dbl(res[k]) for k in ("sum", "min", "max", "last", "rise")), pa.array(np.bincount(g[late], minlength=groups), pa.int64()), pa.array(np.bincount(g[cut], minlength=groups), pa.int64()), pa.array(replayed)]
    return pa.record_batch([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names=NAMES)


def late_event_aggregates(readings: DataFrame, key: str, t: str = "t", v: str = "v", arrival: str = "arrival", tie: str | None = None, period_ms: int = 300_000, publish_delay_ms: int = 60_000, lateness_ms: int = 7_200_000, checkpoint_every: int = 8) -> DataFrame:
    """One row per (key, period): the aggregates as published, as corrected, and what came late or too late.

    readings: event time `t` in ms, `arrival` in us, value `v`. Rows with a null t, v or arrival are no readings; NaN
    counts as null. A null key is a key of its own. Of rows with the same (key, t) the one that arrived first counts
    (ties: smallest `tie`, then smallest v). A period that had no reading when it was published has n_first = 0 and
    null *_first. An empty table gives an empty result; further columns of any name are ignored.
    Columns: <key>, period_start, n_first, sum_first, min_first, max_first, last_first, rise_first, n, sum, min, max,
    last, rise, n_late (arrived after publication, before closing), n_cut (after closing), replayed (readings folded
    again).
    """
    kind = readings.schema[key].dataType.simpleString()
    p = F.col(t) - F.pmod(F.col(t), F.lit(period_ms))
    src = readings.select(F.col(key).alias("k"), p.cast("bigint").alias("period_start"), F.col(t).cast("bigint").alias("t"), F.nanvl(F.col(v).cast("double"), F.lit(None)).alias("v"), F.col(arrival).cast("bigint").alias("arrival"), (F.col(tie) if tie else F.lit(0)).alias("tie")).where("t is not null and v is not null and arrival is not null")
    from lumenspar.operators.arrowgroups import map_groups

    every, publish, close = int(checkpoint_every), publish_delay_ms * 1000, lateness_ms * 1000
    out = map_groups(src, ["k", "period_start"], ["t", "arrival", "tie", "v"], SCHEMA.format(key=kind), lambda tab, start: replay(tab, start, period_ms, publish, close, every))
    return out.withColumnRenamed("k", key)


def outcomes(aggregates: DataFrame, key: str) -> DataFrame:
    """(key, period_start, outcome): `corrected` for periods whose published output a replay replaced by one of more
    readings, `cut_off` for periods that refused readings after closing."""
    kinds = F.array_compact(F.array(F.when((F.col("replayed") > 0) & (F.col("n") > F.col("n_first")), F.lit("corrected")), F.when(F.col("n_cut") > 0, F.lit("cut_off"))))
    return aggregates.select(key, "period_start", F.explode(kinds).alias("outcome"))


class LateEventStore(VersionedGroups):
    """The readings of periods that can still change, below a folder; one batch of arrivals after the other."""

    KEY = ("k", "period_start")

    def process(self, readings: DataFrame, batch: str, out: str, key: str, t: str = "t", v: str = "v", arrival: str = "arrival", tie: str | None = None, period_ms: int = 300_000, lateness_ms: int = 7_200_000, keep_ms: int = 604_800_000, **options: int) -> bool:
        """Writes to `out` the late_event_aggregates of every (key, period) that the batch touches; they replace the rows
        that earlier batches wrote of these. False, with nothing written, if the batch was done before.

        Batches come in order of arrival; within one any order holds. A period's readings are kept until keep_ms after its
        closing, by the newest arrival seen; readings of periods older than that are ignored, since their output is final.
        """
        now = self.manifest()
        if batch in now["done"]:
            return False
        at = mark()
        kind = readings.schema[key].dataType.simpleString()
        schema = f"k {kind}, period_start bigint, t bigint, v double, arrival bigint, tie bigint"
        p = (F.col(t) - F.pmod(F.col(t), F.lit(period_ms))).cast("bigint")
        new = cut(readings.select(F.col(key).alias("k"), p.alias("period_start"), F.col(t).cast("bigint").alias("t"), F.nanvl(F.col(v).cast("double"), F.lit(None)).alias("v"), F.col(arrival).cast("bigint").alias("arrival"), (F.col(tie) if tie else F.lit(0)).cast("bigint").alias("tie")).where("t is not null and v is not null and arrival is not null"), "new")
        clock = new.agg(F.max("arrival")).first()[0] or 0
        oldest = clock // 1000 - period_ms - lateness_ms - keep_ms
        new = new.where(F.col("period_start") >= oldest)
        touched = self.touched(new, *self.KEY)
        old = self.read(now, touched, schema)
        every = new
        if old is not None:
            old = old.where(F.col("period_start") >= oldest)
            keys = new.select(F.col("k").alias("nk"), F.col("period_start").alias("np")).distinct()
            every = new.unionByName(old.join(keys, F.col("k").eqNullSafe(F.col("nk")) & (F.col("period_start") == F.col("np")), "left_semi"))
        late_event_aggregates(every, "k", tie="tie", period_ms=period_ms, lateness_ms=lateness_ms, **options).withColumnRenamed("k", key).write.mode("overwrite").parquet(out)
        self.replace(now, touched, cut(new if old is None else new.unionByName(old), "state"), self.KEY, batch)
        drop_since(at)
        return True
