"""Streams of readings: windowed aggregates, live tail, delivery dedup and late data moved to an open bucket."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenspar.logql import compile_filter
from lumenspar.operators.delivery_dedup import SeenBitmaps


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Sums per tumbling window of event time, final once the watermark passes; later records are dropped by Spark."""
    d = stream.withWatermark(ts, late)
    return d.groupBy(F.window(ts, width), *keys).agg(F.sum("value").alias("value"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "value", "n")


def live_tail(logs: DataFrame, query: str) -> DataFrame:
    """The same compiled filter that searches stored logs, on a stream of them."""
    return compile_filter(logs, query)


class _Rebucket(StatefulProcessor):
    """Sum and count per bucket of one key. A flushed bucket is closed: a late value goes to the oldest open bucket and is
    counted as moved, never dropped. Buckets flush when the arrival clock passes their end; empty ones within expiry_s of
    the last data flush as zero."""

    def __init__(self, interval: int, expiry_s: int) -> None:
        self.interval, self.expiry = interval, expiry_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "b bigint", "sum double, n bigint, moved bigint")
        self.clock = handle.getValueState("clock", "next bigint, last_data bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["arrival", "ts"])
        state = self.clock.get() if self.clock.exists() else None
        nxt, last = (state[0], state[1]) if state else (None, None)
        out: list[tuple] = []

        def flush(upto: int) -> None:
            nonlocal nxt
            while nxt is not None and nxt + self.interval <= upto:
                k = (nxt,)
                if self.open.containsKey(k):
                    s, n, moved = self.open.getValue(k)
                    out.append((*key, nxt, s, n, moved))
                    self.open.removeKey(k)
                elif last is not None and nxt - last <= self.expiry:
                    out.append((*key, nxt, 0.0, 0, 0))
                elif last is not None:  # nothing more until new data: jump
                    ahead = [b[0] for b in self.open.keys()]
                    nxt = min(ahead) if ahead else upto - upto % self.interval
                    if not ahead:
                        return
                    continue
                nxt += self.interval

        for r in pdf.itertuples(index=False):
            own = int(r.ts) // self.interval * self.interval
            now = int(r.arrival) // self.interval * self.interval
            if nxt is None:
                nxt = min(own, now)
            flush(now)
            b = max(own, nxt)
            s, n, moved = self.open.getValue((b,)) if self.open.containsKey((b,)) else (0.0, 0, 0)
            self.open.updateValue((b,), (s + float(r.value), n + 1, moved + int(b != own)))
            last = b if last is None else max(last, b)
        self.clock.update((nxt, last))
        yield pd.DataFrame(out, columns=["key", "bucket", "sum", "n", "moved"])

    def close(self) -> None:
        pass


def rebucket_stream(stream: DataFrame, key: str, ts: str, arrival: str, value: str, interval: int = 10, expiry_s: int = 300) -> DataFrame:
    """(key, bucket, sum, n, moved) as buckets flush; state is a few open buckets per key."""
    d = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("bigint").alias("ts"), F.col(arrival).cast("bigint").alias("arrival"), F.col(value).cast("double").alias("value"))
    return d.groupBy("key").transformWithStateInPandas(_Rebucket(interval, expiry_s), "key string, bucket bigint, sum double, n bigint, moved bigint", "Append", "None")


class _Status(StatefulProcessor):
    """A monitor group's status across micro-batches."""

    def __init__(self, thresholds, options) -> None:
        self.t, self.o = thresholds, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, since bigint, breaches bigint, last_data bigint, notified bigint, seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        from lumenspar.operators.monitors import State, advance

        got = self.state.get() if self.state.exists() else None
        s = State(*got[:5]) if got else State()
        seen = bool(got[5]) if got else False
        out = []
        for r in pd.concat(list(rows)).sort_values("tick").itertuples(index=False):
            v = None if pd.isna(r.value) else float(r.value)
            seen |= v is not None
            if seen:
                event = advance(s, self.t, self.o, int(r.tick), v)
                if event:
                    out.append((*key, int(r.tick), v, s.status, event))
        self.state.update((s.status, s.since, s.breaches, s.last_data, s.notified, seen))
        yield pd.DataFrame(out, columns=["scope", "tick", "value", "status", "event"])

    def close(self) -> None:
        pass


def monitor_events(ticks: DataFrame, thresholds, options) -> DataFrame:
    """Notifications of monitor groups from a stream of (scope, tick, value)."""
    d = ticks.select("scope", "tick", "value")
    return d.groupBy("scope").transformWithStateInPandas(_Status(thresholds, options), "scope string, tick bigint, value double, status string, event string", "Append", "None")


def dedup_stream(stream: DataFrame, folder: str, out: str, checkpoint: str):
    """A writer that keeps one delivery of each message across batches: the seen-bitmaps in `folder` and each batch's rows
    in out/<batch> are written under the batch's number, so a batch that is repeated after a failure counts once."""
    def each(batch: DataFrame, epoch: int) -> None:
        SeenBitmaps(batch.sparkSession, folder).process(batch, f"{epoch:012d}", f"{out}/{epoch:012d}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def outbox(events: DataFrame, path: str, checkpoint: str):
    """Notifications appended to a table under their epoch; delivering them is another process's work."""
    def each(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
