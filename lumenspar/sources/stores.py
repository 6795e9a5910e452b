"""Stores on Parquet: partitioned appends, reads with pruning, compaction, retention, and the text forms of results.

A day is a partition; inside it rows are sorted by what queries select on, so row-group statistics and, for ids, Parquet
bloom filters skip most of a day. Every append goes into a batch folder of its own that replaces itself when the batch is
written again, so a batch that is repeated after a failure counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.functions import sketch

DAY_MS = 86_400_000


def _append(df: DataFrame, path: str, batch: str, sort: list[str], bloom: list[str] = ()) -> None:
    # ranges of day and key: a day of any size is spread over tasks, and files hold few keys each
    w = df.repartitionByRange("day", *sort[:2]).sortWithinPartitions("day", *sort).write.mode("overwrite").partitionBy("day")
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(f"{path}/batch={batch}")


def append_metrics(samples: DataFrame, path: str, batch: str) -> None:
    """metric_samples, with the tags that most queries name promoted to columns beside the tag array."""
    from lumenspar.model import first_value

    hot = {k: first_value(F.col("tags"), k) for k in ("service", "env", "host", "route", "status")}
    _append(samples.withColumns(hot).withColumn("day", F.floor(F.col("ts_s") / 86_400).cast("bigint")), path, batch, ["metric", "series_key", "ts_s"])


def append_sketches(bins: DataFrame, points: DataFrame, path: str, batch: str) -> None:
    """Sketches, a row per series and time with its bins encoded."""
    keys = ["metric", "tags", "series_key", "ts_s"]
    x = sketch.encode(bins, points, keys).withColumn("day", F.floor(F.col("ts_s") / 86_400).cast("bigint"))
    _append(x, path, batch, ["metric", "series_key", "ts_s"])


def read_sketches(spark: SparkSession, path: str, first_ms: int | None = None, last_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sketch_bins, sketch_points) of a sketch store, only the days asked for."""
    df = read(spark, path, first_ms, last_ms)
    keys = ["metric", "tags", "series_key", "ts_s"]
    return sketch.decode(df, keys), df.drop("bins", "day")


def append_logs(logs: DataFrame, path: str, batch: str) -> None:
    _append(logs.withColumn("day", F.floor(F.col("ts") / DAY_MS).cast("bigint")), path, batch, ["service", "source", "host", "status", "ts", "seq"], ["trace_id"])


def append_spans(spans: DataFrame, path: str, batch: str) -> None:
    """Spans and, beside them, the entry spans that searches read."""
    from lumenspar.operators.traces import distinct_spans, entry_spans

    s = distinct_spans(spans).withColumn("day", F.floor(F.col("start") / (DAY_MS * 1000)).cast("bigint"))
    _append(s, f"{path}/spans", batch, ["trace_id", "span_id"], ["trace_id"])
    e = entry_spans(s).withColumn("day", F.floor(F.col("start") / (DAY_MS * 1000)).cast("bigint"))
    _append(e, f"{path}/entries", batch, ["service", "start"])


def read(spark: SparkSession, path: str, first_ms: int | None = None, last_ms: int | None = None, skip_damaged: bool = False) -> DataFrame:
    """A store, only the days of [first_ms, last_ms]; damaged files are skipped only if asked for."""
    df = spark.read.option("ignoreCorruptFiles", str(skip_damaged).lower()).parquet(path)
    if first_ms is not None:
        df = df.where(F.col("day") >= first_ms // DAY_MS)
    if last_ms is not None:
        df = df.where(F.col("day") <= last_ms // DAY_MS)
    return df.drop("batch")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def partitions(spark: SparkSession, path: str) -> list[tuple[int, str, int]]:
    """(day, folder, bytes) of each batch and day of a store: names of folders, not rows."""
    fs, p = _fs(spark, path)
    out = []
    for b in fs.listStatus(p):
        if b.isDirectory():
            for d in fs.listStatus(b.getPath()):
                name = d.getPath().getName()
                if d.isDirectory() and name.startswith("day="):
                    out.append((int(name[4:]), d.getPath().toString(), fs.getContentSummary(d.getPath()).getLength()))
    return sorted(out)


def retain(spark: SparkSession, path: str, now_ms: int, days: int | None = None, most_bytes: int | None = None) -> list[str]:
    """Whole days dropped: those before the last `days`, then the oldest until the store fits most_bytes. Returns the
    folders that went."""
    fs, _ = _fs(spark, path)
    have = partitions(spark, path)
    gone = [x for x in have if days is not None and x[0] < now_ms // DAY_MS - days]
    rest = [x for x in have if x not in gone]
    while most_bytes is not None and rest and sum(b for _, _, b in rest) > most_bytes:
        oldest = rest[0][0]
        gone += [x for x in rest if x[0] == oldest]
        rest = [x for x in rest if x[0] != oldest]
    for _, folder, _ in gone:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)
    return [f for _, f, _ in gone]


def compact(spark: SparkSession, path: str, out: str, sort: list[str], rows_per_file: int = 5_000_000) -> None:
    """All batches of a store rewritten as one, with few files per day in the store's order. Days with many rows get
    several files by range of the first sort column, so no task writes a whole large day."""
    df = spark.read.parquet(path).drop("batch")
    n = max(1, -(-df.count() // rows_per_file))
    df.repartitionByRange(n, "day", *sort).sortWithinPartitions("day", *sort).write.mode("overwrite").partitionBy("day").parquet(f"{out}/batch=compacted")


def result_json(df: DataFrame, scope: str = "scope", points: str = "points") -> DataFrame:
    """(json) of result series: {"scope": ..., "points": [[ms, value], ...]}; numbers that JSON lacks are null."""
    num = lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "null").otherwise(v.cast("string"))
    pts = F.array_join(F.transform(points, lambda p: F.concat(F.lit("["), p["ts_ms"].cast("string"), F.lit(","), num(p["value"]), F.lit("]"))), ",")
    return df.select(F.concat(F.lit('{"scope":'), F.regexp_extract(F.to_json(F.struct(F.col(scope).alias("s"))), r"^\{\"s\":(.*)\}$", 1), F.lit(',"points":['), pts, F.lit("]}")).alias("json"))


def bin_edge(c: Column) -> Column:
    """A bin's edge for JSON: an unbounded one is null."""
    return F.when(F.abs(c) < float("inf"), c)


def server_sent_events(logs: DataFrame, dropped: str | None = None) -> DataFrame:
    """(text) events of a live tail: `log` with the row as JSON, or `dropped` with a count where that column is set."""
    body = F.to_json(F.struct(*(c for c in logs.columns if c != dropped)))
    log = F.concat(F.lit("event: log\ndata: "), body, F.lit("\n\n"))
    if not dropped:
        return logs.select(log.alias("text"))
    return logs.select(F.when(F.col(dropped) > 0, F.concat(F.lit("event: dropped\ndata: "), F.col(dropped).cast("string"), F.lit("\n\n"))).otherwise(log).alias("text"))
