from pyspark.sql import functions as F

from lumenspar.operators.delivery_dedup import duplicates
from lumenspar.operators.monitors import Options, Thresholds, replay
from lumenspar.streaming import windows


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert not q.exception()
    return spark.table(name).collect()


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_late_values_move_to_an_open_bucket(spark, tmp_path):
    batches = [[("a", 0, 1, 1.0), ("a", 3, 4, 2.0)], [("a", 12, 13, 5.0), ("a", 4, 14, 7.0)], [("a", 41, 42, 1.0)], [("a", 61, 62, 1.0)]]
    schema = "k string, ts bigint, arrival bigint, v double"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {(r["bucket"], r["sum"], r["n"], r["moved"]) for r in run(spark, windows.rebucket_stream(src, "k", "ts", "arrival", "v", 10, 20), "rb", tmp_path)}
    assert {(0, 3.0, 2, 0), (10, 12.0, 2, 1), (20, 0.0, 0, 0), (30, 0.0, 0, 0), (40, 1.0, 1, 0), (50, 0.0, 0, 0)} == got


def test_monitor_stream_equals_replay(spark, tmp_path):
    vals = [1, 30, 40, None, 5, 12, 30, 2, 2, 50]
    rows = [(s, i * 10, None if v is None else float(v + k)) for k, s in enumerate(("a", "b")) for i, v in enumerate(vals)]
    schema = "scope string, tick bigint, value double"
    for i in range(0, 10, 3):
        spark.createDataFrame([r for r in rows if i * 10 <= r[1] < (i + 3) * 10], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    t, o = Thresholds(">", 20, 10, 15, 8), Options(min_failures=2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {(r["scope"], r["tick"], r["event"]) for r in run(spark, windows.monitor_events(src, t, o), "mon", tmp_path)}
    want = {(r["scope"], r["tick"], r["event"]) for r in replay(spark.createDataFrame(rows, schema), t, o).where("event <> ''").collect()}
    assert got == want and want


def test_windowed_counts_and_tail(spark, tmp_path):
    spark.sql("select timestamp_seconds(id) as ts, 'k' as k, 1.0D as value from range(0, 40) union all select timestamp_seconds(1000), 'k', 1.0D").coalesce(1).write.parquet(str(tmp_path / "w"))
    got = run(spark, windows.windowed_counts(source(spark, tmp_path / "w", "ts timestamp, k string, value double"), "ts", ["k"]), "wc", tmp_path)
    assert sorted(r["n"] for r in got) == [10, 10, 10, 10]
    schema = "seq bigint, ts bigint, message string, status string, service string, source string, host string, tags array<string>, attrs string, trace_id string, span_id string"
    spark.createDataFrame([(1, 1, "boom", "error", "api", "", "", [], '{"ms":5}', None, None), (2, 2, "ok", "info", "api", "", "", [], None, None, None)], schema).write.parquet(str(tmp_path / "l"))
    assert [r["seq"] for r in run(spark, windows.live_tail(source(spark, tmp_path / "l", schema), "service:api @ms:>1"), "tail", tmp_path)] == [1]


def test_dedup_stream(spark, tmp_path):
    schema = "delivery_id bigint, topic string, rec_offset bigint, payload string"
    p = '{"producer":"a","epoch":0,"pseq":%d}'
    for i, b in enumerate([[(1, "x", 1, p % 1), (2, "x", 1, p % 1)], [(3, "x", 7, p % 1), (4, "x", 2, p % 2)]]):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = windows.dedup_stream(src, str(tmp_path / "seen"), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.exception()
    kept = {r[0] for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect()}
    every = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    assert kept == {r[0] for r in every.select("delivery_id").collect()} - {r[0] for r in duplicates(every.withColumn("x", F.lit(1))).collect()}
