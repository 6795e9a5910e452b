import json
import socket
import time

from pyspark.sql import functions as F

from lumenspar.operators.edge import parse_statsd, split_datagrams
from lumenspar.sources import stores
from lumenspar.sources.datagrams import DatagramReader, DatagramSource

SCHEMA = "seq bigint, ts bigint, message string, status string, service string, source string, host string, tags array<string>, attrs string, trace_id string, span_id string"


def logs(spark, n, start=0):
    return spark.createDataFrame([(i, i * stores.DAY_MS // 4, f"m{i}", "info", f"s{i % 3}", "", "", [], None, f"{i:032x}", None) for i in range(start, start + n)], SCHEMA)


def test_append_prune_compact_retain(spark, tmp_path):
    p = str(tmp_path / "logs")
    stores.append_logs(logs(spark, 40), p, "1")
    stores.append_logs(logs(spark, 40), p, "1")  # the batch is written again
    stores.append_logs(logs(spark, 8, 40), p, "2")
    assert stores.read(spark, p).count() == 48
    day = stores.read(spark, p, 3 * stores.DAY_MS, 3 * stores.DAY_MS)
    assert sorted(r["seq"] for r in day.collect()) == [12, 13, 14, 15]
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().toString()
    stores.compact(spark, p, str(tmp_path / "c"), ["service", "ts"])
    assert stores.read(spark, str(tmp_path / "c")).count() == 48
    gone = stores.retain(spark, p, 12 * stores.DAY_MS, days=7)
    assert len(gone) == 5 and stores.read(spark, p).agg(F.min("ts")).first()[0] == 5 * stores.DAY_MS
    stores.retain(spark, p, 0, most_bytes=1)
    assert stores.partitions(spark, p) == []


def test_metrics_and_spans(spark, tmp_path):
    m = spark.sql("select 'a.b' metric, array(named_struct('key','host','value','h'), named_struct('key','service','value','s')) tags, 'a.b|host:h,service:s' series_key, 5L ts_s, 1.0D value")
    stores.append_metrics(m, str(tmp_path / "m"), "1")
    r = stores.read(spark, str(tmp_path / "m")).first()
    assert (r["service"], r["host"], r["env"], r["day"]) == ("s", "h", None, 0)
    s = spark.sql("select '01' trace_id, '02' span_id, cast(null as string) parent_id, 's' service, 'n' name, 'r' resource, 'web' type, 7L start, 1L duration, 1 error, map('env','dev') meta, map('_top_level',1.0D) metrics")
    stores.append_spans(s.unionByName(s), str(tmp_path / "t"), "1")
    assert stores.read(spark, str(tmp_path / "t/spans")).count() == 1
    assert stores.read(spark, str(tmp_path / "t/entries")).first()["trace_error"]


def test_text_forms(spark):
    df = spark.sql("""select 'host:"a"' scope, array(named_struct('ts_ms', 1L, 'value', 1.5D), named_struct('ts_ms', 2L, 'value', double('NaN')), named_struct('ts_ms', 3L, 'value', cast(null as double)), named_struct('ts_ms', 4L, 'value', double('Infinity'))) points""")
    assert json.loads(stores.result_json(df).first()[0]) == {"scope": 'host:"a"', "points": [[1, 1.5], [2, None], [3, None], [4, None]]}
    t = [r[0] for r in stores.server_sent_events(spark.sql("select 'x' message, 0 lost union all select 'y', 3"), "lost").collect()]
    assert t == ['event: log\ndata: {"message":"x"}\n\n', "event: dropped\ndata: 3\n\n"]


def test_datagram_reader_queue():
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    s.bind(("127.0.0.1", 0))
    port = s.getsockname()[1]
    s.close()
    r = DatagramReader("127.0.0.1", port, 3)
    assert list(r.read({"next": 0})[0]) == []
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for i in range(5):
        out.sendto(f"a:{i}|c".encode(), ("127.0.0.1", port))
    end = time.time() + 5
    while time.time() < end and len(r.rows) + r.dropped < 5:
        time.sleep(0.02)
    rows, off = r.read({"next": 0})
    assert [v for _, v in rows] == ["a:0|c", "a:1|c", "a:2|c"] and off == {"next": 3} and r.dropped == 2
    assert len(list(r.readBetweenOffsets({"next": 1}, {"next": 3}))) == 2
    r.commit(off)
    assert not r.rows and list(r.read(off)[0]) == []


def test_datagram_source_streams(spark, tmp_path):
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    s.bind(("127.0.0.1", 0))
    port = s.getsockname()[1]
    s.close()
    spark.dataSource.register(DatagramSource)
    lines = split_datagrams(spark.readStream.format("datagrams").option("port", port).load())
    q = parse_statsd(lines).select("name", "value").writeStream.format("memory").queryName("udp").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    end = time.time() + 60
    while time.time() < end and not spark.table("udp").count():
        out.sendto(b"app.n:1|c\napp.n:2|c", ("127.0.0.1", port))
        time.sleep(0.5)
    q.stop()
    assert {tuple(r) for r in spark.table("udp").collect()} == {("app.n", 1.0), ("app.n", 2.0)}
