import pytest

from lumenspar.sources import collectors as C


def test_host_cpu(spark):
    df = spark.createDataFrame([("h", 0, "user", 10.0), ("h", 0, "idle", 90.0), ("h", 10, "user", 12.5), ("h", 10, "idle", 97.5), ("h", 20, "user", 1.0), ("h", 20, "idle", 99.0)], "host string, ts bigint, mode string, seconds double")
    assert {(r["ts"], r["mode"]): r["percent"] for r in C.host_cpu(df).collect()} == {(10, "user"): 25.0, (10, "idle"): 75.0}


def test_rates_restart(spark):
    df = spark.createDataFrame([("a", "x", 0, 5.0, "r1"), ("a", "x", 10, 25.0, "r1"), ("a", "x", 20, 30.0, "r2"), ("a", "x", 30, 40.0, "r2")], "host string, metric string, ts bigint, v double, run_id string")
    assert [(r["ts"], r["rate"]) for r in C.cumulative_rates(df, ["host"], "ts", "metric", "v", "run_id").orderBy("ts").collect()] == [(10, 2.0), (30, 1.0)]
    b = C.buffer_hit(spark.createDataFrame([("d", 1, "blks_hit", 3.0), ("d", 1, "blks_read", 1.0), ("d", 2, "blks_hit", 0.0), ("d", 2, "blks_read", 0.0)], "db string, ts bigint, metric string, rate double"))
    assert {r["ts"]: r["buffer_hit"] for r in b.collect()} == {1: 75.0, 2: None}


def test_containers(spark):
    df = spark.createDataFrame([("container.cpu", "a", 1, 1.0), ("container.cpu", "a", 1, 2.0), ("container.uptime", "a", 1, 5.0), ("container.uptime", "a", 1, 9.0), ("container.cpu", "a", 1, None)], "metric string, tags string, ts bigint, value double")
    assert {r["metric"]: r["value"] for r in C.container_metrics(df).collect()} == {"container.cpu": 3.0, "container.uptime": 9.0}
    ev = spark.createDataFrame([("c", 0, "start"), ("c", 5, "oom"), ("c", 6, "die"), ("c", 8, "die"), ("c", 9, "start"), ("c", 12, "die"), ("d", 3, "die")], "container string, ts bigint, action string")
    assert {(r["container"], r["ts"]): (r["lifetime_s"], r["oom"]) for r in C.container_lifetimes(ev).collect()} == {("c", 6): (6, True), ("c", 8): (None, True), ("c", 12): (3, False), ("d", 3): (None, False)}


def test_processes_http_self(spark):
    p = spark.createDataFrame([("w", 0, 1, 100, 1.0, 10, 2, 5), ("w", 10, 1, 100, 2.0, 20, 2, 5), ("w", 10, 2, 105, 9.0, None, None, None)], "label string, ts bigint, pid int, started bigint, cpu_seconds double, rss bigint, threads int, fds int")
    r = C.process_metrics(p).where("ts = 10").first()
    assert (r["processes"], r["rss"], r["threads"], r["fds"]) == (2, 20, 2, None) and r["cpu_pct"] == pytest.approx(10)
    h = spark.createDataFrame([("u", 0, 200, 0.1, "hello", None, "ell", 864000), ("u", 1, 500, 0.1, "", None, None, None), ("u", 2, None, None, None, None, None, None), ("u", 3, 418, 0.1, "", 418, None, None), ("u", 4, 200, 0.1, None, None, "x", None)], "url string, ts bigint, status int, seconds double, body string, expected int, pattern string, cert_until bigint")
    assert [(r["can_connect"], r["up"]) for r in C.http_checks(h).orderBy("ts").collect()] == [(1, 1), (1, 0), (0, 0), (1, 1), (1, 0)]
    s = spark.createDataFrame([("k", 0, 5.0), ("k", 1, 8.0), ("k", 2, 2.0)], "k string, ts bigint, v double")
    assert [r["increase"] for r in C.increases(s, "k", "ts", "v").orderBy("ts").collect()] == [3.0, 2.0]
    assert C.expand_template({"url": "http://%%host%%:%%port%%/m", "x": ["%%port_1%%"], "n": 1}, "h", [80, 81]) == {"url": "http://h:80/m", "x": ["81"], "n": 1}
