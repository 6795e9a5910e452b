import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lumenspar.operators import catalog, edge, pipeline, traces, wire
from lumenspar.plans import ops_queries
from lumenspar.sources.openmetrics import demux_docker, info_fields, parse_page, parse_pages, scrape_to_samples


def test_statsd(spark):
    lines = [
        ("app.requests:1|c|#env:test,route:/api/items", ("app.requests", "count", 1.0, 1.0, ["env:test", "route:/api/items"], None)),
        ("app.workers:4.5|g|#env:test", ("app.workers", "gauge", 4.5, 1.0, ["env:test"], None)),
        ("app.size:2048|h|@0.25", ("app.size", "histogram", 2048.0, 0.25, [], None)),
        ("app.t:3|ms|@0.5|#a|T17|zz:1", ("app.t", "histogram", 3.0, 0.5, ["a"], None)),
        ("app.u:joe|s", ("app.u", "set", None, 1.0, [], None)),
        ("bad", ("", None, None, 1.0, [], "malformed")),
        ("9x:1|c", ("9x", "count", 1.0, 1.0, [], "bad name")),
        ("a:x|c", ("a", "count", None, 1.0, [], "bad value")),
        ("a:1|c|@0", ("a", "count", 1.0, 0.0, [], "bad rate")),
        ("a:1|c|@2", ("a", "count", 1.0, 2.0, [], "bad rate")),
        ("_e{1,1}:a|b", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(lines)], "i int, line string")
    got = {r["i"]: r for r in edge.parse_statsd(df).collect()}
    for i, (_, w) in enumerate(lines):
        if w:
            assert tuple(got[i][c] for c in ("name", "type", "value", "rate", "tags", "reason")) == w
    assert got[3]["client_ts"] == 17
    assert (got[10]["reason"], got[11]["reason"]) == ("event", "malformed")
    d = spark.createDataFrame([("a:1|c\r\nb:2|c\n\n",), ("",)], "value string")
    assert [r[0] for r in edge.split_datagrams(d).collect()] == ["a:1|c", "b:2|c"]


def test_normalize(spark):
    df = spark.createDataFrame([("http.req-1",), ("9a",), ("",), (None,), ("a" * 201,)], "x string")
    assert [r[0] for r in df.select(edge.normalize_name(F.col("x"))).collect()] == ["http.req_1", None, None, None, None]
    df = spark.createDataFrame([("Env:Prod",), ("canary:",), ("a b:c",), ("x:1,2",), (":v",), ("k:" + "v" * 300,)], "x string")
    assert [r[0] for r in df.select(edge.normalize_tag(F.col("x"))).collect()] == ["env:Prod", "canary", "a_b:c", None, None, None]


def test_rates_and_zero_fill(spark):
    rows = [("a", t, float(v)) for t, v in ((0, 5), (10, 15), (20, 3), (20, 4), (30, math.inf), (40, 50), (400, 60))]
    got = edge.counter_rate(spark.createDataFrame(rows, "k string, ts bigint, v double"), "k", "ts", "v", 60).orderBy("ts", "v").collect()
    assert [r["rate"] for r in got] == [None, 1.0, None, None, None, None, None]
    z = edge.zero_fill(spark.createDataFrame([("a", 0, 1.0), ("a", 30, 2.0)], "k string, ts bigint, value double"), "k", "ts", 10, 25).orderBy("ts").collect()
    assert [(r["ts"], r["value"]) for r in z] == [(0, 1), (10, 0), (20, 0), (30, 2), (40, 0), (50, 0)]


def test_openmetrics(spark):
    page = '# HELP x y\n# TYPE http_requests counter\nhttp_requests_total{code="200",host="a\\"b"} 5 1.5 # {trace="1"} 1\n# TYPE temp gauge\ntemp 3\n# TYPE lat histogram\nlat_bucket{le="1"} 2\nlat_bucket{le="+Inf"} 3\nlat_sum 4\nlat_count 3\n# EOF\nignored{'
    got = parse_page(page)
    assert got[0] == ("http_requests", "counter", "http_requests_total", {"code": "200", "host": 'a"b'}, 5.0, 1.5)
    assert [g[0] for g in got] == ["http_requests", "temp", "lat", "lat", "lat", "lat"]
    for bad in ("x{a=1} 2", "x y z w", "x{a=\"1\",a=\"2\"} 1", "x abc", "# TYPE a gauge\n# TYPE a gauge"):
        with pytest.raises(ValueError):
            parse_page(bad)
    pages = [(1, page), (2, page.replace("} 5", "} 25").replace("+Inf\"} 3", "+Inf\"} 7").replace("temp 3", "temp 1")), (3, "broken {"), (4, None), (5, "")]
    df = parse_pages(spark.createDataFrame(pages, "page_id bigint, text string")).withColumn("scraped_at", F.col("page_id") * 10)
    assert df.where("error is not null").count() == 1
    s = {(r["metric"], r["ts"], r["labels"].get("upper_bound")): (r["kind"], r["value"]) for r in scrape_to_samples(df, namespace="app").collect()}
    assert s["app.http_requests", 20, None] == ("gauge", 2.0)
    assert s["app.temp", 10, None] == ("gauge", 3.0)
    assert s["app.lat.bucket", 20, "+Inf"] == ("count", 4.0)
    assert ("app.http_requests", 10, None) not in s


def test_demux_and_info(spark):
    frame = lambda kind, data: bytes([kind, 0, 0, 0]) + len(data).to_bytes(4, "big") + data
    raw = frame(1, b"2026-09-29T01:10:19.6Z hel") + frame(2, b"err\n") + frame(1, b"lo\nnext\n") + frame(1, b"tail")
    got = [(r["stream"], r["ts"], r["line"]) for r in demux_docker(spark.createDataFrame([("f", raw)], "path string, content binary")).collect()]
    assert got == [(2, None, "err"), (1, "2026-09-29T01:10:19.6Z", "hello"), (1, "2026-09-29T01:10:19.6Z", "next"), (1, "2026-09-29T01:10:19.6Z", "tail")]
    r = info_fields(spark.createDataFrame([("# Server\r\nredis_version:7\r\ndb0:keys=1,expires=0\r\n",)], "info string")).first()
    assert r["fields"] == {"redis_version": "7", "db0": "keys=1,expires=0"}


def test_paths_sampling_status(spark):
    df = spark.createDataFrame([("/api/comics/42",), ("/api/comics/42?page=2#top",), ("/problems/two-sum",), ("/u/0123456789abcdef/x",), ("/a/b/c/d/e/f/g/h/i",), ("/k/V1StGXR8Z5jdHi6BmyT",), (None,)], "p string")
    assert [r[0] for r in df.select(traces.normalize_path(F.col("p"))).collect()] == ["/api/comics/:id", "/api/comics/:id", "/problems/two-sum", "/u/:id/x", "/a/b/c/d/e/f/g/h", "/k/:id", None]
    rng = random.Random(1)
    ids = [f"{rng.getrandbits(128):032x}" for _ in range(200)] + ["f" * 32, "0" * 32]
    got = spark.createDataFrame([(i,) for i in ids], "t string").select("t", traces.head_sampled(F.col("t"), 0.3).alias("k")).collect()
    for r in got:
        assert r["k"] == ((int(r["t"][16:], 16) * traces.SAMPLING_FACTOR) % 2**64 < int(0.3 * 2**64))
    s = spark.createDataFrame([("200",), ("99",), ("503",), ("x",), (None,)], "c string").select(traces.status_class(F.col("c")))
    assert [r[0] for r in s.collect()] == ["2xx", None, "5xx", None, None]


def test_chunk_sampler(spark):
    rows = [("h", i, 0.01 * i, 0, True, "a") for i in range(15)] + [("h", 100, 1.0, -1, True, "a"), ("h", 101, 1.0, 2, False, "a"), ("h", 102, 1.0, 0, False, "b"), ("h", 103, 1.1, 0, False, "b"), ("h", 104, 400.0, 0, False, "b")]
    got = {r["chunk_id"]: r["why"] for r in traces.sample_chunks(spark.createDataFrame(rows, "host string, chunk_id bigint, ts_s double, priority int, error boolean, signature string")).collect()}
    assert sum(got[i] == "error" for i in range(15)) == 11  # ten at once and what 0.14 s refill
    assert (got[100], got[101], got[102], got[103], got[104]) == ("dropped", "priority", "rare", "", "rare")


def test_wire(spark):
    now = 1_790_000_000
    s = {"metric": "a.b", "type": "count", "interval": 10, "tags": ["env:dev"], "points": [[now, 1.5]]}
    cases = [(s, None), (s | {"type": "odd"}, "unknown type"), (s | {"type": "gauge"}, "gauge with an interval"), (s | {"interval": 0}, "interval must be positive"), (s | {"tags": ["Env:x"]}, "bad tag"), (s | {"tags": [f"k{i}:v" for i in range(51)]}, "too many tags"), (s | {"points": []}, "no points"), (s | {"points": [[now, 1], [now, None]]}, "value isn't finite"), (s | {"points": [[now + 601, 1]]}, "timestamp in the future"), (s | {"points": [[0, 1]]}, "timestamp must be positive")]
    df = spark.createDataFrame([(json.dumps({"series": [c for c, _ in cases], "extra": 1}),), ("{broken",), (None,)], "payload string")
    got = wire.decode(df, "payload", wire.SERIES, "series").select("payload_ok", "item_no", wire.series_reason(now).alias("reason")).collect()
    assert [r["reason"] for r in got if r["payload_ok"]] == [w for _, w in cases]
    assert sum(not r["payload_ok"] for r in got) == 2
    sk = {"gamma": 1.02, "count": 3, "sum": 6, "min": 1, "max": 3, "zero_count": 1, "bins": [[1, 1], [5, 1]], "neg_bins": []}
    ser = lambda k, **o: {"metric": "m", "tags": [], "interval": 10, "points": [{"ts": now, "sketch": sk | k}]} | o
    cases = [(ser({}), None), (ser({"bins": [[5, 1], [1, 1]]}), "bins aren't ascending"), (ser({"count": 9}), "counts don't add up"), (ser({"gamma": 1}), "inconsistent sketch"), (ser({}, interval=0), "interval must be positive"), (ser({}, points=[]), "no points")]
    df = spark.createDataFrame([(json.dumps({"series": [c for c, _ in cases]}),)], "payload string")
    assert [r[0] for r in wire.decode(df, "payload", wire.SKETCHES, "series").select(wire.sketch_reason(now)).collect()] == [w for _, w in cases]
    sp = {"trace_id": "a" * 32, "span_id": "b" * 16, "service": "s", "name": "n", "error": 0, "duration": 1, "start": now * 10**6}
    cases = [(sp, None), (sp | {"trace_id": "x"}, "bad trace_id"), (sp | {"error": 2}, "error must be 0 or 1"), (sp | {"duration": -1}, "negative duration"), (sp | {"start": now}, "start isn't in us"), (sp | {"service": ""}, "bad service"), (sp | {"parent_id": "q"}, "bad parent_id")]
    df = spark.createDataFrame([(json.dumps({"spans": [c for c, _ in cases]}),), (json.dumps({"chunks": [{"priority": 1, "spans": [sp]}]}),)], "payload string")
    got = wire.decode_spans(df, "payload").select("chunk_no", "priority", wire.span_reason(now * 10**6).alias("r")).collect()
    assert [r["r"] for r in got] == [w for _, w in cases] + [None]


def test_redaction_is_idempotent(spark):
    lines = ["password=hunter2", 'api_key: "a b c"', "Authorization: Bearer abc.def", "token_count=349 microphone=on", "GET /x?token=abc&page=2", "mail me@example.com", "eyJhbGciOi.eyJzdWIi.sig", "csrftoken=1 'secret' => 'x y'", "nothing here", "", None]
    df = spark.createDataFrame([(x,) for x in lines], "m string")
    once = df.select(pipeline.redact(F.col("m")).alias("m"))
    got = [r[0] for r in once.collect()]
    assert got[0] == "password=[REDACTED]" and got[1] == 'api_key: "[REDACTED]"' and got[3] == lines[3] and got[4] == "GET /x?token=[REDACTED]&page=2" and got[8:] == lines[8:]
    assert [r[0] for r in once.select(pipeline.redact(F.col("m"))).collect()] == got
    a = spark.createDataFrame([('{"customerPhone":"1","a":{"password":[1,2]},"n":1.50,"big":12345678901234567890}',), (None,), ("{x",)], "a string").select(pipeline.redact_attrs(F.col("a"))).collect()
    assert [r[0] for r in a] == ['{"customerPhone":"[REDACTED]","a":{"password":"[REDACTED]"},"n":1.50,"big":12345678901234567890}', None, "{x"]
    t = spark.createDataFrame([("2026-09-29T03:42:25.512Z",), ("2026-09-29 03:42:25,512",), ("2026-09-29T05:42:25.512+02:00",), ("29 Sep 2026 03:42:25.512",), ("1790653345",), ("x",), (None,)], "t string").select(pipeline.parse_time(F.col("t"))).collect()
    assert [r[0] for r in t] == [1790653345512] * 4 + [1790653345000, None, None]


def test_append_only_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"s{rng.randrange(3)}", rng.randrange(30), float(rng.randrange(3)), i) for i in range(300)]
    got = {r["arrival"]: r["outcome"] for r in catalog.append_only(spark.createDataFrame(rows, "series_key string, ts_s bigint, value double, arrival bigint")).collect()}
    newest = {}
    for k, t, v, a in rows:
        n = newest.get(k)
        want = "stored" if n is None or t > n[0] else "duplicate" if (t, v) == n else "rejected"
        if want == "stored":
            newest[k] = (t, v)
        assert got[a] == want


@pytest.mark.parametrize("block", [1, 7, 64])
def test_append_only_carries_the_newest_over_blocks(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["hot", "hot", "hot", None, "s"]), min(i // 4, 60) - rng.randrange(4), float(rng.randrange(2)), (None if i < 5 else i // 2, i)) for i in range(400)]
    df = spark.createDataFrame(rows, "series_key string, ts_s bigint, value double, arrival struct<o:bigint,i:bigint>")
    out = catalog.append_only(df, offset="arrival.o", block=block)
    assert out.columns == [*df.columns, "outcome"]
    got = {r["arrival"]["i"]: r["outcome"] for r in out.collect()}
    newest, want = {}, {}
    for k, t, v, (_, i) in rows:
        n = newest.get(k)
        want[i] = "stored" if n is None or t > n[0] else "duplicate" if (t, v) == n else "rejected"
        if want[i] == "stored":
            newest[k] = (t, v)
    assert got == want
    assert set(want.values()) == {"stored", "duplicate", "rejected"}


def test_dedupe_append_only_counts_every_series(spark, tmp_path):
    rows = [(1, 1000, 1.0, 0), (1, 1000, 1.0, 40_000), (1, 500, 2.0, 40_001), (1, 9000, None, 3), (2, 1000, 1.0, 1), (0, 1000, 1.0, 1)]
    spark.createDataFrame(rows, "series_id bigint, t bigint, v double, rec_offset bigint").write.parquet(str(tmp_path / "samples.parquet"))
    got = {r["outcome"]: r["n"] for r in ops_queries.Q["dedupe_append_only"](spark, str(tmp_path)).collect()}
    assert got == {"stored": 3, "duplicate": 1, "rejected": 1}
