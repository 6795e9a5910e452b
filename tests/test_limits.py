import json

import pytest
from pyspark.sql import functions as F

from lumenspar import model
from lumenspar.metricql import Engine
from lumenspar.operators import monitors, traces, wire


def test_series_limit_is_an_error(spark):
    rows = [("m", [("k", str(i))], f"m|k:{i}", 100, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "metric string, tags array<struct<key:string,value:string>>, series_key string, ts_s bigint, value double")
    assert Engine(spark, df, {"m": "gauge"}, max_series=6).query("sum:m{*}", 0, 3599, 3600).points().count() == 1
    with pytest.raises(Exception, match="more than 5 series"):
        Engine(spark, df, {"m": "gauge"}, max_series=5).query("sum:m{*}", 0, 3599, 3600).points().collect()
    assert Engine(spark, df, {"m": "gauge"}, max_series=5).query("sum:m{k:1}", 0, 3599, 3600).points().count() == 1
    assert model.at_most(df.where("false"), "series_key", 0, "x").count() == 0


def test_log_monitor_groups(spark):
    df = spark.createDataFrame([(0, f"g{i}", 1) for i in range(4)], "bucket bigint, grp string, n bigint")
    assert monitors.log_counts(df, 0, 120, 60, groups=4).count() == 8
    with pytest.raises(Exception, match="more than 3 groups"):
        monitors.log_counts(df, 0, 120, 60, groups=3).collect()


def test_payload_limits(spark):
    s = {"metric": "a", "type": "gauge", "interval": 0, "tags": [], "points": [[1, 1.0]]}
    df = spark.createDataFrame([(json.dumps({"series": [s] * n}),) for n in (2, 3, 0)] + [(None,), ("{",)], "payload string")
    got = [r["payload_ok"] for r in wire.decode(df, "payload", wire.SERIES, "series", most=2).collect()]
    assert sorted(got) == [False] * 4 + [True] * 2
    sp = {"trace_id": "a", "span_id": "b"}
    many = spark.createDataFrame([(json.dumps({"spans": [sp] * 5001}),), (json.dumps({"chunks": [{"spans": [sp] * 3}, {"spans": [sp] * 2}]}),), (json.dumps({"chunks": [{"spans": [sp] * 3000}] * 2}),)], "payload string")
    assert wire.decode_spans(many, "payload").count() == 5


def test_silence_and_forgetting(spark):
    o = monitors.Options(no_data_s=100)
    s = monitors.State()
    t = monitors.Thresholds(">", 2.0)
    monitors.advance(s, t, o, 1000, 1.0, data_at=940)
    assert monitors.advance(s, t, o, 1100, None, window_end=1030) == "" and s.status == "OK"
    assert monitors.advance(s, t, o, 1110, None, window_end=1040) == "no_data"
    ticks = spark.createDataFrame([("a", 0, 5.0), ("a", 3600, None), ("a", 90_000, None), ("a", 93_600, 5.0)], "scope string, tick bigint, value double")
    r = monitors.replay(ticks, t).orderBy("tick").collect()
    assert [x["status"] for x in r] == ["ALERT", "ALERT", None, "ALERT"] and [x["event"] for x in r] == ["alert", "", "", "alert"]
    assert [tuple(x)[:3] for x in monitors.list_events(spark.createDataFrame(r), kinds=("alert",), limit=1).collect()] == [(93_600, "a", "alert")]


def test_a_span_written_again_is_the_last_to_arrive(spark):
    df = spark.createDataFrame([("t", "s", "old", 1, 5, 2), ("t", "s", "new", 1, 3, 9), ("t", "u", "x", 1, 1, 1)], "trace_id string, span_id string, service string, start bigint, duration bigint, at bigint")
    assert {r["service"] for r in traces.distinct_spans(df, "at").collect()} == {"new", "x"}
    assert {r["service"] for r in traces.distinct_spans(df).collect()} == {"old", "x"}
    assert traces.distinct_spans(df).columns == df.columns and traces.distinct_spans(df.where(F.lit(False))).count() == 0
