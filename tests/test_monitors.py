import pytest

from lumenspar.metricql.syntax import QueryError
from lumenspar.operators import dashboards
from lumenspar.operators.monitors import MonitorQuery, Options, State, Thresholds, advance, mentions, parse_query, phase, reduce_whole, reduce_windows, render, replay, step, timeline, window

UP = Thresholds(">", 20, 10, 15, 8)
DOWN = Thresholds("<", 3, 5, 4, 7)


@pytest.mark.parametrize(
    ("t", "values", "want"),
    [
        (UP, [5, 11, 9, 8, 21, 16, 15, 7], ["OK", "WARN", "WARN", "OK", "ALERT", "ALERT", "WARN", "OK"]),
        (DOWN, [9, 4.5, 6, 7, 2, 3.5, 4, 8], ["OK", "WARN", "WARN", "OK", "ALERT", "ALERT", "WARN", "OK"]),
        (Thresholds("==", 1), [0, 1, 0], ["OK", "ALERT", "OK"]),
        (Thresholds(">", 20), [21, 20, 21], ["ALERT", "OK", "ALERT"]),
    ],
)
def test_hysteresis(t, values, want):
    s, got = State(), []
    for i, v in enumerate(values):
        advance(s, t, Options(), i * 30, float(v))
        got.append(s.status)
    assert got == want


def test_no_data_failures_and_renotify():
    s, o = State(), Options(min_failures=2, no_data_s=60, renotify_s=90)
    ev = [advance(s, UP, o, i * 30, v) for i, v in enumerate([None, 30.0, 30.0, 30.0, 30.0, 30.0, None, None, 30.0, 30.0])]
    assert ev == ["", "warn", "alert", "", "", "renotify", "", "no_data", "warn", "alert"]


@pytest.mark.parametrize("q", ["avg(last_5m):avg:x{route:/a>b} > 1", "pct_nonnull(last_3m):avg:w{*} by {host} < 50", 'logs("status:error").rollup("count").by("@http.status").last("15m") >= 10', "sum(last_24h):sum:x{*}.rollup(sum, 3600) != 0"])
def test_queries_round_trip(q):
    m = parse_query(q)
    assert isinstance(m, MonitorQuery) and str(parse_query(str(m))) == str(m)


@pytest.mark.parametrize("q", ["avg(last_5m):avg:x{*}", "avg(last_25h):avg:x{*} > 1", "med(last_5m):avg:x{*} > 1", "sum(last_5m):sum:x{*}.rollup(sum, 3600) > 0", 'logs("a").rollup("count").by("level").last("5m") > 1', "avg(last_5m):avg:x{ > 1"])
def test_refused(q):
    with pytest.raises(QueryError):
        parse_query(q)


def test_thresholds_windows_templates():
    for bad in ((">", 10, 20), (">", 10, 5, 11), ("<", 10, 5), ("==", 1, 0)):
        with pytest.raises(QueryError):
            Thresholds(*bad)
    m = parse_query("avg(last_5m):avg:x{*} > 1")
    assert step(m) == 10 and window(m, 1007, 3) == (700, 1000)
    assert 86_400 % step(parse_query("avg(last_24h):avg:x{*} > 1")) == 0
    assert 0 <= phase("mon-a", 30) < 30 and phase("mon-a", 30) == phase("mon-a", 30)
    assert render("{{.Group}} is at {{.Value}} ({{.Tags.host}})", {"Group": "a", "Value": 2.0, "Tags": {"host": "h"}}) == "a is at 2 (h)"
    with pytest.raises(QueryError):
        render("{{.Nope}}", {})
    assert mentions("x @log and @ops a@b") == ["log", "ops"]


def test_windows_and_replay(spark):
    v = [1.0, None, 3.0, 30.0, 40.0, None, None, 2.0]
    df = spark.createDataFrame([("*", i * 10, x) for i, x in enumerate(v)] + [("g", i * 10, None) for i in range(8)], "scope string, b bigint, v double")
    w = {r["tick"]: r["value"] for r in reduce_windows(df.where("scope = '*'"), "avg", 30, 10).collect()}
    assert w == {30: 2.0, 40: 16.5, 50: pytest.approx(73 / 3), 60: 35.0, 70: 40.0, 80: 2.0}
    full = {r["tick"]: r["value"] for r in reduce_windows(df.where("scope = '*'"), "sum", 30, 10, require_full=True).collect()}
    assert full == {30: None, 40: None, 50: 73.0, 60: None, 70: None, 80: None}
    assert {r["scope"]: r["value"] for r in reduce_whole(df, "pct_nonnull").collect()} == {"*": 62.5, "g": 0.0}
    r = replay(reduce_windows(df, "avg", 30, 10), UP).cache()
    assert [x["status"] for x in r.where("scope = '*'").orderBy("tick").collect()] == ["OK", "WARN", "ALERT", "ALERT", "ALERT", "OK"]
    assert [x["status"] for x in r.where("scope = 'g'").collect()] == [None] * 6
    assert [(x["status"], x["since"], x["until"]) for x in timeline(r).orderBy("since").collect()] == [("OK", 30, 40), ("WARN", 40, 50), ("ALERT", 50, 80), ("OK", 80, None)]


def test_dashboards():
    d = {"variables": [{"name": "service", "tag": "service", "default": "api"}], "widgets": [{"type": "timeseries", "queries": ["sum:a{$service}", "p95:b{$other}"]}, {"type": "toplist", "queries": ["sum:a{"]}, {"type": "heatmap", "queries": ["dist:c{*}"]}, {"type": "query_value", "reducer": "last", "queries": ["dist:c{*}"]}, {"type": "odd"}]}
    f = dashboards.validate(d)
    assert len(f) == 5 and any("$other" in x for x in f)
    assert dashboards.bind(d) == {"service": ["service:api"]} and dashboards.bind(d, service="*") == {"service": []}
    assert dashboards.structured("a.b", "sum", ["canary", "env:x"], ["host"]) == ("sum:a.b{canary:*,env:x} by {host}", ["canary is read as canary:*"])
