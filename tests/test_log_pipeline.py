import json

from lumenspar.operators.log_pipeline import Pattern, SourceConfig, requests, run

SCHEMA = "id bigint, source string, line string, arrival_ms bigint, err boolean"


def test_chain(spark):
    rows = [
        (1, "shop", "GET /a 200 12 0.5s token=abc", 1000, False), (2, "shop", "odd line password: q", 1001, True), (3, "shop", "ping", 1002, False),
        (4, "python", "ERROR:app.db:lost\n  at x", 1003, False), (5, "winston", '{"level":50,"msg":"m a@b.org","ts":1790553744033,"secret":{"x":1}}', 1004, False),
        (6, "redis", "12:X 29 Sep 2026 04:58:06.083 # x", 1005, False), (7, "plain", '{"level":50}', 1006, False), (8, None, '{"a":1}', 1007, False), (9, "shop", None, 1008, True), (10, "python", "{broken", 1009, True),
    ]
    shop = SourceConfig((Pattern(r"^(?P<method>[A-Z]+) (?P<path>\S+) (?P<code_int>\d+) (?P<n_float>\S+) (?P<took_float>[\d.]+)s(?P<none> x)?", "${method} ${code} in ${took}${gone}"), Pattern(r"^(?P<w>\w+) line")), ("^ping$",), redact_rules=((r"\bGET\b", "G"),))
    got = {r["id"]: r for r in run(spark.createDataFrame(rows, SCHEMA), {"shop": shop}, stderr="err").collect()}
    assert set(got) == {1, 2, 4, 5, 6, 7, 8, 9, 10}
    assert json.loads(got[1]["attrs"]) == {"method": "GET", "path": "/a", "code": 200, "n": 12.0, "took": 0.5, "message": "GET 200 in 0.5"} and got[1]["message"] == "G 200 in 0.5"
    assert (got[2]["message"], got[2]["attrs"], got[2]["status"]) == ("odd line password: [REDACTED]", '{"w":"odd"}', "info")
    assert (got[4]["message"], got[4]["status"], json.loads(got[4]["attrs"])["name"]) == ("lost\n  at x", "error", "app.db")
    assert (got[5]["message"], got[5]["status"], got[5]["ts_ms"]) == ("m [REDACTED]", "error", 1790553744033) and '"secret":"[REDACTED]"' in got[5]["attrs"]
    assert (got[6]["message"], got[6]["status"], got[6]["ts_ms"]) == ("x", "warn", 1790657886083)
    assert (got[7]["message"], got[7]["parsed"], got[7]["status"], got[7]["ts_ms"]) == ('{"level":50}', False, "info", 1006)
    assert got[8]["parsed"] and got[9]["message"] is None and (got[10]["status"], got[10]["parsed"]) == ("error", False)
    limited = run(spark.createDataFrame(rows * 3, SCHEMA), {"shop": SourceConfig(per_second=2)}, order="id")
    assert limited.where("source = 'shop'").count() == 2 and limited.where("source = 'python'").count() == 6
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_requests(spark):
    text = ['[aaaaaaaa-1] Started GET "/x/1?p=2&q" for 10.0.0.1 at 2026-09-28 08:32:20 -0330', "[bbbbbbbb-2] Started POST \"/y\" for ::1 at 2026-09-28 12:02:20 +0000", "[aaaaaaaa-1] Processing by Admin::RunsController#show as HTML", "[aaaaaaaa-1] Completed 404 Not Found in 5ms (Views: 1ms)", "[bbbbbbbb-2] NoMethodError (undefined method):"]
    df = spark.createDataFrame([("f", i + 1, "rails", x) for i, x in enumerate(text)] + [("g", 1, "python", "INFO:a:b")], "file_name string, line_no bigint, source string, line string")
    got = {r["first_line"]: tuple(r)[2:] for r in requests(df).collect()}
    assert got == {1: ("GET", "/x/1", "p=2&q", "Admin::RunsController", "show", 404, 5.0, None, 3, True, "warn"), 2: ("POST", "/y", None, None, None, None, None, "NoMethodError", 2, False, "error")}
