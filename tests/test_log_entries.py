import random

import pytest

from lumenspar.operators.log_entries import Router, epoch_ms, log_entries


@pytest.mark.parametrize(
    ("source", "line", "want"),
    [
        ("python", 'INFO:     172.21.0.46:43930 - "GET /api/v1/x HTTP/1.1" 200 OK', ("info", "", 0)),
        ("python", "ERROR:    lease renewed", ("error", "", 0)),
        ("python", "WARN watchdog slow flush: 812 ms", ("warn", "watchdog", 0)),
        ("python", "INFO:app.judge:peer said: ERROR 17", ("info", "app.judge", 0)),
        ("python", "2026-09-29T03:42:25.512 INFO watchdog cursor at 2026-01-01 00:00:00", ("info", "watchdog", 1790653345512)),
        ("python", "16:31:59:   3.88s ← cron:reap_orphans()", ("info", "", 0)),
        ("python", '{"level": "ERROR", "message": "m", "timestamp": "2026-09-30T07:06:07.526Z", "logger": "a.b"}', ("error", "a.b", 1790751967526)),
        ("winston", '{"level":40,"msg":"x","ts":"2026-09-28T02:02:12.955+02:00","tag":"api"}', ("warn", "api", 1790553732955)),
        ("winston", '{"severity":"silly","time":1790553744033}', ("debug", "", 1790553744033)),
        ("sidekiq", "2026-09-29T01:10:19.608Z pid=40 tid=gx9 class=Reports::NightlyJob jid=c2 elapsed=5.56 DEBUG: WARN: nested", ("debug", "Reports::NightlyJob", 1790644219608)),
        ("postgres", "2026-09-29 14:17:11.403 CET [260] app@runs_db FATAL:  relation missing", ("critical", "runs_db", 1790687831403)),
        ("postgres", "2026-09-30 08:22:14.872 UTC [423] DEBUG3:  checkpoint", ("debug", "", 1790756534872)),
        ("redis", "12:X 29 Sep 2026 04:58:06.083 # # of clients: 4", ("warn", "X", 1790657886083)),
    ],
)
def test_layouts(source, line, want):
    r = Router().parse(source, line)
    assert (r["level"], r["component"], r["ts"]) == want


@pytest.mark.parametrize(("source", "line"), [("python", "  INFO app.worker step 0"), ("python", "Traceback (most recent call last):"), ("python", "{"), ("python", "ValueError: bad level: ERROR"), ("winston", '  {"level":"error"}'), ("winston", '{"a":1'), ("winston", "[1]"), ("redis", "overflow"), ("python", ""), (None, "INFO a b")])
def test_continuations(source, line):
    assert Router().parse(source, line) is None


def test_times():
    assert epoch_ms("2026-09-29 08:36:20 -0330") == epoch_ms("2026-09-29T12:06:20Z") == 1790683580000
    assert epoch_ms("nonsense") == epoch_ms(None) == epoch_ms(True) == 0
    assert epoch_ms(1790553744) == 1790553744000


RAILS = """[aaaaaaaa-1] Started GET "/x" for 10.0.0.1 at 2026-09-28 08:32:20 -0330
[bbbbbbbb-2] Started GET "/y" for 10.0.0.1 at 2026-09-28 12:02:20 +0000
[aaaaaaaa-1] Processing by OrdersController#index as HTML
    -- continued
[bbbbbbbb-2] Processing by Admin::RunsController#index as HTML
[bbbbbbbb-2]   Parameters: {"note"=>"Completed 500 in my head"}
[aaaaaaaa-1] NoMethodError (undefined method 'total' for nil):

app/models/order.rb:41:in 'sum'
[bbbbbbbb-2] Completed 404 Not Found in 5ms
[aaaaaaaa-1] Completed 200 OK in 5ms
[cccccccc-3] Started GET "/z" for 10.0.0.1 at 2026-09-28 12:02:21 +0000""".split("\n")


@pytest.mark.parametrize("block", [1, 2, 5, 4096])
def test_requests_and_blocks(spark, block):
    rows = [("f", i + 1, "rails", x) for i, x in enumerate(RAILS)] + [("p", 1, "python", "stray"), ("p", 2, "python", "more"), ("p", 3, "python", "ERROR:x:boom"), ("p", 4, "python", None), ("p", 5, "python", ""), ("p", 9, "python", "INFO:y:ok")]
    rows = rows + rows[::3] + [(None, 1, "python", "INFO:y:ok"), ("p", None, "python", "INFO:y:ok")]
    random.Random(block).shuffle(rows)
    df = spark.createDataFrame(rows, "file_name string, line_no bigint, source string, line string").repartition(3)
    got = {tuple(r) for r in log_entries(df, block=block, message=False).collect()}
    t = 1790596940000
    assert got == {
        ("f", 1, 7, "error", "OrdersController", t), ("f", 2, 4, "warn", "Admin::RunsController", t), ("f", 12, 1, "warn", "", t + 1000),
        ("p", 1, 2, "info", "", 0), ("p", 3, 3, "error", "x", 0), ("p", 9, 1, "info", "y", 0),
    }


def test_message_and_empty(spark):
    df = spark.createDataFrame([("p", 1, "python", "ERROR:x:boom"), ("p", 2, "python", "  at y")], "file_name string, line_no bigint, source string, line string")
    assert log_entries(df).first()["message"] == "boom\n  at y"
    assert log_entries(df.where("false")).count() == 0
