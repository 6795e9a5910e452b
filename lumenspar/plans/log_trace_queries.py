"""Queries over logs and traces, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.operators import logs, traces
from lumenspar.sources import adapters
from lumenspar.sources.tables import table

FROM_MS, TO_MS = 1_704_067_200_000, 1_704_067_200_000 + 30 * 86_400_000 - 1
DAY_MS = 86_400_000

LOGS = """l AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts, event_type || ' by user ' || user_id AS message, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS status,
  'svc-' || (user_id % 4) AS service, 'h' || (user_id % 3) AS host, props::JSON AS attrs, CAST(props->>'k' AS DOUBLE) AS k FROM events)"""

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _page(query: str, limit: int = 100, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: logs.search(adapters.event_logs(spark, d), query, FROM_MS, TO_MS, limit, **options).select("seq", "ts", "message", "status", "service")


def _add(name: str, query: str, where: str, order: str = "ts DESC, seq DESC", limit: int = 100, **options) -> None:
    Q[name] = _page(query, limit, **options)
    SQL[name] = f"WITH {LOGS} SELECT seq, ts, message, status, service FROM l WHERE ts BETWEEN {FROM_MS} AND {TO_MS} AND ({where}) ORDER BY {order} LIMIT {limit}"


_add("log_search_all", "", "true")
_add("log_search_label", "service:svc-1 status:error", "service = 'svc-1' AND status = 'error'")
_add("log_search_label_glob", "service:svc-* -host:h1", "service LIKE 'svc-%' AND host <> 'h1'")
_add("log_search_text", '"BY USER 1"', "lower(message) LIKE '%by user 1%'")
_add("log_search_text_glob", "click*user", "lower(message) LIKE '%click%user%'")
_add("log_search_attr_eq", "@k:7", "k = 7")
_add("log_search_attr_glob", "@k:1*", "attrs->>'k' LIKE '1%'")
_add("log_search_attr_cmp", "@k:>=90", "k >= 90")
_add("log_search_attr_range", "@k:[10 TO 12]", "k BETWEEN 10 AND 12")
_add("log_search_not", "-@missing:1 NOT status:info", "status <> 'info'")
_add("log_search_or", "(purchase OR signup) service:svc-2", "(lower(message) LIKE '%purchase%' OR lower(message) LIKE '%signup%') AND service = 'svc-2'")
_add("log_search_env", "env:prod @k:<3", "k < 3")
_add("log_search_oldest", "status:error", "status = 'error'", "ts, seq", newest_first=False)
Q["log_page_2"] = _page("status:info", 50, after=logs.cursor(FROM_MS + 20 * DAY_MS, 0))
SQL["log_page_2"] = f"WITH {LOGS} SELECT seq, ts, message, status, service FROM l WHERE ts BETWEEN {FROM_MS} AND {TO_MS} AND status = 'info' AND (ts < {FROM_MS + 20 * DAY_MS} OR ts = {FROM_MS + 20 * DAY_MS} AND seq < 0) ORDER BY ts DESC, seq DESC LIMIT 50"


def _hist(by: str = "", query: str = "", groups: int = 100) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: logs.histogram(adapters.event_logs(spark, d), query, FROM_MS, TO_MS, DAY_MS, by, groups)


Q["log_histogram"] = _hist()
SQL["log_histogram"] = f"WITH {LOGS} SELECT ts - ts % {DAY_MS} AS bucket, count(*) AS n FROM l GROUP BY ALL"
Q["log_histogram_by_label"] = _hist("service", "status:error")
SQL["log_histogram_by_label"] = f"WITH {LOGS} SELECT ts - ts % {DAY_MS} AS bucket, service AS grp, count(*) AS n FROM l WHERE status = 'error' GROUP BY ALL"
Q["log_histogram_by_attr"] = _hist("@k", groups=5)
SQL["log_histogram_by_attr"] = f"WITH {LOGS}, t AS (SELECT attrs->>'k' AS g, count(*) AS n FROM l GROUP BY ALL ORDER BY n DESC, g LIMIT 5) SELECT ts - ts % {DAY_MS} AS bucket, CASE WHEN attrs->>'k' IN (SELECT g FROM t) THEN attrs->>'k' ELSE '(other)' END AS grp, count(*) AS n FROM l GROUP BY ALL"
Q["log_facets"] = lambda spark, d: logs.facets(adapters.event_logs(spark, d), "-status:error", ["service", "status", "host", "@k"], FROM_MS, TO_MS, 4)
SQL["log_facets"] = f"""WITH {LOGS}, v AS (SELECT unnest(['service', 'status', 'host', '@k']) AS key, unnest([service, status, host, attrs->>'k']) AS value FROM l WHERE status <> 'error'),
  c AS (SELECT key, value, count(*) AS n FROM v WHERE value <> '' GROUP BY ALL) SELECT key, value, n FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, value) <= 4"""
# the real log table, whole
Q["log_table_errors"] = lambda spark, d: logs.histogram(table(spark, d, "logs").dropDuplicates(["seq"]), "@status_code:>=500 -source:rails", 0, 1 << 50, 3_600_000, "service")
SQL["log_table_errors"] = "WITH l AS (SELECT DISTINCT ON (seq) * FROM logs ORDER BY seq) SELECT ts - ts % 3600000 AS bucket, coalesce(service, '') AS grp, count(*) AS n FROM l WHERE TRY_CAST(json_extract(attrs, '$.status_code') AS DOUBLE) >= 500 AND json_type(attrs, '$.status_code') NOT IN ('VARCHAR') AND coalesce(source, '') <> 'rails' GROUP BY ALL"

# traces

ORDERS = "o AS (SELECT o_orderkey + 1 AS id, epoch_us(o_orderdate) + o_orderkey * 1000 AS start, floor(o_totalprice)::BIGINT * 10 AS duration, (o_orderstatus = 'P')::INT AS error, o_orderpriority AS prio FROM orders)"
LINES = "c AS (SELECT l_orderkey + 1 AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n, 'supplier-' || (l_suppkey % 5) AS service, 'part ' || (l_partkey % 10) AS resource, (l_quantity * 1000)::BIGINT AS duration, (l_returnflag = 'R')::INT AS error, epoch_us(o_orderdate) + l_orderkey * 1000 AS base FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
SPANS = f"""{ORDERS}, {LINES}, sp AS (
  SELECT lpad(lower(to_hex(id)), 32, '0') AS trace_id, lpad(lower(to_hex(id)), 16, '0') AS span_id, NULL AS parent_id, 'shop' AS service, 'http.request' AS name, 'GET /orders/' || prio AS resource, start, duration, error, CASE WHEN error = 1 THEN '500' ELSE '200' END AS code FROM o
  UNION ALL SELECT lpad(lower(to_hex(id)), 32, '0'), lpad(lower(to_hex(n)), 4, '0') || lpad(lower(to_hex(id)), 12, '0'), lpad(lower(to_hex(id)), 16, '0'), service, 'supplier.pick', resource, base + n * 100, duration, error, NULL FROM c)"""
ALL_US = (694_224_000_000_000, 1_000_000_000_000_000)


def _q(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = fn
    if sql:
        SQL[name] = sql


_cols = ["trace_id", "span_id", "service", "name", "resource", "start", "duration", "error"]
_q("trace_by_id", lambda s, d: traces.trace(adapters.spans(s, d), f"{8:032x}").select(*_cols), f"WITH {SPANS} SELECT {', '.join(_cols)} FROM sp WHERE trace_id = '{8:032x}'")
_q("trace_view", lambda s, d: traces.trace_view(adapters.spans(s, d)).withColumn("services", F.array_join("services", ",")), f"WITH {SPANS} SELECT trace_id, min(start) AS start, max(start + duration) - min(start) AS duration, count(*) AS span_count, sum(error)::BIGINT AS errors, array_to_string(list_sort(list(DISTINCT service)), ',') AS services, 0::BIGINT AS orphans FROM sp GROUP BY trace_id")
_q("trace_orphans", lambda s, d: traces.orphans(adapters.spans(s, d).where("not (service = 'shop' and error = 1)")).select("trace_id", "span_id"), f"WITH {ORDERS}, {LINES} SELECT lpad(lower(to_hex(id)), 32, '0') AS trace_id, lpad(lower(to_hex(n)), 4, '0') || lpad(lower(to_hex(id)), 12, '0') AS span_id FROM c SEMI JOIN (SELECT id FROM o WHERE error = 1) USING (id)")
_q("trace_entry_search", lambda s, d: traces.search_entries(adapters.spans(s, d), *ALL_US, service="shop", errors=True, min_duration=500_000).select("trace_id", "span_id", "resource", "start", "duration", "status_code", "trace_error"), f"WITH {SPANS}, bad AS (SELECT DISTINCT trace_id FROM sp WHERE error = 1) SELECT trace_id, span_id, resource, start, duration, code AS status_code, trace_id IN (SELECT trace_id FROM bad) AS trace_error FROM sp WHERE service = 'shop' AND start BETWEEN {ALL_US[0]} AND {ALL_US[1]} AND (error = 1 OR trace_id IN (SELECT trace_id FROM bad)) AND duration >= 500000 ORDER BY start DESC, trace_id, span_id LIMIT 50")
_q("trace_services", lambda s, d: traces.services(adapters.spans(s, d), *ALL_US), f"WITH {SPANS} SELECT DISTINCT 'prod' AS env, service FROM sp")
_EDGES = f"e AS (SELECT 'prod' AS env, p.service AS parent, x.service AS child, count(*) AS calls, sum(x.error)::BIGINT AS errors, sum(x.duration)::BIGINT AS dur_sum FROM sp x JOIN sp p ON x.trace_id = p.trace_id AND x.parent_id = p.span_id WHERE p.service <> x.service GROUP BY ALL)"
_q("service_edges", lambda s, d: traces.service_edges(adapters.spans(s, d), *ALL_US), f"WITH {SPANS}, {_EDGES} SELECT * FROM e")
_q("service_map", lambda s, d: traces.service_map(adapters.spans(s, d), *ALL_US), f"WITH {SPANS}, {_EDGES}, u AS (SELECT env, child AS service, calls AS i, errors AS x, 0 AS o FROM e UNION ALL SELECT env, parent, 0, 0, calls FROM e) SELECT env, service, sum(i)::BIGINT AS calls_in, sum(x)::BIGINT AS errors_in, sum(o)::BIGINT AS calls_out FROM u GROUP BY ALL")
_G = repr(traces.sketch.GAMMA)
_RED = """b AS (SELECT {by}, ceil(ln(duration / 1e6) * {inv})::INT AS ix, count(*)::DOUBLE AS c, min(duration / 1e6) AS lo, max(duration / 1e6) AS hi, sum(error)::BIGINT AS er FROM sp GROUP BY ALL),
  r AS (SELECT *, sum(c) OVER (PARTITION BY {by} ORDER BY ix) AS cum, sum(c) OVER (PARTITION BY {by}) AS n FROM b),
  p AS (SELECT {by}, any_value(n)::BIGINT AS requests, sum(er)::BIGINT AS errors, min(lo) AS mn, max(hi) AS mx, min(ix) FILTER (cum > 0.5 * (n - 1)) AS i50, min(ix) FILTER (cum > 0.95 * (n - 1)) AS i95, min(ix) FILTER (cum > 0.99 * (n - 1)) AS i99 FROM r GROUP BY ALL)
  SELECT {by}, requests, round(requests / {secs}, 9) AS per_second, errors, round(errors / requests * 100, 6) AS error_pct,
  round(least(greatest(2 * pow({g}, i50) / ({g} + 1), mn), mx) * 1000, 6) AS p50_ms, round(least(greatest(2 * pow({g}, i95) / ({g} + 1), mn), mx) * 1000, 6) AS p95_ms, round(least(greatest(2 * pow({g}, i99) / ({g} + 1), mn), mx) * 1000, 6) AS p99_ms FROM p ORDER BY requests DESC, {by} LIMIT 50"""
_red = lambda by: f"WITH {SPANS}, " + _RED.format(by=by, inv=repr(traces.sketch.INV_LN_GAMMA), g=_G, secs=(ALL_US[1] - ALL_US[0]) / 1e6)
_q("red_services", lambda s, d: traces.red_table(adapters.spans(s, d), *ALL_US), _red("name, service"))
_q("red_resources", lambda s, d: traces.red_table(adapters.spans(s, d), *ALL_US, by=["service", "resource"]), _red("service, resource"))
_q("red_concentrator", lambda s, d: traces.concentrate(adapters.spans(s, d), 3600)[0], f"WITH {SPANS} SELECT name, service, resource, 'prod' AS env, coalesce(CASE WHEN code = '500' THEN '5xx' WHEN code = '200' THEN '2xx' END, '') AS status_class, (start + duration) // 1000000 // 3600 * 3600 AS ts_s, count(*) AS hits, sum(error)::BIGINT AS errors FROM sp GROUP BY ALL")
_q("red_concentrator_durations", lambda s, d: traces.concentrate(adapters.spans(s, d), 86_400)[1].groupBy("service", "sign", "idx").agg(F.sum("count").cast("bigint").alias("n")), f"WITH {SPANS} SELECT service, 1::INT AS sign, ceil(ln(duration / 1e6) * {traces.sketch.INV_LN_GAMMA!r})::INT AS idx, count(*) AS n FROM sp GROUP BY ALL")
_q("head_sampling", lambda s, d: table(s, d, "orders").select("o_orderkey", F.lower(F.lpad(F.hex(F.col("o_orderkey") * 7919), 32, "0")).alias("t")).select("o_orderkey", traces.head_sampled(F.col("t"), 0.25).alias("kept")), "SELECT o_orderkey, ((o_orderkey * 7919)::UHUGEINT * 1111111111111111111::UHUGEINT) % 18446744073709551616::UHUGEINT < (18446744073709551616 / 4)::UHUGEINT AS kept FROM orders")
_q("path_normalize", lambda s, d: table(s, d, "orders").select("o_orderkey", traces.normalize_path(F.concat(F.lit("/api/orders/"), F.col("o_orderkey").cast("string"), F.lit("/items/abc-"), F.col("o_custkey").cast("string"), F.lit("?page=2#top"))).alias("path")), "SELECT o_orderkey, '/api/orders/:id/items/abc-' || o_custkey AS path FROM orders")
_q("status_class", lambda s, d: table(s, d, "lineitem").select((F.col("l_partkey") % 700).cast("string").alias("code")).groupBy(traces.status_class(F.col("code")).alias("status_class")).agg(F.count("*").alias("n")), "SELECT CASE WHEN l_partkey % 700 BETWEEN 100 AND 599 THEN (l_partkey % 700 // 100) || 'xx' END AS status_class, count(*) AS n FROM lineitem GROUP BY ALL")
_q("trace_rates", lambda s, d: traces.sampled_rates(adapters.spans(s, d), 0.001, 86_400).withColumn("rate", F.round("rate", 9)), f"WITH {SPANS} SELECT 'prod' AS env, service, start // 1000000 // 86400 * 86400 AS \"window\", round(least(1.0, 86.4 / count(*)), 9) AS rate FROM sp GROUP BY ALL")

QUERIES = Q
