"""Queries of the catalogue, edge, pipeline, monitor and retention operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar import model
from lumenspar.logql import compile as logs_compile
from lumenspar.metricql import Engine
from lumenspar.operators import catalog, dashboards, edge, log_pipeline, logs, monitors, pipeline, wire
from lumenspar.plans.core_queries import HEADS
from lumenspar.plans.metric_queries import _BINS, _G, DAY, EVENTS, FROM, SAMPLES, TO, engine
from lumenspar.session import scratch
from lumenspar.sources import adapters, stores
from lumenspar.sources.tables import table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _q(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = fn
    if sql:
        SQL[name] = sql


# catalogue: over the series and tags of the store's own tables

CATALOG = "m AS (SELECT DISTINCT metric, key AS series_key, id FROM series), t AS (SELECT DISTINCT m.metric, m.series_key, g.key AS k, coalesce(g.value, '') AS v FROM m JOIN (SELECT DISTINCT * FROM series_tags) g ON g.series_id = m.id)"


def catalog_samples(spark: SparkSession, d: str) -> DataFrame:
    """The series table as (metric, series_key, tags), one row per id and key."""
    s = table(spark, d, "series").select("id", "metric", F.col("key").alias("series_key")).distinct()
    t = table(spark, d, "series_tags").select(F.col("series_id").alias("id"), F.struct("key", F.coalesce("value", F.lit("")).alias("value")).alias("t")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("tags"))
    return s.join(t, "id", "left").select("metric", "series_key", F.coalesce("tags", F.array().cast(model.TAGS)).alias("tags"))


_q("catalog_metric_names", lambda s, d: catalog.metric_names(catalog_samples(s, d), "system."), "SELECT DISTINCT metric FROM series WHERE metric LIKE 'system.%' ORDER BY metric LIMIT 1000")
_q("catalog_tag_keys", lambda s, d: catalog.tag_keys(catalog_samples(s, d), "net.rx"), f"WITH {CATALOG} SELECT DISTINCT k AS key FROM t WHERE metric = 'net.rx'")
_q("catalog_tag_values", lambda s, d: catalog.tag_values(catalog_samples(s, d), "http.request.rate", "service"), f"WITH {CATALOG} SELECT DISTINCT v AS value FROM t WHERE metric = 'http.request.rate' AND k = 'service' AND v <> ''")
_q("catalog_series_counts", lambda s, d: catalog.series_counts(catalog_samples(s, d)), "SELECT metric, count(DISTINCT key) AS series FROM series GROUP BY metric")


def _tag_card(s: SparkSession, d: str) -> DataFrame:
    c = catalog_samples(s, d).where("metric = 'container.cpu.usage'").select("metric", "series_key", F.explode("tags").alias("t"))
    return c.groupBy(F.col("t.key").alias("key")).agg(F.count_distinct("series_key").alias("series"), F.count_distinct(F.nullif(F.col("t.value"), F.lit(""))).alias("values"))


_q("catalog_tag_cardinality", _tag_card, f"WITH {CATALOG} SELECT k AS key, count(DISTINCT series_key) AS series, count(DISTINCT nullif(v, '')) AS values FROM t WHERE metric = 'container.cpu.usage' GROUP BY k")
_q("catalog_cardinality_page", lambda s, d: catalog.top_cardinality(catalog.series_counts(catalog_samples(s, d)), "series", "metric", 5), "WITH c AS (SELECT metric, count(DISTINCT key) AS series FROM series GROUP BY metric) SELECT metric, series, count(*) OVER () AS total, count(*) OVER () > 5 AS truncated FROM c ORDER BY series DESC, metric LIMIT 5")
_q("catalog_discover", lambda s, d: catalog.discover(catalog_samples(s, d), ["net.rx", "power.draw"]), f"WITH {CATALOG} SELECT DISTINCT trim(v) AS value FROM t WHERE metric IN ('net.rx', 'power.draw') AND k = 'service' AND trim(v) <> '' ORDER BY value LIMIT 100")
_q("select_merge_sources", lambda s, d: catalog.merge_sources([x := adapters.metric_samples(s, d).where("metric = 'app.event.count'"), x.withColumn("value", F.col("value") + 1).withColumn("ts_s", F.col("ts_s") + 3600)]).select("series_key", "ts_s", "value"), f"WITH {EVENTS}, s AS ({SAMPLES['count']}), k AS (SELECT 'app.event.count|shard:' || shard || coalesce(',tier:' || tier, '') || ',type:' || type AS series_key, ts_s, value FROM s), u AS (SELECT *, 0 AS src FROM k UNION ALL SELECT series_key, ts_s + 3600, value + 1, 1 FROM k) SELECT series_key, ts_s, arg_min(value, src) AS value FROM u GROUP BY ALL")

# governance

_q("type_conflict", lambda s, d: catalog.type_conflicts(table(s, d, "events").select(F.concat(F.lit("m."), F.col("event_type")).alias("metric"), F.when(F.col("event_id") % 3 == 0, "gauge").otherwise("count").alias("type"), F.col("event_id").alias("arrival")), s.createDataFrame([("m.click", "gauge")], "metric string, type string")).groupBy("metric", "registered").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected")), "WITH a AS (SELECT 'm.' || event_type AS metric, CASE WHEN event_id % 3 = 0 THEN 'gauge' ELSE 'count' END AS type, event_id FROM events), f AS (SELECT metric, CASE WHEN metric = 'm.click' THEN 'gauge' ELSE arg_min(type, event_id) END AS registered FROM a GROUP BY metric) SELECT metric, registered, count(*) FILTER (type = registered) AS accepted, count(*) FILTER (type <> registered) AS rejected FROM a JOIN f USING (metric) GROUP BY ALL")
_q("tag_rules", lambda s, d: catalog.apply_tag_rules(adapters.metric_samples(s, d), s.createDataFrame([("app.event.count", "deny", ["shard"]), ("app.event.value", "allow", ["type"])], "metric string, mode string, keys array<string>")).groupBy("metric", "series_key").agg(F.count("*").alias("n")), f"WITH {EVENTS}, s AS (SELECT * FROM ({SAMPLES['count']})) SELECT 'app.event.count' AS metric, 'app.event.count|' || coalesce('tier:' || tier || ',', '') || 'type:' || type AS series_key, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'app.event.value', 'app.event.value|type:' || type, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'app.event.rate', 'app.event.rate|shard:' || shard || coalesce(',tier:' || tier, '') || ',type:' || type, count(*) FROM s GROUP BY ALL")
_q("series_limit", lambda s, d: catalog.series_limit(adapters.metric_samples(s, d).where("metric = 'app.event.count'"), 3, DAY).groupBy("accepted").agg(F.count("*").alias("n")), f"WITH {EVENTS}, s AS ({SAMPLES['count']}), k AS (SELECT 'app.event.count|shard:' || shard || coalesce(',tier:' || tier, '') || ',type:' || type AS key, ts_s, ts_s // {DAY} AS w FROM s), f AS (SELECT w, key, row_number() OVER (PARTITION BY w ORDER BY min(ts_s), key) <= 3 AS accepted FROM k GROUP BY w, key) SELECT accepted, count(*) AS n FROM k JOIN f USING (w, key) GROUP BY accepted")
_q("name_cap", lambda s, d: catalog.cap_values(table(s, d, "lineitem").select("l_returnflag", F.concat(F.lit("r"), (F.col("l_partkey") % 50).cast("string")).alias("res"), F.col("l_orderkey").alias("t")), ["l_returnflag"], "res", "t", 10, "other").groupBy("l_returnflag", "res").agg(F.count("*").alias("n")), "WITH x AS (SELECT l_returnflag, 'r' || (l_partkey % 50) AS res, l_orderkey AS t FROM lineitem), f AS (SELECT l_returnflag, res, row_number() OVER (PARTITION BY l_returnflag ORDER BY min(t), res) <= 10 AS own FROM x GROUP BY l_returnflag, res) SELECT l_returnflag, CASE WHEN own THEN res ELSE 'other' END AS res, count(*) AS n FROM x JOIN f USING (l_returnflag, res) GROUP BY ALL")
_q("dedupe_append_only", lambda s, d: catalog.append_only(table(s, d, "samples").where("v is not null").select(F.col("series_id").alias("series_key"), (F.col("t") / 1000).cast("bigint").alias("ts_s"), F.col("v").alias("value"), F.struct("rec_offset", "t", "v").alias("arrival")), offset="arrival.rec_offset").groupBy("outcome").agg(F.count("*").alias("n")), """
    WITH s AS (SELECT series_id, t // 1000 AS ts, v, rec_offset, t FROM samples WHERE v IS NOT NULL),
    f AS (SELECT DISTINCT ON (series_id, ts) series_id, ts AS m, v AS held FROM s ORDER BY series_id, ts, rec_offset NULLS FIRST, t, v),
    w AS (SELECT *, max(ts) OVER (PARTITION BY series_id ORDER BY rec_offset NULLS FIRST, t, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
    SELECT CASE WHEN m IS NULL OR ts > m THEN 'stored' WHEN ts = m AND v = held THEN 'duplicate' ELSE 'rejected' END AS outcome, count(*) AS n FROM w LEFT JOIN f USING (series_id, m) GROUP BY ALL""")
_q("sketch_last_write", lambda s, d: catalog.last_write(table(s, d, "events").select("user_id", "event_type", "value", "event_id"), ["user_id"], "event_id"), "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
_q("log_redelivery", lambda s, d: catalog.new_logs(x := adapters.event_logs(s, d), x.where("seq % 3 = 0")).select("seq"), "SELECT event_id AS seq FROM events WHERE event_id % 3 <> 0")
_q("retention_logs_day", lambda s, d: catalog.retain_days(adapters.event_logs(s, d), "ts", 1_706_000_000_000, 7).groupBy("service").agg(F.count("*").alias("n")), "SELECT 'svc-' || (user_id % 4) AS service, count(*) AS n FROM events WHERE epoch_us(ts) // 1000 >= (1706000000000 // 86400000 - 7) * 86400000 GROUP BY ALL")
_q("retention_traces_first_seen", lambda s, d: catalog.retain_traces(adapters.spans(s, d), 860_000_000_000_000, 24 * 365).select("trace_id").distinct(), "SELECT DISTINCT lpad(lower(to_hex(o_orderkey + 1)), 32, '0') AS trace_id FROM orders WHERE epoch_us(o_orderdate) + o_orderkey * 1000 >= (860000000000000 // 3600000000 - 8760) * 3600000000")

# edge

STATSD = "x AS (SELECT event_id, event_type AS type, value, epoch_us(ts) // 1000000 AS s, CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE 1.0 END AS rate FROM events)"


def statsd_lines(spark: SparkSession, d: str) -> DataFrame:
    """events as statsd lines of each kind, two lines to a datagram."""
    e = adapters.events(spark, d)
    tail = F.concat(F.when(F.col("event_id") % 4 == 0, "|@0.5").otherwise(""), F.lit("|#type:"), F.col("event_type"), F.lit("|T"), F.col("ts_s").cast("string"))
    v = F.format_string("%.2f", "value")
    g = F.concat(F.concat(F.lit("app.n:1|c"), tail), F.lit("\r\n"), F.concat(F.lit("app.v:"), v, F.lit("|g"), tail), F.lit("\n\n"), F.concat(F.lit("app.h:"), v, F.lit("|h"), tail), F.lit("\n"), F.concat(F.lit("app.u:"), F.col("user_id").cast("string"), F.lit("|s"), tail), F.lit("\nbroken line\n_e{1,1}:a|b"))
    return e.select("event_id", g.alias("value"))


def _parsed(s: SparkSession, d: str) -> DataFrame:
    lines = statsd_lines(s, d).select("event_id", F.explode(F.split("value", "\n")).alias("line")).select("event_id", F.regexp_replace("line", "\r+$", "").alias("line")).where("line <> ''")
    return edge.parse_statsd(lines).withColumn("b", edge.bucket(F.col("client_ts"), 3600)).withColumn("tag", F.get("tags", F.lit(0)))


_q("statsd_parse", lambda s, d: _parsed(s, d).groupBy("name", "type", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), "SELECT name, type, reason, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT unnest(['app.n', 'app.v', 'app.h', 'app.u', '', '']) AS name, unnest(['count', 'gauge', 'histogram', 'set', NULL, NULL]) AS type, unnest(['ok', 'ok', 'ok', 'ok', 'malformed', 'event']) AS reason, unnest([1.0, value, value, NULL, NULL, NULL]) AS v FROM events) GROUP BY ALL")
_q("edge_counter", lambda s, d: edge.counters(_parsed(s, d).where("name = 'app.n' and reason is null"), ["tag", "b"]), f"WITH {STATSD} SELECT 'type:' || type AS tag, s // 3600 * 3600 AS b, sum(1 / rate) AS value FROM x GROUP BY ALL")
_q("edge_gauge", lambda s, d: edge.gauges(_parsed(s, d).where("name = 'app.v' and reason is null"), ["tag", "b"], "event_id"), f"WITH {STATSD} SELECT 'type:' || type AS tag, s // 3600 * 3600 AS b, arg_max(value, event_id) AS value FROM x GROUP BY ALL")
_q("edge_set", lambda s, d: edge.sets(_parsed(s, d).where("name = 'app.u' and reason is null"), ["tag", "b"]), "SELECT 'type:' || event_type AS tag, epoch_us(ts) // 1000000 // 3600 * 3600 AS b, count(DISTINCT user_id) AS value FROM events GROUP BY ALL")
_q("edge_histogram", lambda s, d: edge.histograms(_parsed(s, d).where("name = 'app.h' and reason is null"), ["tag", "b"]).withColumn("avg", F.round("avg", 6)), f"WITH {STATSD} SELECT 'type:' || type AS tag, s // 3600 * 3600 AS b, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, sum(1 / rate) AS count FROM x GROUP BY ALL")
_q("edge_distribution", lambda s, d: edge.distributions(_parsed(s, d).where("name = 'app.h' and reason is null"), ["tag"])[1].select("tag", "count", F.round("sum", 4).alias("sum"), "min", "max"), f"WITH {STATSD} SELECT 'type:' || type AS tag, sum(1 / rate) AS count, round(sum(value / rate), 4) AS sum, min(value) AS min, max(value) AS max FROM x GROUP BY ALL")
_q("edge_zero_fill", lambda s, d: edge.zero_fill(adapters.metric_samples(s, d).where("metric = 'app.event.count'").select("series_key", "ts_s", "value"), "series_key", "ts_s", 3600, 6 * 3600), f"WITH {EVENTS}, s AS (SELECT 'app.event.count|shard:' || shard || coalesce(',tier:' || tier, '') || ',type:' || type AS series_key, ts_s, count(*)::DOUBLE AS value FROM e GROUP BY ALL), n AS (SELECT *, least(coalesce(lead(ts_s) OVER (PARTITION BY series_key ORDER BY ts_s) - 3600, ts_s + 21600), ts_s + 21600) AS e FROM s) SELECT series_key, ts_s, value FROM s UNION ALL SELECT series_key, unnest(range(ts_s + 3600, e + 1, 3600)), 0.0 FROM n WHERE e > ts_s")
_q("edge_late_rebucket", lambda s, d: edge.rebucket_late(table(s, d, "samples").where("v is not null").select("series_id", (F.col("t") / 1000).cast("bigint").alias("ts"), "rec_offset").join(table(s, d, "queue_records").where("topic = 'series'").groupBy("rec_offset").agg(F.min(F.unix_seconds("rec_time")).alias("arrival")), "rec_offset"), "ts", "arrival", 10).groupBy("moved").agg(F.count("*").alias("n"), F.sum("bucket").alias("total")), "WITH r AS (SELECT rec_offset, min(epoch_us(rec_time) // 1000000) AS arrival FROM queue_records WHERE topic = 'series' GROUP BY rec_offset), x AS (SELECT t // 1000 // 10 * 10 AS own, arrival // 10 * 10 AS oldest FROM samples JOIN r USING (rec_offset) WHERE v IS NOT NULL) SELECT own < oldest AS moved, count(*) AS n, sum(greatest(own, oldest))::BIGINT AS total FROM x GROUP BY ALL")
_q("counter_rate", lambda s, d: edge.counter_rate(adapters.events(s, d).select("event_type", "event_id", "ts_ms", F.col("value")), "event_type", "event_id", "value").select("event_id", F.round("rate", 6).alias("rate"), F.round("change", 6).alias("change")), "SELECT event_id, CASE WHEN value >= p THEN round((value - p) / (event_id - q), 6) END AS rate, round(value - p, 6) AS change FROM (SELECT *, lag(value) OVER w AS p, lag(event_id) OVER w AS q FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))")
_HD = "h AS (SELECT event_type, epoch_us(ts) // 1000000 // 86400 AS b, [count(*) FILTER (value <= 20)::DOUBLE, count(*) FILTER (value <= 60)::DOUBLE, count(*)::DOUBLE] AS c FROM events GROUP BY ALL)"


def histogram_deltas(s: SparkSession, d: str) -> DataFrame:
    e = adapters.events(s, d).groupBy("event_type", F.floor(F.col("ts_s") / DAY).alias("b")).agg(F.array(F.count_if(F.col("value") <= 20).cast("double"), F.count_if(F.col("value") <= 60).cast("double"), F.count("*").cast("double")).alias("c")).withColumn("bounds", F.array(F.lit(20.0), F.lit(60.0), F.lit(float("inf"))))
    x = edge.histogram_deltas(e, "event_type", "b", "bounds", "c").where("deltas is not null")
    return x.select("event_type", "b", F.posexplode("deltas").alias("i", "delta")).select("event_type", "b", F.col("i").cast("bigint").alias("i"), "delta")


_q("histogram_deltas", histogram_deltas, f"WITH {_HD}, w AS (SELECT *, lag(c) OVER (PARTITION BY event_type ORDER BY b) AS p FROM h), d AS (SELECT event_type, b, CASE WHEN c[1] < p[1] OR c[2] < p[2] OR c[3] < p[3] THEN c ELSE [c[1] - p[1], c[2] - p[2], c[3] - p[3]] END AS x FROM w WHERE p IS NOT NULL) SELECT event_type, b, unnest([0, 1, 2])::BIGINT AS i, unnest([greatest(0, x[1]), greatest(0, x[2] - greatest(0, x[1])), greatest(0, x[3] - greatest(0, x[1], x[2]))]) AS delta FROM d")
_q("metric_name_normalize", lambda s, d: table(s, d, "part").select("p_partkey", edge.normalize_name(F.concat(F.element_at(F.array(F.lit(""), F.lit("9"), F.lit("ü"), F.lit("m" * 190)), (F.col("p_partkey") % 4 + 1).cast("int")), F.concat_ws(".", "p_brand", "p_type"))).alias("name")), f"WITH n AS (SELECT p_partkey, regexp_replace(['', '9', 'ü', '{'m' * 190}'][p_partkey % 4 + 1] || p_brand || '.' || p_type, '[^A-Za-z0-9_.]', '_', 'g') AS n FROM part) SELECT p_partkey, CASE WHEN length(n) <= 200 AND regexp_matches(n, '^[A-Za-z]') THEN n END AS name FROM n")
_q("tag_normalize", lambda s, d: table(s, d, "series").select(F.explode(F.from_json("tags_json", "array<string>")).alias("t")).select("t").distinct().select("t", edge.normalize_tag(F.col("t")).alias("tag")), "WITH t AS (SELECT DISTINCT unnest(from_json(tags_json, '[\"VARCHAR\"]')) AS t FROM series), k AS (SELECT t, regexp_replace(lower(regexp_extract(t, '^([^:]*)', 1)), '[^a-z0-9_.\\-/]', '_', 'g') AS k, regexp_replace(t, '^[^:]*:?', '') AS v FROM t) SELECT t, CASE WHEN regexp_matches(k, '^[a-z][a-z0-9_.\\-/]*$') THEN CASE WHEN v = '' THEN k ELSE k || ':' || v END END AS tag FROM k")

# wire validation

NOW = 1_790_814_300


def _series_payloads(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "metric_meta").crossJoin(s.range(8).withColumnRenamed("id", "k"))  # 18 metrics, 8 variants
    tpl = F.format_string('{"series":[{"metric":"%s","type":"%s","interval":%d,"tags":["env:%s"],"points":[[%d,%s]],"more":1}]}', F.when(F.col("k") == 1, F.concat(F.lit("9"), "metric")).otherwise(F.col("metric")), F.when(F.col("k") == 2, "odd").otherwise(F.col("type")), F.when(F.col("k") == 3, 7 - F.col("interval_s")).otherwise(F.col("interval_s")), F.when(F.col("k") == 4, "a,b").otherwise("dev"), F.when(F.col("k") == 5, F.lit(NOW + 601)).when(F.col("k") == 6, F.lit(0)).otherwise(F.lit(NOW)), F.when(F.col("k") == 7, "null").otherwise("1.5"))
    return x.select("metric", "k", tpl.alias("payload"))


_q("series_validate", lambda s, d: wire.decode(_series_payloads(s, d), "payload", wire.SERIES, "series").select("metric", "k", wire.series_reason(NOW).alias("reason")), "SELECT metric, k, CASE k WHEN 1 THEN 'bad metric name' WHEN 2 THEN 'unknown type' WHEN 3 THEN CASE WHEN type = 'gauge' THEN 'gauge with an interval' WHEN 7 - interval_s <= 0 THEN 'interval must be positive' END WHEN 4 THEN 'bad tag' WHEN 5 THEN 'timestamp in the future' WHEN 6 THEN 'timestamp must be positive' WHEN 7 THEN 'value isn''t finite' END AS reason FROM metric_meta, (SELECT unnest(range(8)) AS k)")

# pipeline

SEVERITIES = [x for names in pipeline.STATUSES.values() for x in names] + [str(n) for n in range(-2, 66)] + ["", "unknown", "ERROR", " Warning ", "Fatal", "4.5"]
_NAMED = " ".join(f"WHEN list_contains({list(names)!r}, x) THEN '{s}'" for s, names in pipeline.STATUSES.items())
_q("log_severity", lambda s, d: table(s, d, "logs").select(F.element_at(F.lit(SEVERITIES), (F.col("seq") % len(SEVERITIES) + 1).cast("int")).alias("name")).select("name", pipeline.severity(F.col("name")).alias("status")).groupBy("name", "status").agg(F.count("*").alias("n")), f"WITH l AS (SELECT {SEVERITIES!r}[seq % {len(SEVERITIES)} + 1] AS name FROM logs), y AS (SELECT name, lower(trim(name)) AS x, try_cast(CASE WHEN regexp_matches(trim(name), '^-?[0-9]+$') THEN name END AS INT) AS i FROM l) SELECT name, CASE {_NAMED} WHEN i BETWEEN 0 AND 2 OR i BETWEEN 51 AND 60 THEN 'critical' WHEN i = 3 OR i BETWEEN 41 AND 50 THEN 'error' WHEN i = 4 OR i BETWEEN 31 AND 40 THEN 'warn' WHEN i = 7 OR i BETWEEN 10 AND 20 THEN 'debug' ELSE 'info' END AS status, count(*) AS n FROM y GROUP BY ALL")
_q("log_epoch_unit", lambda s, d: table(s, d, "logs").select("seq", pipeline.epoch_ms(F.element_at(F.array(F.col("ts") / 1000.0, F.col("ts") * 1.0, F.col("ts") * 1000.0, F.col("ts") * 1e6), (F.col("seq") % 4 + 1).cast("int"))).alias("ms")).distinct(), "SELECT DISTINCT seq, CASE seq % 4 WHEN 0 THEN floor(ts / 1000.0 * 1000)::BIGINT WHEN 1 THEN ts WHEN 2 THEN floor(ts * 1000.0 / 1000)::BIGINT ELSE floor(ts * 1e6 / 1000000)::BIGINT END AS ms FROM logs")
_MAIL_SQL = "'[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\\.)+[A-Za-z]{2,}', '[REDACTED]', 'g'"
# six kinds of secrets, by turns, before the log's own message; its messages hold e-mail addresses and harmless counts of tokens
SECRETS = [("", ""), ("password=hunter2 ", "password=[REDACTED] "), ("api-key: 'a b' ", "api-key: '[REDACTED]' "), ("Authorization: Bearer x.y ", "Authorization: [REDACTED] "), ("GET /a?token=abc&x=1 ", "GET /a?token=[REDACTED]&x=1 "), ("{\"customer_phone\"=>\"+1 555\", \"microphone\"=>1} ", "{\"customer_phone\"=>\"[REDACTED]\", \"microphone\"=>1} "), ("eyJhbGci.eyJzdWIi.c2ln ", "[REDACTED] ")]


def _sql_list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_q("log_redact", lambda s, d: table(s, d, "logs").select("seq", F.concat(F.element_at(F.lit([a for a, _ in SECRETS]), (F.col("seq") % len(SECRETS) + 1).cast("int")), F.coalesce("message", F.lit(""))).alias("m")).select("seq", pipeline.redact(F.col("m")).alias("m")).distinct(), f"SELECT DISTINCT seq, {_sql_list([b for _, b in SECRETS])}[seq % {len(SECRETS)} + 1] || regexp_replace(regexp_replace(coalesce(message, ''), '(phone=|token: )[^ ;,]+', '\\1[REDACTED]', 'g'), {_MAIL_SQL}) AS m FROM logs")
_q("log_redact_attrs", lambda s, d: table(s, d, "logs").select("seq", F.concat(F.expr("left(attrs, length(attrs) - 1)"), F.lit(', "note": "password=hunter2 at a.b@c.org", "deep": {"accessToken": [1, {"x": "}"}], "n": 1.50}}')).alias("attrs")).select("seq", pipeline.redact_attrs(F.col("attrs")).alias("attrs")).distinct(), f"""SELECT DISTINCT seq, regexp_replace(regexp_replace(left(attrs, length(attrs) - 1), '("token"\\s*:\\s*)"[^"]*"', '\\1"[REDACTED]"', 'g'), {_MAIL_SQL}) || ', "note": "password=[REDACTED] at [REDACTED]", "deep": {{"accessToken": "[REDACTED]", "n": 1.50}}}}' AS attrs FROM logs""")
_q("log_remap", lambda s, d: pipeline.remap(table(s, d, "log_lines").where("line like '{%' and source = 'winston'").select("line_id", F.col("line").alias("attrs"))).select("line_id", "status").groupBy("status").agg(F.count_distinct("line_id").alias("n")), "SELECT CASE WHEN lower(l) IN ('debug', 'silly', '20') THEN 'debug' WHEN lower(l) IN ('warn', 'warning', '40') THEN 'warn' WHEN lower(l) IN ('error', '50') THEN 'error' WHEN lower(l) IN ('critical', 'fatal', '60') THEN 'critical' ELSE 'info' END AS status, count(DISTINCT line_id) AS n FROM (SELECT line_id, coalesce(line->>'level', line->>'levelname', line->>'severity') AS l FROM log_lines WHERE line LIKE '{%' AND source = 'winston') GROUP BY ALL")
# each of these sources begins an event with a date or with redis's process id and role
_q("log_multiline", lambda s, d: edge.multiline(table(s, d, "log_lines").where("source in ('redis', 'sidekiq', 'postgres')").dropDuplicates(["file_name", "line_no"]), "file_name", "line_no", "line", r"^(\d+:[XCSM] |\d{4}-\d{2}-\d{2}[ T])").select("file_name", "first_line", "n_lines"), "WITH l AS (SELECT DISTINCT ON (file_name, line_no) file_name, line_no, line FROM log_lines WHERE source IN ('redis', 'sidekiq', 'postgres')), e AS (SELECT *, sum(regexp_matches(line, '^(\\d+:[XCSM] |\\d{4}-\\d{2}-\\d{2}[ T])')::INT) OVER (PARTITION BY file_name ORDER BY line_no) AS e FROM l) SELECT file_name, min(line_no) AS first_line, count(*) AS n_lines FROM e GROUP BY file_name, e")

# the whole chain over the raw lines, each once
ACCESS = log_pipeline.Pattern(r'^(?P<level>[A-Z]+):\s+(?P<ip>[\d.]+):(?P<port_int>\d+) - "(?P<method>[A-Z]+) (?P<path>\S+) HTTP/(?P<version_float>[\d.]+)" (?P<code_int>\d{3})', "${method} ${code}")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "log_lines").dropDuplicates(["file_name", "line_no"]).withColumn("arrival_ms", F.unix_millis("read_at"))


_q("log_pipeline", lambda s, d: log_pipeline.run(_lines(s, d)).groupBy("source", "status", "parsed").agg(F.count("*").alias("n")), f"{HEADS.rstrip().rstrip(',')}, s AS (SELECT source, head AS parsed, lower(trim(lv)) AS x, CASE WHEN regexp_matches(lv, '^\\d+$') THEN lv::INT END AS i FROM w) SELECT source, parsed, CASE {_NAMED} WHEN i BETWEEN 0 AND 2 OR i BETWEEN 51 AND 60 THEN 'critical' WHEN i = 3 OR i BETWEEN 41 AND 50 THEN 'error' WHEN i = 4 OR i BETWEEN 31 AND 40 THEN 'warn' WHEN i = 7 OR i BETWEEN 10 AND 20 THEN 'debug' ELSE 'info' END AS status, count(*) AS n FROM s GROUP BY ALL")


def log_grok(s: SparkSession, d: str) -> DataFrame:
    """Access lines by a custom pattern: message template, numbers as numbers, and the fields that a search finds again."""
    x = log_pipeline.run(_lines(s, d).where("source = 'python'"), {"python": log_pipeline.SourceConfig((ACCESS,))})
    x = logs_compile.with_attributes(x).where(F.exists("attr_flat", lambda a: (a["path"] == "port") & (a["num"] > 40_000)))
    return x.groupBy("message", "status", F.get_json_object("attrs", "$.version").alias("version")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("attrs", "$.port").cast("bigint")).alias("ports"))


_q("log_grok", log_grok, "WITH l AS (SELECT DISTINCT ON (file_name, line_no) line FROM log_lines WHERE source = 'python'), x AS (SELECT regexp_extract(line, '^([A-Z]+):\\s+[\\d.]+:(\\d+) - \"([A-Z]+) \\S+ HTTP/([\\d.]+)\" (\\d{3})', ['level', 'port', 'method', 'version', 'code']) AS f FROM l) SELECT f['method'] || ' ' || f['code'] AS message, CASE f['level'] WHEN 'DEBUG' THEN 'debug' WHEN 'WARNING' THEN 'warn' WHEN 'WARN' THEN 'warn' WHEN 'ERROR' THEN 'error' WHEN 'CRITICAL' THEN 'critical' WHEN 'FATAL' THEN 'critical' ELSE 'info' END AS status, f['version'] AS version, count(*) AS n, sum(f['port']::BIGINT)::BIGINT AS ports FROM x WHERE f['port'] <> '' AND f['port']::BIGINT > 40000 GROUP BY ALL")
_q("log_requests", lambda s, d: log_pipeline.requests(table(s, d, "log_lines")).where("method is not null").drop("n_lines"), """
    WITH l AS (SELECT DISTINCT ON (file_name, line_no) file_name, line_no, regexp_extract(line, '^\\[([0-9a-fA-F][0-9a-fA-F-]{7,})\\] ?(.*)$', ['id', 'm']) AS q FROM log_lines WHERE source = 'rails'),
    x AS (SELECT file_name, line_no, q['id'] AS id, q['m'] AS m FROM l WHERE q['id'] <> ''),
    g AS (SELECT file_name, id, min(line_no) AS first_line, min_by(m, line_no) FILTER (m LIKE 'Started %') AS st, min_by(m, line_no) FILTER (m LIKE 'Processing by %#%') AS pr, min_by(m, line_no) FILTER (regexp_matches(m, '^Completed \\d{3}\\b')) AS co, min_by(m, line_no) FILTER (regexp_matches(m, '^[A-Z]\\w*(::[A-Z]\\w*)* \\(.*\\):\\s*$')) AS ex FROM x GROUP BY ALL)
    SELECT file_name, first_line, regexp_extract(st, '^Started ([A-Z]+)', 1) AS method, nullif(regexp_extract(st, '"([^"?]*)', 1), '') AS path, nullif(regexp_extract(st, '"[^"?]*\\?([^"]*)"', 1), '') AS query, nullif(regexp_extract(pr, 'by ([\\w:]+)#', 1), '') AS controller, nullif(regexp_extract(pr, '#(\\w+)', 1), '') AS action,
        regexp_extract(co, '^Completed (\\d{3})', 1)::INT AS status_code, TRY_CAST(regexp_extract(co, ' in (\\d+(?:\\.\\d+)?)ms', 1) AS DOUBLE) AS duration_ms, nullif(regexp_extract(ex, '^([\\w:]+) ', 1), '') AS exception, co IS NOT NULL AS complete,
        CASE WHEN ex IS NOT NULL THEN 'error' WHEN co IS NULL THEN 'warn' WHEN regexp_extract(co, '^Completed (\\d{3})', 1)::INT >= 500 THEN 'error' WHEN regexp_extract(co, '^Completed (\\d{3})', 1)::INT >= 400 THEN 'warn' ELSE 'info' END AS level FROM g WHERE st IS NOT NULL""")

# monitors

MON = 'avg(last_4h):sum:app.event.count{*} by {type}.rollup(sum, 3600) > 1.5'


def _ticks(s: SparkSession, d: str, agg: str = "avg") -> DataFrame:
    m = monitors.parse_query(MON)
    p = engine(s, d).query(m.node, FROM, TO, 3600).lines
    return monitors.reduce_windows(p, agg, m.window, 3600)


_HOURS = f"""h AS (SELECT type, ts_s AS b, count(*)::DOUBLE AS v FROM e GROUP BY ALL), g AS (SELECT x.type, x.b, h.v FROM (SELECT DISTINCT type, unnest(range({FROM}, {TO}, 3600)) AS b FROM h) x LEFT JOIN h USING (type, b))"""
for _a, _e in (("avg", "avg(v) OVER w"), ("sum", "sum(v) OVER w"), ("min", "min(v) OVER w"), ("max", "max(v) OVER w"), ("last", "last_value(v IGNORE NULLS) OVER w"), ("pct_nonnull", "count(v) OVER w * 100.0 / 4")):
    _q(f"monitor_reduce_{_a}", lambda s, d, a=_a: _ticks(s, d, a).withColumn("value", F.round("value", 6)), f"WITH {EVENTS}, {_HOURS} SELECT 'type:' || type AS scope, b + 3600 AS tick, round({_e}, 6) AS value FROM g WINDOW w AS (PARTITION BY type ORDER BY b ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER (PARTITION BY type ORDER BY b) >= 4")


def monitor_log_count(s: SparkSession, d: str) -> DataFrame:
    q = monitors.parse_query('logs("status:error").rollup("count").by("service").last("1h") >= 2')
    h = logs.histogram(adapters.event_logs(s, d), q.text, FROM * 1000, TO * 1000, 3_600_000, q.by)
    return monitors.log_counts(h, FROM, TO + 1, 3600)


_q("monitor_log_count", monitor_log_count, f"WITH l AS (SELECT 'svc-' || (user_id % 4) AS scope, epoch_us(ts) // 1000000 // 3600 * 3600 AS b FROM events WHERE event_type = 'error'), c AS (SELECT scope, b, count(*)::DOUBLE AS v FROM l GROUP BY ALL) SELECT x.scope, x.b, coalesce(c.v, 0) AS v FROM (SELECT DISTINCT scope, unnest(range({FROM}, {TO + 1}, 3600)) AS b FROM c) x LEFT JOIN c USING (scope, b)")
_T = monitors.Thresholds(">", 2.0, 1.5, 1.25, 1.25)


def _machine(min_failures: int, no_data: int, renotify: int) -> str:
    """The state machine of the thresholds above, one tick after the other."""
    return f"""k AS (SELECT 'type:' || type AS scope, b + 3600 AS tick, avg(v) OVER w AS v FROM g WINDOW w AS (PARTITION BY type ORDER BY b ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER (PARTITION BY type ORDER BY b) >= 4),
    n AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY tick) AS i FROM k),
    m AS (SELECT scope, 0::BIGINT AS i, NULL::BIGINT AS tick, NULL::DOUBLE AS v, 'OK' AS status, 0::BIGINT AS breaches, 0::BIGINT AS data, 0::BIGINT AS told, FALSE AS seen, '' AS event FROM (SELECT DISTINCT scope FROM n)
      UNION ALL
      SELECT scope, i, tick, v, nxt, CASE WHEN v IS NULL AND nxt = 'NO_DATA' THEN 0 ELSE br END, CASE WHEN v IS NULL THEN data ELSE tick END,
        CASE WHEN seen AND (nxt <> status OR again) THEN tick ELSE told END, seen,
        CASE WHEN NOT seen THEN '' WHEN nxt <> status THEN CASE nxt WHEN 'ALERT' THEN 'alert' WHEN 'WARN' THEN 'warn' WHEN 'OK' THEN 'recovery' ELSE 'no_data' END WHEN again THEN 'renotify' ELSE '' END
      FROM (SELECT *, {renotify} > 0 AND nxt IN ('ALERT', 'NO_DATA') AND tick - told >= {renotify} AS again FROM
        (SELECT *, CASE WHEN v IS NULL THEN CASE WHEN {no_data} > 0 AND data > 0 AND tick - data >= {no_data} THEN 'NO_DATA' ELSE status END
            WHEN br >= {min_failures} OR (status = 'ALERT' AND v > 1.25) THEN 'ALERT' WHEN v > 1.5 OR (status IN ('WARN', 'ALERT') AND v > 1.25) THEN 'WARN' ELSE 'OK' END AS nxt FROM
          (SELECT n.scope, n.i, n.tick, n.v, m.status, m.data, m.told, m.seen OR n.v IS NOT NULL AS seen, CASE WHEN n.v IS NULL THEN m.breaches WHEN n.v > 2 THEN m.breaches + 1 ELSE 0 END AS br FROM m JOIN n ON n.scope = m.scope AND n.i = m.i + 1))))"""


_q("monitor_replay", lambda s, d: monitors.replay(_ticks(s, d), _T, monitors.Options(min_failures=2, no_data_s=4 * 3600, renotify_s=6 * 3600)).withColumn("value", F.round("value", 6)), f"WITH RECURSIVE {EVENTS}, {_HOURS}, {_machine(2, 14400, 21600)} SELECT scope, tick, round(v, 6) AS value, CASE WHEN seen THEN status END AS status, event FROM m WHERE i > 0")
_q("monitor_events", lambda s, d: monitors.list_events(monitors.replay(_ticks(s, d), _T, monitors.Options(min_failures=2, no_data_s=4 * 3600, renotify_s=6 * 3600)), FROM, TO, ("alert", "recovery", "warn"), limit=100).withColumn("value", F.round("value", 6)), f"WITH RECURSIVE {EVENTS}, {_HOURS}, {_machine(2, 14400, 21600)} SELECT tick, scope, event, status, round(v, 6) AS value FROM m WHERE event IN ('alert', 'recovery', 'warn') AND tick BETWEEN {FROM} AND {TO - 1} ORDER BY tick DESC, scope LIMIT 100")
_q("monitor_timeline", lambda s, d: monitors.timeline(monitors.replay(_ticks(s, d), _T)), f"WITH RECURSIVE {EVENTS}, {_HOURS}, {_machine(1, 0, 0)}, r AS (SELECT scope, tick, status, lag(status) OVER (PARTITION BY scope ORDER BY tick) AS p FROM m WHERE i > 0 AND seen) SELECT scope, status, tick AS since, lead(tick) OVER (PARTITION BY scope ORDER BY tick) AS until FROM r WHERE status IS DISTINCT FROM p")
_q("monitor_list", lambda s, d: monitors.list_monitors(table(s, d, "monitors"), table(s, d, "monitor_states")), "WITH s AS (SELECT monitor_id, max(CASE status WHEN 'ALERT' THEN 3 WHEN 'WARN' THEN 2 WHEN 'NO_DATA' THEN 1 ELSE 0 END) AS w, count(*) AS g, count(*) FILTER (status = 'ALERT') AS a FROM (SELECT DISTINCT ON (monitor_id, group_key) * FROM monitor_states) GROUP BY monitor_id) SELECT id, name, ['OK', 'NO_DATA', 'WARN', 'ALERT'][coalesce(w, 0) + 1] AS status, coalesce(g, 0) AS groups, coalesce(a, 0) AS alerting FROM monitors LEFT JOIN s ON id = monitor_id")

# dashboards


def dashboard_batch(s: SparkSession, d: str) -> DataFrame:
    """Six queries of one window that share their selection."""
    e = engine(s, d)
    got = e.batch({f"q{i}": f"{a}:app.event.count{{*}} by {{{b}}}" for i, (a, b) in enumerate((x, y) for x in ("sum", "avg", "max") for y in ("shard", "type"))}, FROM, TO, interval=DAY)
    out = None
    for name, r in got.items():
        x = r.points().select(F.lit(name).alias("query"), "scope", "ts_ms", F.round("value", 6).alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


def dashboard_separate(s: SparkSession, d: str) -> DataFrame:
    """The same six queries, each with an engine and a selection of its own."""
    out = None
    for i, (a, b) in enumerate((x, y) for x in ("sum", "avg", "max") for y in ("shard", "type")):
        x = engine(s, d).query(f"{a}:app.event.count{{*}} by {{{b}}}", FROM, TO, DAY).points().select(F.lit(f"q{i}").alias("query"), "scope", "ts_ms", F.round("value", 6).alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


_parts = []
for _i, (_a, _b) in enumerate((x, y) for x in ("sum", "avg", "max") for y in ("shard", "type")):
    _parts.append(f"SELECT 'q{_i}' AS query, x.scope, x.b * 1000 AS ts_ms, round(y.v, 6) AS value FROM (SELECT DISTINCT '{_b}:' || {_b} AS scope, unnest(range({FROM}, {FROM + 30 * DAY}, {DAY})) AS b FROM t) x LEFT JOIN (SELECT '{_b}:' || {_b} AS scope, b, {_a}(v) AS v FROM t GROUP BY ALL) y USING (scope, b)")
_q("dashboard_batch", dashboard_batch, f"WITH {EVENTS}, s AS ({SAMPLES['count']}), t AS (SELECT type, shard, tier, ts_s // {DAY} * {DAY} AS b, sum(value) AS v FROM s GROUP BY ALL) " + " UNION ALL ".join(_parts))
_q("dashboard_separate", dashboard_separate, SQL["dashboard_batch"])
_q("dashboard_toplist", lambda s, d: dashboards.toplist(engine(s, d).query("sum:app.event.count{*} by {shard}", FROM, TO, DAY).lines, "max", 4), f"WITH {EVENTS}, s AS ({SAMPLES['count']}), g AS (SELECT 'shard:' || shard AS scope, ts_s // {DAY} AS b, sum(value) AS v FROM s GROUP BY ALL) SELECT scope, max(v) AS value FROM g GROUP BY scope ORDER BY value DESC, scope LIMIT 4")
BANDS = [0.0, 10.0, 50.0, 100.0, 500.0]
_q("dashboard_heatmap", lambda s, d: dashboards.heatmap(engine(s, d).distribution("dist:app.event.dist{*}", FROM, TO, DAY), BANDS), f"""WITH {EVENTS}, {_BINS}, x AS (SELECT b, CASE WHEN sg > 0 THEN pow({_G}, ix - 1) WHEN sg < 0 THEN -pow({_G}, ix) ELSE 0 END AS lo, CASE WHEN sg > 0 THEN pow({_G}, ix) WHEN sg < 0 THEN -pow({_G}, ix - 1) ELSE 0 END AS hi, sum(c) AS c FROM bins GROUP BY ALL),
    edge AS (SELECT unnest({BANDS}::DOUBLE[]) AS band, unnest({[-1e300, *BANDS[1:]]}::DOUBLE[]) AS low, unnest({[*BANDS[1:], 1e300]}::DOUBLE[]) AS high),
    p AS (SELECT b, band, c * CASE WHEN hi > lo THEN greatest(0, (least(hi, high) - greatest(lo, low)) / (hi - lo)) ELSE (lo >= low AND lo < high)::INT END AS n FROM x, edge)
    SELECT '*' AS scope, b, band, round(sum(n), 6) AS count FROM p WHERE n > 0 GROUP BY ALL""")
_q("dashboard_align", lambda s, d: dashboards.align(engine(s, d).query("sum:app.event.count{*} by {type}", FROM, TO, DAY).lines, [f"type:{t}" for t in ("click", "error", "purchase", "signup", "view")]), f"WITH {EVENTS} SELECT x.b * 1000 AS ts_ms, " + ", ".join(f"CASE WHEN count(*) FILTER (type = '{t}') > 0 THEN count(*) FILTER (type = '{t}')::DOUBLE END AS \"type:{t}\"" for t in ("click", "error", "purchase", "signup", "view")) + f" FROM (SELECT unnest(range({FROM}, {FROM + 30 * DAY}, {DAY})) AS b) x LEFT JOIN e ON e.ts_s // {DAY} * {DAY} = x.b GROUP BY x.b")

# stores: rows written, read again by day and asked


def store_metrics(s: SparkSession, d: str) -> DataFrame:
    """A metric query over a store written in two batches, with promoted columns beside the tags."""
    path = scratch(s, "store")
    x = adapters.metric_samples(s, d).withColumn("tags", F.concat("tags", F.array(F.struct(F.lit("env").alias("key"), F.when(F.col("ts_s") % 7200 == 0, "dev").otherwise("prod").alias("value"))))).withColumn("series_key", model.series_key(F.col("metric"), F.col("tags")))
    stores.append_metrics(x.where("ts_s % 14400 < 7200"), path, "1")
    stores.append_metrics(x.where("ts_s % 14400 >= 7200"), path, "2")
    back = stores.read(s, path, FROM * 1000, TO * 1000)
    return Engine(s, back, adapters.KINDS).query("sum:app.event.count{env IN (dev)} by {type}", FROM, TO, DAY).points().select("scope", "ts_ms", "value")


_q("store_metrics", store_metrics, f"WITH {EVENTS}, s AS ({SAMPLES['count']}), g AS (SELECT 'type:' || type AS scope, ts_s // {DAY} * {DAY} AS b, sum(value) AS v FROM s WHERE ts_s % 7200 = 0 AND ts_s BETWEEN {FROM} AND {FROM + 30 * DAY - 1} GROUP BY ALL) SELECT x.scope, x.b * 1000 AS ts_ms, g.v AS value FROM (SELECT DISTINCT scope, unnest(range({FROM}, {FROM + 30 * DAY}, {DAY})) AS b FROM g) x LEFT JOIN g USING (scope, b)")


def store_sketches(s: SparkSession, d: str) -> DataFrame:
    """Sketches written, read again and merged per day."""
    path = scratch(s, "store")
    stores.append_sketches(*adapters.sketches(s, d), path, "1")
    bins, points = stores.read_sketches(s, path)
    day = (F.col("ts_s") - F.pmod(F.col("ts_s"), F.lit(DAY))).alias("b")
    n = points.groupBy(day).agg(F.sum("count").cast("bigint").alias("points"))
    return bins.groupBy(day, "sign", "idx").agg(F.sum("count").cast("bigint").alias("n")).join(n, "b")


_q("store_sketches", store_sketches, f"WITH {EVENTS}, {_BINS}, p AS (SELECT ts_s // {DAY} * {DAY} AS b, count(value) AS points FROM e GROUP BY ALL) SELECT b, sg AS sign, ix AS idx, sum(c)::BIGINT AS n, any_value(points) AS points FROM bins JOIN p USING (b) GROUP BY ALL")


def store_logs(s: SparkSession, d: str) -> DataFrame:
    """Logs written in two batches, compacted, read by day and searched."""
    path = scratch(s, "store")
    x = adapters.event_logs(s, d)
    stores.append_logs(x.where("seq % 2 = 0"), path, "1")
    stores.append_logs(x.where("seq % 2 = 1"), path, "2")
    stores.compact(s, path, f"{path}-compact", ["service", "ts"])
    return logs.histogram(stores.read(s, f"{path}-compact", FROM * 1000, TO * 1000), "status:error", FROM * 1000, TO * 1000, DAY * 1000, "service")


_q("store_logs", store_logs, f"SELECT epoch_us(ts) // 1000 // {DAY * 1000} * {DAY * 1000} AS bucket, 'svc-' || (user_id % 4) AS grp, count(*) AS n FROM events WHERE event_type = 'error' AND epoch_us(ts) // 1000 BETWEEN {FROM * 1000} AND {TO * 1000} GROUP BY ALL")

QUERIES = Q
