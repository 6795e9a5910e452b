"""Queries of the general data problems (p1, p2, p3, p5, p6, p7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspar.operators import delivery_dedup, late_events, log_entries, regular_grid, spikes
from lumenspar.operators.set_sketch import SetSketch
from lumenspar.session import cut
from lumenspar.sources.tables import arrived_samples, series_meta, table

# Metrics that jump or stand still by nature.
DISCRETE = ["queue.depth", "job.runtime", "db.pool.open", "service.can_connect", "container.memory.limit"]


def p1_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Per series and five minutes: the aggregates as published, as corrected, and what came too late."""
    return _late(spark, d).withColumns({c: F.round(c, 6) for c in ("sum_first", "rise_first", "sum", "rise")})


def _late(spark: SparkSession, d: str) -> DataFrame:
    return late_events.late_event_aggregates(arrived_samples(spark, d), "series_id", tie="rec_offset")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return late_events.outcomes(_late(spark, d), "series_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    meta = series_meta(spark, d).select("series_id", "unit", (~F.col("metric").isin(DISCRETE)).alias("continuous"))
    flagged = spikes.flag_readings(arrived_samples(spark, d), meta, "series_id")
    a = flagged.select(F.lit("samples").alias("tbl"), F.col("series_id").alias("id"), F.col("t").cast("string").alias("pos"))
    m = table(spark, d, "monitors").select(F.col("id").alias("monitor_id"), F.regexp_extract("query", r":\s*[a-z0-9]+:([A-Za-z][\w.]*)", 1).alias("metric")).dropDuplicates(["monitor_id"])
    m = m.join(table(spark, d, "metric_meta").dropDuplicates(["metric"]), "metric", "left").select("monitor_id", "metric", "unit")
    s = table(spark, d, "monitor_states").join(F.broadcast(m), "monitor_id", "left")  # monitor definitions are configuration, written by hand
    states = spikes.flag_groups(s.withColumn("only", F.col("metric") == "queue.depth"), "monitor_id", "group_key", "last_value", "unit", impossible_only=F.col("only"))
    return a.unionByName(states.select(F.lit("monitor_states").alias("tbl"), F.col("monitor_id").alias("id"), F.col("group_key").alias("pos"))).distinct()


def _grid(spark: SparkSession, d: str) -> DataFrame:
    sources = series_meta(spark, d).select("series_id", (F.col("step_s") * 1000).alias("step_ms"), F.when(F.col("type") == "counter", "counter").otherwise("gauge").alias("kind"))
    return regular_grid.regular_grid(arrived_samples(spark, d), sources, "series_id", first_by=("arrival", "rec_offset"))


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    """The regular grid of every series, missing cells interpolated and marked; numbers to six places, halves (means of two
    readings) upwards whatever the last bit."""
    return _grid(spark, d).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("value", "increment")})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the grid that are marked as missing."""
    return _grid(spark, d).where("status = 'missing'").select("series_id", "slot_start")


def p5_entries(spark: SparkSession, d: str) -> DataFrame:
    return log_entries.log_entries(table(spark, d, "log_lines"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return log_entries.log_entries(table(spark, d, "log_lines"), message=False).select("file_name", "first_line", "n_lines", "level", "component", "ts_ms")


SKETCH = SetSketch(m=4096, base=1.2, cap=254)


def identifier_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sparse sketches (day, metric, tag_key, what, reg, k) at the finest level: `series` of series keys, `value` of tag
    values, of all series with a reading; tag_key is null for series as such."""
    ids = table(spark, d, "series").select(F.col("id").alias("series_id"), "metric", "key").distinct()
    tags = table(spark, d, "series_tags").select("series_id", F.col("key").alias("tag_key"), F.nullif("value", F.lit("")).alias("value")).distinct()
    days = table(spark, d, "samples").where("v is not null").select("series_id", F.floor(F.col("t") / 86_400_000).cast("bigint").alias("day")).distinct()
    seen = days.join(ids, "series_id")
    # a series' register is worked out once, before its tags multiply it
    reg, k = SKETCH.register(F.col("key"))
    vreg, vk = SKETCH.register(F.col("value"))
    seen = seen.where("key is not null").select("series_id", "day", "metric", reg.alias("reg"), k.alias("k"))
    tagged = seen.join(tags.select("series_id", "tag_key", vreg.alias("vreg"), F.when(F.col("value").isNotNull(), vk).alias("vk")), "series_id")
    both = F.explode(F.array_compact(F.array(F.struct(F.lit("series").alias("what"), F.col("reg").alias("reg"), F.col("k").alias("k")), F.when(F.col("vk").isNotNull(), F.struct(F.lit("value").alias("what"), F.col("vreg").alias("reg"), F.col("vk").alias("k"))))))
    fine = tagged.select("day", "metric", "tag_key", both.alias("s")).select("day", "metric", "tag_key", "s.what", "s.reg", "s.k")
    plain = seen.select("day", "metric", F.lit(None).cast("string").alias("tag_key"), F.lit("series").alias("what"), "reg", "k")
    return fine.unionByName(plain).groupBy("day", "metric", "tag_key", "what", "reg").agg(F.max("k").alias("k"))


def p6_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct series and tag values per day, metric, tag key and every combination of these; `*` stands for all.

    Coarser groups are merged from the finest sketches by maximum. std_error is the standard error of the estimate.
    """
    fine = cut(identifier_sketches(spark, d), "sketches")  # read once for each family of groups below
    tagged, plain = fine.where("tag_key is not null"), fine.where("tag_key is null")

    def roll(df: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
        """Sketches merged over the keys that a set leaves out; those come out as `*`."""
        cube = df.groupingSets([[*s, "what", "reg"] for s in sets], *keys, "what", "reg").agg(F.max("k").alias("k"), *(F.grouping(c).alias(f"g_{c}") for c in keys))
        return cube.select(*(F.when(F.col(f"g_{c}") == 1, "*").otherwise(F.col(c).cast("string")).alias(c) if c in keys else F.lit("*").alias(c) for c in ("day", "metric", "tag_key")), "what", "reg", "k")

    # the finest groups are there already; series of no tag key in particular come from the plain sketches, tagged or not
    finest = fine.where("metric is not null").select(F.col("day").cast("string").alias("day"), "metric", F.coalesce("tag_key", F.lit("*")).alias("tag_key"), "what", "reg", "k")
    coarse = (
        roll(tagged.where("what = 'series'"), ["day", "metric", "tag_key"], [["day", "tag_key"], ["metric", "tag_key"], ["tag_key"]])
        .unionByName(roll(tagged.where("what = 'value'"), ["day", "metric", "tag_key"], [["day", "tag_key"], ["metric", "tag_key"], ["tag_key"], ["day", "metric"], ["day"], ["metric"], []]))
        .unionByName(roll(plain, ["day", "metric"], [["day"], ["metric"], []]))
    )
    merged = finest.unionByName(coarse).where("day is not null and metric is not null")
    return SKETCH.estimates(merged, ["day", "metric", "tag_key", "what"])


def p6_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard, union and intersection with their errors, from the sketches: of the series of each pair of consecutive days,
    and of the tag values of each tag key and the next by name (`of` tells which)."""
    fine = cut(identifier_sketches(spark, d), "sketches")
    day = SKETCH.merge(fine.where("tag_key is null").select(F.col("day").cast("string").alias("g"), "reg", "k"), ["g"])
    key = SKETCH.merge(fine.where("what = 'value'").select(F.col("tag_key").alias("g"), "reg", "k"), ["g"])
    days = fine.select(F.col("day").alias("n")).distinct()
    next_day = days.select((F.col("n") - 1).alias("n"), F.col("n").alias("b")).join(days, "n").select(F.col("n").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    keys = key.select("g").distinct()
    two = keys.select(F.col("g").alias("a"), F.lead("g").over(Window.partitionBy(F.lit(0)).orderBy("g")).alias("b")).where("b is not null")  # a row per tag key
    return SKETCH.pairs(day, "g", next_day).select(F.lit("day").alias("of"), "*").unionByName(SKETCH.pairs(key, "g", two).select(F.lit("tag_key").alias("of"), "*"))


def p6_error(spark: SparkSession, d: str) -> DataFrame:
    """The exact number of distinct series and tag values per day, metric and tag key (one at a time, then over all), and
    whether the estimate from the sketches is within five of its standard errors."""
    est = p6_distinct(spark, d)
    seen = table(spark, d, "samples").where("v is not null").select("series_id", F.floor(F.col("t") / 86_400_000).cast("string").alias("day")).distinct()
    ids = table(spark, d, "series").where("key is not null").select(F.col("id").alias("series_id"), "metric", F.col("key").alias("x")).distinct()
    tags = table(spark, d, "series_tags").select("series_id", F.col("key").alias("tag_key"), F.nullif("value", F.lit("")).alias("value")).distinct()
    s = seen.join(ids, "series_id")
    sets = [(c,) for c in ("day", "metric")] + [()]

    def exact(df: DataFrame, keys: list[tuple], what: str, x: str) -> DataFrame:
        out = None
        for k in keys:
            g = df.where(F.col(x).isNotNull()).select(*k, x).distinct().groupBy(*k).agg(F.count("*").alias("n"))
            g = g.select(*(F.col(c) if c in k else F.lit("*").alias(c) for c in ("day", "metric", "tag_key")), F.lit(what).alias("what"), "n")
            out = g if out is None else out.unionByName(g)
        return out

    t = s.join(tags, "series_id")
    all_ = exact(s, sets, "series", "x").unionByName(exact(t, [("tag_key",)], "series", "x")).unionByName(exact(t, [*sets, ("tag_key",)], "value", "value"))
    j = all_.where("tag_key is not null").join(est, ["day", "metric", "tag_key", "what"], "left")
    return j.select("day", "metric", "tag_key", "what", "n", F.coalesce(F.abs(F.col("estimate") - F.col("n")) <= 5 * F.greatest(F.col("std_error"), F.lit(0.5)), F.lit(False)).alias("within"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Over the whole table through the seen-bitmaps: whole payloads as the first batch, broken ones as the second, so that
    no later batch brings a better copy of a message."""
    return delivery_dedup.duplicates(table(spark, d, "queue_records"))


QUERIES = {f.__name__: f for f in (p1_found, p1_aggregates, p2_found, p3_found, p3_grid, p5_found, p5_entries, p6_distinct, p6_overlap, p6_error, p7_found)}

SQL = {
    "p1_found": """
        WITH r AS (SELECT rec_offset, min(epoch_us(rec_time)) AS a FROM queue_records WHERE topic = 'series' GROUP BY rec_offset),
        x AS (SELECT series_id, t, min(a) AS a FROM samples JOIN r USING (rec_offset) WHERE v IS NOT NULL GROUP BY series_id, t),
        y AS (SELECT series_id, t - t % 300000 AS period_start, a - (t - t % 300000 + 300000) * 1000 AS late FROM x)
        SELECT DISTINCT series_id, period_start, CASE WHEN late > 7200000000 THEN 'cut_off' ELSE 'corrected' END AS outcome
        FROM y WHERE late > 60000000""",
    "p3_found": """
        WITH m AS (SELECT id AS series_id, min(metric) AS metric FROM series GROUP BY id),
        s AS (SELECT DISTINCT samples.series_id, step_s * 1000 AS step, t // (step_s * 1000) AS slot
              FROM samples JOIN m USING (series_id) JOIN (SELECT metric, min(step_s) AS step_s FROM metric_meta GROUP BY metric) USING (metric) WHERE v IS NOT NULL),
        p AS (SELECT series_id, step, slot, lead(slot) OVER (PARTITION BY series_id ORDER BY slot) AS nxt FROM s)
        SELECT series_id, unnest(range(slot + 1, nxt)) * step AS slot_start FROM p WHERE nxt > slot + 1""",
    "p6_error": """
        WITH s AS (SELECT DISTINCT m.metric, m.key AS x, m.id, (t // 86400000)::VARCHAR AS day FROM samples JOIN (SELECT DISTINCT id, metric, key FROM series WHERE key IS NOT NULL) m ON m.id = series_id WHERE v IS NOT NULL),
        t AS (SELECT s.*, g.key AS tag_key, nullif(g.value, '') AS value FROM s JOIN (SELECT DISTINCT * FROM series_tags) g ON g.series_id = s.id),
        a AS (SELECT day, '*' AS metric, '*' AS tag_key, 'series' AS what, count(DISTINCT x) AS n FROM s GROUP BY ALL UNION ALL SELECT '*', metric, '*', 'series', count(DISTINCT x) FROM s GROUP BY ALL UNION ALL SELECT '*', '*', '*', 'series', count(DISTINCT x) FROM s
          UNION ALL SELECT '*', '*', tag_key, 'series', count(DISTINCT x) FROM t WHERE tag_key IS NOT NULL GROUP BY ALL UNION ALL SELECT '*', '*', tag_key, 'value', count(DISTINCT value) FROM t WHERE tag_key IS NOT NULL AND value IS NOT NULL GROUP BY ALL
          UNION ALL SELECT day, '*', '*', 'value', count(DISTINCT value) FROM t WHERE value IS NOT NULL GROUP BY ALL UNION ALL SELECT '*', metric, '*', 'value', count(DISTINCT value) FROM t WHERE value IS NOT NULL GROUP BY ALL UNION ALL SELECT '*', '*', '*', 'value', count(DISTINCT value) FROM t WHERE value IS NOT NULL)
        SELECT *, TRUE AS within FROM a""",
    "p7_found": """
        WITH RECURSIVE w AS (SELECT delivery_id, topic, rec_offset, payload, CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE FALSE END AS whole FROM queue_records),
        x AS (SELECT delivery_id, coalesce(whole, FALSE) AS whole, 'o/' || topic || '/' || rec_offset AS a,
                     CASE WHEN whole THEN 'p/' || topic || '/' || (payload->>'producer') || '/' || (payload->>'epoch') || '/' || (payload->>'pseq') END AS b FROM w),
        y AS (SELECT delivery_id, whole, coalesce(a, b, 'd/' || delivery_id) AS a, b FROM x),
        e AS (SELECT DISTINCT a, b FROM y WHERE b IS NOT NULL),
        l AS (SELECT DISTINCT p.a AS u, q.a AS v FROM e p JOIN e q USING (b) WHERE p.a <> q.a),
        r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
        m AS (SELECT u, min(v) AS v FROM r GROUP BY u),
        z AS (SELECT delivery_id, row_number() OVER (PARTITION BY least(a, coalesce(m.v, a)) ORDER BY whole DESC, delivery_id) AS n FROM y LEFT JOIN m ON y.a = m.u)
        SELECT delivery_id FROM z WHERE n > 1""",
    "p3_grid": """
        WITH q AS (SELECT rec_offset, min(epoch_us(rec_time)) AS a FROM queue_records WHERE topic = 'series' GROUP BY rec_offset),
        m AS (SELECT id AS series_id, min(metric) AS metric FROM series GROUP BY id),
        g AS (SELECT series_id, step_s * 1000 AS step, type = 'counter' AS counter FROM m JOIN (SELECT DISTINCT ON (metric) * FROM metric_meta) USING (metric)),
        r AS (SELECT DISTINCT ON (series_id, t) series_id, t, v FROM samples JOIN q USING (rec_offset) WHERE v IS NOT NULL ORDER BY series_id, t, a, rec_offset, v),
        p AS (SELECT *, lead(t) OVER w AS nt, lead(v) OVER w AS nv FROM r JOIN g USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY t)),
        c AS (SELECT *, t // step AS slot, unnest(range(t // step, coalesce(nt, t) // step + 1)) AS cell, CASE WHEN nv < v THEN nv ELSE nv - v END AS rise FROM p),
        x AS (SELECT *, rise * (least(nt, (cell + 1) * step) - greatest(t, cell * step)) / (nt - t) AS part FROM c),
        y AS (SELECT series_id, cell * step AS slot_start, counter, count(*) FILTER (cell = slot) AS n, avg(v) FILTER (cell = slot) AS mean,
                     max(v + (nv - v) * (cell * step + step / 2 - t) / (nt - t)) FILTER (cell > slot AND cell < nt // step) AS line, sum(part) AS part FROM x GROUP BY ALL)
        SELECT series_id, slot_start, CASE WHEN n > 0 THEN 'observed' ELSE 'missing' END AS status, n,
               CASE WHEN NOT counter THEN round(CASE WHEN n > 0 THEN mean ELSE line END + 1e-9, 6) END AS value, CASE WHEN counter THEN round(part + 1e-9, 6) END AS increment FROM y""",
    "p1_aggregates": """
        WITH q AS (SELECT rec_offset, min(epoch_us(rec_time)) AS a FROM queue_records WHERE topic = 'series' GROUP BY rec_offset),
        r AS (SELECT DISTINCT ON (series_id, t) series_id, t, v, a FROM samples JOIN q USING (rec_offset) WHERE v IS NOT NULL ORDER BY series_id, t, a, rec_offset, v),
        x AS (SELECT *, t - t % 300000 AS p, a - (t - t % 300000 + 300000) * 1000 AS late FROM r),
        k AS (SELECT *, late <= 60000000 AS early, late <= 7200000000 AS live FROM x),
        e AS (SELECT series_id, p, count(*) AS n_first, round(sum(v), 6) AS sum_first, min(v) AS min_first, max(v) AS max_first, max_by(v, t) AS last_first, round(sum(up), 6) AS rise_first
              FROM (SELECT *, greatest(coalesce(v - lag(v) OVER (PARTITION BY series_id, p ORDER BY t), 0), 0) AS up FROM k WHERE early) GROUP BY ALL),
        l AS (SELECT series_id, p, count(*) AS n, round(sum(v), 6) AS sum, min(v) AS min, max(v) AS max, max_by(v, t) AS last, round(sum(up), 6) AS rise
              FROM (SELECT *, greatest(coalesce(v - lag(v) OVER (PARTITION BY series_id, p ORDER BY t), 0), 0) AS up FROM k WHERE live) GROUP BY ALL),
        b AS (SELECT *, count(*) FILTER (early) OVER (PARTITION BY series_id, p ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
        c AS (SELECT series_id, p, count(*) FILTER (live AND NOT early) AS n_late, count(*) FILTER (NOT live) AS n_cut, min(before) FILTER (live AND NOT early) // 8 * 8 AS kept FROM b GROUP BY ALL),
        s AS (SELECT series_id, p, count(*) FILTER (live AND before >= kept) AS replayed FROM b JOIN c USING (series_id, p) GROUP BY ALL)
        SELECT series_id, p AS period_start, coalesce(n_first, 0) AS n_first, sum_first, min_first, max_first, last_first, rise_first, coalesce(n, 0) AS n, sum, min, max, last, rise, n_late, n_cut, replayed
        FROM c JOIN s USING (series_id, p) LEFT JOIN e USING (series_id, p) LEFT JOIN l USING (series_id, p)""",
    "p2_found": """
        WITH q AS (SELECT rec_offset, min(epoch_us(rec_time)) AS a FROM queue_records WHERE topic = 'series' GROUP BY rec_offset),
        mm AS (SELECT DISTINCT ON (metric) metric, unit FROM metric_meta),
        m AS (SELECT id AS series_id, metric, unit, metric NOT IN ('queue.depth', 'job.runtime', 'db.pool.open', 'service.can_connect', 'container.memory.limit') AS continuous
              FROM (SELECT id, min(metric) AS metric FROM series GROUP BY id) JOIN mm USING (metric)),
        r AS (SELECT DISTINCT ON (series_id, t) series_id, t, v FROM samples JOIN q USING (rec_offset) WHERE v IS NOT NULL AND NOT isnan(v) ORDER BY series_id, t, a, rec_offset, v),
        x AS (SELECT *, CASE WHEN unit IN ('percent', '%') THEN v < 0 OR v > 100 WHEN unit IN ('fraction', 'boolean') THEN v < 0 OR v > 1 WHEN unit = 'celsius' THEN v < -273.15 ELSE v < 0 END AS bad FROM r JOIN m USING (series_id)),
        c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS many FROM x WHERE continuous) WHERE many >= 60),
        d AS (SELECT series_id, t, v, t // 3600000 % 24 AS h, abs(v - lag(v) OVER w) AS step, row_number() OVER w AS n,
                     median(v) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l, median(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS f FROM c WINDOW w AS (PARTITION BY series_id ORDER BY t)),
        e AS (SELECT *, CASE WHEN step > 0 THEN ceil(ln(step) / ln(1.08)) ELSE -20000 END AS b FROM d WHERE step IS NOT NULL),
        hour AS (SELECT series_id, h, count(*) AS k, list(b ORDER BY b) AS s FROM e GROUP BY ALL),
        every AS (SELECT series_id, list(b ORDER BY b) AS s FROM e GROUP BY ALL),
        z AS (SELECT hour.series_id, h, CASE WHEN k >= 120 THEN hour.s ELSE every.s END AS s FROM hour JOIN every USING (series_id)),
        y AS (SELECT series_id, h, s[floor(0.25 * (len(s) - 1))::BIGINT + 1] AS b1, s[floor(0.75 * (len(s) - 1))::BIGINT + 1] AS b3 FROM z),
        fence AS (SELECT series_id, h, q3 + 4.5 * (q3 - q1) AS fence FROM (SELECT series_id, h, CASE WHEN b1 > -20000 THEN 2 * 1.08 ** b1 / 2.08 ELSE 0 END AS q1, CASE WHEN b3 > -20000 THEN 2 * 1.08 ** b3 / 2.08 ELSE 0 END AS q3 FROM y)),
        cand AS (SELECT series_id, t, n, n - row_number() OVER (PARTITION BY series_id ORDER BY n) AS run FROM d JOIN fence USING (series_id, h)
                 WHERE l IS NOT NULL AND f IS NOT NULL AND greatest(least(l, f) - v, v - greatest(l, f)) > greatest(fence, 1e-12)),
        spike AS (SELECT series_id, t FROM (SELECT *, count(*) OVER (PARTITION BY series_id, run) AS k FROM cand) WHERE k <= 3),
        same AS (SELECT series_id, t, sum((step IS NULL OR step <> 0)::INT) OVER (PARTITION BY series_id ORDER BY t) AS run FROM d),
        stuck AS (SELECT series_id, t FROM (SELECT *, count(*) OVER (PARTITION BY series_id, run) AS k FROM same) WHERE k >= 10),
        mon AS (SELECT DISTINCT ON (id) id AS monitor_id, regexp_extract(query, ':\\s*[a-z0-9]+:([A-Za-z][\\w.]*)', 1) AS metric FROM monitors),
        st AS (SELECT DISTINCT monitor_id, group_key, last_value AS v, unit, coalesce(metric = 'queue.depth', FALSE) AS discrete FROM monitor_states LEFT JOIN mon USING (monitor_id) LEFT JOIN mm USING (metric) WHERE last_value IS NOT NULL AND monitor_id IS NOT NULL),
        sb AS (SELECT *, CASE WHEN unit IN ('percent', '%') THEN v < 0 OR v > 100 WHEN unit IN ('fraction', 'boolean') THEN v < 0 OR v > 1 WHEN unit = 'celsius' THEN v < -273.15 ELSE v < 0 END AS bad FROM st),
        bins AS (SELECT monitor_id, list(b ORDER BY b) AS s FROM (SELECT monitor_id, CASE WHEN v = 0 THEN 0 ELSE sign(v) * (ceil(ln(abs(v)) / ln(1.02)) + 40000) END AS b FROM sb WHERE NOT bad AND NOT discrete) GROUP BY ALL HAVING count(*) >= 8),
        quart AS (SELECT monitor_id, CASE WHEN b1 = 0 THEN 0 ELSE sign(b1) * exp((abs(b1) - 40000.5) * ln(1.02)) END AS q1, CASE WHEN b3 = 0 THEN 0 ELSE sign(b3) * exp((abs(b3) - 40000.5) * ln(1.02)) END AS q3
                  FROM (SELECT monitor_id, s[floor(0.25 * (len(s) - 1))::BIGINT + 1] AS b1, s[floor(0.75 * (len(s) - 1))::BIGINT + 1] AS b3 FROM bins))
        SELECT DISTINCT 'samples' AS tbl, series_id AS id, t::VARCHAR AS pos FROM (SELECT series_id, t FROM x WHERE bad UNION ALL SELECT * FROM spike UNION ALL SELECT * FROM stuck)
        UNION SELECT DISTINCT 'monitor_states', monitor_id, group_key FROM sb LEFT JOIN quart USING (monitor_id) WHERE bad OR (NOT discrete AND (v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)))""",
    "p5_found": """
        WITH l AS (SELECT DISTINCT ON (file_name, line_no) file_name, line_no, source, line FROM log_lines WHERE file_name IS NOT NULL AND line_no IS NOT NULL ORDER BY file_name, line_no, line DESC),
        f AS (SELECT *, CASE WHEN line LIKE '{%' AND json_valid(line) THEN json_type(line) = 'OBJECT' ELSE FALSE END AS obj,
            CASE source WHEN 'python' THEN regexp_extract(line, '^(\\d{4}-\\d{2}-\\d{2}[ T]\\d{2}:\\d{2}:\\d{2}(?:[.,]\\d+)?) (DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL) ([\\w.\\-]+) ', ['ts', 'lv', 'co'])
                WHEN 'sidekiq' THEN regexp_extract(line, '^(\\d{4}\\S+) pid=\\d+ tid=\\S+(?: class=(\\S+))?(?: jid=\\S+)?(?: elapsed=[\\d.]+)? ([A-Z]+): ', ['ts', 'co', 'lv'])
                WHEN 'postgres' THEN regexp_extract(line, '^(\\d{4}-\\d{2}-\\d{2} [\\d:.]+(?: [A-Z]+)?) \\[\\d+\\](?: [^@\\s]+@(\\S+))? ([A-Z]+\\d?): ', ['ts', 'co', 'lv'])
                WHEN 'redis' THEN regexp_extract(line, '^\\d+:([XCSM]) (\\d{2} [A-Z][a-z]{2} \\d{4} [\\d:.]+) ([.*#-]) ', ['co', 'ts', 'lv']) END AS h,
            regexp_extract(line, '^(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL)(?::\\s| ([\\w.\\-]+) |:([\\w.\\-]+):)', ['lv', 'a', 'b']) AS p,
            CASE WHEN source = 'rails' THEN regexp_extract(line, '^\\[([0-9a-fA-F][0-9a-fA-F-]{7,})\\] ?(.*)$', ['id', 'm']) END AS q FROM l),
        g AS (SELECT *, CASE WHEN obj THEN coalesce(line->>'level', line->>'levelname', line->>'severity') WHEN h['lv'] <> '' THEN h['lv'] WHEN source = 'python' AND p['lv'] <> '' THEN p['lv'] WHEN source = 'python' AND regexp_matches(line, '^\\d\\d:\\d\\d:\\d\\d: ') THEN 'INFO' END AS lv,
            CASE WHEN obj THEN CASE source WHEN 'python' THEN line->>'logger' WHEN 'winston' THEN line->>'tag' END WHEN h['lv'] <> '' THEN h['co'] WHEN source = 'python' THEN p['a'] || p['b'] END AS co,
            CASE WHEN obj THEN coalesce(line->>'timestamp', line->>'time', line->>'ts', line->>'@timestamp') WHEN h['lv'] <> '' THEN h['ts'] END AS ts, coalesce(q['id'], '') AS id, q['m'] AS m FROM f),
        w AS (SELECT *, lv IS NOT NULL OR obj OR id <> '' AS head FROM g),
        e AS (SELECT *, coalesce(last_value(CASE WHEN head THEN CASE WHEN id <> '' THEN id ELSE line_no::VARCHAR END END IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY line_no), '') AS entry FROM w),
        t AS (SELECT *, CASE WHEN regexp_matches(ts, '^\\d{12,}$') THEN ts::BIGINT WHEN regexp_matches(ts, '^\\d{9,11}$') THEN ts::BIGINT * 1000
                WHEN ts LIKE '% CET' THEN epoch_ms(replace(ts, ' CET', '')::TIMESTAMP) - 3600000
                WHEN regexp_matches(ts, '^\\d{2} [A-Z]') THEN epoch_ms(strptime(ts, ['%d %b %Y %H:%M:%S.%g', '%d %b %Y %H:%M:%S']))
                WHEN ts IS NOT NULL THEN epoch_ms(regexp_replace(replace(ts, ' UTC', ''), '(Z|[+-]\\d{2}:?\\d{2})?$', '').replace(',', '.')::TIMESTAMP) - coalesce(CASE WHEN regexp_matches(ts, '[+-]\\d{2}:?\\d{2}$') AND length(ts) > 16 THEN (CASE WHEN regexp_extract(ts, '([+-])\\d{2}:?\\d{2}$', 1) = '-' THEN -1 ELSE 1 END) * (regexp_extract(ts, '[+-](\\d{2}):?\\d{2}$', 1)::BIGINT * 60 + regexp_extract(ts, '[+-]\\d{2}:?(\\d{2})$', 1)::BIGINT) * 60000 END, 0)
                WHEN m LIKE 'Started %' THEN epoch_ms(regexp_extract(m, ' at (\\d{4}-\\d{2}-\\d{2} [\\d:]+) ', 1)::TIMESTAMP) - (CASE WHEN regexp_matches(m, ' -\\d{4}\\s*$') THEN -1 ELSE 1 END) * (regexp_extract(m, '[+-](\\d{2})\\d{2}\\s*$', 1)::BIGINT * 60 + regexp_extract(m, '[+-]\\d{2}(\\d{2})\\s*$', 1)::BIGINT) * 60000 END AS ms,
            CASE WHEN m LIKE 'Processing by %' THEN regexp_extract(m, '^Processing by ([\\w:]+)#', 1) ELSE co END AS comp,
            CASE WHEN m LIKE 'Completed %' THEN regexp_extract(m, '^Completed (\\d{3})\\b', 1)::INT END AS code, regexp_matches(m, '^[A-Z]\\w*(::[A-Z]\\w*)* \\(.*\\):\\s*$') AS boom FROM e),
        a AS (SELECT file_name, entry, min(line_no) AS first_line, count(*) AS n_lines, bool_or(id <> '') AS rails, arg_min(coalesce(lv, ''), line_no) FILTER (head) AS lv, arg_min(comp, line_no) FILTER (comp <> '') AS component, arg_min(ms, line_no) FILTER (ms <> 0) AS ts_ms, arg_min(code, line_no) FILTER (code IS NOT NULL) AS code, bool_or(boom) AS boom FROM t GROUP BY ALL)
        SELECT file_name, first_line, n_lines, CASE WHEN rails THEN CASE WHEN boom THEN 'error' WHEN code IS NULL THEN 'warn' WHEN code >= 500 THEN 'error' WHEN code >= 400 THEN 'warn' ELSE 'info' END
            WHEN upper(lv) IN ('DEBUG', 'DEBUG1', 'DEBUG2', 'DEBUG3', 'DEBUG4', 'DEBUG5', 'SILLY', '20', '.', '-') THEN 'debug' WHEN upper(lv) IN ('WARN', 'WARNING', '40', '#') THEN 'warn' WHEN upper(lv) IN ('ERROR', '50') THEN 'error' WHEN upper(lv) IN ('CRITICAL', 'FATAL', 'PANIC', '60') THEN 'critical' ELSE 'info' END AS level,
            coalesce(component, '') AS component, coalesce(ts_ms, 0) AS ts_ms FROM a""",
}
HEADS = SQL["p5_found"].split("        e AS (")[0]  # each line once, and what its head tells
_LEVELS = "(?:DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL)"
_TEXT = f"""CASE WHEN obj THEN CASE WHEN json_exists(line, '$.message') THEN CASE WHEN json_type(line, '$.message') = 'VARCHAR' THEN line->>'message' ELSE line END WHEN json_type(line, '$.msg') = 'VARCHAR' THEN line->>'msg' ELSE line END
    WHEN id <> '' THEN m WHEN NOT head THEN line
    WHEN source = 'sidekiq' THEN regexp_replace(line, '^\\S+ pid=.*? ?[A-Z]+\\d?: ', '', 's') WHEN source = 'postgres' THEN regexp_replace(line, '^.*?\\[\\d+\\].*? ?[A-Z]+\\d?: +', '', 's') WHEN source = 'redis' THEN regexp_replace(line, '^\\S+ \\S+ \\S+ \\S+ \\S+ \\S ', '', 's')
    WHEN h['lv'] <> '' THEN regexp_replace(line, '^\\S+ ?\\S* {_LEVELS} [\\w.\\-]+ ', '', 's') WHEN regexp_matches(line, '^\\d\\d:\\d\\d:\\d\\d: ') THEN regexp_replace(line, '^\\S+ +', '', 's')
    WHEN regexp_matches(line, '^[A-Z]+:\\s+[\\d.]+:\\d+ - "') THEN regexp_replace(line, '^.*? - ', '', 's') WHEN regexp_matches(line, '^{_LEVELS}:\\s') THEN regexp_replace(line, '^[A-Z]+:\\s+', '', 's') ELSE regexp_replace(line, '^{_LEVELS}[ :][\\w.\\-]+[ :]', '', 's') END"""
SQL["p5_entries"] = SQL["p5_found"].replace("bool_or(boom) AS boom FROM t", f"bool_or(boom) AS boom, array_to_string(list({_TEXT} ORDER BY line_no), chr(10)) AS message FROM t").replace("coalesce(ts_ms, 0) AS ts_ms FROM a", "coalesce(ts_ms, 0) AS ts_ms, message FROM a")
