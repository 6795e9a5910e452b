"""OpenMetrics and Prometheus text pages, docker log frames and key-value reports as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits and line shapes of the exposition format.
MAX_BYTES, MAX_SAMPLES, MAX_LABELS = 16 << 20, 200_000, 64
_SAMPLE = re.compile(r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*?)\})?\s+(\S+)(?:\s+(-?[0-9.eE+]+))?(?:\s+#\s+\{.*)?\s*$")
_LABEL = re.compile(r'\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\\n]|\\.)*)"\s*(?:,|$)')
_META = re.compile(r"^#\s+(TYPE|HELP|UNIT)\s+(\S+)\s*(.*)$")
SUFFIXES = ("_bucket", "_sum", "_count", "_total", "_created", "_gcount", "_gsum", "_info")
SCHEMA = "page_id bigint, family string, type string, name string, labels map<string,string>, value double, ts double, error string"


def parse_page(text: str) -> list[tuple[str, str, str, dict[str, str], float, float | None]]:
    """(family, type, name, labels, value, ts) of a page; ValueError at the first fault, so a page counts as a whole."""
    if len(text.encode()) > MAX_BYTES:
        raise ValueError("the page is too large")
    types: dict[str, str] = {}
    out = []
    for no, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        if not line.strip():
            continue
        if line.startswith("#"):
            if line.strip() == "# EOF":
                break
            m = _META.match(line)
            if m and m[1] == "TYPE":
                if m[2] in types:
                    raise ValueError(f"line {no}: a second TYPE of {m[2]}")
                types[m[2]] = m[3].strip().lower() or "unknown"
            continue
        m = _SAMPLE.match(line)
        if not m:
            raise ValueError(f"line {no}: not a sample")
        labels: dict[str, str] = {}
        at, inner = 0, m[2] or ""
        while at < len(inner.rstrip().rstrip(",")):
            lm = _LABEL.match(inner, at)
            if not lm:
                raise ValueError(f"line {no}: bad labels")
            if lm[1] in labels:
                raise ValueError(f"line {no}: a second {lm[1]}")
            labels[lm[1]] = re.sub(r'\\(["\\n])', lambda x: "\n" if x[1] == "n" else x[1], lm[2])
            at = lm.end()
        if len(labels) > MAX_LABELS:
            raise ValueError(f"line {no}: too many labels")
        raw = m[3].lower().replace("+inf", "inf")
        try:
            value = float(raw)
        except ValueError:
            raise ValueError(f"line {no}: bad value") from None
        family = m[1] if m[1] in types else next((m[1][: -len(s)] for s in SUFFIXES if m[1].endswith(s) and m[1][: -len(s)] in types), m[1])
        out.append((family, types.get(family, "unknown"), m[1], labels, value, float(m[4]) if m[4] else None))
        if len(out) > MAX_SAMPLES:
            raise ValueError("too many samples")
    return out


def parse_pages(pages: DataFrame, page_id: str = "page_id", text: str = "text") -> DataFrame:
    """One row per sample; a page with a fault gives one row with the error and no sample."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in it:
            rows = []
            for i, x in zip(pdf.i, pdf.x, strict=True):
                try:
                    rows += [(i, *r[:3], r[3], r[4], r[5], None) for r in parse_page(x or "")]
                except ValueError as e:
                    rows.append((i, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=cols)

    return pages.select(F.col(page_id).cast("bigint").alias("i"), F.col(text).alias("x")).mapInPandas(run, SCHEMA)


def scrape_to_samples(samples: DataFrame, ts: str = "scraped_at", include: str = ".*", exclude: str = "", namespace: str = "", drop_labels: tuple[str, ...] = ()) -> DataFrame:
    """(metric, kind, labels, ts, value) of scraped samples in order of time: gauges as they are, counters as a per-second
    rate, histogram buckets, sums and counts as increases (a fall restarts from zero), quantiles of summaries as gauges.
    The label `host` becomes exported_host. First readings of cumulative series give nothing."""
    d = samples.where("error is null").where(F.col("family").rlike(include))
    if exclude:
        d = d.where(~F.col("family").rlike(exclude))
    lab = F.map_filter("labels", lambda k, v: ~k.isin(*drop_labels)) if drop_labels else F.col("labels")
    lab = F.transform_keys(lab, lambda k, v: F.when(k == "host", "exported_host").when(k == "le", "upper_bound").otherwise(k))
    d = d.withColumn("labels", lab).withColumn("key", F.concat("name", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))))
    w = Window.partitionBy("key").orderBy(ts)
    pv, dt = F.lag("value").over(w), F.col(ts) - F.lag(ts).over(w)
    up = F.when(pv.isNotNull() & (dt > 0), F.when(F.col("value") >= pv, F.col("value") - pv).otherwise(F.col("value")))
    cumulative = F.col("type").isin("counter", "histogram") | ((F.col("type") == "summary") & F.col("name").rlike("_(sum|count)$"))
    rate = F.when((F.col("type") == "counter") & (F.col("value") >= pv) & (dt > 0), (F.col("value") - pv) / dt)
    val = F.when(F.col("type") == "counter", rate).when(cumulative, up).otherwise(F.col("value"))
    name = F.regexp_replace(F.regexp_replace("name", "_(bucket|sum|count)$", ".$1"), "_total$", "")
    prefix = f"{namespace}." if namespace else ""
    return d.select(F.concat(F.lit(prefix), name).alias("metric"), F.when(F.col("type") == "counter", "gauge").when(cumulative, "count").otherwise("gauge").alias("kind"), "labels", F.col(ts).alias("ts"), val.alias("value")).where("value is not null and not isnan(value)")


def demux_docker(frames: DataFrame, content: str = "content", file: str = "path") -> DataFrame:
    """(path, stream, line_no, ts, line) of docker's 8-byte-header frames: lines are put together per stream, an RFC 3339
    prefix becomes ts, else the time of the line before."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, data in zip(pdf.f, pdf.c, strict=True):
                part: dict[int, bytes] = {}
                last: dict[int, str | None] = {}
                n, at = 0, 0
                while at + 8 <= len(data):
                    kind, size = data[at], int.from_bytes(data[at + 4 : at + 8], "big")
                    part[kind] = part.get(kind, b"") + bytes(data[at + 8 : at + 8 + size])
                    at += 8 + size
                    *lines, part[kind] = part[kind].split(b"\n")
                    for raw in lines:
                        n += 1
                        rows.append((path, kind, n, *_stamp(raw, last, kind)))
                for kind, raw in part.items():
                    if raw:
                        n += 1
                        rows.append((path, kind, n, *_stamp(raw, last, kind)))
            yield pd.DataFrame(rows, columns=["path", "stream", "line_no", "ts", "line"])

    return frames.select(F.col(file).alias("f"), F.col(content).alias("c")).mapInPandas(run, "path string, stream int, line_no bigint, ts string, line string")


_STAMP = re.compile(r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)) ")


def _stamp(raw: bytes, last: dict[int, str | None], kind: int) -> tuple[str | None, str]:
    text = raw.decode(errors="replace").rstrip("\r")
    m = _STAMP.match(text)
    if m:
        last[kind] = m[1]
        text = text[m.end() :]
    return last.get(kind), text


def info_fields(df: DataFrame, text: str = "info") -> DataFrame:
    """df with `fields`: key:value lines (as of a cache server's INFO) as a map; comments and blank lines are skipped."""
    lines = F.filter(F.split(F.regexp_replace(text, "\r", ""), "\n"), lambda x: (x != "") & ~x.startswith("#") & (F.instr(x, ":") > 0))
    return df.withColumn("fields", F.map_from_entries(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([^:]*):", 1), F.regexp_replace(x, "^[^:]*:", "")))))
